"""The iterated vote over leaves and tiles, against a plain version, and level lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmend.operators import graph, knn, levels, tiles

SCHEMA = "sample string, id long, x double, y double, code int"


def plain_vote(rows, k, s, classes):
    """Refined codes, confidence and changes of each sweep; rows are of one specimen."""
    s = s.checked(classes)
    near, w = {}, {}
    for _, i, x, y, _ in rows:
        found = sorted(((x - v) ** 2 + (y - u) ** 2, j) for _, j, v, u, _ in rows if j != i)[:k]
        band = max([d for d, _ in found] + [1e-12])
        near[i], w[i] = [j for _, j in found], [float(np.exp(-d / band)) if s.weighted else 1.0 for d, _ in found]
    state, changes, sure = {r[1]: r[4] for r in rows}, [], {}
    for _ in range(s.iterations):
        new = {}
        for i, current in state.items():
            votes = {}
            for j, v in zip(near[i], w[i], strict=True):
                votes[state[j]] = votes.get(state[j], 0.0) + v
            weight, held = sum(votes.values()), votes.get(current, 0.0)
            ranked = sorted((-v, c) for c, v in votes.items() if c != current) + [(0.0, None)] * 2
            own, first, second = held + s.preserve * weight, -ranked[0][0], -ranked[1][0]
            total = weight * (1 + s.preserve)
            top, runner = (first, max(own, second)) if first > own else (own, first)
            sure[i] = top / total if total else 1.0
            take = first > own and held / weight <= s.current_support and sure[i] >= s.consensus and (top - runner) / total >= s.margin
            new[i] = ranked[0][1] if take else current
        changes.append(sum(new[i] != state[i] for i in state))
        state = new
        if not changes[-1]:
            break
    return state, sure, changes


def field(n, classes, seed, samples=1):
    rng = np.random.default_rng(seed)
    return [(f"s{i % samples}", i, *map(float, p), int((p[0] * classes + rng.random() * 1.2) % classes) + 1) for i, p in enumerate(rng.random((n, 2)))]


@pytest.mark.parametrize("leaf", [1024, 20])
@pytest.mark.parametrize("settings", [graph.VoteSettings(), graph.KNN_VOTE, graph.POTTS_LIKE, graph.VoteSettings(4, 0.5, 0.1, 0.05, True, 1.0)])
def test_vote_in_leaves(spark, monkeypatch, leaf, settings):
    """With leaves of a few points most labels travel."""
    monkeypatch.setattr(knn, "LEAF", leaf)
    rows = field(420, 4, 11, samples=2)
    done, changes = graph.refine(spark.createDataFrame(rows, SCHEMA), 2, 4, settings, 5)
    got = {r.id: (r.refined, r.confidence) for r in done.collect()}
    total = []
    for s in ("s0", "s1"):
        state, sure, each = plain_vote([r for r in rows if r[0] == s], 5, settings, 4)
        total.append(each)
        assert all(got[i] == (state[i], pytest.approx(sure[i])) for i in state)
    length = max(map(len, total))
    assert changes == [sum(t[k] if k < len(t) else 0 for t in total) for k in range(length)] and sum(changes) > 0


def test_lists_stay_in_their_leaf(spark, monkeypatch):
    """A sweep's plan shuffles labels alone: the lists come from the executors' store, with no exchange above them."""
    monkeypatch.setattr(knn, "LEAF", 20)
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), _cut(df))[1])
    from fieldmend.session import cut as _cut

    graph.refine(spark.createDataFrame(field(300, 3, 2), SCHEMA), 2, 3, graph.VoteSettings(1), 5)
    plan = next(p for p in seen if "FlatMapCoGroupsInArrow" in p and "InMemoryTableScan" in p)
    assert "InMemoryTableScan" in plan and plan.index("InMemoryTableScan") < plan.index("Exchange hashpartitioning(o_sample")
    assert "Exchange" not in plan[plan.index("FlatMapCoGroupsInArrow") : plan.index("InMemoryTableScan")]


def test_what_leaves_ask_for_is_worked_out_once(spark, monkeypatch):
    """Which leaves a label goes to is no part of a sweep's plan, which would work it out twice."""
    monkeypatch.setattr(knn, "LEAF", 20)
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), _cut(df))[1])
    from fieldmend.session import cut as _cut

    graph.refine(spark.createDataFrame(field(300, 3, 2), SCHEMA), 2, 3, graph.VoteSettings(1), 5)
    assert "FlatMapCoGroupsInArrow" in seen[-1] and "FlatMapGroupsInArrow" not in seen[-1] and "Join" not in seen[-1]


def test_lists_are_stored_without_distances(spark, monkeypatch):
    """Neither the search's checkpoint nor the vote's has the neighbours' distances; one of the vote's has the lists."""
    from fieldmend.session import cut as _cut

    monkeypatch.setattr(knn, "LEAF", 20)
    searched, voted = [], []
    monkeypatch.setattr(knn, "cut", lambda df: (searched.append(df.columns), _cut(df))[1])
    monkeypatch.setattr(graph, "cut", lambda df: (voted.append(df.columns), _cut(df))[1])
    graph.refine(spark.createDataFrame(field(300, 3, 2), SCHEMA), 2, 3, graph.VoteSettings(2), 5)
    assert any("dst" in c for c in searched) and not any("d2" in c for c in searched)
    assert sum("dst" in c for c in voted) == 1 and not any("d2" in c for c in voted)


def test_piles_vote(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 20)
    rng = np.random.default_rng(4)
    rows = [("s0", i, *(map(float, rng.random(2)) if i % 3 else (0.5, 0.5)), int(rng.integers(1, 4))) for i in range(900)]
    settings = graph.VoteSettings(2, 0.5, 0.0, 0.0, False, 1.0)
    got = {r.id: r.refined for r in graph.refine(spark.createDataFrame(rows, SCHEMA), 2, 3, settings, 4)[0].collect()}
    assert got == plain_vote(rows, 4, settings, 3)[0]


def test_vote_in_tiles(spark):
    """Each tile with its halo ends as it would alone; its neighbours suit the whole specimen."""
    rows = field(700, 3, 5, samples=2)
    points = spark.createDataFrame(rows, SCHEMA)
    settings = graph.VoteSettings(6, 0.5, 0.0, 0.0, False, 1.0)
    dealt = tiles.tiles(points, tiles.layout(points, 2, counts=[2, 2]), 2).collect()
    done, per = tiles.vote_in_tiles(points, 2, 3, settings, counts=[2, 2])
    got, per = {r.id: (r.tile, r.refined) for r in done.collect()}, {(r["sample"], r.tile): r for r in per.collect()}
    assert len(got) == len(rows) and len(per) == 8
    for (s, tile), row in per.items():
        members = {r.id: r.is_core for r in dealt if (r["sample"], r.tile) == (s, tile)}
        k = min(knn.automatic_k(sum(r[0] == s for r in rows), 3, half_even=True), len(members) - 1)
        state, _, _ = plain_vote([r for r in rows if r[1] in members], k, settings, 3)
        core = [i for i, own in members.items() if own]
        assert all(got[i] == (tile, state[i]) for i in core)
        code = {r[1]: r[4] for r in rows}
        assert (row.core_n, row.halo_n, row.neighbors, row.final_changes) == (len(core), len(members), k, sum(state[i] != code[i] for i in core))


def test_level_lists(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("x", 4)], "l string, n int")
    b = spark.createDataFrame([("z", 1.0), ("y", 2.0)], "l string, v double")
    la, lb = levels.levels(a, "l"), levels.levels(b, "l")
    assert [tuple(r) for r in la.orderBy("code").collect()] == [("x", 1), ("y", 2)]
    both = levels.merged(la, lb)
    assert {tuple(r) for r in both.collect()} == {("x", 1), ("y", 2), ("z", 3)}
    assert {(r.n, r.code) for r in levels.recoded(a, "l", both).collect()} == {(1, 1), (2, 2), (3, None), (4, 1)}
    assert {tuple(r) for r in levels.counted(a, {"l": both}).collect()} == {("x", 2), ("y", 1), ("z", 0)}
    assert {tuple(r) for r in levels.union_filled(a, b).collect()} == {("x", 1, None), ("y", 2, None), (None, 3, None), ("x", 4, None), ("z", None, 1.0), ("y", None, 2.0)}
    assert {r.level for r in levels.only_in(la, lb).collect()} == {"x"}
    assert levels.counted(a.limit(0), {"l": la, "n": levels.levels(a.where(F.lit(False)), "n")}, "rows").count() == 0
