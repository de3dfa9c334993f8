"""Exact neighbours and repair against small brute-force versions."""

from functools import reduce as knn_reduce

import numpy as np
import pytest

from pyspark.sql import functions as F

from fieldmend import session
from fieldmend.operators import knn
from fieldmend.operators.graph import modal, refine
from fieldmend.operators.knn import nearest
from fieldmend.operators.repair import repair

SCHEMA = "sample string, id long, x double, y double, code int"


def brute(rows, k):
    out = set()
    for s, i, x, y, _ in rows:
        near = sorted(((x - v) ** 2 + (y - w) ** 2, j) for t, j, v, w, _ in rows if t == s and j != i)[:k]
        out |= {(s, i, j, rank) for rank, (_, j) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("leaf", [1024, 24])
@pytest.mark.parametrize("kind", ["spread", "piles", "line", "clumps"])
def test_nearest(spark, kind, leaf, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", leaf)
    rng = np.random.default_rng(3)
    clumps = np.concatenate([rng.random((250, 2)) * 1e-3, rng.random((250, 2)) + 50, [[1e6, 3.0], [1e6, 3.0], [-1e5, 7e6]]])
    xy = {"spread": rng.random((900, 2)), "piles": np.round(rng.random((600, 2)) * [6, 2]), "line": np.c_[rng.random(500) ** 6, np.zeros(500)], "clumps": clumps}[kind]
    rows = [("a" if i % 3 else "b", i, float(x), float(y), 1) for i, (x, y) in enumerate(xy)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), 2, 5).collect()
    assert {(r["sample"], r["src"], r["dst"], r["rank"]) for r in got} == brute(rows, 5)


def test_nearest_3d_and_many_specimens(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 30)
    monkeypatch.setattr(session, "SMALL_ROWS", 3)  # joins in place of broadcasts
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 5}", i, *map(float, p), i % 7) for i, p in enumerate(rng.random((900, 3)))]
    points = spark.createDataFrame(rows, "sample string, id long, x double, y double, z double, code int")
    got = nearest(points, 3, 4, carry="code").collect()
    want = set()
    for s, i, *p, _ in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j, c) for t, j, *q, c in rows if t == s and j != i)[:4]
        want |= {(s, i, j, rank, c) for rank, (_, j, c) in enumerate(near, 1)}
    assert {(r["sample"], r["src"], r["dst"], r["rank"], r["vote"]) for r in got} == want


def test_nearest_of_few_points(spark):
    rows = [("one", 1, 0.0, 0.0, 1), ("two", 1, 0.0, 0.0, 1), ("two", 2, 1.0, 0.0, 2)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), 2, 5).collect()
    assert {(r["sample"], r["src"], r["dst"]) for r in got} == {("two", 1, 2), ("two", 2, 1)}
    assert nearest(spark.createDataFrame([], SCHEMA), 2, 5).collect() == []


def test_modal_filter_on_a_grid(spark):
    rows = [("g", i, float(i % 5), float(i // 5), 1 if i % 5 <= 2 else 2) for i in range(25)]
    points = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["refined"] for r in modal(points, nearest(points, 2, 8)).collect()}
    assert all(got[i] == code for _, i, x, _, code in rows if x in (0.0, 4.0))


def test_points_without_extent_stay(spark):
    rows = [("flat", i, 0.0, 0.0, i % 3 + 1) for i in range(30)]
    for r in repair(spark.createDataFrame(rows, SCHEMA), 2, 3).collect():
        assert r["refined"] == r["candidate"] == r["code"] and r["margin_score"] == r["required"] == 0


def test_specimens_do_not_touch_each_other(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(x + shift), float(y), int(x * 3 + 0.4 * rng.random()) % 3 + 1) for s, shift in (("p", 0), ("q", 20)) for i, (x, y) in enumerate(rng.random((120, 2)))]
    both = {(r["sample"], r["id"]): r["refined"] for r in repair(spark.createDataFrame(rows, SCHEMA), 2, 3).collect()}
    alone = {(r["sample"], r["id"]): r["refined"] for s in "pq" for r in repair(spark.createDataFrame([x for x in rows if x[0] == s], SCHEMA), 2, 3).collect()}
    assert both == alone


@pytest.mark.parametrize("classes", [2, 5, 9, 40])
def test_automatic_number_of_neighbours(spark, classes):
    """Each specimen has its own number, and one place may hold more points than that."""
    rng = np.random.default_rng(8)
    rows = [(s, i, *map(float, p), 1) for s, n in (("a", 2), ("b", 20), ("c", 700)) for i, p in enumerate(np.round(rng.random((n, 2)), 1))]
    got = nearest(spark.createDataFrame(rows, SCHEMA), 2, None, classes=classes).groupBy("sample", "src").count().collect()
    for s, n in (("a", 2), ("b", 20), ("c", 700)):
        assert [r["count"] for r in got if r["sample"] == s] == [min(n - 1, knn.automatic_k(n, classes))] * n


def test_refine_at_its_bounds(spark):
    """Two points raise, one class changes nothing, and no points give none."""
    points = spark.createDataFrame([("a", i, float(i), 0.0, 1) for i in range(2)], SCHEMA)
    with pytest.raises(ValueError, match="three at least"):
        refine(points, 2, 2)
    done, changes = refine(points, 2, 1)
    assert changes == [] and all(r["refined"] == r["code"] and r["confidence"] == 1.0 for r in done.collect())
    assert refine(points.where("id < 0"), 2, 2)[0].count() == 0


@pytest.mark.parametrize("kind", ["spread", "clumps", "piles"])
def test_leaves_of_any_depth(spark, kind, monkeypatch):
    """With four parts an axis and leaves of 24 points, thousands of points take several rounds of cuts."""
    monkeypatch.setattr(knn, "LEAF", 24)
    monkeypatch.setattr(knn, "PARTS", 4)
    rng = np.random.default_rng(7)
    n = 2600
    xy = {"spread": rng.random((n, 2)), "clumps": np.concatenate([rng.random((n - 400, 2)) ** 8, rng.random((400, 2)) * 1e4]), "piles": np.concatenate([rng.random((n - 300, 2)), np.full((300, 2), 0.25)])}[kind]
    rows = [("a" if i % 20 else "b", i, float(x), float(y), 1) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, SCHEMA)
    leaves = knn.Leaves(points.withColumn("vote", F.lit(0)), ("x", "y"), 2)
    sizes = [r["count"] for r in leaves.placed(points).groupBy(*leaves.keys).count().collect()]
    assert leaves.round >= 1 and len(leaves.levels) > 2
    assert max(sizes) <= (300 + 4 * leaves.leaf if kind == "piles" else 8 * leaves.leaf)
    a = {i: [q for q in range(len(xy)) if rows[q][0] == rows[i][0] and q != i] for i in range(0, n, 37)}
    got = {}
    for r in nearest(points, 2, 2).where("src % 37 = 0").collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i, others in a.items():
        d = ((xy[others] - xy[i]) ** 2)
        d = d[:, 0] + d[:, 1]
        want = [others[j] for j in np.lexsort((others, d))[:2]]
        assert [t for _, t in sorted(got[i])] == want


@pytest.mark.parametrize("kind", ["plane", "strip", "ties"])
def test_search_looks_around_each_point_only(kind, monkeypatch):
    """Few of all pairs are measured, and what is found is what all pairs give."""
    rng, seen = np.random.default_rng(2), []
    at = {"plane": rng.random((1000, 2)), "strip": rng.random((1000, 2)) * [1, 300], "ties": np.round(rng.random((1000, 2)) * [8, 60])}[kind]
    ids, k = np.sort(rng.choice(10_000, 1000, replace=False)), rng.integers(0, 8, 1000)
    monkeypatch.setattr(knn, "reduce", lambda f, v: (seen.append(v[0].size), knn_reduce(f, v))[1])
    r, c, v = knn.k_nearest(at, ids, at, ids, k)
    monkeypatch.undo()
    d2 = (at[:, None, 0] - at[None, :, 0]) ** 2 + (at[:, None, 1] - at[None, :, 1]) ** 2
    np.fill_diagonal(d2, np.inf)
    want = [(i, j) for i in range(1000) for j in np.lexsort((np.arange(1000), d2[i]))[: k[i]]]
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == want and np.array_equal(v, d2[r, c]) and sum(seen) < 400_000


def test_piles_are_dealt_in_leaves_of_a_fair_size(spark, monkeypatch):
    """Points beyond the first of their place share leaves with whole other places; a place larger than a leaf has several."""
    monkeypatch.setattr(knn, "LEAF", 20)
    rows = [("a", i, float(i % 100), float(i % 7), 1) for i in range(2100)] + [("a", 5000 + i, 3.5, 3.5, 2) for i in range(400)]
    lists = knn.nearest_lists(spark.createDataFrame(rows, SCHEMA), 2, 1, carry="code", lists=("dst",), leaf=True).collect()
    assert len(lists) == 2500 and all(len(r.dst) == 1 for r in lists)
    leaves = {}
    for r in lists:
        if r.leaf.startswith("pile"):
            leaves.setdefault(r.leaf, []).append(r.id)
    assert len(leaves) < 200 and max(map(len, leaves.values())) < 100 and {r.dst[0] for r in lists if r.id > 5001} == {5000}
