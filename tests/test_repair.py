"""Repair and its steps on both sides of their size bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmend import session
from fieldmend.functions import geometry, quantiles
from fieldmend.operators.repair import repair, repair_labels

SCHEMA = "sample string, id long, x double, y double, code int"


@pytest.mark.parametrize(("largest", "accuracy"), [(None, 10_000), (None, 50), (10, 10_000)])
def test_percentiles(spark, largest, accuracy, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in range(3) for v in np.concatenate([rng.normal(size=400), np.full(300 * k, 0.25), [np.nan] * 5])] + [(9, 1.5), (8, float("nan"))] + [(7, float(k)) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], {"q": F.col("v"), "w": -F.col("v")}, [0.01, 0.5, 1.0], largest).collect()}
    for k in (0, 1, 2, 7, 9):
        v = np.array([x for i, x in rows if i == k and x == x])
        assert got[k].q == pytest.approx(np.quantile(v, [0.01, 0.5, 1.0])) and got[k].w == pytest.approx(np.quantile(-v, [0.01, 0.5, 1.0]))


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_code_equals_the_transform(spark, dims):
    rng = np.random.default_rng(2)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 1 << 16, (300, dims))] + [(0,) * dims, ((1 << 16) - 1,) * dims]
    names = [f"a{k}" for k in range(dims)]
    got = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).select(*names, geometry.hilbert_code([F.col(n) for n in names]).alias("h")).collect()
    for r in got:
        x = [r[n] for n in names]
        for b in range(15, 0, -1):
            for k in range(dims):
                if x[k] >> b & 1:
                    x[0] ^= (1 << b) - 1
                else:
                    t = (x[0] ^ x[k]) & ((1 << b) - 1)
                    x[0], x[k] = x[0] ^ t, x[k] ^ t
        for k in range(1, dims):
            x[k] ^= x[k - 1]
        t = 0
        for b in range(15, 0, -1):
            if x[-1] >> b & 1:
                t ^= (1 << b) - 1
        want = 0
        for b in range(15, -1, -1):
            for k in range(dims):
                want = want << 1 | ((x[k] ^ t) >> b & 1)
        assert r.h == want
    # Neighbours on the curve are neighbours in space, and each cell comes once.
    side = 8
    cells = [(i, j) + ((k,) if dims == 3 else ()) for i in range(side) for j in range(side) for k in range(side if dims == 3 else 1)]
    frame = spark.createDataFrame(cells, ", ".join(f"{n} long" for n in names)).select(*names, geometry.hilbert_code([F.col(n) for n in names]).alias("h"))
    path = [[r[n] for n in names] for r in frame.orderBy("h").collect()]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_bounds_do_not_change_a_repair(spark, monkeypatch):
    """Runs of few rows, joins in place of broadcasts and picked percentiles; a pile, a clump and a specimen that stays."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.random((220, 2)), np.full((80, 2), 0.4), rng.random((60, 2)) * 1e-4 + 0.7])
    rows = [("a", i, float(x), float(y), int(3 * x + 0.3 * rng.random()) % 3 + 1) for i, (x, y) in enumerate(xy)] + [("b", i, float(i), 0.0, 1) for i in range(9)]
    rows += [("c", i, *map(float, p), int(p[0] > 0.5) + 1) for i, p in enumerate(rng.random((90, 2)))]
    points = spark.createDataFrame(rows, SCHEMA)
    plain = {(r["sample"], r["id"]): r for r in repair(points, 2, 3).collect()}
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    monkeypatch.setattr(quantiles, "EXACT_ROWS", 0)
    other = {(r["sample"], r["id"]): r for r in repair(points, 2, 3, run_rows=40).collect()}
    assert plain.keys() == other.keys() and len(plain) == len(rows)
    for key, r in plain.items():
        assert (r["code"], r["refined"], r["candidate"], r["changed"]) == tuple(other[key][c] for c in ("code", "refined", "candidate", "changed"))
        assert [r[c] for c in ("margin_score", "required", "isolation")] == pytest.approx([other[key][c] for c in ("margin_score", "required", "isolation")], abs=1e-6)
    assert any(r["changed"] for r in plain.values())


def test_public_repair_takes_no_controls(spark):
    """A tuning control is refused by its name before anything is read."""
    points = spark.createDataFrame([("a", 1, 0.0, 0.0, "u")], "sample string, id long, x double, y double, label string")
    for name in ("run_rows", "neighbors", "iterations", "control"):
        with pytest.raises(ValueError, match=name):
            repair_labels(points, 2, **{name: 3})
