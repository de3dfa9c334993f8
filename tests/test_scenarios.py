"""Ranks and choices within groups, the recipe of sixty scenarios, stored scenarios, resamples and evaluation in one pass."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmend.functions.rng import below, uniform
from fieldmend.operators import corruption, metrics, sampling
from fieldmend.sources import points as stored


def skewed(spark, n=3000, seed=1):
    """One group holds nine tenths of the rows, keys repeat."""
    rng = np.random.default_rng(seed)
    rows = [("big" if k % 10 else f"s{k % 70}", int(k), float(np.round(rng.random(), 2))) for k in range(n)]
    return spark.createDataFrame(rows, "g string, id long, v double").repartition(5)


def test_ranks_within_groups(spark):
    df = skewed(spark)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).select("id", "rank")
    got = sampling.ranked(df, F.col("v"), F.col("id"), by=["g"]).select("id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r.rank for r in sampling.ranked(df, F.desc("v"), F.col("id")).collect()) == list(range(1, 3001))
    assert sampling.ranked(df.limit(0), F.col("v"), by=["g"]).count() == 0


@pytest.mark.parametrize("count", ["7", "bround(0.4 * fm_n)", "fm_n", "0", "100000"])
def test_first_of_groups(spark, count):
    df = skewed(spark)
    place = F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))
    want = df.withColumns({"fm_n": F.count("*").over(Window.partitionBy("g")), "place": place}).select("id", (F.col("place") <= F.expr(count)).alias("first"))
    got = sampling.first_of_groups(df, ["g"], F.col("v"), F.expr(count)).select("id", "first")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_task_holds_a_class(spark):
    """The rows that are sorted are those below a threshold, and no window is partitioned by the group alone."""
    plan = sampling.first_of_groups(skewed(spark), ["g"], F.col("v"), F.lit(3))._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(g" not in plan


def field(spark, n=400, classes=4):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 2}", k, *map(float, rng.random(2)), 1 + (0 if k < n - 2 * classes else k % classes), bool(rng.random() < 0.3)) for k in range(n)]
    return spark.createDataFrame(rows, "sample string, id long, x double, y double, truth int, boundary boolean").withColumn("adjacent", F.col("truth") % classes + 1)


def test_many_scenarios_equal_one_by_one(spark):
    points = field(spark)
    counts = {1: 5, 2: 200, 3: 384, 4: 388}
    design = spark.createDataFrame(list(counts.items()), "scenario int, want int")
    draw = lambda s: F.xxhash64(s, "id")
    many = corruption.select_preserving(points.crossJoin(design), F.col("want"), [draw("scenario"), F.col("id")], "y", F.col("id") % 50 != 0, by=["scenario"])
    for scenario, want in counts.items():
        one = corruption.select_preserving(points, want, [draw(F.lit(scenario)), F.col("id")], "y", F.col("id") % 50 != 0)
        got = {(r.id, r.anchor, r.selected) for r in many.where(F.col("scenario") == scenario).collect()}
        assert got == {(r.id, r.anchor, r.selected) for r in one.collect()} and sum(s for _, _, s in got) == want
        kept = many.where(f"scenario = {scenario} and not selected").select("sample", "truth").distinct().count()
        assert kept == points.select("sample", "truth").distinct().count()
    with pytest.raises(ValueError, match="keep one point"):
        corruption.select_preserving(points.crossJoin(design.where("scenario > 2").withColumn("want", F.col("want") + 10)), F.col("want"), [draw("scenario")], by=["scenario"])


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_sixty_scenarios(spark):
    points, design = field(spark), corruption.scenario_design(spark)
    assert design.count() == 60 and design.select("scenario_id").distinct().count() == 60
    everything, many = jobs(spark, "sixty", lambda: corruption.corrupt_scenarios(points, design, [1, 2, 3, 4], 2).collect())
    some, few = jobs(spark, "four", lambda: corruption.corrupt_scenarios(points, design.where("scenario <= 4"), [1, 2, 3, 4], 2).collect())
    # Adaptive execution runs stages as jobs, whose number differs by a few with the sizes.
    assert many <= few + 6 and len(everything) == 60 * 400 and len(some) == 4 * 400
    for r in design.collect():
        own = [x for x in everything if x.scenario == r.scenario]
        assert sum(x.label != x.truth for x in own) == min(399, round(r.noise * 400))
        assert len({(x.sample, x.truth) for x in own if x.label == x.truth}) == len({(x.sample, x.truth) for x in own})
        assert all(1 <= x.label <= 4 for x in own)
    boundary = {r.id for r in points.where("boundary").collect()}
    first = [x.id for x in everything if x.scenario == 4 and x.label != x.truth]
    assert design.where("scenario = 4").first().mechanism == "boundary" and set(first) <= boundary


def test_stored_scenarios_are_read_alone(spark, tmp_path):
    points = field(spark)
    design = spark.createDataFrame([(k, f"s{k}") for k in (1, 2, 3)], "scenario int, scenario_id string")
    wide = points.select("sample", "id", F.col("truth").alias("s1"), F.lit(1).alias("s2"), F.when(F.col("id") % 9 == 0, 2).otherwise(F.col("truth")).alias("s3"))
    stored.store_benchmark(str(tmp_path), "crc", points, design, wide)
    third = stored.load_benchmark(spark, str(tmp_path), "colorectal", "s3")
    plan = third._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan and "(scenario" in plan
    assert {(r.id, r.label) for r in third.collect()} == {(r.id, r.s3) for r in wide.collect()}
    assert stored.load_benchmark(spark, str(tmp_path), "crc", 1).where("label <> truth").count() == 0
    long = points.select(F.lit(1).alias("scenario"), "sample", "id", F.col("truth").alias("label"))
    stored.store_benchmark(str(tmp_path), "crc", points, design, long)
    assert stored.load_benchmark(spark, str(tmp_path), "crc").count() == 400
    stored.store_benchmark(str(tmp_path), "crc", points, design, wide)
    for name, scenario in (("nowhere", 1), ("crc", 9), ("crc", "s9"), ("crc", 2)):
        with pytest.raises(ValueError):
            stored.load_benchmark(spark, str(tmp_path), name, scenario)


def test_wide_scenarios_are_worked_out_once(spark, tmp_path):
    """Each label of a wide matrix is worked out once and neither dealt nor sorted; the session's setting is as before."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def label(code):
        seen.add(1)
        return code

    points, key = field(spark), "spark.sql.maxConcurrentOutputFileWriters"
    design, before = spark.createDataFrame([(k, f"s{k}") for k in (1, 2, 12)], "scenario int, scenario_id string"), spark.conf.get(key)
    wide = points.select("sample", "id", *(label("truth").alias(f"s{k}") for k in (1, 2, 12)))
    stored.store_benchmark(str(tmp_path), "crc", points, design, wide)
    assert seen.value == 3 * 400 and spark.conf.get(key) == before
    assert stored.load_benchmark(spark, str(tmp_path), "crc", "s12").where("label = truth").count() == 400


@pytest.mark.parametrize("share", [0.0, 1e-300, 0.2, 0.5, 1 - 2**-52, 1 - 2**-53, 1.0, 2.0])
def test_draws_below_a_share(spark, share):
    assert spark.range(300).where(below(6, "s", share, "id") != (uniform(6, "s", "id") < share)).count() == 0


@pytest.mark.parametrize("strata", [None, ["g"]])
def test_resamples_of_large_tables_are_the_same(spark, monkeypatch, strata):
    df = skewed(spark, 120).select("g", F.concat(F.lit("k"), "id").alias("id"), "v")
    near = {r.replicate: r.mean for r in sampling.bootstrap(df, "v", 30, 5, strata).collect()}
    monkeypatch.setattr(sampling, "SMALL_ROWS", 10)
    far = {r.replicate: r.mean for r in sampling.bootstrap(df, "v", 30, 5, strata).collect()}
    assert sorted(near) == sorted(far) == list(range(1, 31)) and all(near[k] == pytest.approx(far[k]) for k in near)
    assert np.std(list(near.values())) > 0


def plain_measures(rows):
    mean = lambda v: float(np.mean(v)) if len(v) else None
    right = [r["refined"] == r["truth"] for r in rows]
    sizes = {}
    for r in rows:
        sizes[r["region"]] = sizes.get(r["region"], 0) + 1
    most = min(sizes, key=lambda g: (-sizes[g], g))
    return {
        "accuracy": mean(right), "dense_region_accuracy": mean([x for x, r in zip(right, rows) if r["region"] == most]), "sparse_region_accuracy": mean([x for x, r in zip(right, rows) if r["sparse"]]),
        "boundary_accuracy": mean([x for x, r in zip(right, rows) if r["boundary"] is True]), "interior_accuracy": mean([x for x, r in zip(right, rows) if r["boundary"] is False]),
        "unresolved_fraction": mean([r["unresolved"] for r in rows]), "worst_recall": min(mean([x for x, r in zip(right, rows) if r["truth"] == t]) for t in {r["truth"] for r in rows}),
    }


def test_evaluation_reads_rows_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [dict(sample=f"s{k % 3}", truth=str(rng.integers(4)), initial=str(rng.integers(4)), refined=str(rng.integers(4)), region="abc"[rng.integers(3)], boundary=[True, False, None][rng.integers(3)], sparse=bool(rng.random() < 0.2), unresolved=bool(rng.random() < 0.1)) for k in range(300)]
    schema = "sample string, truth string, initial string, refined string, region string, boundary boolean, sparse boolean, unresolved boolean"
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).write.parquet(f"{tmp_path}/t")
    done = metrics.evaluate(spark.read.parquet(f"{tmp_path}/t"), ["sample"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(") <= 3 and "Join" not in plan
    got = {r["sample"]: r for r in done.collect()}
    for s in got:
        for name, value in plain_measures([r for r in rows if r["sample"] == s]).items():
            assert got[s][name] == (None if value is None else pytest.approx(value)), name
    one = metrics.evaluate(spark.createDataFrame([("a", "a", "b")], "truth string, initial string, refined string")).first()
    assert (one.n, one.accuracy, one.ari, one.boundary_accuracy, one.damage_rate, one.error_reduction) == (1, 0.0, 1.0, None, 1.0, None)


def test_scenarios_sort_only_rows_near_their_last_one(spark, monkeypatch):
    """Of all rows of all scenarios one in ten at most is put in order, and what is selected is as if all were."""
    points, design, sorted_ = field(spark, 1500), corruption.scenario_design(spark).where("scenario in (1, 27, 52, 58)"), []
    monkeypatch.setattr(corruption, "ranked", lambda df, *a, **k: (sorted_.append(df.count()), sampling.ranked(df, *a, **k))[1])
    done = corruption.corrupt_scenarios(points, design, [1, 2, 3, 4], 2, 5).collect()
    assert len(done) == 4 * 1500 and 0 < sum(sorted_) <= 600
    monkeypatch.setattr(corruption, "ranked", sampling.ranked)
    for scenario, mechanism, noise in ((1, "random", 0.05), (52, "boundary", 0.4)):
        assert design.where(f"scenario = {scenario} and mechanism = '{mechanism}' and noise = {noise}").count() == 1
        draw = corruption.uniform(5, "order", F.lit(scenario), "id")
        order = [draw if mechanism == "random" else F.when(F.col("boundary"), draw).otherwise(1 + draw), F.col("id")]
        want = corruption.select_preserving(points.withColumn("far", F.when(F.col("boundary"), 0.0).otherwise(1.0)), round(noise * 1500), order, "far").where("selected")
        assert {r.id for r in want.collect()} == {r.id for r in done if r.scenario == scenario and r.label != r.truth}
