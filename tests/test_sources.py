"""Point tables: reading, writing, validation and stored benchmark fields."""

import pytest
from pyspark.sql import functions as F

from fieldmend.operators import statistics, tiles
from fieldmend.sources import points

ROWS = [("a", i, float(i % 7), float(i), "left" if i < 10 else "right", "left" if i < 12 else "right", i / 20) for i in range(20)]
SCHEMA = "sample string, id long, x double, y double, truth string, label string, boundary_proximity double"


def test_text_sink_cuts_blanks(spark, tmp_path):
    points.write_table(spark.createDataFrame([("a  ",), (" b",), ("",)], "line string"), f"{tmp_path}/p.txt")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/p.txt").collect()) == ["", " b", "a"]


@pytest.mark.parametrize("kind", ["csv", "parquet", "json", "orc"])
def test_written_tables_are_read_back(spark, tmp_path, kind):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    points.write_table(frame, f"{tmp_path}/p.{kind}")
    back = points.read_table(spark, f"{tmp_path}/p.{kind}", None if kind == "parquet" else SCHEMA)
    assert sorted(map(tuple, back.select(*frame.columns).collect())) == sorted(ROWS)


def test_benchmark_takes_aliases_and_derives_the_boundary(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).drop("sample").withColumn("area", F.lit("u")).withColumn("sparse_layer", F.lit(True))
    field = points.SpatialBenchmark.of(frame, 2)
    assert {"sample", "region", "sparse", "boundary"} <= set(field.frame.columns)
    assert field.frame.where("boundary").count() == 4 and field.frame.where("sample = 'sample1'").count() == 20
    with pytest.raises(ValueError):
        points.SpatialBenchmark.of(frame.withColumn("boundary", F.lit("yes")), 2)


def test_a_tile_of_two_points_goes_without_its_halo(spark):
    rows = [("a", i, x, 0.0, 1) for i, x in enumerate([0.0, 0.96, 1.05, 1.5, 1.6, 2.0])]
    seen = []

    def refine(frame):
        seen.extend(r["sample"] for r in frame.collect())
        return frame.withColumn("refined", F.col("code"))

    done = tiles.in_tiles(spark.createDataFrame(rows, "sample string, id long, x double, y double, code int"), 2, refine, 0.01, counts=[2, 1])
    assert sorted(r.id for r in done.collect()) == list(range(6))
    assert sorted(seen) == ["a#1"] * 2 + ["a#2"] * 4


def test_tiles_are_dealt_once(spark):
    """What refine reads is worked out: no pass over it deals points to tiles again or joins them back to their rows."""
    rows = [("a", i, float(i % 8), float(i // 8), 1 + i % 3, float(i)) for i in range(64)] + [("a", None, 1.5, 1.5, 1, -1.0)]
    seen = []

    def refine(frame):
        seen.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return frame.withColumn("refined", F.col("code"))

    done = tiles.in_tiles(spark.createDataFrame(rows, "sample string, id long, x double, y double, code int, cx double"), 2, refine, counts=[3, 2])
    assert sorted((r.id, r.code, r.cx) for r in done.collect()) == [(i, 1 + i % 3, float(i)) for i in range(64)]
    assert "Generate" not in seen[0] and "Join" not in seen[0]


def test_distinct_choices_and_ratios(spark):
    rows = spark.createDataFrame([(1, 9.0, 9.0), (2, 9.0, 8.0), (3, None, 1.0)], "id int, p double, q double")
    assert [r.id for r in statistics.choose_distinct(rows, ["p", "q"]).orderBy("place").collect()] == [1, 2]
    assert [r.id for r in statistics.choose_distinct(rows.limit(1), ["p", "q"]).collect()] == [1]
    scores = spark.createDataFrame([(1, "base", 4.0), (2, "base", 8.0), (1, "new", 2.0), (2, "new", 2.0), (3, "new", 5.0)], "id int, method string, value double")
    got = statistics.speedups(scores, "id", "base").where("method = 'new'").first()
    assert (got.n, got.paired, got.mean_difference, got.mean_ratio, got.median_ratio) == (3, 2, -4.0, 3.0, 3.0)
