"""Queries of the recipe of sixty corrupted scenarios, of stored scenarios and of contamination by area, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmend.functions.rng import below
from fieldmend.operators import corruption
from fieldmend.operators.knn import nearest_lists
from fieldmend.plans import fields
from fieldmend.plans.graph_queries import edges_sql, u_sql
from fieldmend.plans.registry import query
from fieldmend.session import cut, scratch
from fieldmend.sources import points as stored

SEED = 1040000
CLASSES = [1, 2, 3]
UNIT = "({a} - lo{a}) / greatest(hi{a} - lo{a}, 2.220446049250313e-16)"
RECIPE = f"""WITH {edges_sql(fields.ORD, 2, 6)},
adj AS (SELECT e.sample, src AS id, arg_min(b.code, rank) AS near FROM e JOIN pts a ON a.sample = e.sample AND a.id = src JOIN pts b ON b.sample = e.sample AND b.id = dst WHERE a.code <> b.code GROUP BY ALL),
f AS (SELECT pts.sample, pts.id, x, y, code AS truth, near IS NOT NULL AS edge, coalesce(near, code % 3 + 1) AS near FROM pts LEFT JOIN adj USING (sample, id)),
box AS (SELECT count(*) AS n, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy FROM f),
sc AS (SELECT f.*, n, {UNIT.format(a="x")} AS ux, {UNIT.format(a="y")} AS uy FROM f, box),
design AS (SELECT *, CAST(row_number() OVER (ORDER BY noise, m, rep) AS INTEGER) AS scenario FROM (VALUES (0.05::DOUBLE), (0.10), (0.15), (0.25), (0.40)) a(noise),
  (VALUES (1, 'random'), (2, 'boundary'), (3, 'patch'), (4, 'region')) b(m, mechanism), (VALUES (1), (2), (3)) c(rep)),
pool AS (SELECT row_number() OVER (ORDER BY {u_sql(SEED, 'centre', 'id')}, id) - 1 AS place, ux AS cx, uy AS cy, near AS target FROM sc QUALIFY place < 960),
cen AS (SELECT scenario, j, cx, cy, target FROM design, range(16) r(j), pool WHERE place = ((scenario - 1) * 16 + j) % (SELECT count(*) FROM pool) AND (mechanism = 'patch' OR (mechanism = 'region' AND j = 0))),
own AS (SELECT scenario, sample, id, min(d2) AS d2, arg_min(target, (d2, j)) AS target FROM (SELECT scenario, sample, id, j, target, (ux - cx) * (ux - cx) + (uy - cy) * (uy - cy) AS d2 FROM sc, cen) GROUP BY ALL),
ev AS (SELECT d.scenario, d.mechanism, sc.sample, sc.id, truth, near, edge, target, least(n - 1, CAST(round_even(noise * n, 0) AS BIGINT)) AS want, {u_sql(SEED, 'order', "d.scenario || ':' || sc.id")} AS u, own.d2
  FROM sc CROSS JOIN design d LEFT JOIN own ON own.scenario = d.scenario AND own.sample = sc.sample AND own.id = sc.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY CASE mechanism WHEN 'random' THEN u WHEN 'boundary' THEN CASE WHEN edge THEN u ELSE 1 + u END ELSE d2 END, id) AS rk,
  row_number() OVER (PARTITION BY scenario, sample, truth ORDER BY edge, id) = 1 AS anchor FROM ev),
g AS (SELECT *, rk <= want AS first, count(*) FILTER (rk <= want) OVER w AS n_in, count(*) OVER w AS n_all FROM rk WINDOW w AS (PARTITION BY scenario, sample, truth)),
h AS (SELECT *, anchor AND first AND n_in = n_all AS back, NOT first AND row_number() OVER (PARTITION BY scenario, sample, truth, first ORDER BY rk) <= n_all - n_in - 1 AS spare FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY scenario, spare ORDER BY rk) AS k, count(*) FILTER (back) OVER (PARTITION BY scenario) AS backs FROM h),
done AS (SELECT scenario, sample, id, truth, CAST(CASE WHEN NOT ((first AND NOT back) OR (spare AND k <= backs)) THEN truth
    WHEN mechanism = 'random' THEN list_filter([1, 2, 3], lambda v: v <> truth)[CAST(least(floor({u_sql(SEED, 'other', "scenario || ':' || id")} * 2), 1) AS INTEGER) + 1]
    WHEN mechanism = 'boundary' OR target = truth THEN near ELSE target END AS INTEGER) AS label FROM t)"""


def field(spark, d):
    """Orders with truth, boundary (one of six neighbours is of another class) and adjacent (the nearest of these, or the next class)."""
    points = fields.orders(spark, d)
    lists = nearest_lists(points, 2, 6, carry="code", lists=("vote",))
    other = F.filter("vote", lambda v: v != F.col("own"))
    near = lists.select("sample", "id", (F.size(other) > 0).alias("boundary"), F.coalesce(F.get(other, F.lit(0)), F.col("own") % 3 + 1).cast("int").alias("adjacent"))
    return cut(points.withColumnRenamed("code", "truth").join(near, ["sample", "id"]))


def scenarios(spark, d):
    return corruption.corrupt_scenarios(field(spark, d), corruption.scenario_design(spark), CLASSES, 2, SEED)


@query("q_scenarios", f"{RECIPE} SELECT scenario, sample, id, truth, label FROM done WHERE label <> truth")
def q_scenarios(spark, d):
    """Every label that changes in each of the sixty scenarios of the recipe."""
    return scenarios(spark, d).where("label <> truth")


@query("q_scenario_summary", f"{RECIPE} SELECT scenario, sample, truth, count(*) AS n, count(*) FILTER (label <> truth) AS changed FROM done GROUP BY ALL")
def q_scenario_summary(spark, d):
    """How many labels of each class of each specimen change in each scenario; one at least never does."""
    return scenarios(spark, d).groupBy("scenario", "sample", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("truth")).alias("changed"))


@query("q_scenario_store", f"SELECT sample, id, x, y, code AS truth, CAST(CASE WHEN {u_sql(6, 's17', 'id')} < 0.2 THEN code % 3 + 1 ELSE code END AS INTEGER) AS label FROM ({fields.ORD})")
def q_scenario_store(spark, d):
    """A wide matrix of 45 scenarios, written as one folder per scenario; scenario 17 read back by its name."""
    points = fields.orders(spark, d)
    shifted = [F.when(below(6, f"s{k}", 0.2, "id"), F.col("code") % 3 + 1).otherwise(F.col("code")).cast("int").alias(f"s{k}") for k in range(1, 46)]
    design = spark.createDataFrame([(k, f"orders_{k:02d}") for k in range(1, 46)], "scenario int, scenario_id string")
    place = scratch(spark, "fields")
    stored.store_benchmark(place, "orders", points.withColumnRenamed("code", "truth"), design, points.select("sample", "id", *shifted))
    return stored.load_benchmark(spark, place, "orders", "orders_17").select("sample", "id", "x", "y", "truth", "label")


SHARE, MINORITY = 0.05, {"1": 2, "2": 3, "3": 1}


@query(
    "q_contaminate",
    f"""WITH p AS (SELECT sample, id, code, row_number() OVER (PARTITION BY sample, code ORDER BY {u_sql(9, 'minority', 'id')}, id) AS k, count(*) OVER (PARTITION BY sample, code) AS n FROM ({fields.ORD}))
SELECT sample, id, code AS area, CAST(CASE WHEN k <= round_even({SHARE} * n, 0) THEN code % 3 + 1 ELSE code END AS INTEGER) AS label FROM p""",
)
def q_contaminate(spark, d):
    """A twentieth of each area of each specimen takes the area's minority class."""
    points = fields.orders(spark, d).withColumn("area", F.col("code")).withColumnRenamed("code", "truth")
    return corruption.contaminate(points, SHARE, MINORITY, "area", 9).select("sample", "id", "area", F.col("label").cast("int").alias("label"))
