"""Queries of random draws, sampling, corruption and paired statistics, with SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldmend.operators import corruption, metrics, sampling, statistics
from fieldmend.operators.knn import nearest
from fieldmend.plans import fields
from fieldmend.plans.graph_queries import FACES, edges_sql, triple, TRIPLE, u_sql
from fieldmend.plans.registry import query, rounded, table

PI = repr(math.pi)
MASK = f"m AS ({fields.CELLS}), {FACES}"
CELL_ID = "(r - 1) + (c - 1) * 50 + 1"
COUNT = "least((SELECT count(*) FROM k) - 1, greatest(1, round_even(0.15 * (SELECT count(*) FROM k), 0)))"


def n_sql(seed: int, stream: str, id_: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u_sql(seed, stream + '.r', id_)})) * cos({2 * math.pi!r} * {u_sql(seed, stream + '.a', id_)}))"


CORRUPT = f"""WITH {MASK}, cls AS (SELECT list(DISTINCT value ORDER BY value) AS all_ FROM m WHERE value IS NOT NULL),
edge AS (SELECT r, c, bool_or(coalesce(there AND other <> value, false)) AS b FROM n GROUP BY ALL),
near AS (SELECT r, c, list(other ORDER BY t) AS near FROM (SELECT r, c, other, min(turn) AS t FROM n WHERE other IS NOT NULL AND other <> value GROUP BY ALL) GROUP BY ALL),
k AS (SELECT mask_id, r, c, {CELL_ID} AS id, value, b, coalesce(near, []) AS near, list_filter(all_, lambda v: v <> value) AS others FROM m JOIN edge USING (r, c) LEFT JOIN near USING (r, c), cls WHERE value IS NOT NULL)"""
OTHER = f"others[CAST(least(floor({u_sql(1, 'other', 'id')} * len(others)), len(others) - 1) AS INTEGER) + 1]"
NEAR = f"CASE WHEN len(near) > 0 THEN near[CAST(least(floor({u_sql(1, 'near', 'id')} * len(near)), len(near) - 1) AS INTEGER) + 1] ELSE {OTHER} END"
#: No class of this mask is small enough to be selected as a whole, so the first rows are the selection.
PICK = "SELECT m.mask_id, m.r, m.c, m.value, coalesce(CASE WHEN rk <= {count} THEN new END, m.value) AS corrupted FROM m LEFT JOIN s USING (r, c)"


@query("q_corrupt_impulse", f"{CORRUPT}, s AS (SELECT r, c, {OTHER} AS new, row_number() OVER (ORDER BY {u_sql(1, 'order', 'id')}, id) AS rk FROM k) {PICK.format(count=COUNT)}")
def q_corrupt_impulse(spark, d):
    return corruption.corrupt_mask(fields.mask(spark, d), "impulse")


@query("q_corrupt_boundary", f"{CORRUPT}, s AS (SELECT r, c, {NEAR} AS new, row_number() OVER (ORDER BY b DESC, {u_sql(1, 'order', 'id')}, id) AS rk FROM k) {PICK.format(count=COUNT)}")
def q_corrupt_boundary(spark, d):
    return corruption.corrupt_mask(fields.mask(spark, d), "boundary")


@query(
    "q_corrupt_patch",
    f"""{CORRUPT}, ctr AS (SELECT r AS cr, c AS cc, coalesce(near[1], (SELECT min(value) FROM m)) AS target FROM k ORDER BY {u_sql(1, 'order', 'id')}, id LIMIT 1),
s AS (SELECT r, c, target AS new, row_number() OVER (ORDER BY (r - cr) * (r - cr) + (c - cc) * (c - cc), {u_sql(1, 'order', 'id')}, id) AS rk FROM k, ctr WHERE value <> target) {PICK.format(count=COUNT)}""",
)
def q_corrupt_patch(spark, d):
    return corruption.corrupt_mask(fields.mask(spark, d), "patch")


@query("q_anchors", f"WITH p AS ({fields.ORD}) SELECT sample, code AS truth, id FROM p QUALIFY row_number() OVER (PARTITION BY sample, code ORDER BY y DESC, id) = 1")
def q_anchors(spark, d):
    points = fields.orders(spark, d).withColumnRenamed("code", "truth")
    return corruption.anchors(points, "y").where("anchor").select("sample", "truth", "id")


@query("q_anchor_check", f"WITH t AS ({TRIPLE}) SELECT sample, truth, bool_or(refined = truth) AS held FROM t GROUP BY ALL")
def q_anchor_check(spark, d):
    return corruption.check_anchors(triple(spark, d), "refined")


@query(
    "q_select_preserving",
    f"""WITH p AS (SELECT 'all' AS sample, c_custkey AS id, c_nationkey AS truth FROM customer), cut AS (SELECT count(*) - 2 * count(DISTINCT truth) AS m FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY id) = 1 AS anchor, row_number() OVER (ORDER BY {u_sql(5, 'order', 'id')}, id) AS rk FROM p),
g AS (SELECT a.*, rk <= m AS first, count(*) FILTER (rk <= m) OVER (PARTITION BY truth) AS n_in, count(*) OVER (PARTITION BY truth) AS n_all FROM a, cut),
h AS (SELECT *, anchor AND first AND n_in = n_all AS back, NOT first AND row_number() OVER (PARTITION BY truth, first ORDER BY rk) <= n_all - n_in - 1 AS spare FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY spare ORDER BY rk) AS k FROM h)
SELECT id, truth, anchor, (first AND NOT back) OR (spare AND k <= (SELECT count(*) FROM h WHERE back)) AS selected FROM t""",
)
def q_select_preserving(spark, d):
    """All rows but two a class, so that classes are selected as a whole and a choice exists at every size."""
    from fieldmend.functions.rng import uniform

    points = table(spark, d, "customer").select(F.lit("all").alias("sample"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("truth"))
    sums = points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("truth").alias("classes")).first()
    count = sums.n - 2 * sums.classes
    return corruption.select_preserving(points, count, [uniform(5, "order", "id"), F.col("id")]).select("id", "truth", "anchor", "selected")


def preserving_sql(order: str, count: str) -> str:
    """From p (sample, id, truth, prox) to done, with selected."""
    return f"""a AS (SELECT *, row_number() OVER (PARTITION BY sample, truth ORDER BY prox DESC, id) = 1 AS anchor, row_number() OVER (ORDER BY {order}) AS rk FROM p),
g AS (SELECT *, rk <= {count} AS first, count(*) FILTER (rk <= {count}) OVER (PARTITION BY sample, truth) AS n_in, count(*) OVER (PARTITION BY sample, truth) AS n_all FROM a),
h AS (SELECT *, anchor AND first AND n_in = n_all AS back, NOT first AND row_number() OVER (PARTITION BY sample, truth, first ORDER BY rk) <= n_all - n_in - 1 AS spare FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY spare ORDER BY rk) AS k FROM h),
done AS (SELECT *, (first AND NOT back) OR (spare AND k <= (SELECT count(*) FROM h WHERE back)) AS selected FROM t)"""


ANY = f"list_filter([1, 2, 3], lambda v: v <> truth)[CAST(least(floor({u_sql(7, 'other', 'id')} * 2), 1) AS INTEGER) + 1]"


def _field(mechanism: str, noise: float):
    draw, near = u_sql(7, "order", "id"), mechanism in ("patch", "region")
    points = f"f AS (SELECT sample, id, x, y, code AS truth, y AS prox FROM ({fields.ORD}))"
    if near:
        target = f"[1, 2, 3][CAST(least(floor({u_sql(7, 'target', 'centre')} * 3), 2) AS INTEGER) + 1]"
        points += f""", c AS (SELECT id AS centre, x AS cx, y AS cy FROM f ORDER BY {u_sql(7, 'centre', 'id')}, id LIMIT {16 if mechanism == "patch" else 1}),
o AS (SELECT f.*, centre, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM f, c QUALIFY row_number() OVER (PARTITION BY sample, id ORDER BY d2, centre) = 1), p AS (SELECT *, {target} AS target FROM o)"""
    else:
        points += ", p AS (SELECT * FROM f)"
    order = {"random": "", "boundary": "prox, "}.get(mechanism, "d2, ") + f"{draw}, id"
    new = f"CASE WHEN target <> truth THEN target ELSE {ANY} END" if near else ANY
    count = f"(SELECT CAST(floor({noise} * count(*) + 1e-9) AS BIGINT) FROM p)"

    @query(f"q_corrupt_field_{mechanism}", f"WITH {points}, {preserving_sql(order, count)} SELECT sample, id, truth, CAST(CASE WHEN selected THEN {new} ELSE truth END AS INTEGER) AS label, selected AS corrupted FROM done")
    def run(spark, d):
        p = fields.orders(spark, d).withColumnRenamed("code", "truth")
        return corruption.corrupt_field(p, mechanism, noise, [1, 2, 3], 2, 7, "y").select("sample", "id", "truth", "label", "corrupted")


_field("random", 0.2)
_field("boundary", 0.15)
_field("patch", 0.2)
_field("region", 0.1)


@query("q_global_rank", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def q_global_rank(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return sampling.ranked(orders, F.col("o_totalprice"), F.col("id")).select("id", "rank")


WKEY = "round(-ln(1.0 - {u}) / w, 12)"


@query("q_sample_uniform", f"SELECT c_custkey AS id FROM customer ORDER BY {u_sql(2, 'sample', 'c_custkey')}, c_custkey LIMIT 100")
def q_sample_uniform(spark, d):
    return sampling.uniform_sample(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 100, 2)


@query("q_sample_weighted", f"SELECT id FROM (SELECT o_orderkey AS id, o_totalprice AS w FROM orders) ORDER BY {WKEY.format(u=u_sql(2, 'weighted', 'id'))}, id LIMIT 500")
def q_sample_weighted(spark, d):
    return sampling.weighted_sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), 500, F.col("o_totalprice"), 2).select("id")


@query(
    "q_sample_stratified",
    f"""WITH p AS (SELECT *, y AS w FROM ({fields.ORD})), k AS (SELECT id, code, {WKEY.format(u=u_sql(2, 'weighted', 'id'))} AS key, row_number() OVER (PARTITION BY code ORDER BY {u_sql(2, 'minimum', 'id')}, id) <= 40 AS first FROM p)
SELECT id, code FROM k ORDER BY first DESC, key, id LIMIT 400""",
)
def q_sample_stratified(spark, d):
    return sampling.stratified_sample(fields.orders(spark, d), 400, 40, ["code"], F.col("y"), 2).select("id", "code")


# Scores of "methods" over "conditions": mean prices by status over months, rounded in whole cents.
SCORES = "SELECT date_diff('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS id, o_orderstatus AS method, ((2 * CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS value FROM orders GROUP BY ALL"


def scores(spark, d):
    day = F.col("o_orderdate").cast("date")
    month = ((F.year(day) - 1992) * 12 + F.month(day) - 1).cast("long")
    cents = table(spark, d, "orders").select(month.alias("id"), F.col("o_orderstatus").alias("method"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return cents.groupBy("id", "method").agg(F.expr("((2 * sum(cents) + count(*)) div (2 * count(*))) / 100.0D").alias("value"))


def full_scores(spark, d):
    """The conditions in which all three methods have a score."""
    s = scores(spark, d)
    whole = s.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("id")
    return s.join(whole, "id", "left_semi")


FULL = f"s0 AS ({SCORES}), s AS (SELECT * FROM s0 WHERE id IN (SELECT id FROM s0 GROUP BY id HAVING count(*) = 3))"


@query("q_rank_average", f"WITH {FULL} SELECT id, method, value, rank() OVER (PARTITION BY id ORDER BY value DESC) + (count(*) OVER (PARTITION BY id, value) - 1) / 2.0 AS rank FROM s")
def q_rank_average(spark, d):
    return metrics.average_rank(full_scores(spark, d), ["id"], "value")


@query("q_pivot_methods", f"WITH {FULL} SELECT id, max(CASE WHEN method = 'F' THEN value END) AS F, max(CASE WHEN method = 'O' THEN value END) AS O, max(CASE WHEN method = 'P' THEN value END) AS P FROM s GROUP BY id")
def q_pivot_methods(spark, d):
    return statistics.wide(full_scores(spark, d), "id", ["F", "O", "P"])


@query(
    "q_win_rates",
    f"WITH {FULL} SELECT b.method, count(*) AS n, round(avg((a.value > b.value)::INT), 6) AS win, round(avg((a.value = b.value)::INT), 6) AS tie, round(avg((a.value < b.value)::INT), 6) AS loss, round(avg(a.value - b.value), 4) AS mean_difference FROM s a JOIN s b USING (id) WHERE a.method = 'F' AND b.method <> 'F' GROUP BY b.method",
)
def q_win_rates(spark, d):
    return rounded(rounded(statistics.win_rates(full_scores(spark, d), "id", "F"), "win", "tie", "loss"), "mean_difference", digits=4)


@query(
    "q_friedman",
    f"""WITH {FULL}, r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY value DESC) + (count(*) OVER (PARTITION BY id, value) - 1) / 2.0 AS rk FROM s),
t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY id, value)), m AS (SELECT method, sum(rk) AS rs, count(*) AS n FROM r GROUP BY method),
q AS (SELECT 12 * sum((rs - n * 2.0) ^ 2) / (max(n) * 12 - (SELECT ties FROM t) / 2.0) AS x FROM m)
SELECT round(x, 6) AS statistic, 2 AS df, round(exp(-x / 2), 6) AS p_value FROM q""",
)
def q_friedman(spark, d):
    return rounded(statistics.friedman(full_scores(spark, d), "id"), "statistic", "p_value")


@query(
    "q_signed_ranks",
    f"""WITH {FULL}, d AS (SELECT a.method AS a, b.method AS b, round(a.value - b.value, 12) AS d FROM s a JOIN s b USING (id) WHERE a.method < b.method AND round(a.value - b.value, 12) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS rk FROM d)
SELECT a, b, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS v FROM r GROUP BY ALL""",
)
def q_signed_ranks(spark, d):
    return statistics.wilcoxon_holm(full_scores(spark, d), "id").select("a", "b", "n", "v")


@query(
    "q_holm",
    f"""WITH {FULL}, d AS (SELECT a.method AS a, b.method AS b, round(a.value - b.value, 12) AS d FROM s a JOIN s b USING (id) WHERE a.method < b.method AND round(a.value - b.value, 12) <> 0),
t AS (SELECT *, count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM d), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (t - 1) / 2.0 AS rk FROM t),
g AS (SELECT a, b, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS v, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY ALL),
z AS (SELECT *, v - n * (n + 1) / 4.0 AS z, sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS sigma FROM g),
x AS (SELECT a, b, n, v, CASE WHEN sigma > 0 THEN abs(z - 0.5 * sign(z)) / sigma / sqrt(2.0) ELSE 0 END AS x FROM z),
p AS (SELECT a, b, n, v, CASE WHEN x > 0 THEN least(1.0, greatest(0.0, 1 - list_sum(list_transform(range(400), lambda k: exp((2 * k + 1) * ln(x) - x * x - lgamma(k + 1.5)))))) ELSE 1.0 END AS p FROM x),
h AS (SELECT *, least(1.0, p * (count(*) OVER () + 1 - row_number() OVER (ORDER BY p, a, b))) AS q FROM p)
SELECT a, b, n, v, round(p, 6) AS p_value, round(max(q) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""",
)
def q_holm(spark, d):
    return rounded(statistics.wilcoxon_holm(full_scores(spark, d), "id"), "p_value", "p_holm")


@query(
    "q_speedups",
    f"""WITH s AS ({SCORES}), f AS (SELECT id, value AS base FROM s WHERE method = 'F')
SELECT method, count(*) AS n, count(base) AS paired, round(avg(value - base), 4) AS mean_difference, round(sum(base) / sum(value) FILTER (base IS NOT NULL), 6) AS mean_ratio, round(median(base / value), 6) AS median_ratio
FROM s LEFT JOIN f USING (id) GROUP BY method""",
)
def q_speedups(spark, d):
    """Each method against a baseline that lacks some conditions."""
    return rounded(rounded(statistics.speedups(scores(spark, d), "id", "F"), "mean_ratio", "median_ratio"), "mean_difference", digits=4)


BOOT = f"""WITH x AS (SELECT id, value, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS size FROM ({SCORES}) WHERE method = 'F'),
dr AS (SELECT rep, CAST(least(floor({u_sql(4, 'boot', "CAST(rep AS VARCHAR) || '-' || CAST(id AS VARCHAR)")} * size), size - 1) AS BIGINT) AS place FROM x, range(1, 10001) t(rep)),
b AS (SELECT rep, avg(value) AS mean FROM dr JOIN x USING (place) GROUP BY rep)"""


@query("q_bootstrap_ci", f"{BOOT} SELECT round(quantile_cont(mean, 0.025), 4) AS lower, round(quantile_cont(mean, 0.975), 4) AS upper FROM b")
def q_bootstrap_ci(spark, d):
    means = sampling.bootstrap(scores(spark, d).where("method = 'F'"), "value", 10_000, 4)
    return rounded(sampling.percentile_interval(means), "lower", "upper", digits=4)


@query(
    "q_bootstrap_strata",
    f"""WITH {FULL}, x AS (SELECT method, id, value, row_number() OVER (PARTITION BY method ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY method) AS size FROM s),
dr AS (SELECT method, rep, CAST(least(floor({u_sql(4, 'boot', "CAST(rep AS VARCHAR) || '-' || CAST(id AS VARCHAR)")} * size), size - 1) AS BIGINT) AS place FROM x, range(1, 201) t(rep))
SELECT CAST(rep AS INTEGER) AS replicate, round(avg(value), 4) AS mean FROM dr JOIN x USING (method, place) GROUP BY rep""",
)
def q_bootstrap_strata(spark, d):
    """Means of resamples that keep the number of conditions of each method."""
    return rounded(sampling.bootstrap(full_scores(spark, d), "value", 200, 4, ["method"]), "mean", digits=4)


EV = "SELECT CAST(user_id % 4 AS VARCHAR) AS sample, event_id AS id, CAST(epoch(ts) AS DOUBLE) AS x, value AS y, event_type AS label FROM events"


def event_points(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("sample"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("x"), F.col("value").cast("double").alias("y"), F.col("event_type").alias("label"))


WINDOWS = f"""WITH p AS ({EV.replace('CAST(epoch(ts) AS DOUBLE)', 'CAST(floor(epoch(ts)) AS DOUBLE)')}), b AS (SELECT sample, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p GROUP BY sample),
g AS (SELECT sample, CAST(least(floor((x - lx) / greatest(hx - lx, 1e-12) * 8), 7) AS INTEGER) AS gx, CAST(least(floor((y - ly) / greatest(hy - ly, 1e-12) * 6), 5) AS INTEGER) AS gy, label, count(*) AS c FROM p JOIN b USING (sample) GROUP BY ALL)
SELECT sample, gx, gy, CAST(sum(c) AS BIGINT) AS n, round(-sum(greatest(c / n, 1e-12) * ln(greatest(c / n, 1e-12))), 6) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY sample, gx, gy) AS n FROM g) WHERE n >= 20 GROUP BY ALL"""


@query("q_grid_windows", WINDOWS)
def q_grid_windows(spark, d):
    return rounded(statistics.grid_windows(event_points(spark, d), least=20), "entropy")


@query(
    "q_distinct_windows",
    f"""WITH w AS (SELECT concat_ws(':', sample, gx, gy) AS id, n, entropy, round(n * entropy, 3) AS mixed FROM ({WINDOWS})),
a AS (SELECT 1 AS place, 'n' AS score, id FROM w ORDER BY n DESC, id LIMIT 1), b AS (SELECT 2 AS place, 'mixed' AS score, id FROM w WHERE id NOT IN (SELECT id FROM a) ORDER BY mixed DESC, id LIMIT 1),
c AS (SELECT 3 AS place, 'entropy' AS score, id FROM w WHERE id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) ORDER BY entropy DESC, id LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def q_distinct_windows(spark, d):
    """The windows with most points, with most points and classes, and with most classes, each another one."""
    w = rounded(statistics.grid_windows(event_points(spark, d), least=20), "entropy")
    w = w.select(F.concat_ws(":", "sample", F.col("gx").cast("string"), F.col("gy").cast("string")).alias("id"), "n", "entropy", F.round(F.col("n") * F.col("entropy"), 3).alias("mixed"))
    return statistics.choose_distinct(w, ["n", "mixed", "entropy"])


@query(
    "q_adjacent_label",
    f"""WITH {edges_sql(fields.EMB, 3, 8)}, v AS (SELECT e.sample, src AS id, rank, q.code AS vote, p.code FROM e JOIN pts q ON q.sample = e.sample AND q.id = e.dst JOIN pts p ON p.sample = e.sample AND p.id = e.src)
SELECT sample, id, bool_or(vote <> code) AS boundary, CAST(arg_min(vote, rank) FILTER (vote <> code) AS INTEGER) AS adjacent FROM v GROUP BY ALL""",
)
def q_adjacent_label(spark, d):
    points = fields.embeddings(spark, d)
    return statistics.adjacent_labels(nearest(points, 3, 8), points)


@query("q_duplicates", f"SELECT sample, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT sample, x, y, count(*) AS n FROM ({fields.PART}) GROUP BY ALL) GROUP BY sample")
def q_duplicates(spark, d):
    from fieldmend.sources.points import clean_points

    return clean_points(fields.parts(spark, d).withColumn("label", F.lit("a")), 2)[1]
