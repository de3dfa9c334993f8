"""Paired comparison of methods over conditions: pivots, win rates, Friedman and Wilcoxon tests, Holm's adjustment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.operators.metrics import average_rank
from fieldmend.operators.sampling import ranked


def wide(scores: DataFrame, key: str, methods: list[str], value: str = "value") -> DataFrame:
    """A row per condition, a column per method."""
    return scores.groupBy(key).pivot("method", methods).agg(F.first(value))


def win_rates(scores: DataFrame, key: str, method: str, value: str = "value") -> DataFrame:
    """How often a method is better, equal and worse than each other one, and by how much in the mean."""
    mine = scores.where(F.col("method") == method).select(key, F.col(value).alias("mine"))
    both = scores.where(F.col("method") != method).join(mine, key)
    diff = F.col("mine") - F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), share(diff > 0).alias("win"), share(diff == 0).alias("tie"), share(diff < 0).alias("loss"), F.avg(diff).alias("mean_difference"))


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def friedman(scores: DataFrame, key: str, value: str = "value") -> DataFrame:
    """statistic, df and p_value: rank sums of the methods over the conditions, corrected for ties. A row per method is
    what the last step sees."""
    ranks = average_rank(scores, [key], value)
    k = Window.partitionBy(key)
    sizes = ranks.withColumn("k", F.count(F.lit(1)).over(k))
    ties = sizes.groupBy(key, value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = sizes.groupBy("method").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    one = sums.agg(F.sum(F.pow(F.col("r") - F.col("n") * (F.col("k") + 1) / 2.0, 2)).alias("s"), F.max("n").alias("n"), F.max("k").alias("k")).crossJoin(ties)  # one row each
    statistic = 12 * F.col("s") / (F.col("n") * F.col("k") * (F.col("k") + 1) - F.col("ties") / (F.col("k") - 1))
    row = one.select(statistic.alias("statistic"), (F.col("k") - 1).cast("int").alias("df")).first()
    p = None if row.statistic is None else gamma_q(row.df / 2, row.statistic / 2)
    return scores.sparkSession.createDataFrame([(row.statistic, row.df, p)], "statistic double, df int, p_value double")


def signed_ranks(scores: DataFrame, key: str, pairs: DataFrame, value: str = "value") -> DataFrame:
    """For each pair of methods (a, b): n (differences but zeros), v (rank sum of the positive ones), ties."""
    side = lambda m, c: scores.select(key, F.col("method").alias(m), F.col(value).alias(c))
    diff = pairs.join(side("a", "va"), "a").join(side("b", "vb"), ["b", key]).withColumn("d", F.round(F.col("va") - F.col("vb"), 12)).where("d <> 0").withColumn("size", F.abs("d"))
    # Equal differences share the mean of their places, which are worked out by ranges: no pair is in one task.
    equal = ranked(diff, F.col("size"), F.col(key), by=["a", "b"], out="place").groupBy("a", "b", "size").agg(F.count(F.lit(1)).alias("t"), F.min("place").alias("first"), F.count_if(F.col("d") > 0).alias("up"))
    rank = F.col("first") + (F.col("t") - 1) / 2.0
    return equal.groupBy("a", "b").agg(F.sum("t").alias("n"), F.sum(F.col("up") * rank).alias("v"), F.sum((F.col("t") * (F.col("t") * F.col("t") - 1)).cast("double")).alias("ties"))


def holm(p_values: list[float]) -> list[float]:
    """Holm's step-down adjustment, in the order given."""
    order = sorted(range(len(p_values)), key=lambda i: p_values[i])
    out, high = [0.0] * len(p_values), 0.0
    for place, i in enumerate(order):
        high = max(high, min(1.0, (len(p_values) - place) * p_values[i]))
        out[i] = high
    return out


def wilcoxon_holm(scores: DataFrame, key: str, value: str = "value") -> DataFrame:
    """a, b, n, v, p_value (normal approximation with continuity correction) and p_holm for all pairs of methods."""
    methods = scores.select("method").distinct()
    pairs = methods.select(F.col("method").alias("a")).join(methods.select(F.col("method").alias("b")), F.col("a") < F.col("b"))  # a handful of methods
    rows = sorted(signed_ranks(scores, key, pairs, value).collect(), key=lambda r: (r.a, r.b))
    ps = []
    for r in rows:
        z = r.v - r.n * (r.n + 1) / 4
        sigma = math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.ties / 48)
        z = (z - math.copysign(0.5, z) * (z != 0)) / sigma if sigma else 0.0
        ps.append(min(1.0, math.erfc(abs(z) / math.sqrt(2))))
    out = [(r.a, r.b, r.n, r.v, p, q) for r, p, q in zip(rows, ps, holm(ps), strict=True)]
    return scores.sparkSession.createDataFrame(out, "a string, b string, n long, v double, p_value double, p_holm double")


def speedups(scores: DataFrame, key: str, baseline: str, value: str = "value") -> DataFrame:
    """For each method: n conditions, paired ones (the baseline has them too), the mean difference to the baseline, and
    how many times smaller it is: mean_ratio of the paired means and median_ratio. Conditions that the baseline lacks
    stay in n and in nothing else."""
    base = scores.where(F.col("method") == baseline).select(key, F.col(value).alias("fm_base"))
    both = scores.join(base, key, "left")
    mine = F.when(F.col("fm_base").isNotNull(), F.col(value))
    return both.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count("fm_base").alias("paired"), F.avg(mine - F.col("fm_base")).alias("mean_difference"),
        (F.sum("fm_base") / F.sum(mine)).alias("mean_ratio"), F.median(F.col("fm_base") / mine).alias("median_ratio"),
    )


def choose_distinct(rows: DataFrame, scores: list[str], id_: str = "id") -> DataFrame:
    """place, score and id: for each score in turn the row that has most of it and was not chosen before; of equals the
    first id. Only the first rows of each score, as many as there are scores, can be chosen, and only these are read."""
    taken: list = []
    for s in scores:
        first = rows.orderBy(F.desc_nulls_last(s), id_).select(id_).limit(len(scores)).collect()
        taken.append(next((r[0] for r in first if r[0] not in taken), None))
    found = [(k, s, i) for k, (s, i) in enumerate(zip(scores, taken, strict=True), 1) if i is not None]
    return rows.sparkSession.createDataFrame(found, f"place int, score string, {id_} {rows.schema[id_].dataType.simpleString()}")


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy of class counts, shares floored at 1e-12."""
    total = sum(counts[1:], counts[0])
    share = [F.greatest(c / total, F.lit(1e-12)) for c in counts]
    return -sum((s * F.log(s) for s in share[1:]), share[0] * F.log(share[0]))


def grid_windows(points: DataFrame, across: int = 8, down: int = 6, least: int = 500) -> DataFrame:
    """Cells of a grid over each specimen with at least so many points: sample, gx, gy, n, entropy of the classes."""
    box = points.groupBy("sample").agg(*(f(a).alias(f"{p}{a}") for a in "xy" for p, f in (("lo", F.min), ("hi", F.max))))
    cell = lambda a, k: F.least(F.floor((F.col(a) - F.col(f"lo{a}")) / F.greatest(F.col(f"hi{a}") - F.col(f"lo{a}"), F.lit(1e-12)) * k), F.lit(k - 1)).cast("int")
    placed = points.join(box, "sample").select("sample", cell("x", across).alias("gx"), cell("y", down).alias("gy"), "label")
    per = placed.groupBy("sample", "gx", "gy", "label").agg(F.count(F.lit(1)).alias("c"))
    sums = per.groupBy("sample", "gx", "gy").agg(F.sum("c").alias("n"), F.collect_list("c").alias("cs")).where(F.col("n") >= least)
    share = F.transform("cs", lambda c: F.greatest(c / F.col("n"), F.lit(1e-12)))
    return sums.select("sample", "gx", "gy", "n", (-F.aggregate(F.array_sort(share), F.lit(0.0), lambda s, p: s + p * F.log(p))).alias("entropy"))


def adjacent_labels(edges: DataFrame, points: DataFrame) -> DataFrame:
    """sample, id, boundary (a neighbour differs) and adjacent: the label of the nearest neighbour that differs."""
    votes = edges.join(points.select("sample", F.col("id").alias("dst"), F.col("code").alias("vote")), ["sample", "dst"]).join(points.select("sample", F.col("id").alias("src"), "code"), ["sample", "src"])
    other = F.when(F.col("vote") != F.col("code"), F.col("vote"))
    return votes.groupBy("sample", F.col("src").alias("id")).agg(F.count(other).alias("n"), F.min_by(other, F.when(other.isNotNull(), F.col("rank"))).alias("adjacent")).select("sample", "id", (F.col("n") > 0).alias("boundary"), "adjacent")
