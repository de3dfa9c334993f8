"""Evaluation of refined labels against the truth. frames: truth, initial, refined (text), optionally region, boundary,
sparse, unresolved. All measures are per group of `keys`. The rows are read once and counted, each task first adding up its
own; the counts of equal rows are then summed by grouping sets, by truth and refined, by either, by region and in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(of: Column, where: Column | None = None) -> Column:
    """The share of true values among the rows where a condition holds; null where it holds nowhere."""
    value = of.cast("double")
    return F.avg(value if where is None else F.when(where, value))


def by_class(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Recall per true class."""
    return frame.groupBy(*keys, "truth").agg(F.count(F.lit(1)).alias("n"), rate(F.col("refined") == F.col("truth")).alias("recall"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _ari(s: Column, sa: Column, sb: Column, total: Column, same: Column) -> Column:
    """The adjusted Rand index out of pairs in cells, rows and columns; 1 for a single row. Where chance leaves no room it is 1 for
    identical partitions and 0 otherwise."""
    chance, top = sa * sb / _pairs(total), (sa + sb) / 2
    room = top - chance
    return F.when(total < 2, 1.0).when(F.abs(room) <= 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(top)), same.cast("double")).otherwise((s - chance) / room)


def _sets(cells: DataFrame, keys: list[str], sets: dict[str, list[str]], *sums: Column) -> DataFrame:
    """cells summed by grouping sets, each row with the name of its set as fm_set."""
    names = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    which = F.lit(None).cast("string")
    for name, columns in sets.items():
        absent = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in columns)
        which = F.when(F.col("fm_gid").bitwiseAND((1 << len(names)) - 1) == absent, name).otherwise(which)
    grouped = cells.groupingSets([[*map(F.col, keys), *map(F.col, columns)] for columns in sets.values()], *map(F.col, keys), *map(F.col, names))
    return grouped.agg(*sums, F.grouping_id().alias("fm_gid")).withColumn("fm_set", which)


def adjusted_rand(frame: DataFrame, keys: list[str], a: str = "truth", b: str = "refined") -> DataFrame:
    """ari per group: pairs of rows that agree, adjusted for chance."""
    cells = frame.groupBy(*keys, F.col(a).alias("fm_a"), F.col(b).alias("fm_b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = _sets(cells, keys, {"both": ["fm_a", "fm_b"], "a": ["fm_a"], "b": ["fm_b"]}, F.sum("n").alias("n"))
    of = {x: F.col("fm_set") == x for x in ("both", "a", "b")}
    sums = each.groupBy(*keys).agg(
        *(F.sum(F.when(c, _pairs(F.col("n")))).alias(f"s_{x}") for x, c in of.items()), *(F.count_if(c).alias(f"k_{x}") for x, c in of.items()), F.sum(F.when(of["both"], F.col("n"))).alias("total")
    )
    same = (F.col("k_both") == F.col("k_a")) & (F.col("k_both") == F.col("k_b"))
    return sums.select(*keys, _ari(F.col("s_both"), F.col("s_a"), F.col("s_b"), F.col("total"), same).alias("ari"))


def joined_on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(b)  # one row each without keys


def evaluate(frame: DataFrame, keys: list[str] | None = None, seconds: float | None = None, method: str | None = None, weight: str | None = None) -> DataFrame:
    """One row per group with all measures; those of an empty stratum are null. weight names a column that tells how many rows one
    stands for. The sparse and the dense region are those with the
    fewest and the most rows, the first in order of equals, unless sparse is given."""
    keys = list(keys or [])
    given = [c for c in ("boundary", "sparse", "unresolved") if c in frame.columns]
    region = F.col("region" if "region" in frame.columns else "truth").cast("string")
    cells = frame.groupBy(*keys, "truth", "initial", "refined", region.alias("fm_region"), *given).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("fm_c"))
    right, was, changed = F.col("refined") == F.col("truth"), F.col("initial") == F.col("truth"), F.col("refined") != F.col("initial")
    no = F.lit(None).cast("boolean")
    edge, thin = (F.col(c) if c in given else no for c in ("boundary", "sparse"))
    rates = {
        "initial_accuracy": (was, None), "accuracy": (right, None), "boundary_accuracy": (right, edge), "interior_accuracy": (right, ~edge), "thin": (right, thin), "correction_recall": (right, ~was),
        "damage_rate": (~right, was), "changed_precision": (right, changed), "changed_fraction": (changed, None), "unresolved_fraction": (F.col("unresolved") if "unresolved" in given else F.lit(False), None),
    }
    sums = [F.sum("fm_c").alias("n")]
    for name, (of, where) in rates.items():
        known = of.isNotNull() if where is None else F.coalesce(where, F.lit(False)) & of.isNotNull()
        sums += [F.sum(F.when(known, of.cast("double") * F.col("fm_c"))).alias(f"fm_x_{name}"), F.sum(F.when(known, F.col("fm_c"))).alias(f"fm_n_{name}")]
    of = {"both": ["truth", "refined"], "truth": ["truth"], "refined": ["refined"], "region": ["fm_region"], "all": []}
    each = _sets(cells, keys, of, *sums)
    at = {x: F.col("fm_set") == x for x in of}
    share = F.col("fm_x_accuracy") / F.col("fm_n_accuracy")
    total = [F.max(F.when(at["all"], F.col("n"))).alias("n")] + [F.max(F.when(at["all"], F.col(f"fm_x_{r}") / F.col(f"fm_n_{r}"))).alias(r) for r in rates]
    by_region = [F.min_by(F.when(at["region"], share), F.when(at["region"], F.struct(sign * F.col("n"), "fm_region"))).alias(name) for name, sign in (("fm_few", 1), ("fm_most", -1))]
    pairs = [F.sum(F.when(at[x], _pairs(F.col("n")))).alias(f"s_{x}") for x in ("both", "truth", "refined")] + [F.count_if(at[x]).alias(f"k_{x}") for x in ("both", "truth", "refined")]
    recalls = [F.count_if(at["truth"] & F.col("truth").isNotNull()).alias("classes"), F.avg(F.when(at["truth"], share)).alias("macro_recall"), F.min(F.when(at["truth"], share)).alias("worst_recall")]
    all_ = each.groupBy(*keys).agg(*total, *by_region, *pairs, *recalls)
    same = (F.col("k_both") == F.col("k_truth")) & (F.col("k_both") == F.col("k_refined"))
    wrong = 1 - F.col("initial_accuracy")
    out = all_.select(
        *keys, F.col("n").cast("long").alias("n"), "classes", "initial_accuracy", "accuracy", (F.col("accuracy") - F.col("initial_accuracy")).alias("accuracy_gain"),
        F.when(wrong > 0, (wrong - (1 - F.col("accuracy"))) / wrong).alias("error_reduction"), _ari(F.col("s_both"), F.col("s_truth"), F.col("s_refined"), F.col("n"), same).alias("ari"),
        "macro_recall", "worst_recall", F.col("thin" if "sparse" in given else "fm_few").alias("sparse_region_accuracy"), F.col("fm_most").alias("dense_region_accuracy"),
        "boundary_accuracy", "interior_accuracy", "correction_recall", "damage_rate", "changed_precision", "changed_fraction", "unresolved_fraction", F.lit(seconds).cast("double").alias("seconds"),
    )
    return out if method is None else out.select(F.lit(method).alias("method"), "*")


def average_rank(frame: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from the largest value of a group down, equal values sharing the mean of their ranks."""
    down, equal = Window.partitionBy(*keys).orderBy(F.desc(value)), Window.partitionBy(*keys, value)
    return frame.withColumn(out, F.rank().over(down) + (F.count(F.lit(1)).over(equal) - 1) / 2.0)
