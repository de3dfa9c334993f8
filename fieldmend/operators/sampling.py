"""Sampling without replacement, bootstraps, and global ranks that no single task works out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.functions.rng import pick, uniform, weighted_key
from fieldmend.session import SMALL_ROWS, cut, small


def ranked(df: DataFrame, *order: Column, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in an order of all rows or of the rows that share `by`. Rows are sorted by ranges of
    about equal size, whatever the groups' sizes; the first place of each group in each range, a row each, tells the rest.
    Rows that are equal in the order get places in no fixed order, so its last column should tell rows apart."""
    by = list(by or [])
    sort = [*map(F.col, by), *order]
    # A row's place in its task is in the lower 33 bits, the task in the upper ones.
    spread = cut(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("fm_at", F.monotonically_increasing_id()))
    spread = spread.withColumn("fm_range", F.shiftright("fm_at", 33))
    first = spread.groupBy(*by, "fm_range").agg(F.count(F.lit(1)).alias("fm_size"), F.min("fm_at").alias("fm_first"))
    before = Window.partitionBy(*by).orderBy("fm_range").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = small(first.select(*by, "fm_range", (F.coalesce(F.sum("fm_size").over(before), F.lit(0)) + 1 - F.col("fm_first")).alias("fm_start")))
    return spread.join(starts, [*by, "fm_range"]).withColumn(out, (F.col("fm_start") + F.col("fm_at")).cast("long")).drop("fm_at", "fm_range", "fm_start")


#: Quantiles of a group's keys that are worked out to find a threshold, and their accuracy: ranks are off by n / ACCURACY at most.
QUANTILES, ACCURACY = 64, 10_000


def first_of_groups(df: DataFrame, by: list[str], key: Column, count: Column, id_: str = "id", out: str = "first") -> DataFrame:
    """df with a flag: the `count` rows of each group with the least (key, id). count may use fm_n, the size of the group.
    A mergeable sketch of each group's keys gives a threshold that surely has so many rows below it; only rows below it are
    sorted, so that a group takes neither a task of its own nor a sort of all its rows."""
    keyed = df.withColumn("fm_key", key)
    sketch = F.percentile_approx("fm_key", F.array(*(F.lit(j / QUANTILES) for j in range(1, QUANTILES))), F.lit(ACCURACY))
    groups = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("fm_n"), sketch.alias("fm_q")).withColumn("fm_count", count.cast("long"))
    place = F.ceil((F.col("fm_count") / F.col("fm_n") + 1.0 / ACCURACY) * QUANTILES).cast("int")
    groups = groups.select(*by, "fm_count", F.coalesce(F.get("fm_q", F.greatest(place, F.lit(1)) - 1), F.lit(float("inf"))).alias("fm_bound"))
    limits, _ = small(groups)
    keyed = keyed.join(limits, by)
    near = ranked(keyed.where(F.col("fm_key") <= F.col("fm_bound")), F.col("fm_key"), F.col(id_), by=by, out="fm_place")
    near = near.withColumn(out, F.col("fm_place") <= F.col("fm_count"))
    rest = keyed.where(F.col("fm_key") > F.col("fm_bound")).withColumn(out, F.lit(False))
    return near.select(*df.columns, out).unionByName(rest.select(*df.columns, out))


def uniform_sample(df: DataFrame, m: int, seed: int, stream: str = "sample", id_: str = "id") -> DataFrame:
    """m rows without replacement, each set alike likely."""
    return df.withColumn("fm_u", uniform(seed, stream, id_)).orderBy("fm_u", id_).limit(m).drop("fm_u")


def weighted_sample(df: DataFrame, m: int, weight: Column, seed: int, stream: str = "weighted", id_: str = "id") -> DataFrame:
    """m rows without replacement, drawn one after another in proportion to their weights."""
    return df.withColumn("fm_k", weighted_key(seed, stream, weight, id_)).orderBy("fm_k", id_).limit(m).drop("fm_k")


def stratified_sample(df: DataFrame, m: int, least: int, classes: list[str], weight: Column, seed: int, id_: str = "id") -> DataFrame:
    """`least` rows of each class first, then rows by weight until there are m."""
    first = first_of_groups(df, classes, uniform(seed, "minimum", id_), F.lit(least), id_, "fm_first")
    keyed = first.withColumn("fm_k", weighted_key(seed, "weighted", weight, id_))
    return keyed.orderBy(F.desc("fm_first"), "fm_k", id_).limit(m).drop("fm_k", "fm_first")


def bootstrap(df: DataFrame, value: str, replicates: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """replicate and the mean of a resample of df (id, value; with replacement, within strata), for each replicate. Rows are drawn by
    their place in the stratum. A small table's values are broadcast, each task adds up a vector of all replicates over its
    rows, and the vectors are added up; a larger table's draws are joined to it."""
    keys = list(strata or [])
    rows = ranked(df.select(*keys, "id", F.col(value).cast("double").alias("fm_value")), F.col("id"), by=keys, out="fm_place")
    if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        table = F.broadcast(rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fm_place", "fm_value"))).alias("fm_all")))
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = rows.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(n)).alias("fm_block")).agg(F.collect_list("id").alias("fm_ids"))
        blocks = (blocks.join(table, keys) if keys else blocks.crossJoin(table)).repartition(n, "fm_block").withColumn("fm_all", F.col("fm_all.fm_value"))
        drawn = lambda r, i: F.element_at("fm_all", pick(seed, "boot", F.size("fm_all"), F.concat_ws("-", r, i)) + 1)
        total = lambda r: F.aggregate("fm_ids", F.lit(0.0), lambda acc, i: acc + drawn(r, i))
        vectors = blocks.select(F.size("fm_ids").alias("n"), F.transform(F.sequence(F.lit(1), F.lit(replicates)), total).alias("sums"))
        each = vectors.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        return each.select((F.col("at") + 1).alias("replicate"), (F.col("s") / F.col("n")).alias("mean"))
    sizes, _ = small(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("fm_size")))
    sized = rows.join(sizes, keys) if keys else rows.crossJoin(sizes)
    draws = sized.select(*keys, "id", "fm_size", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.withColumn("fm_place", (pick(seed, "boot", F.col("fm_size"), F.concat_ws("-", F.col("replicate"), F.col("id"))) + 1).cast("long"))
    return draws.join(rows.select(*keys, "fm_place", "fm_value"), [*keys, "fm_place"]).groupBy("replicate").agg(F.avg("fm_value").alias("mean"))


def percentile_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return means.agg(F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"))
