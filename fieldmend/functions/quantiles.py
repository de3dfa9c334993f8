"""Exact percentiles of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.session import small

#: Rows of a group whose distinct values one task may count by itself; accuracy of the brackets of larger ones.
EXACT_ROWS, ACCURACY = 1_000_000, 10_000


def percentiles(df: DataFrame, keys: list[str], values: dict[str, Column], at: list[float], largest: int | None = None) -> DataFrame:
    """keys and, by the names of values, arrays of their percentiles, between neighbouring values in proportion; nulls don't
    count. largest: the rows of the largest group, if they are known.

    Small groups are counted whole. Of others approximate percentiles a little below and above tell where each one must lie:
    rows below are counted, and only those between are put in order."""
    if largest is not None and largest <= EXACT_ROWS:
        return df.groupBy(*keys).agg(*(F.percentile(v, F.array(*map(F.lit, at))).alias(n) for n, v in values.items()))
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items())))).where("value is not null")
    group = [*keys, "name"]
    ends = [F.lit(min(1.0, max(0.0, p + d / ACCURACY))) for p in at for d in (-3, 3)]
    brackets, _ = small(long.groupBy(*group).agg(F.count(F.lit(1)).alias("fm_n"), F.percentile_approx("value", F.array(*ends), F.lit(ACCURACY)).alias("fm_b")))
    # Of few rows a bracket may miss the neighbour that a percentile needs, so all of them are between.
    few = F.col("fm_n") < 2 * ACCURACY
    end = lambda i, far: F.when(few, F.lit(far)).otherwise(F.col("fm_b")[i])
    places = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(p).alias("p"), end(2 * j, -math.inf).alias("low"), end(2 * j + 1, math.inf).alias("high")) for j, p in enumerate(at)))
    near = long.join(brackets.select(*group, "fm_n", F.inline(places)), group).where(F.col("value") <= F.col("high"))
    near = near.withColumn("value", F.when(F.col("value") >= F.col("low"), F.col("value")))
    counted = near.groupBy(*group, "j", "p", "fm_n", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group, "j").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0))
    spot = (F.col("fm_n") - 1) * F.col("p")
    counted = counted.withColumn("upto", upto).withColumns({"first": F.floor(spot), "second": F.ceil(spot), "share": spot - F.floor(spot)})
    value = lambda rank: F.max(F.when((F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("c")), F.col("value")))
    found = counted.groupBy(*group, "j").agg(value("first").alias("a"), value("second").alias("b"), F.max("share").alias("share"))
    found = found.withColumn("v", (1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    return found.groupBy(*keys).agg(*(F.array(*(F.max(F.when((F.col("name") == n) & (F.col("j") == j), F.col("v"))) for j in range(len(at)))).alias(n) for n in values))
