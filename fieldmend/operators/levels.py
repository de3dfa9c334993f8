"""Level lists as relations: counts with the levels that don't occur, unions of fields with different columns or levels, levels
that only one field has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.session import small


def levels(frame: DataFrame, column: str) -> DataFrame:
    """level and code (its place from 1, ascending) of the values of a column; a table of levels, which is small if its rows are few."""
    found, _ = small(frame.select(F.col(column).cast("string").alias("level")).where("level is not null").distinct())
    return found.withColumn("code", F.row_number().over(Window.orderBy("level")))


def counted(frame: DataFrame, by: dict[str, DataFrame], out: str = "n") -> DataFrame:
    """How many rows there are of each combination of levels, 0 where there is no row. by: a column of frame and the relation (level) of its values; rows
    outside the levels are not counted."""
    names = list(by)
    grid = None
    for name, table in by.items():
        one = small(table.select(F.col("level").alias(name)).distinct())[0]
        grid = one if grid is None else grid.crossJoin(one)  # of level lists
    n = frame.groupBy(*(F.col(c).cast("string").alias(c) for c in names)).agg(F.count(F.lit(1)).alias("fm_n"))
    return grid.join(n, names, "left").select(*names, F.coalesce("fm_n", F.lit(0)).cast("long").alias(out))


def union_filled(*frames: DataFrame) -> DataFrame:
    """All rows of the frames, with the columns of any of them; null where a frame has none."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def merged(*tables: DataFrame) -> DataFrame:
    """level and code of the levels that any of these relations has."""
    return levels(union_filled(*(t.select("level") for t in tables)), "level")


def recoded(frame: DataFrame, label: str, table: DataFrame, out: str = "code") -> DataFrame:
    """frame with the code of its label in a relation of levels; null outside them."""
    held = small(table.select(F.col("level").alias("fm_level"), F.col("code").alias("fm_code")))[0]
    return frame.join(held, F.col(label).cast("string") == F.col("fm_level"), "left").withColumn(out, F.col("fm_code")).drop("fm_level", "fm_code")


def only_in(table: DataFrame, *others: DataFrame) -> DataFrame:
    """The levels of a relation that none of the others has."""
    out = table.select("level")
    for other in others:
        out = out.subtract(other.select("level"))
    return out
