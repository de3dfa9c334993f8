"""Point fields and masks over the supplied tables, in Spark and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmend.plans.registry import table

#: Levels of the embeddings' labels (0 to 9) in binary order, so code = label + 1.
EMB_CLASSES = 10
EMB = """SELECT CAST(vec_id % 3 AS VARCHAR) AS sample, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS INTEGER) + 1 AS code FROM embeddings"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 points (2,000 at sf0.1) in three specimens, ten classes, three axes."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 3).cast("string").alias("sample"), F.col("vec_id").alias("id"), *(e[k].cast("double").alias(a) for k, a in enumerate("xyz")), (F.col("label").cast("int") + 1).alias("code")
    )


CUST_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CUST = f"""SELECT 'all' AS sample, c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y,
CAST(list_position({CUST_LEVELS}, c_mktsegment) AS INTEGER) AS code FROM customer"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specimen with a discrete axis, five classes."""
    levels = F.array(*map(F.lit, CUST_LEVELS))
    return table(spark, sf_dir, "customer").select(
        F.lit("all").alias("sample"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"),
        F.array_position(levels, F.col("c_mktsegment")).cast("int").alias("code"),
    )


ORD_LEVELS = ["F", "O", "P"]
ORD = f"""SELECT CAST(year(o_orderdate) AS VARCHAR) AS sample, o_orderkey AS id,
CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, o_totalprice AS y,
CAST(list_position({ORD_LEVELS}, o_orderstatus) AS INTEGER) AS code FROM orders"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specimen per year, three classes."""
    levels = F.array(*map(F.lit, ORD_LEVELS))
    return table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("string").alias("sample"), F.col("o_orderkey").alias("id"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"),
        F.array_position(levels, F.col("o_orderstatus")).cast("int").alias("code"),
    )


PART = """SELECT 'all' AS sample, p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specimen on few lines, with many ties."""
    return table(spark, sf_dir, "part").select(F.lit("all").alias("sample"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))


#: Masks: a grid of parts, one row per cell; small sizes are void.
MASK_ROWS = 50
CELLS = f"""SELECT 'all' AS mask_id, CAST(p_partkey % {MASK_ROWS} + 1 AS INTEGER) AS r, CAST(p_partkey // {MASK_ROWS} + 1 AS INTEGER) AS c,
CASE WHEN p_size >= 5 THEN p_type END AS value FROM part"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.lit("all").alias("mask_id"), (key % MASK_ROWS + 1).cast("int").alias("r"), (F.floor(key / MASK_ROWS) + 1).cast("int").alias("c"), F.when(F.col("p_size") >= 5, F.col("p_type")).alias("value")
    )
