"""Queries of level lists, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmend.operators import levels
from fieldmend.plans.registry import query, table


@query(
    "q_level_counts",
    """SELECT nation, segment, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT n_name AS nation, n_nationkey AS k FROM nation) CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer)
LEFT JOIN (SELECT c_nationkey AS k, c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal < 500 GROUP BY ALL) USING (k, segment)""",
)
def q_level_counts(spark, d):
    """Customers with little money, by nation and segment; zeros where there are none."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    poor = customer.where("c_acctbal < 500").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return levels.counted(poor, {"nation": levels.levels(nation, "n_name"), "segment": levels.levels(customer, "c_mktsegment")})


@query(
    "q_union_filled",
    """SELECT 'customer' AS part, c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL, s_name FROM supplier""",
)
def q_union_filled(spark, d):
    """Two tables with columns of their own as one."""
    customer = table(spark, d, "customer").select(F.lit("customer").alias("part"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, d, "supplier").select(F.lit("supplier").alias("part"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return levels.union_filled(customer, supplier)


@query("q_levels_only", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS level FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 5)")
def q_levels_only(spark, d):
    """The nations of customers that none of the first suppliers is in."""
    return levels.only_in(levels.levels(table(spark, d, "customer"), "c_nationkey"), levels.levels(table(spark, d, "supplier").where("s_suppkey <= 5"), "s_nationkey"))


@query(
    "q_levels_merged",
    """WITH l AS (SELECT level, CAST(row_number() OVER (ORDER BY level) AS INTEGER) AS code FROM (SELECT o_orderstatus AS level FROM orders UNION SELECT l_returnflag FROM lineitem))
SELECT o_orderkey AS id, o_orderstatus AS label, code FROM orders JOIN l ON level = o_orderstatus""",
)
def q_levels_merged(spark, d):
    """Orders' status coded by the levels that it shares with the lines' flags."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    both = levels.merged(levels.levels(orders, "label"), levels.levels(table(spark, d, "lineitem"), "l_returnflag"))
    return levels.recoded(orders, "label", both)
