"""Queries of the benchmark runner."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmend.operators import graph
from fieldmend.operators.knn import nearest, nearest_lists
from fieldmend.plans import fields
from fieldmend.plans.benchmark import design, run_benchmark
from fieldmend.plans.graph_queries import EMB_E, MODAL
from fieldmend.plans.registry import query, rounded, table
from fieldmend.sources.points import SpatialBenchmark


def modal_method(frame, dims):
    return graph.modal(frame, nearest(frame, dims, 11)).select("sample", "id", "refined")


def majority_method(frame, dims):
    return graph.strict_majority_labels(nearest_lists(frame, dims, 6, carry="code", lists=("vote",))).select("sample", "id", "refined")


@query(
    "q_benchmark_table",
    f"""WITH {EMB_E}, {MODAL.replace("SELECT p.sample, p.id", ", r AS (SELECT p.sample, p.id", 1).replace("= 1)" + chr(10) + ", r AS", "= 1), r AS")}),
t AS (SELECT code AS truth, code % 10 + 1 AS initial, refined FROM r)
SELECT 'emb' AS dataset, method, count(*) AS n, count(DISTINCT truth) AS classes, round(avg((initial = truth)::INT), 6) AS initial_accuracy, round(avg((pred = truth)::INT), 6) AS accuracy, round(avg((pred <> initial)::INT), 6) AS changed_fraction
FROM (SELECT 'Initial' AS method, truth, initial, initial AS pred FROM t UNION ALL SELECT 'modal', truth, initial, refined FROM t) GROUP BY method""",
)
def q_benchmark_table(spark, d):
    """Labels shifted by one as input; the modal filter of the true labels as the method, so accuracies are known."""
    points = fields.embeddings(spark, d).withColumn("truth", F.col("code").cast("string")).withColumn("label", (F.col("code") % 10 + 1).cast("string"))
    field = SpatialBenchmark.of(points, 3, "emb")
    refined = lambda f: graph.modal(f, nearest(f, 3, 11)).select("sample", "id", F.col("refined").cast("string").alias("refined"))
    done = run_benchmark(field, {"modal": refined})
    return rounded(done, "initial_accuracy", "accuracy", "changed_fraction").select("dataset", "method", "n", "classes", "initial_accuracy", "accuracy", "changed_fraction")


@query(
    "q_design_grid",
    """SELECT segment, status, rep, CAST(row_number() OVER (ORDER BY segment, status, rep) AS INTEGER) AS scenario_id
FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer), (SELECT DISTINCT o_orderstatus AS status FROM orders), (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) c(rep)""",
)
def q_design_grid(spark, d):
    """The grid of the levels of two columns and three replicates."""
    return design(spark, segment=table(spark, d, "customer").select("c_mktsegment"), status=table(spark, d, "orders").select("o_orderstatus"), rep=[1, 2, 3])


@query(
    "q_benchmark_errors",
    f"""SELECT dataset, method, n, CASE WHEN method = 'broken' THEN 'no result' END AS error, CASE WHEN method <> 'broken' THEN 1.0::DOUBLE END AS accuracy
FROM (SELECT count(*) AS n FROM ({fields.EMB})), (VALUES ('emb'), ('emb.1'), ('dataset3')) a(dataset), (VALUES ('Initial'), ('broken')) b(method)""",
)
def q_benchmark_errors(spark, d):
    """A method that fails is a row with its error; fields of one name, or without one, get names of their own."""
    points = fields.embeddings(spark, d).withColumn("truth", F.col("code").cast("string")).withColumn("label", F.col("truth"))

    def broken(frame):
        raise ArithmeticError("no result")

    done = run_benchmark([SpatialBenchmark.of(points, 3, name) for name in ("emb", "emb", None)], {"broken": broken}, on_error="record")
    return rounded(done, "accuracy").select("dataset", "method", "n", "error", "accuracy")
