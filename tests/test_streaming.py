"""Evaluation of arriving specimens: batches, restarts, empty files."""

import numpy as np
import pytest

from fieldmend.operators.metrics import evaluate
from fieldmend.streaming import evaluation

SCHEMA = "sample string, truth string, initial string, refined string, boundary boolean"


def some(spark, n, seed):
    rng = np.random.default_rng(seed)
    pick = lambda: str(rng.integers(3)) if rng.random() > 0.05 else None
    return spark.createDataFrame([(f"s{k % 2}", str(rng.integers(3)), pick(), pick(), [True, False, None][rng.integers(3)]) for k in range(n)], SCHEMA)


def measures(df):
    return sorted(repr({c: round(v, 9) if isinstance(v, float) else v for c, v in r.asDict().items()}) for r in df.collect())


@pytest.mark.parametrize("keys", [[], ["sample"]])
def test_batches_and_restart(spark, tmp_path, keys):
    """The query is stopped and started again with more files; each row counts once."""
    at, out, checkpoint = f"{tmp_path}/rows", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    some(spark, 90, 1).repartition(3).write.parquet(at)

    def run():
        evaluation.evaluate_stream(evaluation.arriving(spark, at, SCHEMA), out, checkpoint, keys).awaitTermination()
        return measures(evaluation.evaluated(spark, out, keys))

    assert run() == measures(evaluate(spark.read.parquet(at), keys))
    first = spark.read.parquet(out).selectExpr("max(batch)").first()[0]
    assert first >= 2  # a file a batch
    assert run() == measures(evaluate(spark.read.parquet(at), keys))  # nothing new
    some(spark, 70, 2).repartition(2).write.mode("append").parquet(at)
    some(spark, 0, 3).write.mode("append").parquet(at)
    assert run() == measures(evaluate(spark.read.parquet(at), keys))
    assert spark.read.parquet(out).selectExpr("max(batch)").first()[0] > first
