"""Evaluation of specimens as they arrive.

The state of the stream is what an evaluation needs of the rows met so far: how many there are of each combination of truth, initial and
refined label, region and flags. Its size is that of the label combinations, not of the rows; each task adds up its own rows
before they are sent. After each batch the counts are written as a table of their own (one folder per batch, so that a batch that
is done again after a failure replaces its own), and `evaluated` works the measures out of the latest one. A query that is
started again with the same checkpoint goes on after the last batch it had finished, so each file counts once.

Defined results: rows with null labels are counted as in metrics.evaluate; before any batch there is no table, and evaluated
raises; files that hold no rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmend.operators.metrics import evaluate

LABELS, FLAGS = ("truth", "initial", "refined"), ("region", "boundary", "sparse", "unresolved")


def arriving(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, so many a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows there are of each combination, as rows_."""
    columns = [*keys, *LABELS, *(c for c in FLAGS if c in rows.columns)]
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows_"))


def evaluate_stream(rows: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the evaluation of a stream of rows: counts go to <out>/batch=<number>. With available_now it ends when all files that
    are there have been read; without, it waits for more."""

    def write(counts: DataFrame, number: int) -> None:
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = counted(rows, list(keys or [])).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def evaluated(spark: SparkSession, out: str, keys: list[str] | None = None) -> DataFrame:
    """The measures of metrics.evaluate, of all rows met so far."""
    counts = spark.read.parquet(out)
    last = counts.agg(F.max("batch")).first()[0]
    return evaluate(counts.where(F.col("batch") == last).drop("batch"), keys, weight="rows_")
