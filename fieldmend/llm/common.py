"""What the operators of this folder share: the shared folder, lineage cuts, files in tasks, text batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmend.session import shared_folder

#: Rows per Arrow batch: texts may be long, and a Python worker holds one batch.
BATCH_ROWS = 500


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Computes a DataFrame once, as a Parquet table in the shared folder, and reads that."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps the Arrow batches of this session small enough for long texts. Batches are made when a result is asked for, after
    the operator has returned, so the setting stays; it is never raised."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def packed(docs: DataFrame, *more) -> DataFrame:
    """The rows of docs as one column fm_row, and more columns: whatever docs' own are called, none clashes with these."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("fm_row"), *more)


def unpacked(df: DataFrame, columns: list[str], **changed) -> list:
    """The columns of packed docs again, some changed."""
    return [changed[c].alias(c) if c in changed else F.col("fm_row")[c].alias(c) for c in columns]


def opened(uri: str):
    """The pyarrow file system and path of a URI, inside a task."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def written(uri: str, write) -> None:
    """Writes a file by write(stream) under a name of its own and moves it to its place, so that a task that
    runs again, or twice at once, leaves the same whole file."""
    filesystem, path = opened(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with filesystem.open_output_stream(part) as stream:
        write(stream)
    filesystem.move(part, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
