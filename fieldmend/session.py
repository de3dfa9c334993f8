"""Session helpers: defaults for local runs, the shared folder, cutting of lineage, small tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of no more rows and bytes than these is small: it may be on the driver and be broadcast.
SMALL_ROWS, SMALL_BYTES = 20_000, 32 << 20


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "fieldmend") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FIELDMEND_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local master may do without; it gets a temporary one."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="fieldmend-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(remove)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Computes a DataFrame once and cuts its lineage, by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, what: str) -> list:
    """The values of a column of distinct rows, ascending, for lists that plans hold as literals; more than SMALL_ROWS raise."""
    found = [r[0] for r in df.limit(SMALL_ROWS + 1).collect()]
    if len(found) > SMALL_ROWS:
        raise ValueError(f"there are more than {SMALL_ROWS} {what}")
    return sorted(v for v in found if v is not None)


def small(df: DataFrame, rows: int | None = None):
    """A DataFrame with the rows of df, worked out once, and these rows if they are few: a table of no more than `rows`
    rows is to be broadcast where it is joined; a larger one is cut, and there are no rows."""
    most = SMALL_ROWS if rows is None else rows
    found = df.limit(most + 1).toArrow()
    if found.num_rows > most or found.nbytes > SMALL_BYTES:
        return cut(df), None
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)), found.to_pylist()
