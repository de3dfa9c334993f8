"""Point fields: validation, level lists, constructors, readers and writers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmend.functions.geometry import axes


def validate_points(points: DataFrame, dims: int) -> None:
    """Raises ValueError where coordinates, labels or specimens are not usable; one aggregate over the rows."""
    names = axes(dims)
    for a in names:
        if a not in points.columns or not isinstance(points.schema[a].dataType, T.NumericType):
            raise ValueError(f"points need a numeric column {a}")
    bad = [F.count_if(F.col(a).isNull() | F.isnan(F.col(a).cast("double")) | (F.abs(F.col(a).cast("double")) == float("inf"))) for a in names]
    found = points.agg(
        F.count(F.lit(1)).alias("n"), *(b.alias(f"bad{k}") for k, b in enumerate(bad)), F.count_if(F.col("label").isNull()).alias("labels"), F.count_if(F.col("sample").isNull()).alias("samples"),
        F.count_if(F.col("id").isNull()).alias("ids"),
    ).first()
    if not found.n or any(found[f"bad{k}"] for k in range(dims)):
        raise ValueError("points need rows, and coordinates that are neither missing nor infinite")
    if found["labels"]:
        raise ValueError(f"{found['labels']} points have no label")
    if found["samples"] or found["ids"]:
        raise ValueError("points without sample or id")


def encoded(points: DataFrame, levels: list[str]) -> DataFrame:
    """points with code, the 1-based place of label in levels. Labels outside the levels raise at run time."""
    code = F.array_position(F.array(*map(F.lit, levels)), F.col("label").cast("string")).cast("int")
    return points.withColumn("code", F.when(code > 0, code).otherwise(F.raise_error(F.concat(F.lit("label outside its levels: "), F.col("label").cast("string"))).cast("int")))


@dataclass
class SpatialBenchmark:
    """A point field with its truth: frame holds sample, id, x, y (z), label, truth and optionally region, boundary,
    sparse, corrupted."""

    frame: DataFrame
    dims: int
    name: str | None = None
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, frame: DataFrame, dims: int, name: str | None = None, metadata: dict | None = None) -> SpatialBenchmark:
        """Validates and completes a frame: one specimen named sample1 unless given; aliases of region and sparse;
        boundary as the lowest fifth of boundary_proximity where only that is given."""
        if "sample" not in frame.columns:
            frame = frame.withColumn("sample", F.lit("sample1"))
        for target, others in (("region", ("regions", "area")), ("sparse", ("sparse_region", "sparse_layer"))):
            for other in others:
                if target not in frame.columns and other in frame.columns:
                    frame = frame.withColumnRenamed(other, target)
        validate_points(frame, dims)
        for flag in ("boundary", "sparse", "corrupted"):
            if flag in frame.columns:
                if not isinstance(frame.schema[flag].dataType, T.BooleanType) or frame.where(F.col(flag).isNull()).limit(1).count():
                    raise ValueError(f"{flag} is true or false for each point")
        if "boundary" not in frame.columns and "boundary_proximity" in frame.columns:
            cut_ = frame.agg(F.percentile("boundary_proximity", 0.2).alias("cut"))
            frame = frame.join(F.broadcast(cut_)).withColumn("boundary", F.col("boundary_proximity") <= F.col("cut")).drop("cut")
        if frame.limit(2).count() < 2:
            raise ValueError("a benchmark needs two observations")
        return cls(frame, dims, name, dict(metadata or {}))


#: Names that a stored field also goes by.
ALIASES = {"colorectal": "crc"}


def catalogue(fields: dict[str, DataFrame], scenarios: int = 60) -> DataFrame:
    """A row per field (code): dataset, included, observations, classes and the scenarios of its recipe; one pass over each."""
    rows = [f.select(F.lit(name).alias("dataset"), "code") for name, f in fields.items()]
    each = reduce(DataFrame.unionByName, rows).groupBy("dataset", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset")
    return each.agg(F.lit(True).alias("included"), F.sum("n").cast("int").alias("observations"), F.count("code").cast("int").alias("classes"), F.lit(scenarios).alias("scenarios"))


def store_benchmark(folder: str, name: str, points: DataFrame, design: DataFrame, scenarios: DataFrame) -> None:
    """Writes a field: points (sample, id, coordinates, truth ..), the design (scenario, scenario_id ..) and its scenarios. These are either
    long (scenario, sample, id, label) or wide: sample, id and a column of labels for each number of a scenario, s1, s2 .. The
    labels are written one folder per scenario, so that a scenario is read without the others. Long rows are dealt by ranges of
    scenario and id; a wide matrix is read for each scenario with that one's column alone, in one job, and its rows are neither dealt
    nor sorted (a matrix that is dear to work out should be stored before)."""
    place = f"{folder}/{ALIASES.get(name, name)}"
    points.write.mode("overwrite").parquet(f"{place}/points")
    design.coalesce(1).write.mode("overwrite").parquet(f"{place}/design")
    if "scenario" in scenarios.columns:
        long = scenarios.select("scenario", "sample", "id", "label").repartitionByRange("scenario", "id")
        long.write.mode("overwrite").partitionBy("scenario").parquet(f"{place}/scenarios")
        return
    wide = [c for c in scenarios.columns if c not in ("sample", "id")]
    each = [scenarios.select(F.lit(int(c[1:])).alias("scenario"), "sample", "id", F.col(c).alias("label")) for c in wide]
    # A task has rows of one scenario, so one open file will do and Spark needn't sort by scenario.
    conf, key = scenarios.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, "1")
    try:
        reduce(DataFrame.union, each).write.mode("overwrite").partitionBy("scenario").parquet(f"{place}/scenarios")
    finally:
        conf.set(key, before)


def load_benchmark(spark: SparkSession, folder: str, name: str, scenario: int | str = 1) -> DataFrame:
    """The points of a stored field with the labels of one scenario, by its number or its scenario_id. Only this scenario's folder is
    read. A field or scenario that isn't there raises, as does one that leaves a class without a correct label."""
    place = f"{folder}/{ALIASES.get(name, name)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/points")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"no field {name} is stored here")
    key = "scenario" if isinstance(scenario, int) else "scenario_id"
    found = spark.read.parquet(f"{place}/design").where(F.col(key) == scenario).select("scenario").first()
    if found is None:
        raise ValueError(f"{name} has no scenario {scenario}")
    wanted = spark.read.parquet(f"{place}/scenarios").where(F.col("scenario") == found.scenario).select("sample", "id", "label")
    loaded = spark.read.parquet(f"{place}/points").join(wanted, ["sample", "id"])
    from fieldmend.operators.corruption import require_anchors

    require_anchors(loaded, f"scenario {scenario} of {name}")
    return loaded


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header (schema in DDL form) or a Parquet, ORC or JSON table, by the path's ending."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind in ("json", "orc"):
        return (spark.read.schema(schema) if schema else spark.read).format(kind).load(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """The sink for read_table's kinds; .txt writes a single text column with trailing blanks cut."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind == "txt":
        df.select(F.rtrim(F.col(df.columns[0]).cast("string"))).write.mode(mode).text(path)
    elif kind in ("json", "orc"):
        df.write.mode(mode).format(kind).save(path)
    else:
        df.write.mode(mode).parquet(path)


def clean_points(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Rows with label and finite coordinates, and how many share their coordinates with an earlier row, per specimen."""
    ok = F.col("label").isNotNull()
    for a in axes(dims):
        ok = ok & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) != float("inf"))
    kept = points.where(ok)
    groups = kept.groupBy("sample", *axes(dims)).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return kept, groups.groupBy("sample").agg(F.sum("extra").cast("long").alias("duplicates"))
