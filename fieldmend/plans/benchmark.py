"""The benchmark runner: every method on every field, timed and evaluated, in one table."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmend.operators.metrics import evaluate
from fieldmend.sources.points import SpatialBenchmark

Method = Callable[..., DataFrame]


def unique_names(names: list[str | None]) -> list[str]:
    """Names for all: dataset1, dataset2 .. where there are none; repeated ones get .1, .2 .."""
    given = [n or f"dataset{i + 1}" for i, n in enumerate(names)]
    seen: dict[str, int] = {}
    taken = set(given)
    out = []
    for n in given:
        if n in seen:
            k = seen[n]
            while f"{n}.{k}" in taken:
                k += 1
            seen[n] = k + 1
            taken.add(f"{n}.{k}")
            out.append(f"{n}.{k}")
        else:
            seen[n] = 1
            out.append(n)
    return out


def call(method: Method, frame: DataFrame, seed: int, dims: int) -> DataFrame:
    """A method takes a frame and, if it names them, seed and dims; it returns sample, id, refined."""
    known = inspect.signature(method).parameters
    open_ = any(p.kind is p.VAR_KEYWORD for p in known.values())
    return method(frame, **{k: v for k, v in (("seed", seed), ("dims", dims)) if open_ or k in known})


def run_benchmark(fields: SpatialBenchmark | list[SpatialBenchmark], methods: dict[str, Method], include_initial: bool = True, seed: int = 1, on_error: str = "stop") -> DataFrame:
    """A row per field and method: dataset, method, the measures, error. "Initial" is the input itself. A method's
    result is written to a checkpoint within the time that counts; on_error="record" keeps an error's text."""
    if not methods or not all(callable(m) for m in methods.values()):
        raise ValueError("methods are functions by name, one at least")
    if "Initial" in methods:
        raise ValueError("Initial is the name of the input itself")
    if on_error not in ("stop", "record"):
        raise ValueError("on_error is stop or record")
    from fieldmend.session import cut

    fields = [fields] if isinstance(fields, SpatialBenchmark) else list(fields)
    rows = []
    for i, (name, field) in enumerate(zip(unique_names([f.name for f in fields]), fields, strict=True), 1):
        frame = cut(field.frame)
        todo: dict[str, Method | None] = ({"Initial": None} if include_initial else {}) | methods
        for j, (label, method) in enumerate(todo.items(), 0 if include_initial else 1):
            known = frame.withColumnRenamed("label", "initial")
            try:
                began = time.perf_counter()
                done = frame.select("sample", "id", F.col("label").alias("refined")) if method is None else cut(call(method, frame, seed + 1000 * i + j, field.dims).select("sample", "id", "refined"))
                seconds = 0.0 if method is None else time.perf_counter() - began
                row = evaluate(known.join(done, ["sample", "id"]), seconds=seconds, method=label).withColumn("error", F.lit(None).cast("string"))
            except Exception as e:
                if on_error == "stop":
                    raise RuntimeError(f"Method `{label}` failed on `{name}`: {e}") from e
                row = evaluate(known.withColumn("refined", F.col("initial")), seconds=time.perf_counter() - began, method=label)
                keep = {"method", "n", "classes", "initial_accuracy", "seconds"}
                row = row.select(*(F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in row.dtypes)).withColumn("error", F.lit(str(e)))
            rows.append(row.select(F.lit(name).alias("dataset"), "*"))
    return reduce(DataFrame.unionByName, rows)


def design(spark, **factors: list | DataFrame) -> DataFrame:
    """The full grid of factors with scenario_id, numbered by the order of the factors. A factor is a list of values, or a column
    whose levels are its values, ascending; a design has 20,000 rows per factor at most."""
    from pyspark.sql import Window

    from fieldmend.session import small

    frames = []
    for name, values in factors.items():
        if isinstance(values, DataFrame):
            levels, rows = small(values.select(F.col(values.columns[0]).alias(name)).distinct().where(F.col(name).isNotNull()))
            if rows is None:
                raise ValueError(f"the factor {name} has too many levels")
            frames.append(levels.withColumn(f"fm_{name}", F.col(name)))
        else:
            frames.append(spark.createDataFrame([(v, i) for i, v in enumerate(values)], [name, f"fm_{name}"]))
    grid = reduce(DataFrame.crossJoin, frames)  # a few values each
    return grid.withColumn("scenario_id", F.row_number().over(Window.orderBy(*(f"fm_{n}" for n in factors)))).drop(*(f"fm_{n}" for n in factors))
