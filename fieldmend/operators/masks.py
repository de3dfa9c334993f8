"""Categorical masks as tables of cells: mask_id, r, c (s for volumes), value; a null value is void. Cells number from 1;
an id counts them with the first axis fastest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmend.operators.metrics import evaluate, joined_on
from fieldmend.operators.repair import repair
from fieldmend.session import cut


def axes_of(cells: DataFrame) -> list[str]:
    return ["r", "c", "s"] if "s" in cells.columns else ["r", "c"]


def from_arrays(df: DataFrame, column: str = "mask") -> DataFrame:
    """Cells of nested arrays (rows of columns, or rows of columns of slices), with mask_id."""
    depth = df.schema[column].dataType.simpleString().count("array<")
    if depth not in (2, 3):
        raise ValueError("a mask is an array of rows of cells, or of rows of columns of cells")
    out = df.select("mask_id", F.posexplode(column).alias("r", "v"))
    for a in ("c", "s")[: depth - 1]:
        out = out.select(*[x for x in out.columns if x != "v"], F.posexplode("v").alias(a, "v2")).withColumnRenamed("v2", "v")
    names = ["r", "c", "s"][:depth]
    return out.select("mask_id", *((F.col(a) + 1).alias(a) for a in names), F.col("v").alias("value"))


def with_id(cells: DataFrame) -> DataFrame:
    """cells with id, their linear index in their mask."""
    names = axes_of(cells)
    size = cells.groupBy("mask_id").agg(*(F.max(a).cast("long").alias(f"n{a}") for a in names))
    joined = cells.join(size, "mask_id")
    number, stride = F.lit(0).cast("long"), F.lit(1).cast("long")
    for a in names:
        number, stride = number + (F.col(a) - 1) * stride, stride * F.col(f"n{a}")
    return joined.withColumn("id", number + 1).drop(*(f"n{a}" for a in names))


def validate_mask(cells: DataFrame) -> None:
    from pyspark.sql import types as T

    kind = cells.schema["value"].dataType
    if not isinstance(kind, (T.StringType, T.BooleanType, T.NumericType)):
        raise ValueError(f"cells hold text, booleans or numbers, not {kind.simpleString()}")
    found = cells.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("kept")).first()
    if not found.n:
        raise ValueError("a mask without cells")
    if not found.kept:
        raise ValueError("all cells of the mask are void")


def face_neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of cells that share a face: mask_id, the cell's axes, value, and turn, other (the neighbour's value)."""
    names = axes_of(cells)
    moves = [(a, d) for a in names for d in (-1, 1)]
    shift = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), *(F.lit(d if a == b else 0).alias(f"d{b}") for b in names)) for k, (a, d) in enumerate(moves))))
    moved = cells.withColumn("m", shift)
    # Each cell is offered to its neighbours: the one at -d sees it in direction d.
    offered = moved.select("mask_id", *((F.col(a) - F.col(f"m.d{a}")).cast("int").alias(a) for a in names), F.col("m.turn").alias("turn"), F.col("value").alias("other"))
    return cells.select("mask_id", *(F.col(a).cast("int").alias(a) for a in names), "value").join(offered, ["mask_id", *names])


def class_boundary(cells: DataFrame) -> DataFrame:
    """Each kept cell with boundary: a face neighbour is kept and of another class."""
    return _flagged(cells, F.col("other").isNotNull() & (F.col("value") != F.col("other")), "boundary")


def _flagged(cells: DataFrame, test: Column, name: str) -> DataFrame:
    """Kept cells with a flag: the test holds for a face neighbour. Cells without neighbours have none."""
    names = axes_of(cells)
    flags = face_neighbours(cells).where(F.col("value").isNotNull()).groupBy("mask_id", *names).agg(F.max(F.coalesce(test, F.lit(False))).alias(name))
    kept = cells.where(F.col("value").isNotNull()).select("mask_id", *(F.col(a).cast("int").alias(a) for a in names), "value")
    return kept.join(flags, ["mask_id", *names], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def inner_boundary(cells: DataFrame) -> DataFrame:
    """Each kept cell with inner: a face neighbour is void or of another class; the edge of the grid does not count."""
    return _flagged(cells, ~F.col("value").eqNullSafe(F.col("other")), "inner")


def adjacent_classes(cells: DataFrame) -> DataFrame:
    """Kept cells with near: the other classes among their face neighbours, in order of direction, each once."""
    names = axes_of(cells)
    others = face_neighbours(cells).where("value is not null and other is not null and other <> value").groupBy("mask_id", *names).agg(F.array_sort(F.collect_list(F.struct("turn", "other"))).alias("o"))
    near = F.array_distinct(F.transform("o", lambda x: x["other"]))
    kept = cells.where("value is not null").select("mask_id", *(F.col(a).cast("int").alias(a) for a in names), "value")
    return kept.join(others, ["mask_id", *names], "left").withColumn("near", F.coalesce(near, F.array().cast("array<string>"))).drop("o")


DIAGNOSTICS = ["candidate", "margin_score", "required", "repair_margin", "atlas_dispersion", "isolation", "changed"]


def clean_mask(cells: DataFrame, levels: list, samples: str | None = None) -> DataFrame:
    """cells with cleaned (of value's type) and diagnostics; void cells stay void, with null diagnostics. levels are
    all values in order; samples names a column that tells specimens apart within a mask."""
    validate_mask(cells)
    names = axes_of(cells)
    kind = cells.schema["value"].dataType
    values = F.array(*map(F.lit, levels)).cast(f"array<{kind.simpleString()}>")
    told = with_id(cells).withColumn("sample", F.col("mask_id") if samples is None else F.concat_ws(":", "mask_id", samples))
    points = told.where(F.col("value").isNotNull()).select("sample", "id", *(F.col(a).cast("double").alias(b) for a, b in zip(names, "xyz", strict=False)), F.array_position(values, F.col("value")).cast("int").alias("code"))
    done = repair(points, len(names), len(levels))
    name = lambda c: F.element_at(values, F.col(c))
    done = done.select("sample", "id", name("refined").alias("cleaned"), name("candidate").alias("candidate"), *DIAGNOSTICS[1:])
    return told.join(done, ["sample", "id"], "left").select(*cells.columns, "cleaned", *DIAGNOSTICS)


def class_overlap(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Per class of the reference: cells in either and in both, IoU and Dice. frame: truth, refined."""
    cells = frame.groupBy(*keys, "truth", "refined").agg(F.count(F.lit(1)).alias("c"))
    ref = cells.groupBy(*keys, F.col("truth").alias("class")).agg(F.sum("c").alias("ref"), F.sum(F.when(F.col("truth") == F.col("refined"), F.col("c")).otherwise(0)).alias("common"))
    pred = cells.groupBy(*keys, F.col("refined").alias("class")).agg(F.sum("c").alias("pred"))
    joined = ref.join(pred, [*keys, "class"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
    return joined.withColumn("iou", F.col("common") / (F.col("ref") + F.col("pred") - F.col("common"))).withColumn("dice", 2 * F.col("common") / (F.col("ref") + F.col("pred")))


def boundary_overlap(reference: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per mask and class of the reference: IoU of the inner boundaries (null where neither has one)."""
    names = axes_of(reference)
    band = lambda m: inner_boundary(m).where("inner").select("mask_id", *names, "value")
    a, b = band(reference).withColumn("a", F.lit(1)), band(cleaned).withColumn("b", F.lit(1))
    met = a.join(b, ["mask_id", *names, "value"], "full").groupBy("mask_id", F.col("value").alias("class")).agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count(F.lit(1)).alias("either")
    )
    classes = reference.where("value is not null").select("mask_id", F.col("value").alias("class")).distinct()
    return classes.join(met, ["mask_id", "class"], "left").withColumn("boundary_iou", F.col("common") / F.col("either"))


def evaluate_cleaning(reference: DataFrame, initial: DataFrame, cleaned: DataFrame, seconds: float | None = None, method: str | None = None) -> DataFrame:
    """One row per mask; only cells that all three have count. The rare class is the reference's smallest."""
    names = axes_of(reference)
    keys = ["mask_id"]
    pick = lambda m, c: m.where("value is not null").select("mask_id", *names, F.col("value").cast("string").alias(c))
    # Each join of cells sorts them; cut, so that no task holds the sorts of all joins at once.
    frame = cut(pick(reference, "truth").join(pick(initial, "initial"), [*keys, *names]).join(pick(cleaned, "refined"), [*keys, *names]))
    joint = lambda c: reference.select("mask_id", *names).join(frame.select("mask_id", *names, F.col(c).alias("value")), [*keys, *names], "left")
    edge = cut(class_boundary(joint("truth")).select("mask_id", *names, "boundary"))
    frame = cut(frame.join(edge, [*keys, *names]))
    base = evaluate(frame, keys, seconds)
    over = class_overlap(frame, keys)
    sums = over.groupBy(*keys).agg(
        F.avg("iou").alias("mean_iou"), F.min("iou").alias("worst_iou"), (F.sum(F.col("iou") * F.col("ref")) / F.sum("ref")).alias("frequency_weighted_iou"), F.avg("dice").alias("macro_dice"),
        F.min_by("class", F.struct("ref", "class")).alias("rare_class"), F.min_by("iou", F.struct("ref", "class")).alias("rare_class_iou"),
    )
    bands = boundary_overlap(joint("truth"), joint("refined")).groupBy(*keys).agg(F.avg("boundary_iou").alias("mean_boundary_iou"))
    right, was = F.col("refined") == F.col("truth"), F.col("initial") == F.col("truth")
    moved = frame.groupBy(*keys).agg(F.avg(F.col("boundary").cast("double")).alias("boundary_fraction"), F.avg((right & ~was).cast("double")).alias("repaired_fraction"), F.avg((~right & was).cast("double")).alias("damaged_fraction"))
    out = reduce(lambda a, b: joined_on(a, b, keys), [base, sums, bands, moved])
    out = out.withColumn("repair_identity_error", F.abs(F.col("accuracy_gain") - (F.col("repaired_fraction") - F.col("damaged_fraction"))))
    return out if method is None else out.select(F.lit(method).alias("method"), "*")
