"""Tiles of large specimens: cores that cut a specimen without overlap, and halos around them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmend.functions.geometry import axes
from fieldmend.operators.graph import VoteSettings, vote_in_leaves
from fieldmend.operators.knn import automatic_neighbours, nearest_lists
from fieldmend.session import cut, small


def balanced_counts(spans: list[float], target: int) -> list[int]:
    """Tiles per axis: the axis with the widest tiles is cut once more until there are `target` tiles."""
    spans, counts = [s if s > 0 else 1.0 for s in spans], [1] * len(spans)
    while math.prod(counts) < target:
        widths = [s / c for s, c in zip(spans, counts, strict=True)]
        counts[widths.index(max(widths))] += 1
    return counts


def layout(points: DataFrame, dims: int, target_size: int = 100_000, counts: list[int] | None = None) -> DataFrame:
    """sample, and per axis lo, width and count of its tiles; a row per specimen."""
    names = axes(dims)
    box = points.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{p}{a}") for a in names for p, f in (("lo", F.min), ("hi", F.max))))
    fixed = counts

    def split(pdf):
        import numpy as np

        out = pdf[["sample", *(f"lo{a}" for a in names)]].copy()
        spans = np.stack([(pdf[f"hi{a}"] - pdf[f"lo{a}"]).to_numpy(float) for a in names], axis=1)
        cuts = [fixed or balanced_counts(list(s), math.ceil(n / target_size)) for s, n in zip(spans, pdf["n"], strict=True)]
        for k, a in enumerate(names):
            c = np.array([x[k] for x in cuts], float)
            w = spans[:, k] / np.maximum(c, 1)
            out[f"w{a}"], out[f"c{a}"] = np.where(w == 0, 1.0, w), c.astype("int32")
        return out

    schema = "sample string, " + ", ".join(f"lo{a} double" for a in names) + ", " + ", ".join(f"w{a} double, c{a} int" for a in names)
    return box.mapInPandas(lambda it: map(split, it), schema)


def tiles(points: DataFrame, grid: DataFrame, dims: int, overlap: float = 0.15) -> DataFrame:
    """sample, tile, id, is_core: each point in the tile that is its own and in those whose halo it is in. Tiles are
    numbered from 1, the first axis fastest. A point is offered to its own tile and its neighbours only, so overlap
    is at most 1."""
    return _dealt(points.select("sample", "id", *axes(dims)), grid, dims, overlap).select("sample", "tile", "id", "is_core")


def _dealt(points: DataFrame, grid: DataFrame, dims: int, overlap: float) -> DataFrame:
    """Whole rows of points with tile and is_core, as in tiles."""
    if not 0 <= overlap <= 1:
        raise ValueError(f"halos overlap by 0 to 1 of a tile, not {overlap}")
    names = axes(dims)
    joined = points.select("sample", *names, F.struct(*points.columns).alias("fm_row")).join(small(grid)[0], "sample")
    for a in names:
        here = F.least(F.greatest(F.floor((F.col(a) - F.col(f"lo{a}")) / F.col(f"w{a}")), F.lit(0)), F.col(f"c{a}") - 1)
        # Rounding in the division must not put a point beyond the edge that the tile is compared with.
        here = F.when(F.col(a) < F.col(f"lo{a}") + here * F.col(f"w{a}"), here - 1).when((here < F.col(f"c{a}") - 1) & (F.col(a) >= F.col(f"lo{a}") + (here + 1) * F.col(f"w{a}")), here + 1).otherwise(here)
        joined = joined.withColumn(f"own{a}", here.cast("int")).withColumn(f"t{a}", F.explode(F.sequence(F.greatest(F.col(f"own{a}") - 1, F.lit(0)), F.least(F.col(f"own{a}") + 1, F.col(f"c{a}") - 1))))
        low, high = F.col(f"lo{a}") + F.col(f"t{a}") * F.col(f"w{a}"), F.col(f"lo{a}") + (F.col(f"t{a}") + 1) * F.col(f"w{a}")
        inside = ((F.col(f"t{a}") == 0) | (F.col(a) >= low - overlap * F.col(f"w{a}"))) & ((F.col(f"t{a}") == F.col(f"c{a}") - 1) | (F.col(a) <= high + overlap * F.col(f"w{a}")))
        joined = joined.where(inside | (F.col(f"t{a}") == F.col(f"own{a}")))
    number, stride = F.lit(1), F.lit(1)
    for a in names:
        number, stride = number + F.col(f"t{a}") * stride, stride * F.col(f"c{a}")
    core = reduce(lambda p, q: p & q, [F.col(f"t{a}") == F.col(f"own{a}") for a in names])
    return joined.select("fm_row.*", number.cast("int").alias("tile"), core.alias("is_core"))


def as_specimens(points: DataFrame, dims: int, overlap: float = 0.15, target_size: int = 100_000, counts: list[int] | None = None) -> DataFrame:
    """points of each tile with its halo as specimens of their own (sample#tile), with of (the specimen), tile and is_core. A tile
    with less than three points goes without its halo, one without a core not at all. Points are dealt once, as many passes
    over the tiles follow."""
    dealt = cut(_dealt(points, layout(points, dims, target_size, counts), dims, overlap))
    lean, _ = small(tile_summary(dealt).where("halo_n < 3 or core_n = 0").select("sample", "tile", F.lit(True).alias("fm_lean")))
    dealt = dealt.join(lean, ["sample", "tile"], "left").where("is_core or fm_lean is null").drop("fm_lean")
    return dealt.where("id is not null").withColumn("of", F.col("sample")).withColumn("sample", F.concat_ws("#", "of", F.col("tile").cast("string")))


def in_tiles(points: DataFrame, dims: int, refine, overlap: float = 0.15, target_size: int = 100_000, counts: list[int] | None = None) -> DataFrame:
    """refine applied to each tile with its halo, as a specimen of its own; the cores' rows come back under the
    specimen's name, with tile. refine takes and returns frames with sample and id."""
    wide = as_specimens(points, dims, overlap, target_size, counts)
    keys = wide.select("sample", "id", "of", "tile", "is_core")
    done = refine(wide.drop("of", "tile", "is_core")).join(keys, ["sample", "id"]).where("is_core")
    return done.drop("sample", "is_core").withColumnRenamed("of", "sample")


def vote_in_tiles(
    points: DataFrame, dims: int, classes: int, settings: VoteSettings | None = None, k: int | None = None, overlap: float = 0.15, target_size: int = 100_000, counts: list[int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The iterated vote in tiles: points with tile, refined and confidence, and a row per tile: sample, tile, core_n, halo_n,
    neighbors (k, or what suits the specimen's size and classes, rounded to even) and final_changes of its core. All tiles sweep in
    lock step; one that has come to rest stays as it is, so each ends as it would alone."""
    sizes = points.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("classes"))
    number = F.lit(k) if k else automatic_neighbours(F.col("n"), F.col("classes"), half_even=True)
    wanted, _ = small(sizes.select(F.col("sample").alias("of"), number.alias("wanted")))
    wide = as_specimens(points, dims, overlap, target_size, counts).join(wanted, "of")
    # No name for the lists, so that Spark may remove the search's checkpoint as soon as the vote has its own.
    done, _ = vote_in_leaves(nearest_lists(wide, dims, "wanted", "code", ("dst",), leaf=True, at=True), classes, settings)
    joined = wide.join(done, ["sample", "id"])
    changed = F.count_if(F.col("is_core") & (F.col("refined") != F.col("code")))
    rows = joined.groupBy(F.col("of").alias("sample"), "tile").agg(F.count_if("is_core").alias("core_n"), F.count(F.lit(1)).alias("halo_n"), F.max("wanted").alias("wanted"), changed.alias("final_changes"))
    rows = rows.select("sample", "tile", "core_n", "halo_n", F.least(F.col("wanted"), F.col("halo_n") - 1).cast("int").alias("neighbors"), "final_changes")
    return joined.where("is_core").drop("sample", "is_core", "wanted").withColumnRenamed("of", "sample"), rows


def tile_summary(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("sample", "tile").agg(F.count_if("is_core").alias("core_n"), F.count(F.lit(1)).alias("halo_n"))
