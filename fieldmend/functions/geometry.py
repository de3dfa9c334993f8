"""Coordinates: robust scaling, charts (rotations), space-filling-curve codes."""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import accumulate
from operator import xor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmend.functions.quantiles import percentiles
from fieldmend.session import small

AXES = ("x", "y", "z")
BITS = 16
CHARTS = {2: 7, 3: 9}
#: Fractional parts of the golden ratio and of the roots of two and three (fixed values).
GOLDEN, ROOT_TWO, ROOT_THREE = 0.6180339887498949, 0.4142135623730951, 0.7320508075688772


def axes(dims: int) -> tuple[str, ...]:
    if dims not in (2, 3):
        raise ValueError(f"points lie in two or three dimensions, not in {dims}")
    return AXES[:dims]


def rotation(dims: int, chart: int) -> list[list[float]]:
    """The matrix of a chart, applied to row vectors: new[k] = sum of old[j] * m[j][k]."""
    if dims == 2:
        a = math.pi * math.fmod(chart * GOLDEN, 1.0)
        return [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]
    u, v, w = (math.fmod(start + chart * by, 1.0) for start, by in ((0.5, ROOT_TWO), (0.25, GOLDEN), (0.75, ROOT_THREE)))
    inner, outer = math.sqrt(1.0 - u), math.sqrt(u)
    i, j = inner * math.sin(2.0 * math.pi * v), inner * math.cos(2.0 * math.pi * v)
    k, r = outer * math.sin(2.0 * math.pi * w), outer * math.cos(2.0 * math.pi * w)
    return [
        [1.0 - 2.0 * (j * j + k * k), 2.0 * (i * j - k * r), 2.0 * (i * k + j * r)],
        [2.0 * (i * j + k * r), 1.0 - 2.0 * (i * i + k * k), 2.0 * (j * k - i * r)],
        [2.0 * (i * k - j * r), 2.0 * (j * k + i * r), 1.0 - 2.0 * (i * i + j * j)],
    ]


def scaled(names: tuple[str, ...], of: str = "{}") -> dict[str, Column]:
    """Coordinates (or their ends, named by `of`) by the 1st and 99th percentile q of the axis, cut off at -0.1 and 1.1."""
    out = {}
    for a in names:
        low, high = F.col(f"q{a}")[0], F.col(f"q{a}")[1]
        out[a] = F.least(F.lit(1.1), F.greatest(F.lit(-0.1), (F.col(of.format(a)) - low) / F.greatest(high - low, F.lit(1e-12))))
    return out


def specimens(points: DataFrame, dims: int) -> tuple[DataFrame, list[dict] | None]:
    """Of each specimen: sample, n, qx, qy (qz), the 1st and 99th percentiles, spread (some scaled axis has two values) and,
    where points have a code, observed (classes) and top (largest code). A small table, as of session.small."""
    names = axes(dims)
    known = [F.count_distinct("code").alias("observed"), F.max("code").alias("top")] if "code" in points.columns else []
    ends = [f(F.col(a).cast("double")).alias(f"{e}_{a}") for a in names for e, f in (("least", F.min), ("most", F.max))]
    sizes, rows = small(points.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), *ends, *known))
    largest = None if rows is None else max((r["n"] for r in rows), default=0)
    cuts = percentiles(points, ["sample"], {f"q{a}": F.col(a).cast("double") for a in names}, [0.01, 0.99], largest)
    both = sizes.join(cuts, "sample")
    low, high = scaled(names, "least_{}"), scaled(names, "most_{}")
    spread = reduce(lambda p, q: p | q, [high[a] > low[a] for a in names])
    return small(both.select("sample", "n", *(f"q{a}" for a in names), spread.alias("spread"), *(["observed", "top"] if known else [])))


def robust_unit(points: DataFrame, dims: int, stats: DataFrame | None = None) -> DataFrame:
    """points with ux, uy (uz): scaled by the 1st and 99th percentile of the specimen, cut off at -0.1 and 1.1."""
    names = axes(dims)
    stats = specimens(points.drop("code"), dims)[0] if stats is None else stats
    joined = points.join(stats.select("sample", *(f"q{a}" for a in names)), "sample")
    return joined.withColumns({f"u{a}": c for a, c in scaled(names).items()}).drop(*(f"q{a}" for a in names))


def charts(points: DataFrame, dims: int, count: int | None = None) -> DataFrame:
    """Each point in each chart: chart, and t0, t1 (t2), the rotated unit coordinates."""
    n = count or CHARTS[dims]
    matrices = [rotation(dims, c) for c in range(n)]
    rows = F.array(*(F.struct(F.lit(c).alias("chart"), *(F.lit(m[j][k]).alias(f"r{j}{k}") for j in range(dims) for k in range(dims))) for c, m in enumerate(matrices)))
    wide = points.withColumn("r", F.explode(rows))
    u = [F.col(f"u{a}") for a in axes(dims)]
    turned = [reduce(lambda s, x: s + x, [u[j] * F.col("r")[f"r{j}{k}"] for j in range(dims)]).alias(f"t{k}") for k in range(dims)]
    return wide.select(*points.columns, F.col("r.chart").alias("chart"), *turned)


def chart_cells(points: DataFrame, dims: int) -> DataFrame:
    """Each point (with u) in each chart: chart, and a0, a1 (a2), the chart's coordinates as whole numbers of BITS bits
    between the least and the largest of the specimen. The ends come from one pass over the points themselves."""
    n, u = CHARTS[dims], [F.col(f"u{a}") for a in axes(dims)]
    turned = [[reduce(lambda s, x: s + x, [u[j] * F.lit(m[j][k]) for j in range(dims)]) for k in range(dims)] for m in (rotation(dims, c) for c in range(n))]
    ends = [F.array(*(f(t) for t in row)).alias(f"{e}{c}") for c, row in enumerate(turned) for e, f in (("low", F.min), ("high", F.max))]
    ends, _ = small(points.groupBy("sample").agg(*ends))
    each = F.array(*(F.struct(F.lit(c).alias("chart"), F.array(*row).alias("t"), F.col(f"low{c}").alias("low"), F.col(f"high{c}").alias("high")) for c, row in enumerate(turned)))
    wide = points.join(ends, "sample").select(*points.columns, F.inline(each))

    def cell(k: int) -> Column:
        lo, hi = F.col("low")[k], F.col("high")[k]
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 1e-12), (F.col("t")[k] - lo) / F.greatest(hi - lo, F.lit(1e-12))))
        return F.floor(unit * ((1 << BITS) - 1)).cast("long").alias(f"a{k}")

    return wide.select(*points.columns, "chart", *(cell(k) for k in range(dims)))


@lru_cache(4)
def hilbert_table(dims: int, levels: int) -> list[int]:
    """Skilling's transform as a table for `levels` bits of each axis at once, from the highest down. What the bits above do to
    a bit is a state: an order of the axes, which are inverted, and the parity of what the last axis had. Index: the state, then
    the axes' bits; value: the next state, then the curve's bits."""
    start = (tuple(range(dims)), (0,) * dims, 0)
    number, todo, rows = {start: 0}, [start], []

    def step(state, bits):
        order, inverted, parity = state
        x = [bits[order[k]] ^ inverted[k] for k in range(dims)]
        order, inverted = list(order), list(inverted)
        for k in range(dims):
            if x[k]:
                inverted[0] ^= 1
            else:
                order[0], order[k], inverted[0], inverted[k] = order[k], order[0], inverted[k], inverted[0]
        gray = list(accumulate(x, xor))
        digit = reduce(lambda d, g: 2 * d + (g ^ parity), gray, 0)
        return (tuple(order), tuple(inverted), parity ^ gray[-1]), digit

    width = dims * levels
    while todo:
        state = todo.pop(0)
        for packed in range(1 << width):
            now, out = state, 0
            for b in range(levels - 1, -1, -1):
                now, digit = step(now, [packed >> (levels * (dims - 1 - k) + b) & 1 for k in range(dims)])
                out = out << dims | digit
            if now not in number:
                number[now] = len(number)
                todo.append(now)
            rows.append(number[now] << width | out)
    return rows


def hilbert_code(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve, by a few look-ups. cells are whole numbers of `bits` bits."""
    dims = len(cells)
    levels = {2: 4, 3: 2}[dims]
    width = dims * levels
    # A string, so that the plan holds one constant and not one for each entry.
    table = F.split(F.lit(",".join(map(str, hilbert_table(dims, levels)))), ",").cast("array<bigint>")
    found, code = None, F.lit(0).cast("long")
    for at in range(bits - levels, -1, -levels):
        part = reduce(lambda s, c: F.shiftleft(s, levels).bitwiseOR(F.shiftright(c.cast("long"), at).bitwiseAND((1 << levels) - 1)), cells, F.lit(0).cast("long"))  # noqa: B023
        place = part if found is None else found.bitwiseAND(F.lit(-1 << width).cast("long")).bitwiseOR(part)
        found = F.get(table, place.cast("int"))
        code = F.shiftleft(code, width).bitwiseOR(found.bitwiseAND((1 << width) - 1))
    return code
