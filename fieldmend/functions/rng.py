"""A counter-based random source: each draw is a hash of seed, stream and row, so a result depends neither on
partitioning nor on the order of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *ids: str | Column) -> Column:
    """Uniform in [0, 1): 52 bits of an md5."""
    return F.conv(F.substring(_digits(seed, stream, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def below(seed: int, stream: str, share: float, *ids: str | Column) -> Column:
    """Whether uniform is less than a share, by the digits alone, which costs half as much."""
    least = math.ceil(share * (1 << 52))
    return F.lit(share > 0) if not 0 < least < 1 << 52 else _digits(seed, stream, *ids) < F.lit(f"{least:013x}")


def _digits(seed: int, stream: str, *ids: str | Column) -> Column:
    parts = [F.lit(str(seed)), F.lit(stream), *((F.col(i) if isinstance(i, str) else i).cast("string") for i in ids)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def normal(seed: int, stream: str, *ids: str | Column) -> Column:
    """Standard normal, by Box and Muller's transform of two streams."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, stream + ".r", *ids)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, stream + ".a", *ids))


def pick(seed: int, stream: str, n: Column | int, *ids: str | Column) -> Column:
    """An integer from 0 to n - 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(uniform(seed, stream, *ids) * n), n - 1).cast("int")


def weighted_key(seed: int, stream: str, weight: Column, *ids: str | Column) -> Column:
    """The smallest m of these keys are a weighted sample of m rows without replacement. Rounded, so that rows
    are never told apart by the last bits of a logarithm."""
    return F.round(-F.log(F.lit(1.0) - uniform(seed, stream, *ids)) / weight, 12)
