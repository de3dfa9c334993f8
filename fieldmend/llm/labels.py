"""What the two classifiers share: folds by crc32, bounded training samples, isotonic calibration, features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most; beyond it, those with the smallest hashes of doc_id.
FIT_ROWS = 60_000


def fold(doc_id: str, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`. A null doc_id is in fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(-1))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and label of about `rows` training rows at most, by a hash threshold. A document with more than
    one label row takes the largest label; null labels are passed over."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(train)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return known


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x (x ascending and distinct): knots and non-decreasing values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [k for s, c, a, b in blocks for k in ((a,) if a == b else (a, b))]
    values = [s / c for s, c, a, b in blocks for _ in ((0,) if a == b else (0, 1))]
    return np.array(knots), np.array(values)


def calibration(scored: DataFrame, bins: int = 2000, smooth: float = 1.0) -> tuple[list[float], list[float]]:
    """Knots of an isotonic map from raw score to the rate of label 1. scored has raw and label; raw scores are
    counted in bins first, so the driver sees so many rows at most. Rates are pulled towards the mean by
    `smooth` rows."""
    counted = scored.groupBy(F.round(F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) * bins / 3).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")
    )
    rows = sorted((r.bin, r.n, r.ones) for r in counted.collect())
    if not rows:
        return [0.0], [0.5]
    b, n, ones = (np.array(v, float) for v in zip(*rows, strict=True))
    mean = ones.sum() / n.sum()
    knots, values = pool_adjacent(b * 3 / bins, ones / n, n)
    # blocks hold many rows; smooth the ends, where they may not
    total = len(values)
    weights = np.full(total, max(1.0, n.sum() / total))
    values = (values * weights + smooth * mean) / (weights + smooth)
    return [float(k) for k in knots], [float(min(1.0, max(0.0, v))) for v in np.maximum.accumulate(values)]


def calibrated(raw: np.ndarray, knots: list[float], values: list[float]) -> np.ndarray:
    return np.interp(raw, knots, values)
