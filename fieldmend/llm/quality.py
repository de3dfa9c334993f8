"""Quality classifier: random Fourier features over document statistics.

Each text becomes a vector of statistics (lengths, character classes, repetition). Standardised, they go
through `features` random cosines, whose dot products approximate a Gaussian kernel. Ridge weights solve the
normal equations, which partitions sum by themselves and Spark adds up. Scores of rows kept out of that fit give
an isotonic map to probabilities.

Labels come only from rows of training folds; labels, lang, source and doc_id never enter a score, so equal
texts have equal scores. The fit takes at most FIT_ROWS labelled rows (a documented bound); every text is scored
whole. Defined results: null texts are empty; empty texts get the score of their statistics; with no labelled rows
or one class, the score is the mean label, or 0.5; repeated rows give a row each; other columns are passed over.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_batches, unpacked
from .labels import FIT_ROWS, calibrated, calibration, fit_sample, fold

FEATURES, GAMMA, RIDGE, SEED = 256, 0.04, 1.0, 20240101
_MARKS = re.compile(rb"[!?#$%&*|~^=<>\\@_+{}\[\]/-]{2,}")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, whatever its language; shares of bytes, words and lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * 22
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words = data.split()
    m = max(1, len(words))
    lower = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    starts = len(set(lower)) / m
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(lower, lower[1:], strict=False))) / max(1, m - 1) if m > 1 else 1.0
    marked = len(_MARKS.findall(data)) / m
    stops = count[46] + count[33] + count[63]
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(size.mean()),
        float(min(size.std(), 50.0)),
        float(starts),
        float(pairs),
        float(count[65:91].sum()),
        float(count[97:123].sum()),
        float(count[48:58].sum()),
        float(count[128:].sum()),
        float(count[32]),
        float(count[10] * 10),
        float(count[44]),
        float(stops),
        float(count[33]),
        float(count[124]),
        float(count[35:39].sum() + count[42] + count[94] + count[126]),
        float(count[60:63].sum() + count[123] + count[125] + count[91] + count[93] + count[92]),
        float(min(1.0, marked)),
        float(len(set(lines)) / max(1, len(lines))),
        float(np.log1p(np.mean([len(x) for x in lines])) if lines else 0.0),
        float(sum(1 for x in lines if x[-1:] in b".!?:;\"'") / max(1, len(lines))),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array) of each row."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches):
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.mapInArrow(measure, "doc_id long, stats array<double>")


class Kernel:
    """Random cosines of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, np.sqrt(2 * gamma), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])


def _matrix(column) -> np.ndarray:
    width = len(column[0]) if len(column) else 1
    flat = column.flatten() if hasattr(column, "flatten") else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def normal_equations(train: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over train (stats, label) of f f', f y and rows. Each partition adds up its own; a row of the result
    is one row of the matrix, summed by Spark per row."""
    d = len(kernel.b) + 1

    def add(batches):
        a, b, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            if batch.num_rows:
                f, y = kernel(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                a, b, n = a + f.T @ f, b + f.T @ y, n + len(y)
        if n:
            values = np.hstack([a, b[:, None], np.full((d, 1), float(n))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d + 2)), pa.array(np.tile(np.arange(d + 2), d)), pa.array(values.ravel())], names=["i", "j", "v"])

    parts = train.select("stats", "label").mapInArrow(add, "i long, j long, v double")
    out = np.zeros((d, d + 2))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # the size of the model
        out[r.i, r.j] = r.v
    return out[:, :d], out[:, d], float(out[0, d + 1])


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, label: str = "quality", features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """doc_id, held_out and score of each row of docs. Rows of fold `held` (crc32 of doc_id modulo `folds`) lend
    no labels."""
    measured = stored(with_statistics(docs), "statistics")
    sample = fit_sample(docs, labels, label, fold("doc_id", folds) != held, fit_rows)
    train = measured.join(sample, "doc_id").dropDuplicates(["doc_id"])
    parts = max(1, min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    train = stored(train.repartition(parts, "doc_id").sortWithinPartitions("doc_id"), "train")
    width = len(statistics(""))
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"), *(f(F.col("stats")[k]).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    held_out = (fold("doc_id", folds) == held).alias("held_out")
    if not sums.n or sums.rate in (0.0, 1.0):
        return measured.select("doc_id", held_out, F.lit(0.5 if not sums.n else float(sums.rate)).alias("score"))
    mean = np.array([sums[f"m{k}"] for k in range(width)])
    scale = np.array([sums[f"s{k}"] or 1.0 for k in range(width)])
    kernel = Kernel(mean, scale, features, gamma, SEED)
    # A fifth of the training rows is kept out of the ridge fit, for the calibration.
    apart = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0
    a, b, _ = normal_equations(train.where(~apart), kernel)
    penalty = ridge * np.eye(len(b))
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(a + penalty, b)

    def raw(column) -> np.ndarray:
        return kernel(_matrix(column)) @ weights if len(column) else np.zeros(0)

    def score_train(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(raw(batch.column(0))), batch.column(1)], names=["raw", "label"])

    knots, values = calibration(train.where(apart).select("stats", "label").mapInArrow(score_train, "raw double, label int"))

    def score(batches):
        for batch in batches:
            done = calibrated(raw(batch.column(1)), knots, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.float64())], names=["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out, "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs without those that score below the threshold; all columns stay. Rows that share a doc_id share their best score."""
    bad = score_quality(docs, labels, **options).groupBy("doc_id").agg(F.max("score").alias("fm_score")).where(F.col("fm_score") < threshold)
    bad = bad.select(F.col("doc_id").alias("fm_doc"))
    kept = packed(docs, F.col("doc_id").cast("long").alias("fm_id")).join(bad, F.col("fm_id").eqNullSafe(F.col("fm_doc")), "left_anti")
    return kept.select(*unpacked(kept, docs.columns))
