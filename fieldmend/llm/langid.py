"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, each stretch of characters that are not letters becomes one gap, and its n-grams of letters and
gaps (one to three characters) fall into BUCKETS hash buckets. Training documents are counted per language
and bucket, partition by partition, and Spark adds the counts up. The smoothed logarithms of the rates make a matrix of
one row per bucket and one column per language, which is broadcast; its size is bounded by CELLS and doesn't grow with
the documents. Each batch is scored sparsely: of its n-grams only the distinct buckets of each text are looked up, weighted by
how often they occur.

Learnt are the languages of training rows with text and lang, up to FIT_ROWS documents of each, chosen by a hash of
doc_id (a documented bound on the fit; every text is scored, and whole). lang, source and doc_id never enter a prediction, so
equal texts have equal ones. The score is the model's posterior probability of the predicted language.

Defined results: null texts and texts without a letter are `und` with score 0, as are all where there is nothing to learn from;
ties take the language that sorts first; a null doc_id counts as a training row; repeated rows give a row each; other columns
are passed over, whatever their names. More languages than CELLS holds raise an error.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .labels import fold

#: Hash buckets, sizes of n-grams, what is added to each count, training documents of a language, numbers in the matrix at most.
BUCKETS, SIZES, SMOOTH, FIT_ROWS, CELLS = 1 << 16, (1, 2, 3), 0.1, 20_000, 1 << 24
#: Texts are cut into stretches of so many characters for the work; stretches overlap, so all n-grams are counted.
STRETCH = 1 << 20
_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's n-grams, ascending, and how often each occurs; none without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    found = []
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for a in range(0, len(codes), STRETCH):
        hashed = []
        for n in sizes:
            part = codes[a : a + STRETCH + n - 1]
            m = max(0, len(part) - n + 1)
            h = part[:m] * _FACTORS[0] + np.uint64(n)
            for j in range(1, n):
                h += part[j : j + m] * _FACTORS[j]
            hashed.append(h)
        h = np.concatenate(hashed)
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        h = np.sort(h.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        found.append((h[first].astype(np.int64), np.diff(first, append=len(h))))
    if len(found) == 1:
        return found[0]
    total = np.zeros(buckets, np.int64)
    for at, n in found:
        total[at] += n
    at = np.flatnonzero(total)
    return at, total[at]


def learn(docs: DataFrame, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, fit_rows: int = FIT_ROWS, smooth: float = SMOOTH) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of docs (doc_id, text, lang; all of them training rows), ascending, their log priors and the matrix of log rates
    (bucket, language)."""
    docs = docs.where("text is not null and lang is not null")
    most = CELLS // buckets
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"there are more than {most} languages to learn")
    names = sorted(r["lang"] for r in found)
    if not names:
        return [], np.zeros(0), np.zeros((buckets, 0))
    counts = {r["lang"]: r["n"] for r in found}
    rates = docs.sparkSession.createDataFrame([(x, k, min(1.0, fit_rows / counts[x])) for k, x in enumerate(names)], "lang string, code int, rate double")
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.join(F.broadcast(rates), "lang").where(share < F.col("rate")).select("code", "text")
    languages = len(names)

    def count(batches):
        sums = np.zeros((languages, buckets), np.int64)
        for batch in batches:
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = grams(text.as_py(), sizes, buckets)
                sums[code, at] += n
        code, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[code, at])], names=["code", "bucket", "n"])

    cells = sample.mapInArrow(count, "code int, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n")).toArrow()  # CELLS at most
    table = np.full((buckets, languages), smooth)
    table[cells["bucket"].to_numpy(), cells["code"].to_numpy()] += cells["n"].to_numpy()
    prior = np.log(np.array([counts[x] for x in names], float) / sum(counts.values()))
    return names, prior, np.log(table) - np.log(table.sum(axis=0))


def identify(docs: DataFrame, folds: int = 3, held: int = 1, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, fit_rows: int = FIT_ROWS, smooth: float = SMOOTH) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs. Rows of fold `held` (crc32 of doc_id modulo `folds`) are not learnt from."""
    spark = docs.sparkSession
    text_batches(spark)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    train = docs.select(*columns, F.col("lang").cast("string").alias("lang")).where(fold("doc_id", folds) != held)
    names, prior, matrix = learn(train, buckets, sizes, fit_rows, smooth)
    shared = spark.sparkContext.broadcast((names, prior, matrix))  # CELLS numbers at most

    def score(batches):
        names, prior, matrix = shared.value
        for batch in batches:
            best, sure = [], []
            for text in batch.column(1):
                at, n = grams(text.as_py(), sizes, buckets)
                if not len(at) or not names:
                    best.append("und")
                    sure.append(0.0)
                    continue
                each = prior + n @ matrix[at]
                k = int(each.argmax())
                best.append(names[k])
                sure.append(float(1 / np.exp(each - each[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    done = docs.select(*columns).mapInArrow(score, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
