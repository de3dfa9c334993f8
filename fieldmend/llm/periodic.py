"""Periodic runs of words: stretches that repeat a short block over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(least, times q) that no neighbouring word extends keeping period q. The steps, for all texts of a batch at once:

1. Words become numbers, texts are laid end to end, the longest first, with a mark of its own between any two, so
   that no run crosses from one to the next.
2. Harmonic grid: a run of period q holds max(least, times q) - q places or more whose word equals the one q further
   on, so each multiple of that number is a grid point. For all periods there are n log n pairs (period, grid point), dealt
   out in blocks of GRID pairs; of a text as many as its own length asks for.
3. Of all pairs of a block whose words are equal, the longest common extensions to the right and to the left are found
   simultaneously, by binary search on prefix hashes modulo a prime.
4. Hashes can only make an extension too long, so each stretch found is verified word for word; where they differ, the
   words between are compared one by one. Equal stretches keep their smallest period.

Words: what stands between spaces, tabs and line ends (0x09-0x0D, 0x20). Each text is whole in one task, as a row is;
memory is a few numbers per word of a batch and of a block. There is no shuffle.

Defined results: null, empty and wordless texts have no words, no runs and an empty collapsed text; `planted` leaves texts
of a null doc_id as they are; repeated rows give a row each; other columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Pairs of period and grid point that are looked at together; words of short texts that are laid end to end.
GRID, WORDS = 1 << 20, 1 << 20
#: A prime below 2 ** 31, so that products of two residues fit 64 bits, and the base of the hashes.
PRIME, BASE = (1 << 31) - 1, 1_000_003
WORD = r"[^\x20\x09-\x0D]+"


class Prefixes:
    """Hashes of any stretch of numbers, by prefix sums of number times power of the base."""

    def __init__(self, numbers: np.ndarray, prime: int, base: int = BASE):
        n, self.prime = len(numbers), np.int64(prime)
        self.powers = np.ones(n + 1, np.int64)
        done, step = 1, base % prime
        while done <= n:
            more = min(done, n + 1 - done)
            self.powers[done : done + more] = self.powers[:more] * step % prime
            done, step = done + more, step * step % prime
        self.sums = np.zeros(n + 1, np.int64)
        np.cumsum(numbers % prime * self.powers[:n] % prime, out=self.sums[1:])
        self.sums %= prime

    def equal(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths at `at` and at `at + apart` have the same hash."""
        first = (self.sums[at + length] - self.sums[at]) % self.prime * self.powers[apart] % self.prime
        second = (self.sums[at + apart + length] - self.sums[at + apart]) % self.prime
        return first == second

    def extend(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """For all pairs at once: how many words from `at` on (or before it) equal those `apart` further on, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(at[open_] - middle if back else at[open_], apart[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low


def _grid(reach: np.ndarray, step: np.ndarray):
    """Blocks of pairs (period, grid point): of each period q = 1, 2, ... the multiples of its step below its reach."""
    counts = np.maximum(0, -(-reach // step))
    first = np.concatenate(([0], np.cumsum(counts)))
    for a in range(0, int(first[-1]), GRID):
        pair = np.arange(a, min(a + GRID, int(first[-1])))
        k = np.searchsorted(first, pair, side="right") - 1
        yield k + 1, (pair - first[k]) * step[k]


def _verified(w: np.ndarray, start: int, end: int, q: int, need: int) -> list[tuple[int, int]]:
    """The stretches within start to end whose words q apart are equal, whole and at both ends: mostly this one."""
    same = w[start : end - q] == w[start + q : end]
    if same.all():
        return [(start, end)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    out = []
    for a, b in zip(edges[::2] + start, edges[1::2] + start, strict=True):
        while a > 0 and w[a - 1] == w[a - 1 + q]:
            a -= 1
        while b + q < len(w) and w[b] == w[b + q]:
            b += 1
        if b - a + q >= need:
            out.append((int(a), int(b + q)))
    return out


def runs_of(texts: list[np.ndarray], least: int = 6, times: int = 4, prime: int = PRIME) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, a list of word numbers from 0 up, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(order) or sizes[order[0]] < least:
        return found
    order = order[: int(np.searchsorted(-sizes[order], -least, side="right"))]
    parts = [np.array([-1], np.int64)]
    for place, k in enumerate(order):
        parts += [texts[k], np.array([-2 - place], np.int64)]
    w = np.concatenate(parts)
    ends = np.cumsum(sizes[order] + 1)
    starts = ends - sizes[order]
    owner = np.repeat(np.arange(len(order)), sizes[order] + 1)  # of word place + 1; a mark belongs to the text before it
    period = np.arange(1, max(1, int(sizes[order[0]]) // times) + 1)
    need = np.maximum(least, times * period)
    held = np.searchsorted(-sizes[order], -need, side="right")  # texts that are long enough for the period
    reach = np.where(held > 0, ends[held - 1] - period, 0)
    hashes = Prefixes(w + len(order) + 2, prime)
    spans: list[np.ndarray] = []
    for q, at in _grid(reach, need - period):
        hit = np.flatnonzero(w[at] == w[at + q])
        at, q = at[hit], q[hit]
        own = owner[np.maximum(at - 1, 0)]
        inside = np.flatnonzero(own == owner[np.maximum(at + q - 1, 0)])
        at, q, own = at[inside], q[inside], own[inside]
        start = at - hashes.extend(at, q, at - starts[own], back=True)
        end = at + q + hashes.extend(at, q, ends[own] - at - q, back=False)
        long = np.flatnonzero(end - start >= need[q - 1])
        if long.size:
            spans.append(np.unique(np.stack([start[long], end[long], q[long]], axis=1), axis=0))
    if not spans:
        return found
    kept: dict[tuple[int, int], int] = {}
    last, whole = None, 0
    for start, end, q in np.unique(np.concatenate(spans), axis=0).tolist():
        if (start, end) == last and q % whole == 0:
            continue  # a multiple of a period that holds
        for a, b in _verified(w, start, end, q, int(need[q - 1])):
            kept[a, b] = min(q, kept.get((a, b), q))
            if (a, b) == (start, end):
                last, whole = (start, end), q
    for (a, b), q in kept.items():
        own = int(np.searchsorted(starts, a, side="right")) - 1
        found[order[own]].append((a - int(starts[own]), b - a, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that any run holds after its first period, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edge[start + q] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed (the text with each run cut to its first period) of each row."""
    if times < 2 or least < 2:
        raise ValueError("a run is at least two periods and two words long")
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(batches):
        for batch in batches:
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            words, sizes, runs, texts = [], [], [], []

            def done():
                ids = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in words]
                for t, found in zip(words, runs_of(ids, least, times), strict=True):
                    sizes.append(len(t))
                    runs.append(found)
                    texts.append(collapsed(t, found))
                words.clear()

            total = 0
            for text in batch.column(1):
                words.append((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                total += len(words[-1])
                if total >= WORDS:
                    done()
                    total = 0
            done()
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(f) for f in runs]))).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts end in a period of their own: with h = crc32 of the decimal doc_id,
    g = h div 10, texts of n > 0 words with h mod 10 = 0 repeat the p = 1 + (n - a) div (3 + g mod 8) words from a = g mod n
    on to their end."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = kept.withColumn("fm_words", F.when(h % 10 == 0, words)).withColumn("fm_n", F.size("fm_words"))
    g, n = F.floor(h / 10), F.col("fm_n")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    kept = kept.withColumn("fm_a", a).withColumn("fm_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))

    def tail() -> Column:
        block = F.slice("fm_words", F.col("fm_a") + 1, F.col("fm_p"))
        again = F.flatten(F.array_repeat(block, F.ceil((n - F.col("fm_a")) / F.col("fm_p")).cast("int")))
        return F.concat(F.slice("fm_words", F.lit(1), F.col("fm_a")), F.slice(again, F.lit(1), n - F.col("fm_a")))

    return kept.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(tail(), " ")).otherwise(F.col("text")).alias("text"))
