"""Benchmark decontamination by n-gram windows.

Words: A-Z lower-cased, then runs of digits, a-z and characters from U+0080 on. A window is `n` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A document word inside an
occurrence of a window is hit.

While the benchmark has no more than `max_broadcast_windows` windows (its size is counted first), the windows
travel as a broadcast hash set, keyed by their word numbers: a look-up compares whole windows, so that each hit
is verified. A larger benchmark goes through a shuffle join on window digests instead. What a row gives depends on
its own text alone, either way.

Defined results: null and empty texts have no words; null items and items without words have no windows; an
item that is repeated counts once; items without an id are one item, whose id is null; repeated document rows each give a
row, and rows that share a doc_id are each judged by their own text; other columns are passed over (kept by `decontaminate`),
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_batches, unpacked

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
N = 10
MAX_BROADCAST_WINDOWS = 200_000
#: Beyond them: windows of a text at once, and the size of the table that tells which windows are worth a shuffle.
STRETCH, SKETCH_BITS = 50_000, 24
REPORT = "doc_id long, n_words long, n_hit long, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def item_windows(words: list, n: int) -> list[tuple]:
    """All windows of an item."""
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


class WindowSet:
    """The windows of a benchmark, as word numbers."""

    @classmethod
    def of(cls, state: dict) -> WindowSet:
        made = cls((), 1)
        made.__dict__.update(state)
        return made

    def __init__(self, items, n: int):
        self.number: dict[bytes, int] = {}
        self.items: list[str | None] = []
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        known: dict[str | None, int] = {}
        for item_id, text in items:
            for window in item_windows(words_of(text), n):
                ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in window], np.int32)
                k = known.setdefault(item_id, len(known))
                holders = self.windows.setdefault(len(window), {}).setdefault(ids.tobytes(), [])
                if k not in holders:
                    holders.append(k)
        self.items = list(known)

    def scan(self, text: str | None) -> tuple[list, np.ndarray | None, set[int]]:
        """The words of a text, which of them are hit (None: none), and the items that occur."""
        words = words_of(text)
        if not words:
            return words, None, set()
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        found: set[int] = set()
        edges = None
        for size, windows in self.windows.items():
            if size > len(words):
                continue
            for at in np.flatnonzero(unknown[size:] == unknown[:-size]):
                if holders := windows.get(ids[at : at + size].tobytes()):
                    found.update(holders)
                    if edges is None:
                        edges = np.zeros(len(words) + 1, np.int32)
                    edges[at] += 1
                    edges[at + size] -= 1
        return words, None if edges is None else np.cumsum(edges[:-1]) > 0, found


def n_windows(benchmark: DataFrame, n: int) -> int:
    """How many windows a benchmark has at most, by its words."""
    words = F.size(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " "))
    counted = benchmark.where(F.col("text").isNotNull()).agg(F.sum(F.greatest(F.lit(1), words - (n - 1))))
    return counted.first()[0] or 0


def window_set(benchmark: DataFrame, n: int, limit: int):
    """The broadcast contents of a WindowSet, or None where the benchmark is too large for one."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").alias("text"))
    if n_windows(items, n) > limit:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(vars(WindowSet(items.where("text is not null").collect(), n)))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS
) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, and the ids of the items it holds windows of (as strings,
    sorted, null last)."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = window_set(benchmark, n, max_broadcast_windows)
    if shared is None:
        return joined_contamination(docs, benchmark, n)

    def scan(batches):
        held = WindowSet.of(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(1):
                words, hit, found = held.scan(text.as_py())
                out.append((len(words), 0 if hit is None else int(hit.sum()), sorted((held.items[k] for k in found), key=lambda i: (i is None, i or ""))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "items"],
            )

    return docs.mapInArrow(scan, REPORT)


def text_key():
    """Tells texts apart; null for a null text, which has no hits."""
    return F.sha2(F.col("text").cast("string"), 256)


def joined_hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """fm_key, fm_at (the places of its hit words) and items of each distinct text of docs that holds a window, by a
    shuffle join of window digests, for a benchmark of any size."""

    def digest(window) -> bytes:
        return hashlib.md5(b" ".join(window)).digest()

    def sketch(first: bytes, last: bytes) -> int:
        return zlib.crc32(last, zlib.crc32(first)) >> (32 - SKETCH_BITS)

    def of_items(batches):
        for batch in batches:
            rows = [(i, digest(w), len(w), sketch(w[0], w[-1])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in item_windows(words_of(t), n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.int32(), pa.int32()))], names=["item", "gram", "size", "mark"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    grams = stored(items.mapInArrow(of_items, "item string, gram binary, size int, mark int").distinct(), "grams")
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most n values
    bits = np.zeros(1 << SKETCH_BITS, bool)
    words_ = grams.groupBy(F.shiftright("mark", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, mark & 63))").alias("bits"))
    found = words_.toArrow()  # 2 ** (SKETCH_BITS - 6) rows at most
    if found.num_rows:
        rows = np.unpackbits(found.column("bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        bits.reshape(-1, 64)[found.column("word").to_numpy()] = rows
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # of a fixed size

    def of_docs(batches):
        held = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for s in sizes:
                    # The windows of a long text in stretches; of these, only such as begin and end like one of the benchmark.
                    for first in range(0, len(words) - s + 1, STRETCH):
                        some = [i for i in range(first, min(first + STRETCH, len(words) - s + 1)) if held[sketch(words[i], words[i + s - 1])]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * len(some), pa.string()), pa.array([digest(words[i : i + s]) for i in some], pa.binary()), pa.array([s] * len(some), pa.int32()), pa.array(some, pa.int32())],
                            names=["fm_key", "gram", "size", "at"],
                        )

    texts = docs.where(F.col("text").isNotNull()).select(text_key().alias("fm_key"), F.col("text").cast("string").alias("text"))
    windows = texts.dropDuplicates(["fm_key"]).mapInArrow(of_docs, "fm_key string, gram binary, size int, at int")
    # In a struct a null id is collected too.
    ids = F.collect_set(F.struct("item"))
    return windows.join(grams, ["gram", "size"]).groupBy("fm_key").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))).alias("fm_at"),
        F.array_sort(F.transform(ids, lambda x: x["item"])).alias("items"),
    )


def joined_contamination(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """contamination by joined_hits."""
    hit = joined_hits(docs, benchmark, n)

    def count_words(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(words_of(t)) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "fm_key", "n_words"])

    counted = docs.select("doc_id", text_key().alias("fm_key"), "text").mapInArrow(count_words, "doc_id long, fm_key string, n_words long")
    both = counted.join(hit, "fm_key", "left")
    return both.select("doc_id", "n_words", F.coalesce(F.array_size("fm_at"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents", max_broadcast_windows: int = MAX_BROADCAST_WINDOWS
) -> DataFrame:
    """docs without the documents that hold a window (remove="documents"), or with the hit words cut out of
    their texts (remove="spans"). All columns stay."""
    text_batches(docs.sparkSession)
    shared = window_set(benchmark, n, max_broadcast_windows)
    if shared is None:
        return joined_removal(docs, benchmark, n, remove)
    at = docs.columns.index("text")

    def keep(batches):
        held = WindowSet.of(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            hits = [held.scan(t)[1] for t in texts]
            if remove == "documents":
                yield batch.filter(pa.array([h is None for h in hits], pa.bool_()))
            else:
                cut = [t if h is None else without(t, h) for t, h in zip(texts, hits, strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return docs.mapInArrow(keep, docs.schema)


def joined_removal(docs: DataFrame, benchmark: DataFrame, n: int, remove: str) -> DataFrame:
    """decontaminate by joined_hits."""
    hits = joined_hits(docs, benchmark, n).select("fm_key", "fm_at")
    keyed = packed(docs, text_key().alias("fm_key"))
    if remove == "documents":
        kept = keyed.join(hits, "fm_key", "left_anti")
        return kept.select(*unpacked(kept, docs.columns))
    at, width = docs.columns.index("text"), len(docs.columns)

    def cut(batches):
        for batch in batches:
            texts = []
            for text, places in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                if places is not None:
                    hit = np.zeros(len(words_of(text)), bool)
                    hit[places] = True
                    text = without(text, hit)
                texts.append(text)
            columns = batch.columns[:width]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(width)]))

    both = keyed.join(hits, "fm_key", "left")
    places = F.col("fm_at").alias(next(c for c in ("fm_at", *(f"fm_at{k}" for k in range(len(docs.columns)))) if c not in docs.columns))
    return both.select(*unpacked(both, docs.columns), places).mapInArrow(cut, docs.schema)


def without(text: str, hit: np.ndarray) -> str:
    """A text without the words that are hit and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(data.lower())]
    out, at, k = [], 0, 0
    while k < len(spans):
        if hit[k]:
            last = k
            while last + 1 < len(spans) and hit[last + 1]:
                last += 1
            out.append(data[at : spans[k][0]])
            at, k = spans[last][1], last
        k += 1
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")
