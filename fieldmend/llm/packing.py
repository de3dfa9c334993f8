"""Best-fit packing of token sequences under several capacities.

A piece of a document demands tokens, one place in the document count, and attention cost (its length
squared). A bin is a training sequence with a capacity for each. Pieces are taken in decreasing order of
demand; each goes to the open bin that holds it under every capacity and that leaves the least weighted norm of
residual capacities (rule="norm"), or the least weighted dot product of its demand with the residual (rule="dot").
Where none holds it, a bin opens.

Groups of about `group_size` pieces, dealt by a hash of the stored row (so rows that share an id, or have none, spread like
others), are packed each by itself, and no task holds more. The bins that a group leaves under `refill` full give their
pieces to a second round of groups, which packs these again.

A sum of squares never exceeds the squared sum, so an attention capacity of the token capacity squared can't refuse what the
tokens allow; a lower one can, and a document count can.

Defined results: null texts are empty; an empty text is a piece of its closing id alone; only pieces longer than
the token capacity are cut; a piece that is over another capacity by itself raises ValueError; repeated rows are packed each
by itself; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .tokens import encoder, in_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, filled long"
GROUP_SIZE = 4096
REFILL = 0.98
WEIGHTS = (1.0, 0.02, 0.02)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for some in in_slices(texts):
                for doc, data in zip(ids[some], encode(texts[some]), strict=True):
                    data += end
                    for k, at in enumerate(range(0, max(1, len(data)), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


def best_fit(demands: np.ndarray, capacities: np.ndarray, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, int]:
    """The bin of each row of demands (n by d), and the number of bins. Rows are taken by decreasing demand (the
    largest share of a capacity first, then the row number)."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    share = demands / capacities
    if (share > 1).any():
        raise ValueError(f"a piece demands {demands[(share > 1).any(axis=1)][0].tolist()} of the capacities {list(capacities)}")
    w = np.asarray(weights, float)
    order = np.lexsort((np.arange(len(share)), *(-share.T[::-1])))
    bins = np.full(len(share), -1, np.int64)
    least = share.min(axis=0, initial=1.0)
    rest, names = np.empty((64, share.shape[1])), np.empty(64, np.int64)
    n_open = n_bins = 0
    slack = 1e-9
    for item in order:
        d = share[item]
        place = -1
        if n_open:
            left = rest[:n_open] - d
            fits = (left >= -slack).all(axis=1)
            if fits.any():
                cost = np.square(left) @ w if rule == "norm" else left @ (w * d)
                place = int(np.argmin(np.where(fits, cost, np.inf)))
        if place < 0:
            if n_open == len(names):
                rest, names = np.vstack([rest, np.empty_like(rest)]), np.concatenate([names, np.empty_like(names)])
            place, n_open = n_open, n_open + 1
            rest[place], names[place] = 1.0, n_bins
            n_bins += 1
        rest[place] -= d
        bins[item] = names[place]
        if (rest[place] < least - slack).any():  # nothing can go there any more
            n_open -= 1
            rest[place], names[place] = rest[n_open], names[n_open]
    return bins, n_bins


def _packer(capacities: tuple, weights: tuple, rule: str, shift: int) -> Callable:
    def pack(pdf):
        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy(np.float64)
        demands = np.stack([length, np.ones(len(pdf)), np.square(length)], axis=1)
        bins, n = best_fit(demands, np.asarray(capacities, float), weights, rule)
        pdf["sequence_id"] = (pdf["pack_group"].to_numpy(np.int64) << 22) + 2 * bins + shift
        pdf = pdf.iloc[np.lexsort((np.arange(len(pdf)), bins))]
        used = pdf.groupby("sequence_id", sort=False)["length"]
        pdf["offset"] = used.cumsum() - pdf["length"]
        pdf["filled"] = used.transform("sum")
        return pdf.drop(columns=["pack_group"])[[*(c.split()[0] for c in PACKED.split(", "))]]

    return pack


def pack(
    pieces: DataFrame,
    capacity: int = 4096,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple = WEIGHTS,
    rule: str = "norm",
    group_size: int = GROUP_SIZE,
    refill: float = REFILL,
) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. No length may exceed the
    token capacity; without further limits a sequence holds any documents that its tokens allow."""
    if any(limit is not None and limit < 1 for limit in (capacity, max_documents, max_attention)) or group_size < 1:
        raise ValueError("capacities and group_size are 1 at least")
    capacities = (capacity, capacity if max_documents is None else max_documents, capacity * capacity if max_attention is None else max_attention)
    # The row number is stored with the piece, so it does not change when a task runs again.
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    named = [c.split()[0] for c in PACKED.split(", ")]

    def deal(df: DataFrame, n: int, salt: int) -> DataFrame:
        groups = max(1, -(-n // group_size))
        return df.withColumn("pack_group", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)))

    once = deal(pieces, pieces.count(), 1).groupBy("pack_group").applyInPandas(_packer(capacities, weights, rule, 0), PACKED)
    once = stored(once, "packed")
    loose = F.col("filled") < refill * capacity
    rest = once.where(loose).select(*named[:6])
    twice = deal(rest, rest.count(), 2).groupBy("pack_group").applyInPandas(_packer(capacities, weights, rule, 1), PACKED)
    return once.where(~loose).unionByName(twice).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, **options) -> DataFrame:
    """Documents to packed pieces: tokens, cut at the capacity, best-fit."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity, **options)
