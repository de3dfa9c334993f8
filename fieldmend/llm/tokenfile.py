"""Token ids in Arrow stream files of fixed-size-list batches.

Documents in ascending doc_id order (null first; equal ids by their texts' digest) are one stream of ids, dealt by ranges of
about equal numbers of documents over shards; the ranges cut equal ids too, by digest, then by row. A shard is an Arrow stream
file whose record batches hold `rows` sequences of `sequence_length` ids each (a fixed-size list) with their masks (true: an
id, false: padding of the last sequence). Batches are not compressed and all of one size, so that sequence k of a file lies at
a place that `k` alone gives, and a reader goes there: it maps a local file and looks at ids without a copy, and reads one
batch of any other. Beside it lies a small index file, also an Arrow stream: doc_id and n_tokens of the shard's documents in
order.

Ids are stored as uint16 where the vocabulary allows, else as uint32. Files are written under the shared folder
under names of their own and moved into place, so a task that runs again leaves the same files.

Defined results: null texts are empty and have the closing id alone; repeated rows are each a document; other
columns are passed over, whatever their names; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, opened, stored, text_batches, written
from .tokens import encoder, in_slices

SEQUENCE_LENGTH = 2048
ROWS_PER_BATCH = 64
#: Characters of text per shard at most, on average.
SHARD_CHARS = 128 << 20
MANIFEST = "shard long, path string, documents long, tokens long"


def schema_of(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Collects ids and writes whole batches as they fill, so it holds one batch at most."""

    def __init__(self, stream, kind: pa.DataType, length: int, rows: int):
        self.kind, self.length, self.rows = kind, length, rows
        self.writer = pa.ipc.new_stream(stream, schema_of(kind, length))
        self.rest: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.n += len(ids)
        full = self.length * self.rows
        if self.n >= full:
            data = np.concatenate(self.rest)
            for at in range(0, len(data) - full + 1, full):
                self._batch(data[at : at + full], full)
            self.rest = [data[len(data) // full * full :]]
            self.n = len(self.rest[0])

    def _batch(self, data: np.ndarray, n: int) -> None:
        size = self.length * self.rows
        ids, mask = np.zeros(size, data.dtype), np.zeros(size, bool)
        ids[:n], mask[:n] = data, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema_of(self.kind, self.length)))

    def close(self) -> None:
        if self.n:
            self._batch(np.concatenate(self.rest), self.n)
        self.writer.close()


class ShardReader:
    """Random access to a shard: sequence(k), mask(k), and ids(start, n) over the stream of ids. The file's first two messages,
    the schema and a batch, tell where all others lie. Files that can be mapped are not copied; of others one batch is held."""

    def __init__(self, uri: str):
        filesystem, path = opened(uri)
        self.source = pa.memory_map(path) if filesystem.type_name == "local" else filesystem.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        self.k, self.held, self.size, self.rows = -1, None, 0, 1
        if self.source.size() - self.first > 8:  # else there is the end mark alone
            self.held = self._read()
            self.k, self.size, self.rows = 0, self.source.tell() - self.first, self.held.num_rows

    def _read(self) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self.k:
            self.source.seek(self.first + k * self.size)
            self.held, self.k = self._read(), k
        return self.held

    def values(self, k: int) -> np.ndarray:
        """The ids of batch k."""
        return self.batch(k).column(0).values.to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> np.ndarray:
        at = k % self.rows * self.length
        return self.values(k // self.rows)[at : at + self.length]

    def mask(self, k: int) -> np.ndarray:
        return self.batch(k // self.rows).column(1)[k % self.rows].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        size = self.length * self.rows
        parts = []
        while n > 0:
            part = self.values(start // size)[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, sequence_length: int = SEQUENCE_LENGTH, rows: int = ROWS_PER_BATCH, shards: int | None = None
) -> DataFrame:
    """Writes the shards and returns their manifest: shard, path, documents, tokens."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folder = folder or new_folder(spark, "tokens")
    if shards is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    # The digest and the row only break ties: a third of all rows may share an id.
    order = ["doc_id", "key", "row"]
    dealt = docs.withColumn("key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        code = encoder(tokenizer)
        narrow = code.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16
        kind = pa.uint16() if narrow else pa.uint32()
        dtype = "<u2" if narrow else "<u4"
        end = np.array([end_id], dtype)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard, index = TaskContext.get().partitionId(), []

        def fill(stream):
            out = ShardWriter(stream, kind, sequence_length, rows)
            for batch in chain((first,), batches):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for some in in_slices(texts):
                    for doc, data in zip(ids[some], code.encode(texts[some]), strict=True):
                        data = np.concatenate([np.frombuffer(data, "<u4").astype(dtype), end])
                        index.append((doc, len(data)))
                        out.add(data)
            out.close()

        uri = f"{folder}/shard-{shard:06d}"
        written(f"{uri}.arrows", fill)
        listed = pa.table({"doc_id": pa.array([i[0] for i in index], pa.int64()), "n_tokens": pa.array([i[1] for i in index], pa.int64())})

        def list_documents(stream):
            with pa.ipc.new_stream(stream, listed.schema) as out:
                out.write_table(listed)

        written(f"{uri}.index.arrows", list_documents)
        kinds = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "documents": [len(index)], "tokens": [sum(i[1] for i in index)]}, schema=kinds)

    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files.
    Only the manifest, a row per shard, is ordered as a whole."""
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                reader = ShardReader(f"{path}.arrows")
                filesystem, at = opened(f"{path}.index.arrows")
                with filesystem.open_input_file(at) as f:
                    listed = pa.ipc.open_stream(f).read_all()
                ids, counts = listed.column(0).to_pylist(), listed.column(1).to_numpy()
                starts = np.cumsum(counts) - counts
                crcs = [zlib.crc32(reader.ids(int(s), int(c)).astype("<u4").tobytes()) for s, c in zip(starts, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartitionById(n, F.col("shard").cast("int")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
