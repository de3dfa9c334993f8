"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so each can be read by its place. Of pages with equal payloads of at least
`least` bytes the one with the largest page_id is a response record; the others are revisit records without a
payload that refer to it. Smaller payloads are always responses.

Index: captures are sorted by key (the host's labels reversed, then path and query, then page_id, then the payload's digest),
and equal keys by place, over parts by ranges. Each part is a file of compressed blocks of `block` lines, and a sparse
directory beside it holds the first key, place and size of each block. A look-up finds the part and the block by binary
search, reads that range alone, and searches in the block.

Files are written under the shared folder by pyarrow file systems, under names of their own and moved into
place. Defined results: null html is an empty payload; null urls have an empty host; a page without an id is no other
page's response, and revisits the largest page_id of its payload if there is one; repeated rows have a record
each; other columns are passed over, whatever their names; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, opened, stored, text_batches, written

LEAST, BLOCK, DATE = 1000, 256, "2024-01-01T00:00:00Z"
#: Captures of an index part at most, on average.
PART_LINES = 2_000_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURES = "key string, page_id long, path string, offset long, length long"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query"""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + (url or "").lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return key.lower()


def capture_key(url: str | None, page_id: int | None, digest: str) -> str:
    return f"{url_key(url)} {'-' if page_id is None else format(page_id, '020d')} {digest}"


def record(page_id, url, payload: bytes, refers_to, digest: str) -> bytes:
    """A record, not yet compressed. digest: the payload's SHA-1 in hex."""
    name = f"<urn:page:{page_id}>"
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def member(data: bytes) -> bytes:
    """A gzip member; its bytes depend on the data alone."""
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of each page."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = pages.where(F.octet_length("payload") >= least).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = stored(groups, "payloads")
    # A null id joins by a flag of its own.
    key = [F.coalesce(F.col("page_id"), F.lit(0)).alias("of"), F.col("page_id").isNull().alias("no_id")]
    revisits = large.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(*key, "digest", "refers_to").distinct()
    # The one shuffle of payloads, if any: archives are written from the partitions of this join.
    return pages.select("*", *key).join(revisits, ["of", "no_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes the archives, one per partition, and returns the captures: key, page_id, path, offset, length."""
    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or new_folder(spark, "warc")
    rows = with_revisits(pages, least).select("page_id", "url", "payload", "digest", "refers_to")
    rows = rows.sortWithinPartitions("page_id", "digest", "url")

    def write(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        kept = []

        def fill(stream):
            at = 0
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    data = member(record(page_id, url, payload, refers_to, digest))
                    stream.write(data)
                    kept.append((capture_key(url, page_id, digest), page_id, path, at, len(data)))
                    at += len(data)

        first = next(batches, None)
        if first is None:
            return
        batches = _again(first, batches)
        written(path, fill)
        for k in range(0, len(kept), 10_000):
            yield _table(kept[k : k + 10_000], CAPTURES)

    return stored(rows.mapInArrow(write, CAPTURES), "captures")


def _again(first, rest):
    yield first
    yield from rest


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


PARTS = "part long, first_key string, blocks long, lines long"


def write_index(captures: DataFrame, folder: str | None = None, block: int = BLOCK) -> tuple[str, DataFrame]:
    """Writes the index and returns its folder and its parts: part, first_key, blocks, lines."""
    spark = captures.sparkSession
    folder = folder or new_folder(spark, "cdx")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // PART_LINES))
    # Equal keys are dealt over several parts too.
    dealt = captures.repartitionByRange(n, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")

    def write(batches):
        part = TaskContext.get().partitionId()
        directory, total = [], 0

        def blocks():
            lines = []
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    lines.append(row)
                    if len(lines) == block:
                        yield lines
                        lines = []
            if lines:
                yield lines

        def fill(stream):
            nonlocal total
            at = 0
            for lines in blocks():
                data = zlib.compress(json.dumps(lines).encode())
                stream.write(data)
                directory.append((lines[0][0], at, len(data)))
                at, total = at + len(data), total + len(lines)

        first = next(batches, None)
        if first is None:
            return
        batches = _again(first, batches)
        written(f"{folder}/part-{part:06d}.blocks", fill)
        written(f"{folder}/part-{part:06d}.directory", lambda stream: stream.write(json.dumps(directory).encode()))
        yield _table([(part, directory[0][0], len(directory), total)], PARTS)

    return folder, stored(dealt.mapInArrow(write, PARTS), "parts")


class PartReader:
    """Look-ups in one part: its directory in memory, blocks read by range."""

    def __init__(self, folder: str, part: int):
        filesystem, path = opened(f"{folder}/part-{part:06d}.directory")
        with filesystem.open_input_file(path) as f:
            self.directory = json.loads(f.read())
        self.first = [d[0] for d in self.directory]
        filesystem, path = opened(f"{folder}/part-{part:06d}.blocks")
        self.file = filesystem.open_input_file(path)
        self.at, self.lines, self.keys = -1, [], []

    def find(self, key: str) -> list:
        """The lines of a key; equal keys can run over into later blocks, from the last block before it on."""
        out = []
        k = max(0, bisect_right(self.first, key) - 1)
        while k > 0 and self.first[k] == key:
            k -= 1
        while k < len(self.directory) and self.first[k] <= key:
            if k != self.at:
                _, offset, size = self.directory[k]
                self.file.seek(offset)
                self.lines = json.loads(zlib.decompress(self.file.read(size)))
                self.at, self.keys = k, [x[0] for x in self.lines]
            to = bisect_right(self.keys, key)
            a = to
            while a > 0 and self.keys[a - 1] == key:
                a -= 1
            out += self.lines[a:to]
            k += 1
        return out


def look_up(keys: DataFrame, index: tuple[str, DataFrame]) -> DataFrame:
    """The captures of all keys (column key); each distinct key is looked up once."""
    folder, parts = index
    spark = keys.sparkSession
    # A row per part, so as many as there are partitions.
    firsts = [(r.first_key, r.part) for r in parts.orderBy("first_key", "part").select("first_key", "part").collect()]
    heads = [f for f, _ in firsts]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def route(batches):
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                k = bisect_right(heads, key) - 1
                if k >= 0:
                    found.append((firsts[k][1], key))
                while k > 0 and heads[k] == key:  # a key that runs over parts
                    k -= 1
                    found.append((firsts[k][1], key))
            yield _table(found, "part long, key string")

    def find(batches):
        readers: dict[int, PartReader] = {}
        for batch in batches:
            rows = []
            for part, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part not in readers:
                    readers.clear()
                    readers[part] = PartReader(folder, part)
                rows += map(tuple, readers[part].find(key))
            yield _table(rows, CAPTURES)

    routed = keys.select("key").where("key is not null").distinct().mapInArrow(route, "part long, key string")
    return routed.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "key").mapInArrow(find, CAPTURES)


def read_records(captures: DataFrame, stretch: int = 64 << 20) -> DataFrame:
    """The records at the captures' places, in the order of each archive: page_id, record_type, payload_bytes and
    payload_digest (of the payload that is there; for a revisit the digest it states), refers_to."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.withColumn("stretch", F.floor(F.col("offset") / stretch)).repartition(n, "path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length")

    def number(name: str):
        tail = name.rstrip(">").rpartition(":")[2]
        return None if tail == "None" else int(tail)

    def read(batches):
        now, file = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if path != now:
                    filesystem, at = opened(path)
                    now, file = path, filesystem.open_input_file(at)
                file.seek(offset)
                headers, payload = parsed(zlib.decompress(file.read(length), 31))
                stated = base64.b32decode(headers["WARC-Payload-Digest"].partition(":")[2]).hex()
                kind = headers["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"payload and digest differ at {path}:{offset}")
                rows.append((number(headers["WARC-Record-ID"]), kind, len(payload) if kind == "response" else None, stated, number(headers["WARC-Refers-To"]) if kind == "revisit" else None))
            yield _table(rows, RECORDS)

    return dealt.mapInArrow(read, RECORDS)


def read_pages(pages: DataFrame, index: tuple[str, DataFrame]) -> DataFrame:
    """The records of pages (page_id, url, html), found through the index; revisits have the size of the payload that
    they refer to."""

    def keys(batches):
        for batch in batches:
            yield _table([(capture_key(u, i, d),) for i, u, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)], "key string")

    digest = F.sha1(F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8"))
    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), digest.alias("digest")).mapInArrow(keys, "key string")
    records = stored(read_records(look_up(wanted, index)), "records")
    full = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    full = stored(full, "responses").withColumnsRenamed({"page_id": "full_id", "payload_digest": "full_digest"})
    revisits = records.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("full_id")) & (F.col("payload_digest") == F.col("full_digest")), "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*out).unionByName(revisits.withColumn("payload_bytes", F.col("full_bytes")).select(*out))
