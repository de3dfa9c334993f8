"""Similarity join of documents on word shingles: exact links and their components.

Two documents link when 100 * shared shingles >= percent * shingles of both. The steps:

1. A pass over all texts gives each document's set size and a 128-bit digest of its set, and counts all shingles
   in a table of SKETCH counters. Equal sets collapse to the smallest doc_id.
2. Contraction: documents that share a pair of minimum hashes are compared with the smallest doc_id there, so a
   group of near copies becomes a star of verified links and not all its pairs. This only saves work.
3. T-occurrence search (DivideSkip): shingles are in one global order, by counter, then by hash. Documents that
   link share `need` = ceil(percent n / 100) shingles at least; a document's first n - need + SHORT shingles are its
   short inverted lists, and of these any linked document shares SHORT at least. The lists that hold more than one
   component so far are joined, by shingle and length class: a document probes for those of its own size or less, which
   lie in fewer lists, as two sets of one size must share more. For each probe and sixteenth of the documents met the lists
   are merged by a heap, and documents that occur SHORT times stay.
4. These candidates' other shingles, the long lists, are probed by binary search until the required overlap is
   reached or out of reach: first, ROUNDS times, of each document the candidate that it shares most short lists with, and
   candidates that this brings into one component are done with; then all that are left.

Pairs within a component are not probed once it is known, and no link between components is lost, so components
are exact. Lists are joined by Spark's sort-merge join, which spills and splits skewed keys.

Defined results: null texts and texts without words have empty sets and link with nothing, each its own
component; rows that share a doc_id share their links, those of each of its texts; null doc_ids have no component;
repeated rows give a row each; other columns are passed over (kept by `keep_one`), whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_batches, unpacked
from .shingles import Shingler, min_hashes, mix, overlap

SKETCH, SHORT, BANDS = 1 << 17, 2, 4
#: A probe's merge is split so many ways; rounds in which documents take one candidate each.
MERGES, ROUNDS = 16, 2
#: Up to so many ids are broadcast to choose documents; beyond it they are joined.
BROADCAST_IDS = 1_000_000


def _bits(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, d1, d2 (set size and digest) of each row, and the counts of all shingles by their upper bits."""
    shift = np.uint64(64 - (SKETCH.bit_length() - 1))
    slice_ = 4096

    def sign(batches):
        shingler, counts = Shingler(k), np.zeros(SKETCH, np.int64)
        names = ["doc_id", "n", "d1", "d2", "slice", "counts"]
        for batch in batches:
            sets = shingler.sets(batch.column(1).to_pylist())
            if sets:
                counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=SKETCH)
            digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64()))], names=names
            )
        at = np.flatnonzero(counts.reshape(-1, slice_).any(axis=1))
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64())] + [pa.nulls(m, pa.int64())] * 3 + [pa.array(at.astype(np.int32)), pa.array(list(counts.reshape(-1, slice_)[at]), pa.list_(pa.int64()))], names=names
        )

    both = stored(docs.mapInArrow(sign, "doc_id long, n long, d1 long, d2 long, slice int, counts array<long>"), "signatures")
    cells = both.where("slice is not null").select("slice", F.posexplode("counts").alias("at", "c")).where("c > 0")
    table = np.zeros(SKETCH, np.int64)
    for r in cells.groupBy("slice", "at").agg(F.sum("c").alias("c")).collect():  # SKETCH rows at most
        table[r["slice"] * slice_ + r["at"]] = r["c"]
    return both.where("slice is null").select("doc_id", "n", "d1", "d2"), table


def required(n: int, percent: int) -> int:
    """How many shingles a set of n must share with any set that it links with."""
    return -(-n * percent // 100)


def short_lists(docs: DataFrame, k: int, percent: int, table: np.ndarray) -> DataFrame:
    """doc_id, n, lists (its rarest shingles) and bands of each document that can link with an unequal one."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # SKETCH numbers
    seeds = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))
    shift = np.uint64(64 - (SKETCH.bit_length() - 1))

    def choose(batches):
        shingler, counts = Shingler(k), shared.value
        for batch in batches:
            ids, ns, lists, bands = [], [], [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1).to_pylist()), strict=True):
                n = len(s)
                if doc is None or n * 100 // percent == n:
                    continue
                order = np.lexsort((s, counts[(s >> shift).astype(np.int64)]))
                least = min_hashes(s, seeds).reshape(BANDS, 2)
                ids.append(doc)
                ns.append(n)
                lists.append(s[order[: n - required(n, percent) + SHORT]].view(np.int64))
                bands.append(mix(least[:, 0] * np.uint64(3) + least[:, 1] + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "lists", "bands"])

    return docs.mapInArrow(choose, "doc_id long, n long, lists array<long>, bands array<long>")


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these doc_ids."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Texts of the pairs' documents are joined to them, and each pair's sets probed."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = chosen(docs, ids)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def probe(batches):
        shingler = Shingler(k)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left = batch.column(2).to_pylist()
            distinct = list(dict.fromkeys(left))
            known = dict(zip(distinct, shingler.sets(distinct), strict=True))
            keep = []
            for x, y in zip(left, shingler.sets(batch.column(3).to_pylist()), strict=True):
                s = known[x]
                total = len(s) + len(y)
                need = -(-total * percent // (100 + percent))
                found = overlap(s, y, need)
                keep.append(found >= 0 and 100 * found >= percent * (total - found) and total > 0)
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k_ in zip(x, keep, strict=True) if k_], pa.int64()) for x in (a, b)], names=["a", "b"])

    return both.mapInArrow(probe, "a long, b long").distinct()


def merge_lists(lists: list[list[int]], times: int) -> list[tuple[int, int]]:
    """The numbers that occur in so many of these ascending lists, and how often, by a heap over the lists."""
    return [(x, n) for x, run in groupby(heapq.merge(*lists)) if (n := sum(1 for _ in run)) >= times]


def occurrences(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share SHORT short lists or more (times); b is the smaller set. postings: s, at (the place
    of s among the document's shingles in the global order), doc_id, n, comp.

    A pair of n and m shingles links only if it shares need = ceil(percent (n + m) / (100 + percent)) of them, so the
    first SHORT that it shares lie among the first n - need + SHORT of one and m - need + SHORT of the other; for m <= n
    the latter is m - ceil(2 percent m / (100 + percent)) + SHORT at most. Near copies with edits of their own hold these
    first, as their rarest shingles, and mostly do not meet at all."""
    spread = postings.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s")
    spread = stored(spread, "lists")
    few = spread.count() <= BROADCAST_IDS
    open_ = stored(postings.join(F.broadcast(spread) if few else spread, "s", "left_semi"), "postings")
    size = lambda n: F.floor(F.log(n) / F.lit(float(np.log(100 / percent) if percent < 100 else 1))).cast("int")
    least = F.ceil(2 * F.col("n") * percent / F.lit(100 + percent))
    smaller = open_.where(F.col("at") < F.col("n") - least + SHORT)
    smaller = smaller.select("s", F.col("at").alias("at_b"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), size(F.col("n")).alias("size"))
    probes = open_.withColumnRenamed("doc_id", "a").withColumn("size", F.explode(F.sequence(size(F.ceil(F.col("n") * percent / 100)), size(F.col("n")))))
    need = F.ceil((F.col("n") + F.col("m")) * percent / F.lit(100 + percent))
    close = (F.col("at") < F.col("n") - need + SHORT) & (F.col("at_b") < F.col("m") - need + SHORT)
    below = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("a")))
    met = probes.join(smaller, ["s", "size"]).where(below & (F.col("comp") != F.col("comp_b")) & close)
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = met.select("a", F.pmod(F.xxhash64("b"), F.lit(MERGES)).alias("part"), "s", "b").repartition(n, "a", "part").sortWithinPartitions("a", "part", "s", "b")

    def merge(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)

        out: list[tuple[int, int, int]] = []
        for (a, _), group in groupby(rows(), key=lambda r: r[:2]):
            lists = [[r[3] for r in run] for _, run in groupby(group, key=lambda r: r[2])]
            out += ((a, b, times) for b, times in merge_lists(lists, SHORT))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["a", "b", "times"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["a", "b", "times"])

    return lists.mapInArrow(merge, "a long, b long, times long")


def connected(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links (a, b)."""
    links = stored(links, "links")
    if links.isEmpty():
        return roots
    return stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")


def probed(docs: DataFrame, pairs: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """roots (node, root) after the candidates pairs (a, b, times) have been probed, in rounds."""
    pairs = stored(pairs, "candidates")
    for last in [False] * ROUNDS + [True]:
        if pairs.isEmpty():
            break
        taken = pairs
        if not last:
            # Of each document, on either side, the candidate with most short lists in common.
            best = [pairs.groupBy(c).agg(F.max(F.struct("times", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("x")).select("x.a", "x.b", "x.times") for c in ("a", "b")]
            taken = best[0].unionByName(best[1]).distinct()
        roots = connected(roots, verified(docs, taken.select("a", "b"), k, percent))
        if not last:
            left = rooted(rooted(pairs, "a", roots, "a_root"), "b", roots, "b_root").where("a_root <> b_root").select("a", "b", "times")
            pairs = stored(left.join(taken.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
    return roots


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with) of all nodes but the roots themselves, by alternating
    large and small stars; edges (a, b)."""
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        if not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")


def rooted(nodes: DataFrame, node: str, roots: DataFrame, out: str) -> DataFrame:
    """nodes with the root of a column, itself where it has none."""
    return nodes.join(roots.select(F.col("node").alias(node), F.col("root").alias("fm_root")), node, "left").withColumn(out, F.coalesce("fm_root", node)).drop("fm_root")


def shared_ids(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that hold the sets of one doc_id together, where rows with different texts share it."""
    key = F.struct("d1", "d2", "n")
    own = rows.where("n > 0 and doc_id is not null")
    twice = own.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    twice = stored(twice, "shared")
    return own.join(twice, "doc_id", "left_semi").join(sets, ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and 100 at most")
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, table = signatures(docs, k)
    sets = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    sets = stored(sets, "sets")
    reps = sets.select(F.col("rep").alias("doc_id")).distinct()
    lists = short_lists(docs, k, percent, table).join(reps, "doc_id", "left_semi")
    lists = stored(lists.withColumn("key", F.xxhash64("lists")).dropDuplicates(["doc_id", "key"]).drop("key"), "shingles")

    bands = lists.select("doc_id", F.explode("bands").alias("band"))
    stars = stored(bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a"), "bands")
    near = bands.join(stars, "band").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    first = stored(components(verified(docs, near, k, percent)), "first")

    placed = rooted(lists.select("doc_id", "n", "lists"), "doc_id", first, "comp")
    postings = placed.select("doc_id", "n", "comp", F.posexplode("lists").alias("at", "s"))
    roots = probed(docs, occurrences(postings, percent), connected(first, shared_ids(rows, sets)), k, percent)

    whole = rooted(sets, "rep", roots, "component_id").select("d1", "d2", F.col("n").alias("n"), "component_id")
    whole = stored(whole, "members")
    return rows.join(whole, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a smaller doc_id in their component; all columns stay, and all rows of a doc_id that
    stays, nulls among them."""
    found = jaccard_components(docs, k, percent)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("fm_doc")).distinct()
    kept = packed(docs, F.col("doc_id").cast("long").alias("fm_id")).join(gone, F.col("fm_id") == F.col("fm_doc"), "left_anti")
    return kept.select(*unpacked(kept, docs.columns))
