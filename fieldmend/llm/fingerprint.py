"""Document fingerprints by a randomised edit embedding.

Embedding: a walk over a text's characters takes one step after another; at each step j a shared random bit for
the character's class tells whether the walk goes on to the next character or stays, and the character under the
walk is what the embedding has at j. Texts that differ by an edit fall out of step there and soon into step again,
so their edit distance becomes a Hamming distance. The bits repeat after PERIOD steps.

Bit sampling: each of SLOTS slots looks at one step of the embedding. Of all steps up to the walk's end it takes the
one with the smallest hash under the slot, so texts of nearly equal lengths look at the same steps. A slot keeps eight
bits of a hash of the GRAM characters from there on. The fingerprint is the slots as pairs of hex digits.

Likeness of two fingerprints: the share of equal slots, less what chance gives, from 0 to 1.

near_copies: a walk over a whole text that has fallen out of step often stays so for as many steps again, so long texts with
many edits have few slots in common. There walks begin anew at anchors: places whose gram's hash is the least of all
within AROUND characters, which an edit elsewhere doesn't move. What a few steps lead to from each anchor are the text's
features, and each slot takes the one with the least hash under it, so slots agree as often as texts share features,
wherever these stand. Banding: samples of slots as keys bring candidates together, which a check of likeness and of the
texts' edit distance confirms.

Defined results: null texts are empty; empty texts have a fingerprint of their own; equal texts have equal
fingerprints; repeated rows follow each other; other columns are passed over, whatever their names. The document that follows
another is the next in descending doc_id (nulls last; equal ids by the text's digest, descending); after the last comes the
first. near_copies leaves rows without a doc_id out; rows that share one with different texts share their links.
"""

from __future__ import annotations

import hashlib
import math
import operator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_batches
from .jaccard import chosen, components, rooted
from .shingles import mix

PERIOD, CLASSES, SLOTS, GRAM = 2039, 64, 128, 6
#: near_copies: keys of a document, and slots (of 16 bits) sampled for each.
BANDS, BAND = 32, 2
#: near_copies: an anchor's gram is the least so far on either side; steps of the walk from it at which a feature is taken.
AROUND, REACH = 8, (4, 8, 12, 16)
#: Steps that a sampler looks at in one go; characters of a range of documents at most, on average.
CHUNK, SLICE_CHARS = 1 << 15, 64 << 20
#: near_copies: documents of a bucket that are compared at once; how often a bucket is held against one document first.
BLOCK, STARS = 1000, 2
#: near_copies: the least likeness of marks for texts to be compared, and edits of a linked pair by the longer text's length.
LEAST, SHARE = 0.1, 0.05
#: Points and characters of pairs of texts that are worked out together; pairs that these are picked from; characters of a side of a
#: group of pairs, on average; pairs of marks compared at once; documents of small buckets that are dealt together, on average.
CELLS, CHARS, GATHERED, SIDE_CHARS, MARKS, LOT = 1 << 15, 1 << 20, 4000, 16 << 20, 1 << 13, 4096
NEVER = np.iinfo(np.int64).max


class Walk:
    """Shared random walks. A state per step of the period holds, for each class of characters, the state at which
    the walk reaches the next character."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (PERIOD, CLASSES), dtype=np.int64)
        bits[0] = 1  # no character holds a walk for more than a period
        self.bits = bits
        # advance[j, c]: steps from j until a character of class c is left
        advance = np.zeros((PERIOD, CLASSES), np.int64)
        run = np.ones(CLASSES, np.int64)
        for j in range(2 * PERIOD - 1, -1, -1):
            run = np.where(bits[j % PERIOD] == 1, 1, run + 1)
            advance[j % PERIOD] = run
        self.states: list[list] = [[None] * CLASSES + [j] for j in range(PERIOD)]
        for j in range(PERIOD):
            for c in range(CLASSES):
                self.states[j][c] = self.states[(j + int(advance[j, c])) % PERIOD]
        self.number = operator.itemgetter(CLASSES)

    def steps(self, classes: bytes, start: int = 0) -> np.ndarray:
        """The step at which each character is reached, and last the step at which the walk ends, from a step on."""
        at = np.fromiter(map(self.number, accumulate(classes, operator.getitem, initial=self.states[start % PERIOD])), np.int32, len(classes) + 1)
        moved = np.diff(at)
        moved[moved <= 0] += PERIOD
        out = np.empty(len(at), np.int64)
        out[0] = start
        np.cumsum(moved, out=out[1:])
        out[1:] += start
        return out


class Sampler:
    """The step that each slot looks at, by the length of the walk: records of a hash over the steps."""

    def __init__(self, slots: int):
        self.salts = mix(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x51ED2701))
        self.every = np.arange(slots)
        self.records: list[list[int]] = [[] for _ in range(slots)]
        # A row per slot, filled up with a step beyond all.
        self.at = np.full((slots, 1), NEVER)
        self.least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
        self.n = 0

    def grow(self, n: int) -> None:
        """Looks for further records up to step n, CHUNK steps at a time."""
        if self.n >= n:
            return
        while self.n < n:
            steps = np.arange(self.n, self.n + CHUNK, dtype=np.uint64)
            for k, salt in enumerate(self.salts):
                hashed = mix(steps ^ salt)
                if hashed.min() < self.least[k]:
                    low = np.minimum.accumulate(np.concatenate((self.least[k : k + 1], hashed)))
                    self.records[k] += steps[low[1:] < low[:-1]].astype(np.int64).tolist()
                    self.least[k] = low[-1]
            self.n += CHUNK
        self.at = np.full((len(self.records), max(map(len, self.records))), NEVER)
        for k, row in enumerate(self.records):
            self.at[k, : len(row)] = row

    def __call__(self, n: int) -> np.ndarray:
        self.grow(n)
        return self.at[self.every, (self.at < n).sum(axis=1) - 1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Fingerprinter:
    def __init__(self, slots: int = SLOTS):
        self.walk, self.sample = Walk(), Sampler(slots)
        self.slots = slots
        self.salt = np.arange(slots, dtype=np.uint64)
        self.empty = bytes(k % 256 for k in range(slots)).hex()

    def walked(self, points: np.ndarray, start: int = 0) -> np.ndarray:
        return self.walk.steps(((points * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8).tobytes(), start)

    def __call__(self, text: str) -> str:
        points = code_points(text)
        return self.of(points, self.walked(points))

    def of(self, points: np.ndarray, steps: np.ndarray) -> str:
        """The fingerprint of a text and its walk."""
        if not len(points):
            return self.empty
        chars = np.searchsorted(steps, self.sample(int(steps[-1])), side="right") - 1
        grams = np.zeros(self.slots, np.uint64)
        last = len(points) - 1
        for k in range(GRAM):
            at = chars + k
            grams = mix(grams + np.where(at <= last, points[np.minimum(at, last)], 0xFFFFFFFF).astype(np.uint64))
        return (mix(grams ^ (self.salt << np.uint64(40))) & np.uint64(255)).astype(np.uint8).tobytes().hex()

    def of_edited(self, points: np.ndarray, steps: np.ndarray, kept: int) -> str:
        """The fingerprint of a text whose first `kept` characters begin another text, of which `steps` is the walk;
        only what comes after them is walked anew."""
        rest = self.walked(points[kept:], int(steps[kept]))
        return self.of(points, np.concatenate((steps[:kept], rest)))


def lowest_near(x: np.ndarray, around: int) -> np.ndarray:
    """The least number within so many places of each."""
    edge = np.full(around, np.iinfo(x.dtype).max, x.dtype)
    low, size, want = np.concatenate((edge, x, edge)), 1, 2 * around + 1
    while size < want:
        more = min(size, want - size)
        low = np.minimum(low[:-more], low[more:])
        size += more
    return low


class Anchored:
    """A text's mark: slots of 16 bits out of walks that begin at anchors."""

    def __init__(self, slots: int = SLOTS):
        self.bits = Walk().bits
        self.odd = mix(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)
        self.salts = mix(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x2545F491))
        self.empty = bytes(2 * slots)

    def features(self, points: np.ndarray) -> list[np.ndarray]:
        """For each of REACH the distinct hashes of an anchor's gram and the gram that the walk from it leads to."""
        n = len(points)
        wide = np.concatenate((points, np.full(GRAM, 0xFFFFFFFF, np.uint32))).astype(np.uint64)
        grams = np.zeros(n + 1, np.uint64)
        for k in range(GRAM):
            grams += wide[k : n + 1 + k] * self.odd[k]
        grams = mix(grams)
        kinds = ((wide[: n + 1] * np.uint64(0x9E3779B1)) >> np.uint64(26)).astype(np.int64) & (CLASSES - 1)
        anchors = np.flatnonzero(grams[:n] == lowest_near(grams[:n], AROUND))
        at, out = anchors.copy(), []
        for step in range(REACH[-1] + 1):
            if step in REACH:
                out.append(np.unique(mix(grams[anchors] * np.uint64(3) + grams[at] + np.uint64(step))))
            at = np.minimum(at + self.bits[step, kinds[at]], n)
        return out

    def __call__(self, text: str) -> bytes:
        points = code_points(text)
        if not len(points):
            return self.empty
        least = np.full(len(self.salts), np.iinfo(np.uint64).max, np.uint64)
        for v, found in enumerate(self.features(points)):
            salts = self.salts[v :: len(REACH), None]
            for at in range(0, len(found), CHUNK):
                low = mix(found[None, at : at + CHUNK] ^ salts).min(axis=1)
                least[v :: len(REACH)] = np.minimum(least[v :: len(REACH)], low)
        return (least & np.uint64(0xFFFF)).astype("<u2").tobytes()


def slots_of(prints: list[str]) -> np.ndarray:
    """Fingerprints as rows of slots."""
    return np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)


def marks_of(marks: list[bytes]) -> np.ndarray:
    """Marks as rows of slots."""
    return np.frombuffer(b"".join(marks), "<u2").reshape(len(marks), -1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots of each row, less what chance gives."""
    chance = 1 / (1 << 8 * a.itemsize)
    return np.maximum(0.0, ((a == b).mean(axis=-1) - chance) / (1 - chance))


def likeness(a: str, b: str) -> float:
    return float(alike(*slots_of([a, b])))


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many characters from the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Beside them: the task, and of its first and its last document which it is, and the text.
EDGE = ", part int, edge string, text string"


def ordered(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text) in `n` ranges of about equal numbers of rows, a task each, in descending order: nulls last, equal ids by the
    text's digest, equal texts of one id by row."""
    keyed = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc(), F.col("row").desc()]
    return keyed.repartitionByRange(max(1, n), *order).sortWithinPartitions(*order).select("doc_id", "text")


def _marked(make: Fingerprinter, doc, text: str, points: np.ndarray, steps, print_: str, following: str, next_points: np.ndarray, next_print: str) -> tuple:
    """A row of OUT out of a document and the text that follows it."""
    other, n = edited(text, following), len(text) // 3
    kept = len(text) - n
    f = print_ if other == text else make.of_edited(np.concatenate((points[:kept], next_points[:n])), steps, kept)
    return doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), print_, f, likeness(print_, f), likeness(print_, next_print)


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """OUT for each row of docs: fingerprints of each text and of its edited text, and their likeness. Documents are sorted by ranges, a
    task each, and each task compares those that follow each other in it. Of its first and its last document it writes the
    texts beside the results; these, two a task, are then joined across the tasks' bounds."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = ordered(docs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SLICE_CHARS)))

    def mark(batches):
        from pyspark import TaskContext

        make, part = Fingerprinter(slots), TaskContext.get().partitionId()
        out, held = [], None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = code_points(text)
                if held is not None and text == held[1]:
                    steps, print_ = held[3:]
                else:
                    steps = make.walked(points)
                    print_ = make.of(points, steps)
                if held is None:
                    out.append((doc, *[None] * 6, part, "first", text))
                else:
                    out.append((*_marked(make, *held, text, points, print_), None, None, None))
                held = doc, text, points, steps, print_
                if len(out) >= 2000:
                    yield _batch(out, OUT + EDGE)
                    out = []
        if held is not None:
            out.append((held[0], *[None] * 6, part, "last", held[1]))
        yield _batch(out, OUT + EDGE)

    both = stored(ranges.mapInArrow(mark, OUT + EDGE), "fingerprints", "zstd")  # hex digits take half a byte
    columns = [c.split()[0] for c in OUT.split(", ")]
    firsts, lasts = (both.where(F.col("edge") == e).select("part", "doc_id", "text") for e in ("first", "last"))
    over = Window.orderBy("part")
    # Numbers of tasks alone, not their documents.
    following = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(over), F.min("part").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    pairs = lasts.join(following, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after")

    def join(batches):
        make = Fingerprinter(slots)
        for batch in batches:
            out = []
            for doc, text, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                points, next_points = code_points(text), code_points(after)
                steps = make.walked(points)
                next_print = make.of(next_points, make.walked(next_points))
                out.append(_marked(make, doc, text, points, steps, make.of(points, steps), after, next_points, next_print))
            yield _batch(out)

    return both.where("edge is null").select(*columns).unionByName(pairs.mapInArrow(join, OUT))


def _batch(rows: list[tuple], schema: str = OUT) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edits between two texts, or None if they are more than `most`."""
    return edit_distances([a], [b], [most])[0]


def edit_distances(left: list[str], right: list[str], most: list[int]) -> list[int | None]:
    """Edits between the texts of each pair, or None if they are more than its own `most`. Pairs of about equal bounds are worked out
    together, as many as CELLS and CHARS hold. Time goes with the square of the bound."""
    out: list[int | None] = [None] * len(left)
    order = sorted((k for k, (s, t) in enumerate(zip(left, right, strict=True)) if abs(len(s) - len(t)) <= most[k]), key=lambda k: most[k])
    begin = 0
    while begin < len(order):
        end, chars = begin, 0
        while end < len(order) and (end == begin or (chars < CHARS and (end - begin) * most[order[end]] < CELLS and most[order[end]] <= 1.2 * most[order[begin]] + 8)):
            chars += len(left[order[end]]) + len(right[order[end]])
            end += 1
        some = order[begin:end]
        edits = _edits([code_points(left[k]) for k in some], [code_points(right[k]) for k in some], np.array([most[k] for k in some]))
        for k, n in zip(some, edits.tolist(), strict=True):
            out[k] = n if n >= 0 else None
        begin = end
    return out


def _ended(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, with an end that equals nothing in front of all and behind each; where each begins, and its length."""
    n = np.array([len(t) for t in texts])
    begin = np.cumsum(n + 1) - n
    flat = np.full(int(n.sum()) + len(n) + 1, end, np.uint32)
    for at, t in zip(begin.tolist(), texts, strict=True):
        flat[at : at + len(t)] = t
    return flat, begin, n


def _edits(left: list[np.ndarray], right: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edits of each pair, -1 if more than `most`: furthest reaching points, of all diagonals of all pairs at once. Lengths differ by
    `most` at most."""
    (x, bx, nx), (y, by, ny) = _ended(left, 0x110000), _ended(right, 0x110001)
    out, pair, goal = np.full(len(left), -1), np.arange(len(left)), nx - ny
    # Diagonals (place on the left less place on the right) from which the goal is in reach: a column each, and one more at either end.
    low, high = -((most - goal) // 2), (most + goal) // 2
    on = low[:, None] + np.arange(int(most.max()) + 3) - 1
    # Points are places in x; far below 0 where there is none. The farthest of each diagonal, and what leads from x to y.
    last = np.where((on < low[:, None]) | (on > high[:, None]), -NEVER // 2, bx[:, None] + np.minimum(nx[:, None], ny[:, None] + on))
    across = (by - bx)[:, None] - on
    reach = np.full(on.shape, -NEVER // 2)
    start, target, end = 1 - low, goal - low + 1, bx + nx
    first = bx[:, None].copy()
    _slide(first, x, y, np.take_along_axis(across, start[:, None], 1))
    np.put_along_axis(reach, start[:, None], first, 1)
    edits, live = 0, np.ones(len(pair), bool)
    while True:
        done = live & (reach[np.arange(len(pair)), target] >= end)
        out[pair[done]] = edits
        live &= ~done & (most > edits)
        count = np.count_nonzero(live)
        if not count:
            return out
        if count <= 0.8 * len(pair):
            pair, most, start, target, end, last, across, reach = (v[live] for v in (pair, most, start, target, end, last, across, reach))
            live = np.ones(count, bool)
        edits += 1
        # Columns that so many edits come to and from which those that remain lead to the goal.
        more = most - edits
        lo = max(1, int(start.min()) - edits, int((target - more).min()))
        hi = min(reach.shape[1] - 2, int(start.max()) + edits, int((target + more).max())) + 1
        at = np.maximum(reach[:, lo:hi], reach[:, lo - 1 : hi - 1])
        at += 1
        np.maximum(at, reach[:, lo + 1 : hi + 1], out=at)
        np.minimum(at, last[:, lo:hi], out=at)
        _slide(at, x, y, across[:, lo:hi])
        reach[:, lo:hi] = at


def _slide(at: np.ndarray, x: np.ndarray, y: np.ndarray, across: np.ndarray) -> None:
    """Moves points, places in x, on along equal characters: all by one, the few that go on in blocks."""
    same = np.take(x, at, mode="clip") == np.take(y, at + across, mode="clip")
    some = np.flatnonzero(same)
    if not len(some):
        return
    row, column = np.divmod(some, at.shape[1])
    p, live, size = at[row, column] + 1, np.arange(len(some)), 8
    q = p + across[row, column]
    while len(live):
        block = np.arange(size)
        equal = np.take(x, p[live, None] + block, mode="clip") == np.take(y, q[live, None] + block, mode="clip")
        moved = equal.argmin(axis=1)
        whole = (moved == 0) & equal[:, 0]
        moved[whole] = size
        p[live] += moved
        q[live] += moved
        live = live[whole]
        size = max(8, min(4 * size, 1024, (1 << 20) // max(1, len(live))))
    at[row, column] = p


def band_slots(slots: int, bands: int, band: int) -> list[list[int]]:
    """The slots that each key is made of; the same for all documents."""
    rng = np.random.default_rng(50)
    return [sorted(rng.choice(slots, band, replace=False).tolist()) for _ in range(bands)]


def near_copies(docs: DataFrame, least: float = LEAST, share: float = SHARE, slots: int = SLOTS, bands: int = BANDS, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b, likeness), a < b: documents that agree in a sample of slots, whose likeness is `least`
    and whose edit distance is at most `share` of the longer text. Equal texts collapse first.

    First each band bucket's documents are held against one of them: the smallest doc_id, then ones drawn by a hash, and
    of these each document's likest is verified, so large groups of copies contract. Then all pairs of a bucket that are
    still in different components are compared, each in the first bucket it shares, in blocks of about `block` documents dealt by
    Spark. So the links leave
    out pairs within a component but have the components that all pairs would give. Buckets hold ids alone; marks and
    texts are joined to pairs. Pairs whose lengths alone are too far apart are dropped before their marks are compared."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")

    def mark(batches):
        make = Anchored(slots)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([make(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "h", "mark"])

    every = docs.withColumn("h", F.unhex(F.sha2("text", 256))).mapInArrow(mark, "doc_id long, h binary, mark binary")
    keys = F.array(*(F.xxhash64(F.lit(k), *(F.substring("mark", 2 * i + 1, 2) for i in some)) for k, some in enumerate(band_slots(slots, bands, band))))
    # The lengths of all texts of an id, as an edit check takes each of them.
    lengths = docs.groupBy("doc_id").agg(F.min(F.length("text")).alias("lo"), F.max(F.length("text")).alias("hi"))
    marks = stored(every.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark")).drop("h").join(lengths, "doc_id"), "marks")
    keyed = marks.select("doc_id", F.posexplode(keys).alias("k", "band"))
    pivot = keyed.groupBy("band").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("hi")).where("p <> hi").select("band", "p")
    shared = stored(keyed.join(pivot, "band"), "shared")
    links = _near(docs, _likest(_marked_pairs(shared.where("doc_id <> p").select("p", "doc_id"), marks, least, share)), share)
    for k in range(1, STARS):
        placed = _placed(shared, links)
        x = F.min(F.struct(F.xxhash64(F.lit(k), "doc_id").alias("o"), F.col("doc_id").alias("p"), F.col("comp").alias("p_comp"))).alias("x")
        pivot = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), x).where("lo <> hi").select("band", "x.p", "x.p_comp")
        apart = placed.join(pivot, "band").where("comp <> p_comp").select("p", "doc_id")
        links = stored(links.unionByName(_near(docs, _likest(_marked_pairs(apart, marks, least, share)), share)), "links")
    placed = _placed(shared, links)
    open_ = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    open_ = stored(open_, "open")
    # Buckets of one block are dealt in lots, as most hold a few documents.
    lots = (open_.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // LOT + 1
    open_ = open_.select("band", "blocks", F.when(F.col("blocks") == 1, F.pmod("band", F.lit(lots))).otherwise(F.col("band")).alias("lot"))
    dealt = placed.join(open_, "band").join(marks, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lot", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "band", "k", "own", "doc_id", "comp", "mark", "lo", "hi")
    rest = dealt.groupBy("lot", "p", "q").applyInArrow(_compared(least, share, band_slots(slots, bands, band)), "a long, b long, likeness double")
    return links.unionByName(_near(docs, rest, share))


def near_copy_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id and component_id of each row of docs: the smallest doc_id that it is connected with by near_copies and equal
    texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("h"))
    reps = stored(rows.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("rep")), "reps")
    same = rows.where("doc_id is not null").join(reps, "h").where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(near_copies(docs, **options).select("a", "b").unionByName(same))
    return rooted(rows.select("doc_id"), "doc_id", roots, "component_id")


def _placed(shared: DataFrame, links: DataFrame) -> DataFrame:
    """band, k (which of a document's keys it is), doc_id and comp, the smallest doc_id of the component so far, of shared."""
    return stored(rooted(shared.select("band", "k", "doc_id"), "doc_id", components(links.select("a", "b")), "comp"), "placed")


def _far(lo, hi, share: float, floor=F.floor):
    """Whether texts of so many characters at least and others of so many at most differ in length by more edits than `share` of the
    longer text; for columns, or arrays with their floor."""
    return lo - hi > floor(lo * share)


def _marked_pairs(pairs: DataFrame, marks: DataFrame, least: float, share: float) -> DataFrame:
    """(a, b, likeness) of the pairs (p, doc_id) whose likeness is `least` and whose lengths are not too far apart."""
    both = pairs.distinct().join(marks, "doc_id").join(marks.select(*(F.col(c).alias(f"p_{c}") for c in marks.columns)).withColumnRenamed("p_doc_id", "p"), "p")
    both = both.where(~_far(F.col("lo"), F.col("p_hi"), share) & ~_far(F.col("p_lo"), F.col("hi"), share))
    return both.select(F.col("p").alias("a"), F.col("doc_id").alias("b"), "mark", "p_mark").mapInArrow(_alike(least), "a long, b long, likeness double")


def _likest(pairs: DataFrame) -> DataFrame:
    """Of each b the pair that is likest, the smallest a among equals."""
    return pairs.groupBy("b").agg(F.max(F.struct("likeness", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b", "x.likeness")


def _pairs(a, b, like) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], names=["a", "b", "likeness"])


def _alike(least: float):
    """The pairs of (a, b, mark, mark) whose likeness is `least`."""

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                like = alike(*(marks_of(batch.column(k).to_pylist()) for k in (2, 3)))
                keep = np.flatnonzero(like >= least)
                yield _pairs(*(batch.column(k).to_numpy()[keep] for k in (0, 1)), like[keep])

    return check


def _compared(least: float, share: float, keys: list[list[int]]):
    """All pairs of different components, of the two blocks p and q of each bucket of a lot, whose likeness is `least` and whose lengths are
    not too far apart. A pair that meets in many buckets comes from the first of them alone."""
    of_keys = np.array(keys)

    def compare(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        table = table.sort_by([("band", "ascending"), ("own", "ascending"), ("doc_id", "ascending")])
        band, k, own, ids, comp, lo, hi = (table.column(c).to_numpy() for c in ("band", "k", "own", "doc_id", "comp", "lo", "hi"))
        marks = marks_of(table.column("mark").to_pylist())
        # The documents of q that each of p is held against: those of its bucket, of one block those behind it.
        left = np.flatnonzero(own == p)
        first, behind = left + 1, np.searchsorted(band, band[left], "right")
        if p != q:
            first = behind - np.searchsorted(band[own == q], band[left], "right") + np.searchsorted(band[own == q], band[left], "left")
        out = [(ids[:0], ids[:0], np.zeros(0))]
        pairs = np.cumsum(behind - first)
        begin = 0
        while begin < len(left):
            end = max(begin + 1, int(np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + MARKS, "right")))
            n = (behind - first)[begin:end]
            i = np.repeat(left[begin:end], n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[begin:end], n)
            begin = end
            fits = (comp[i] != comp[j]) & ~_far(lo[i], hi[j], share, np.floor) & ~_far(lo[j], hi[i], share, np.floor)
            i, j = i[fits], j[fits]
            met = (marks[i] == marks[j])[:, of_keys].all(axis=2)
            # Of an id with several texts one may be in the bucket and another not.
            new = (met.argmax(axis=1) == k[i]) | ~met.any(axis=1)
            i, j = i[new], j[new]
            like = alike(marks[i], marks[j])
            keep = like >= least
            i, j = ids[i[keep]], ids[j[keep]]
            out.append((np.minimum(i, j), np.maximum(i, j), like[keep]))
        return pa.Table.from_batches([_pairs(*(np.concatenate([o[c] for o in out]) for c in range(3)))])

    return compare


def _near(docs: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b, likeness), as a < b, whose edit distance is at most `share` of the longer text. Pairs are dealt into groups by
    hashes of both ids, and a group gets each text that it has to do with once, however many pairs that is in."""
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("likeness").alias("likeness"))
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(chosen(docs, ids).dropDuplicates(["doc_id", "text"]), "texts")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = max(math.isqrt(n) + 1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // SIDE_CHARS))
    at = [F.pmod(F.xxhash64(c), F.lit(sides)).alias(g) for c, g in (("a", "g"), ("b", "h"))]
    dealt = pairs.select(*at, "a", "b", "likeness")
    ends = dealt.select("g", "h", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ends = ends.join(texts, "doc_id").select(F.col("g").alias("o_g"), F.col("h").alias("o_h"), "doc_id", "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[str]] = {}
        for doc, text in zip(right.column("doc_id").to_pylist(), right.column("text").to_pylist(), strict=True):
            found.setdefault(doc, []).append(text)
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        linked = np.zeros(len(a), bool)
        for begin in range(0, len(a), GATHERED):
            both = [(k, s, t) for k in range(begin, min(begin + GATHERED, len(a))) for s in found[a[k]] for t in found[b[k]]]
            edits = edit_distances([s for _, s, _ in both], [t for _, _, t in both], [int(share * max(len(s), len(t))) for _, s, t in both])
            linked[[k for (k, _, _), n in zip(both, edits, strict=True) if n is not None]] = True
        return left.filter(pa.array(linked)).select(["a", "b", "likeness"])

    # So many partitions, however few bytes: the work goes with the pairs and their texts' lengths.
    groups = dealt.repartition(n, "g", "h").groupBy("g", "h").cogroup(ends.repartition(n, "o_g", "o_h").groupBy("o_g", "o_h"))
    return stored(groups.applyInArrow(check, "a long, b long, likeness double"), "verified")
