"""Exact nearest neighbours within specimens, ties by id.

Each specimen is cut into leaves of about equal numbers of points: by quantiles of the first axis, then within these by
quantiles of the next. An axis gets as many cuts as make leaves about as wide as high; what is still far larger than a leaf
is cut once more in the same way, to any depth, and tables of the cuts, keyed by the parts above, are the directory by which
points and balls are routed. Every point looks for its neighbours in its own leaf, once; what it finds bounds how far the true
ones may be. Points whose ball stays within the leaf are done. The others are looked up in each leaf that their ball reaches,
and the nearest of all stay. Leaves hold equal numbers however points clump; only points at one place can't be cut apart, and
of these the k + 1 with the smallest ids stand for all.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.functions.geometry import axes
from fieldmend.session import cut, small

#: Points of a leaf, on average; most cuts of an axis and one more; rows searched together; distances held at once by a task.
LEAF, PARTS, BLOCK, MATRIX = 1024, 128, 64, 1 << 18
#: Leaves of points of piles are so many times as large, as nothing is searched in them.
PILES = 4
#: A ball is taken by so much larger, for rounding.
HAIR = 1e-9
LISTS = {"d2": "array<double>", "dst": "array<long>", "vote": "array<long>"}
FOUND = pa.schema([("id", pa.int64()), ("d2", pa.float64()), ("dst", pa.int64()), ("vote", pa.int64())])


def k_nearest(src: np.ndarray, ids: np.ndarray, at: np.ndarray, dst: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and squared distance of each row's k nearest columns, by (distance, id) and but itself. dst ascend.
    Rows look at the columns around them on the longest axis; those whose k-th neighbour is as far as a column left out look
    again, farther."""
    rows, cols, dist = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    n = len(dst)
    if not n or not len(src) or k.max() < 1:
        return rows[0], cols[0], dist[0]
    own = np.minimum(np.searchsorted(dst, ids), n - 1)
    mine = dst[own] == ids
    axis = int(np.ptp(at, axis=0).argmax())
    order = np.argsort(at[:, axis], kind="stable")
    line, todo, reach = at[order, axis], np.argsort(src[:, axis], kind="stable"), 48 + 2 * int(k.max())
    while len(todo):
        late, begin = [], 0
        while begin < len(todo):
            size = BLOCK
            while True:
                row = todo[begin : begin + size]
                low = max(0, np.searchsorted(line, src[row[0], axis]) - reach)
                high = min(n, np.searchsorted(line, src[row[-1], axis], "right") + reach)
                if size == 1 or len(row) * (high - low) <= MATRIX:
                    break
                size = max(1, min(len(row) // 2, MATRIX // (high - low)))
            begin += len(row)
            col = np.sort(order[low:high])
            d2 = reduce(lambda s, t: s + t, [(src[row, j, None] - at[None, col, j]) ** 2 for j in range(src.shape[1])])
            here = np.minimum(np.searchsorted(col, own[row]), len(col) - 1)
            itself = np.flatnonzero(mine[row] & (col[here] == own[row]))
            d2[itself, here[itself]] = np.inf
            most = min(int(k[row].max()), len(col))
            if most < 1:
                continue
            bound = np.partition(d2, most - 1, axis=1)[:, most - 1]
            if high - low < n:
                # Squares and sums of what isn't negative round alike, so no column left out is nearer than this.
                gap = np.full(len(row), np.inf)
                if low > 0:
                    gap = (src[row, axis] - line[low - 1]) ** 2
                if high < n:
                    gap = np.minimum(gap, (line[high] - src[row, axis]) ** 2)
                sure = bound < gap
                late.append(row[~sure])
                row, d2, bound = row[sure], d2[sure], bound[sure]
            r, c = np.nonzero(d2 <= np.minimum(bound, np.finfo(float).max)[:, None])
            v = d2[r, c]
            by = np.lexsort((c, v, r))
            r, c, v = r[by], c[by], v[by]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k[row][r]
            rows.append(row[r[keep]])
            cols.append(col[c[keep]])
            dist.append(v[keep])
        todo, reach = np.concatenate(late) if late else todo[:0], 4 * reach
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
    by = np.argsort(r, kind="stable")
    return r[by], c[by], v[by]


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _matrix(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(a).to_numpy().astype(float) for a in names], axis=1)


def _searched(left: pa.Table, right: pa.Table, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k_nearest of left's points among right's, which ascend by id."""
    return k_nearest(_matrix(left, names), _ints(left, "id"), _matrix(right, names), _ints(right, "id"), _ints(left, "k"))


def _finder(names: tuple[str, ...], lists: tuple[str, ...], keep: list[str]):
    """The points of a leaf with their lists in it, with r2, the squared distance of the k-th neighbour (infinite if there are fewer),
    and fm_out: whether the ball of this size reaches beyond the leaf."""

    def find(leaf: pa.Table) -> pa.Table:
        leaf = leaf.sort_by("id")
        r, c, v = _searched(leaf, leaf, names)
        far, count = np.zeros(len(leaf)), np.bincount(r, minlength=len(leaf))
        np.maximum.at(far, r, v)
        far[count < _ints(leaf, "k")] = np.inf
        out_ = np.zeros(len(leaf), bool)
        for a in names:
            x = leaf.column(a).to_numpy()
            r_ = np.sqrt(far) * (1 + HAIR) + np.abs(x) * 1e-15
            out_ |= (x - r_ < leaf.column(f"fm_lo{a}").to_numpy()) | (x + r_ >= leaf.column(f"fm_hi{a}").to_numpy())
        out_ &= _ints(leaf, "k") > 0
        offsets, at = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(c)
        out = leaf.select(keep).append_column("r2", pa.array(far)).append_column("fm_out", pa.array(out_)).append_column("own", leaf.column("vote"))
        for name in lists:
            items = pa.array(v) if name == "d2" else leaf.column({"dst": "id", "vote": "vote"}[name]).take(at).combine_chunks()
            out = out.append_column(name, pa.ListArray.from_arrays(offsets, items))
        return out

    return find


def _looker(names: tuple[str, ...], keep: list[str]):
    """What points (left) find in a leaf (right) that their balls reach, no farther than r2; a row each."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([c.removeprefix("o_") for c in right.column_names]).sort_by("id")
        r, c, v = _searched(left, right, names)
        near = v <= left.column("r2").to_numpy()[r]
        r, c, v = r[near], pa.array(c[near]), v[near]
        found = left.take(pa.array(r)).select(keep)
        for name, column in (("d2", pa.array(v)), ("dst", right.column("id").take(c)), ("vote", right.column("vote").take(c))):
            found = found.append_column(name, column)
        return found

    return look


def _parts(names: tuple[str, ...], leaf: int) -> dict[str, Column]:
    """Into how many parts each axis is cut, from n and the quantiles q of each axis."""
    span = {a: F.get(f"q{a}", F.lit(PARTS * 19 // 20 - 1)) - F.get(f"q{a}", F.lit(max(0, PARTS // 20 - 1))) for a in names}
    want = F.greatest(F.col("n") / F.lit(float(leaf)), F.lit(1.0))
    wide = F.array_sort(F.array(*span.values()))

    def width(j: int) -> Column:
        """The side of a leaf if the j widest axes are cut."""
        return F.pow(reduce(lambda p, q: p * q, [wide[len(names) - 1 - i] for i in range(j)]) / want, F.lit(1.0 / j))

    side = width(1)
    for j in range(2, len(names) + 1):
        side = F.when(wide[len(names) - j] >= width(j), width(j)).otherwise(side)
    return {a: F.when((side > 0) & (want > 1), F.least(F.greatest(F.ceil(span[a] / side), F.lit(1)), F.lit(PARTS))).otherwise(F.lit(1)).cast("int") for a in names}


def _quantiles(a: str) -> Column:
    return F.percentile_approx(a, F.array(*(F.lit(i / PARTS) for i in range(1, PARTS))), F.lit(1_000))


def _cuts(q: str, parts: Column) -> Column:
    """The places of the cuts, out of quantiles at all PARTS."""
    places = F.transform(F.slice(F.sequence(F.lit(0), parts), F.lit(2), F.greatest(parts - 1, F.lit(0))), lambda i: F.get(q, F.round(i * PARTS / parts).cast("int") - 1))
    return F.array_distinct(places)


def _part(cuts: str, at: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= at))


class Leaves:
    """How each specimen is cut: a table of cuts for each level, an axis of a round, keyed by the parts of the levels above."""

    def __init__(self, points: DataFrame, names: tuple[str, ...], k: int):
        self.leaf, self.names = max(LEAF, 8 * (k + 1)), names
        self.levels: list[tuple[str, str, list[str], DataFrame]] = []  # axis, name of the part, the parts above, table
        self.round = 0
        box = points.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), *(_quantiles(a).alias(f"q{a}") for a in names))
        box, rows = small(self._planned(box, names, ["sample"]))
        self.box = box
        self.largest = None if rows is None else max((r["n"] for r in rows), default=0)
        self._cut(points, names, box, rows)
        # A round makes PARTS leaves an axis at most; what is far larger is cut again until cuts find nothing more to part.
        above = self.largest
        while self.levels and (above is None or above > self.leaf * PARTS ** len(names) // 2):
            keys = self.keys
            groups = self.placed(points).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(_quantiles(a).alias(f"q{a}") for a in names)).where(F.col("n") > 4 * self.leaf)
            groups, rows = small(self._planned(groups, names, keys))
            most = groups.agg(F.max("n")).first()[0] if rows is None else max((r["n"] for r in rows), default=0)
            if not most or (above is not None and most >= above and self.round):
                break
            before, above, self.round = len(self.levels), most, self.round + 1
            self._cut(points, names, groups, rows)
            if len(self.levels) == before:
                break

    @property
    def keys(self) -> list[str]:
        return ["sample", *(part for _, part, _, _ in self.levels)]

    def _planned(self, groups: DataFrame, names: tuple[str, ...], keys: list[str]) -> DataFrame:
        """Groups of points with the number of parts of each axis, and the cuts of the first."""
        parts, first = _parts(names, self.leaf), names[0]
        groups = groups.select(*keys, "n", *(p.alias(f"p{a}") for a, p in parts.items()), f"q{first}")
        return groups.select(*keys, "n", *(f"p{a}" for a in names), _cuts(f"q{first}", F.col(f"p{first}")).alias("cuts"))

    def _cut(self, points: DataFrame, names: tuple[str, ...], groups: DataFrame, rows: list | None) -> None:
        """Levels for one round over groups of points, one for each axis that is cut at all."""
        used, above = [a for a in names if rows is None or any(r[f"p{a}"] > 1 for r in rows)], self.keys
        for a in used:
            part = f"s{self.round}{a}"
            if a == names[0]:
                self.levels.append((a, part, above, groups.select(*above, "cuts")))
                continue
            keys = self.keys
            sized = self.placed(points).join(groups.select(*above, f"p{a}"), above)
            table = sized.groupBy(*keys).agg(_quantiles(a).alias("q"), F.max(f"p{a}").alias("p"))
            self.levels.append((a, part, keys, small(table.select(*keys, _cuts("q", F.col("p")).alias("cuts")))[0]))

    def placed(self, df: DataFrame, ends: bool = False) -> DataFrame:
        """df (sample and coordinates) with the number of its part on each level; 0 where a level leaves it whole. With ends also
        between which cuts of each axis the leaf lies, as fm_lo and fm_hi."""
        if ends:
            df = df.withColumns({f"fm_{e}{a}": F.lit(v) for a in self.names for e, v in (("lo", -math.inf), ("hi", math.inf))})
        for a, part, keys, table in self.levels:
            df = df.join(table.withColumnRenamed("cuts", "fm_cuts"), keys, "left").withColumn(part, F.coalesce(_part("fm_cuts", F.col(a)), F.lit(0)))
            if ends:
                low, high = F.greatest(f"fm_lo{a}", F.get("fm_cuts", F.col(part) - 1)), F.least(f"fm_hi{a}", F.get("fm_cuts", F.col(part)))
                df = df.withColumns({f"fm_lo{a}": low, f"fm_hi{a}": high})
            df = df.drop("fm_cuts")
        return df

    def reached(self, df: DataFrame) -> DataFrame:
        """A row for each leaf that a ball of squared radius r2 about each row of df reaches, with the leaf's parts as to_."""
        for a, part, keys, table in self.levels:
            table = table.select(*(F.col(c).alias(c if c == "sample" else f"to_{c}") for c in keys), F.col("cuts").alias("fm_cuts"))
            df = df.join(table, ["sample", *(f"to_{c}" for c in keys if c != "sample")], "left")
            low, high = (F.coalesce(_part("fm_cuts", end), F.lit(0)) for end in self._ball(a))
            df = df.withColumn(f"to_{part}", F.explode(F.sequence(low, high))).drop("fm_cuts")
        return df

    @staticmethod
    def _ball(a: str) -> tuple[Column, Column]:
        """The ends of a ball on an axis; a hair more, for rounding."""
        r = F.sqrt("r2") * (1 + HAIR) + F.abs(F.col(a)) * 1e-15
        return F.col(a) - r, F.col(a) + r


def piles(points: DataFrame, names: tuple[str, ...], k: int, lists: tuple[str, ...], leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """Points to search, and the lists of the others: of more than k + 1 points at one place those beyond the first
    k + 1 have the first k as their neighbours. The others' leaf is of whole places of about `leaf` points, or a part of a larger one."""
    place = ["sample", *names]
    heavy = cut(points.groupBy(*place).agg(F.count(F.lit(1)).alias("fm_n")).where(F.col("fm_n") > k + 1))
    heap = heavy.agg(F.sum("fm_n")).first()[0]
    if not heap:
        return points, None
    # The limit on the place's rows is kept in front of the shuffle too, so that a pile is in no task as a whole.
    first = cut(points.withColumn("fm_row", F.row_number().over(Window.partitionBy(*place).orderBy("id"))).where(F.col("fm_row") <= k + 1))
    items = F.array_sort(F.collect_list(F.when(F.col("fm_row") <= k, F.struct("id", "vote"))))
    ends = first.groupBy(*place).agg(F.max("id").alias("fm_last"), items.alias("fm_items")).join(heavy, place)
    dealt = F.concat_ws(".", F.lit("pile"), F.pmod(F.xxhash64(*place), F.lit(heap // leaf + 1)).cast("string"))
    ends = small(cut(ends.select(*place, "fm_last", "fm_items", dealt.alias("leaf"), (F.col("fm_n") / leaf).cast("long").alias("fm_more"))))[0]
    rest = points.join(ends, place).where(F.col("id") > F.col("fm_last")).withColumn("fm_items", F.slice("fm_items", F.lit(1), F.col("k")))
    each = {"d2": F.transform("fm_items", lambda x: F.lit(0.0)), "dst": F.col("fm_items.id"), "vote": F.col("fm_items.vote")}
    part = F.when(F.col("fm_more") < 2, F.col("leaf")).otherwise(F.concat_ws(".", "leaf", F.pmod(F.xxhash64("id"), F.col("fm_more")).cast("string")))
    return first.drop("fm_row"), rest.select("sample", "id", F.col("vote").alias("own"), *names, *(each[c].alias(c) for c in lists), part.alias("leaf"))


def nearest_lists(
    points: DataFrame, dims: int, k: int | str | None, carry: str | None = None, lists: tuple[str, ...] = ("d2", "dst", "vote"), classes: int = 1, leaf: bool = False, at: bool = False
) -> DataFrame:
    """sample, id, own and lists: d2, dst and vote (or some of these) of the k nearest other points of the specimen by
    (d2, dst), as arrays; k is the specimen's size less one where that is smaller. Without k each specimen has its
    automatic number for so many classes; a text names a column of points that has it, MOST_NEIGHBOURS at most. carry names a
    whole-number column of points: of the point itself as own, of dst as vote. With leaf also the leaf that the point lies
    in, as text; with at also its coordinates."""
    names = axes(dims)
    own_k = automatic_neighbours(F.col("n"), classes) if k is None else F.col("fm_k") if isinstance(k, str) else F.lit(k)
    given = [F.col(k).alias("fm_k")] if isinstance(k, str) else []
    k = k if isinstance(k, int) else MOST_NEIGHBOURS
    vote = F.col(carry).cast("long") if carry else F.lit(None).cast("long")
    points = points.select("sample", "id", vote.alias("vote"), *(F.col(a).cast("double").alias(a) for a in names), *given)
    leaves = Leaves(points, names, k)
    points = points.join(leaves.box.select("sample", "n"), "sample").withColumn("k", F.least(own_k, F.col("n") - 1).cast("int")).drop("n", "fm_k")
    rest = None
    if leaves.largest is None or leaves.largest > 8 * leaves.leaf:
        points, rest = piles(points, names, k, lists, leaves.leaf)
    keys = leaves.keys
    parts = keys[1:]
    also = list(names) if at else []
    where = ([F.concat_ws(".", *parts).alias("leaf")] if leaf else []) + also
    if rest is not None:
        rest = rest.select("sample", "id", "own", *lists, *(["leaf"] if leaf else []), *also)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # So many partitions, however few bytes: the work of a leaf grows with its points.
    placed = leaves.placed(points, ends=True).repartition(n, *keys)
    kept = ["sample", "id", "k", *names, *parts]
    kinds = "sample string, id long, k int, " + ", ".join(f"{a} double" for a in names) + "".join(f", {c} int" for c in parts)
    out = ", ".join(f"{c} {LISTS[c]}" for c in lists)
    found = placed.groupBy(*keys).applyInArrow(_finder(names, lists, kept), f"{kinds}, r2 double, fm_out boolean, own long, {out}")
    if not parts:
        done = found.select("sample", "id", "own", *lists, *where)
        return done if rest is None else done.unionByName(rest)
    found = cut(found)
    inside = found.where(~F.col("fm_out")).select("sample", "id", "own", *lists, *where)
    carried = ["sample", "id", "k", "own", *(["leaf"] if leaf else []), *also]
    unlike = [a for a in names if a not in also]
    asked = leaves.reached(found.where("fm_out").select("sample", "id", "k", "own", *where, "r2", *unlike))
    asked = asked.select(*carried, "r2", *unlike, *(F.col(f"to_{c}").alias(c) for c in parts))
    # Names of their own, as both sides come from one frame.
    there = found.select(*(F.col("own" if c == "vote" else c).alias(f"o_{c}") for c in ["id", "vote", *names, *keys]))
    more = asked.repartition(n, *keys).groupBy(*keys).cogroup(there.groupBy(*(f"o_{c}" for c in keys)))
    more = more.applyInArrow(_looker(names, carried), f"sample string, id long, k int, own long, {'leaf string, ' if leaf else ''}{''.join(f'{a} double, ' for a in also)}d2 double, dst long, vote long")
    item = F.struct("d2", "dst", "vote")
    merged = more.groupBy("sample", "id").agg(F.first("own").alias("own"), *(F.first(c).alias(c) for c in [*(["leaf"] if leaf else []), *also]), F.slice(F.array_sort(F.collect_list(item)), 1, F.first("k")).alias("fm_items"))
    merged = merged.select("sample", "id", "own", *(F.col("fm_items")[c].alias(c) for c in lists), *(["leaf"] if leaf else []), *also)
    done = inside.unionByName(merged)
    return done if rest is None else done.unionByName(rest)


def nearest(points: DataFrame, dims: int, k: int | None, carry: str | None = None, classes: int = 1) -> DataFrame:
    """Edges (sample, src, dst, d2, rank) to the k nearest other points, as in nearest_lists; with carry also vote."""
    lists = nearest_lists(points, dims, k, carry, ("d2", "dst", "vote") if carry else ("d2", "dst"), classes)
    edges = lists.select("*", F.posexplode("dst").alias("at", "to"))
    votes = [F.get("vote", F.col("at")).alias("vote")] if carry else []
    return edges.select("sample", F.col("id").alias("src"), F.col("to").alias("dst"), F.get("d2", F.col("at")).alias("d2"), (F.col("at") + 1).alias("rank"), *votes)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once: sample, a, b with a < b."""
    return edges.select("sample", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


#: Bounds of the automatic number of neighbours.
LEAST_NEIGHBOURS, MOST_NEIGHBOURS = 11, 31


def automatic_neighbours(n: Column, classes: int | Column, half_even: bool = False) -> Column:
    """automatic_k of a column of specimens' sizes."""
    classes = classes if isinstance(classes, Column) else F.lit(classes)
    raw = F.log2(F.greatest(n, F.lit(1)).cast("double")) * 1.6 * F.least(F.lit(1.0), 5.0 / F.greatest(classes, F.lit(1)))
    whole = F.bround(raw) if half_even else F.floor(raw + 0.5)
    return F.least(F.greatest(whole.cast("int"), F.lit(LEAST_NEIGHBOURS)), F.lit(MOST_NEIGHBOURS))


def automatic_k(n: int, classes: int, half_even: bool = False) -> int:
    """min(31, max(11, round(1.6 log2(n) min(1, 5 / classes)))), rounded away from zero, or to even in tiles."""
    raw = 1.6 * math.log2(max(n, 1)) * min(1.0, 5.0 / max(1, classes))
    return min(MOST_NEIGHBOURS, max(LEAST_NEIGHBOURS, round(raw) if half_even else math.floor(raw + 0.5)))
