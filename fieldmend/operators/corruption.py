"""Corruption of labels in which every class of every specimen keeps a correct point. All draws are hashes of seed and
row, so a corruption is the same however rows are dealt."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.functions.geometry import axes
from fieldmend.functions.rng import pick, uniform
from fieldmend.operators import masks
from fieldmend.operators.sampling import first_of_groups, ranked
from fieldmend.session import cut, few, small

INFEASIBLE = "so many labels can't change: each class of each specimen must keep one point; take a smaller share"


def anchors(points: DataFrame, proximity: str | None = None) -> DataFrame:
    """points (sample, id, truth) with anchor: of each specimen and class the point farthest from a boundary, the first
    of equals. It is found by partial aggregates and joined by its id, so that no class is in one task."""
    far = F.col(proximity) if proximity else F.lit(0.0)
    found = points.groupBy("sample", "truth").agg(F.min_by("id", F.struct(-far, "id")).alias("id"))
    return points.join(small(found.select("sample", "id", F.lit(True).alias("anchor")))[0], ["sample", "id"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))


def check_anchors(points: DataFrame, label: str = "label") -> DataFrame:
    """sample, truth and held: whether a point of the class still has its label."""
    return points.groupBy("sample", "truth").agg(F.bool_or(F.col(label) == F.col("truth")).alias("held"))


def require_anchors(points: DataFrame, context: str, label: str = "label") -> None:
    if check_anchors(points, label).where(~F.col("held")).limit(1).count():
        raise ValueError(f"{context} does not retain one correct label of every class within each specimen")


def select_preserving(
    points: DataFrame, count: int | Column, order: list[Column], proximity: str | None = None, eligible: Column | None = None, by: list[str] | None = None
) -> DataFrame:
    """points with anchor and selected: the first `count` in an order, of each scenario if `by` names its columns. A group (specimen
    and class) that is selected as a whole gives its anchor back; as many of the next points take their place as leave
    each group one. All scenarios are worked out together: one sort by ranges places all rows, one aggregate tells what each
    group gives back, and only points close behind the last one selected are looked at for the exchange."""
    by = list(by or [])
    group = [*by, "sample", "truth"]
    far = F.col(proximity) if proximity else F.lit(0.0)
    marked = points.withColumns({"fm_may": F.lit(True) if eligible is None else eligible, "fm_count": count if isinstance(count, Column) else F.lit(count), "fm_far": far})
    placed = ranked(marked, F.desc("fm_may"), *order, by=by, out="fm_rank").withColumn("fm_first", F.col("fm_may") & (F.col("fm_rank") <= F.col("fm_count")))
    open_ = F.when(~F.col("fm_first"), F.col("fm_rank"))
    groups = placed.groupBy(*group).agg(
        F.min_by("id", F.struct(-F.col("fm_far"), "id")).alias("fm_anchor"), F.count_if("fm_first").alias("fm_in"), F.count(F.lit(1)).alias("fm_all"),
        F.max(open_).alias("fm_last"), F.count_if(F.col("fm_may") & ~F.col("fm_first")).alias("fm_rest"), F.max("fm_count").alias("fm_count"),
    )
    changed = exchanged(placed.where("fm_may and not fm_first").select(*group, "id", "fm_rank"), cut(groups), by)
    done = placed.join(changed, [*by, "sample", "id"], "left")
    return done.select(*points.columns, F.coalesce("anchor", F.lit(False)).alias("anchor"), F.coalesce("fm_sel", "fm_first").alias("selected"))


def exchanged(open_: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """anchor and fm_sel of the rows that are an anchor or whose selection changes, as groups that are selected as a whole give their
    anchor back. open_: the rows behind the last one selected with their fm_rank, twice as many as there are groups at least;
    groups: a row each with its anchor, rows, rows selected (fm_in), rows left (fm_rest) and the place of the last of these."""
    group = [*by, "sample", "truth"]
    whole = F.col("fm_in") == F.col("fm_all")
    spare = F.greatest(F.least("fm_rest", F.col("fm_all") - F.col("fm_in") - 1), F.lit(0))
    totals = groups.groupBy(*by).agg(F.sum("fm_in").alias("fm_taken"), F.count_if(whole).alias("fm_back"), F.sum(spare).alias("fm_spare"), F.max("fm_count").alias("fm_want"), F.count(F.lit(1)).alias("fm_groups"))
    totals, _ = small(totals)
    if totals.where("fm_taken < fm_want or fm_spare < fm_back").limit(1).count():
        raise ValueError(INFEASIBLE)
    # Behind the last one selected each group holds back one point, so these hold as many spare ones as are given back.
    near = (open_.join(totals, by) if by else open_.crossJoin(totals)).where("fm_back > 0 and fm_rank <= fm_want + fm_back + fm_groups")
    near = near.join(groups.select(*group, "fm_last"), group).where("not (fm_rank <=> fm_last)")
    near = near.withColumn("fm_row", F.row_number().over(Window.partitionBy(*by).orderBy("fm_rank"))).where("fm_row <= fm_back")
    changed = near.select(*by, "sample", "id", F.lit(False).alias("fm_is"), F.lit(True).alias("fm_sel"))
    held = groups.select(*by, "sample", F.col("fm_anchor").alias("id"), F.lit(True).alias("fm_is"), F.when(whole, False).alias("fm_sel"))
    return small(changed.unionByName(held).groupBy(*by, "sample", "id").agg(F.bool_or("fm_is").alias("anchor"), F.bool_or("fm_sel").alias("fm_sel")))[0]


#: Bins of a unit of the square root of a key, bins in all (keys are at most 3), and counts that a task holds at once.
BINS, ALL_BINS, HELD = 256, 512, 1 << 23


class Keyed:
    """The order in which scenarios take points, worked out in batches of points for one scenario after the other, so that a row for each
    scenario and point is never shuffled, sorted or stored."""

    def __init__(self, plan: list[dict], names: list[str], seed: int):
        self.plan, self.names, self.seed = plan, names, seed

    def keys(self, batch: pa.RecordBatch):
        """Each scenario with its points' keys (those with the least are taken) and, for patches, their nearest centres."""
        ids = [str(i).encode() for i in batch.column("id").to_pylist()]
        edge = batch.column("fm_edge").to_numpy(zero_copy_only=False)
        at = [batch.column(f"fm_{a}").to_numpy() for a in self.names]
        for one in self.plan:
            if one["mechanism"] in ("random", "boundary"):
                # functions.rng.uniform of the scenario and the point: the first 52 bits of an md5.
                head = f"{self.seed}:order:{one['scenario']}:".encode()
                bits = np.frombuffer(b"".join([hashlib.md5(head + i, usedforsecurity=False).digest() for i in ids]), ">u8")[::2] >> 12
                draw = bits.astype(np.int64) / float(1 << 52)
                yield one, draw if one["mechanism"] == "random" else np.where(edge, draw, 1 + draw), None
                continue
            key, owner = np.full(len(ids), np.inf), np.zeros(len(ids), int)
            for j, c in enumerate(one["fm_centres"]):
                d2 = reduce(lambda p, q: p + q, [(x - c[f"fm_{a}"]) * (x - c[f"fm_{a}"]) for x, a in zip(at, self.names, strict=True)])
                nearer = d2 < key
                key[nearer], owner[nearer] = d2[nearer], j
            yield one, key, owner

    def counted(self, batches):
        """Numbers of points by scenario, specimen, class and bin of the key."""
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for (sample, truth), counts in held.items():
                at, bins = np.nonzero(counts)
                scenario = np.array([one["scenario"] for one in self.plan], np.int32)[at]
                yield pa.record_batch({
                    "scenario": pa.array(scenario), "sample": pa.array([sample] * len(at), pa.string()), "truth": pa.array([truth] * len(at), pa.int32()), "fm_bin": pa.array(bins), "fm_c": pa.array(counts[at, bins]),
                })
            held.clear()

        for batch in batches:
            if not len(batch):
                continue
            pairs = list(zip(batch.column("sample").to_pylist(), batch.column("truth").to_pylist(), strict=True))
            groups = {g: k for k, g in enumerate(dict.fromkeys(pairs))}
            code = np.array([groups[g] for g in pairs]) * ALL_BINS
            if held and (len(held.keys() | groups.keys())) * len(self.plan) * ALL_BINS > HELD:
                yield from flush()
            for g in groups:
                held.setdefault(g, np.zeros((len(self.plan), ALL_BINS), np.int64))
            for k, (_, key, _) in enumerate(self.keys(batch)):
                counts = np.bincount(code + _bins(key), minlength=len(groups) * ALL_BINS).reshape(-1, ALL_BINS)
                for g, i in groups.items():
                    held[g][k] += counts[i]
        yield from flush()

    def within(self, batches, ends: dict[int, tuple[int, int]]):
        """The points whose key lies in the bins from the first to the last of their scenario's ends."""
        for batch in batches:
            for one, key, _ in self.keys(batch):
                low, high = ends[one["scenario"]]
                at = np.flatnonzero((_bins(key) >= low) & (_bins(key) <= high))
                if len(at):
                    rows = batch.select(["sample", "truth", "id"]).take(pa.array(at))
                    yield pa.record_batch({"scenario": pa.array(np.full(len(at), one["scenario"], np.int32)), **dict(zip(rows.schema.names, rows.columns, strict=True)), "fm_key": pa.array(key[at])})

    def decided(self, batches, last: dict[int, tuple]):
        """Every scenario's points with fm_first, whether they come no later than its last one (key, id and sample), and fm_new, the class
        they then take, but for random ones."""
        for batch in batches:
            near = batch.column("fm_near").to_numpy()
            for one, key, owner in self.keys(batch):
                end = last.get(one["scenario"])
                first = np.zeros(len(key), bool) if end is None else key < end[0]
                for i in np.flatnonzero(key == end[0]) if end is not None else ():
                    first[i] = (batch.column("id")[i].as_py(), batch.column("sample")[i].as_py()) <= end[1:]
                new = near
                if owner is not None:
                    target = np.array([c["near"] for c in one["fm_centres"]])[owner]
                    new = np.where(target == batch.column("truth").to_numpy(), near, target)
                new = pa.nulls(len(key), pa.int32()) if one["mechanism"] == "random" else pa.array(new.astype(np.int32))
                yield pa.record_batch({
                    "scenario": pa.array(np.full(len(key), one["scenario"], np.int32)), "sample": batch.column("sample"), "id": batch.column("id"), "truth": batch.column("truth"), "fm_first": pa.array(first), "fm_new": new,
                })


def _bins(key: np.ndarray) -> np.ndarray:
    return np.minimum(np.sqrt(key) * BINS, ALL_BINS - 1).astype(np.int64)


def selected_by_key(points: DataFrame, keyed: Keyed, sizes: DataFrame, n: int) -> DataFrame:
    """select_preserving for all scenarios of a plan, each with its fm_count: every row of scenario, sample, id and truth, with fm_new and
    selected. Points are counted by bins of their keys, those in the bins about a scenario's last one selected are put in
    order, and the key of that one tells all others. sizes: each specimen and class with its anchor; n: all points."""
    spark, group = points.sparkSession, ["scenario", "sample", "truth"]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    counts = cut(points.mapInArrow(keyed.counted, "scenario int, sample string, truth int, fm_bin long, fm_c long").groupBy(*group, "fm_bin").agg(F.sum("fm_c").alias("fm_c")))
    wanted = F.broadcast(spark.createDataFrame([(one["scenario"], one["fm_count"]) for one in keyed.plan], "scenario int, fm_count long"))  # a row per scenario
    upto = F.sum("fm_c").over(Window.partitionBy("scenario").orderBy("fm_bin"))
    ends = counts.groupBy("scenario", "fm_bin").agg(F.sum("fm_c").alias("fm_c")).withColumn("fm_upto", upto).join(wanted, "scenario")
    far = F.least(F.col("fm_count") + 2 * sizes.count(), F.lit(n))
    ends = ends.groupBy("scenario").agg(
        F.max("fm_count").alias("fm_count"), F.min(F.when(F.col("fm_upto") >= F.col("fm_count"), F.col("fm_bin"))).alias("fm_low"), F.min(F.when(F.col("fm_upto") >= far, F.col("fm_bin"))).alias("fm_high"),
        F.coalesce(F.max(F.when(F.col("fm_upto") < F.col("fm_count"), F.col("fm_upto"))), F.lit(0)).alias("fm_before"),
    )
    ends, rows = small(ends)
    reach = {r["scenario"]: (r["fm_low"], r["fm_high"]) for r in rows}
    within = cut(points.mapInArrow(lambda it: keyed.within(it, reach), f"scenario int, sample string, truth int, id {kinds['id']}, fm_key double"))
    near = ranked(within, F.col("fm_key"), F.col("id"), F.col("sample"), by=["scenario"], out="fm_rank").join(ends, "scenario").withColumn("fm_rank", F.col("fm_rank") + F.col("fm_before"))
    left = F.col("fm_rank") > F.col("fm_count")
    around = near.groupBy(*group).agg(F.count_if(~left).alias("fm_near"), F.max(F.when(left, F.col("fm_rank"))).alias("fm_last"))
    groups = counts.join(ends, "scenario").groupBy(*group).agg(
        F.sum("fm_c").alias("fm_all"), F.sum(F.when(F.col("fm_bin") < F.col("fm_low"), F.col("fm_c")).otherwise(0)).alias("fm_below"), F.max(F.col("fm_bin") > F.col("fm_high")).alias("fm_beyond"), F.max("fm_count").alias("fm_count")
    )
    groups = groups.join(around, group, "left").join(sizes, ["sample", "truth"])
    chosen = F.col("fm_below") + F.coalesce("fm_near", F.lit(0))
    # The last row of a group may lie behind those put in order.
    groups = cut(groups.select(*group, "fm_anchor", "fm_all", "fm_count", chosen.alias("fm_in"), (F.col("fm_all") - chosen).alias("fm_rest"), F.when(~F.col("fm_beyond"), F.col("fm_last")).alias("fm_last")))
    changed = exchanged(near.where(left).select(*group, "id", "fm_rank"), groups, ["scenario"]).select("scenario", "sample", "id", "fm_sel").where("fm_sel is not null")
    last = {r["scenario"]: (r["fm_key"], r["id"], r["sample"]) for r in near.where(F.col("fm_rank") == F.col("fm_count")).select("scenario", "fm_key", "id", "sample").collect()}  # a row per scenario
    done = points.mapInArrow(lambda it: keyed.decided(it, last), f"scenario int, sample string, id {kinds['id']}, truth int, fm_first boolean, fm_new int")
    return done.join(small(changed)[0], ["scenario", "sample", "id"], "left").withColumn("selected", F.coalesce("fm_sel", "fm_first"))


def other_class(seed: int, stream: str, classes: list[str], current: str, id_: str = "id") -> Column:
    """One of the other classes, alike likely."""
    others = F.array_except(F.array(*map(F.lit, classes)), F.array(F.col(current)))
    return F.element_at(others, pick(seed, stream, F.size(others), id_) + 1)


def corruption_count(n: int, rate: float) -> int:
    return min(n - 1, max(1, round(rate * n)))


def corrupt_mask(cells: DataFrame, mechanism: str, rate: float = 0.15, seed: int = 1) -> DataFrame:
    """The cells of one mask with corrupted: values of exactly round(rate n) kept cells (half to even) replaced.
    impulse: anywhere, by any other class; boundary: class boundaries first, by a neighbouring class; patch: around a
    centre, by one class."""
    if mechanism not in ("impulse", "boundary", "patch"):
        raise ValueError("mechanism is impulse, boundary or patch")
    if not 0 < rate < 1:
        raise ValueError(f"a share of cells is over 0 and under 1, not {rate}")
    names = masks.axes_of(cells)
    edge = masks.class_boundary(cells).select("mask_id", *names, "boundary")
    points = masks.with_id(cells).where("value is not null").join(edge, ["mask_id", *names])
    points = cut(points.select(F.col("mask_id").alias("sample"), "id", *names, F.col("value").alias("truth"), "boundary", F.when(F.col("boundary"), 0.0).otherwise(1.0).alias("depth")))
    n = points.count()
    classes = few(points.select("truth").distinct(), "classes")
    if n < 2 or len(classes) < 2:
        raise ValueError("mask corruption needs at least two cells and two classes")
    count = corruption_count(n, rate)
    near = masks.adjacent_classes(cells).select(F.col("mask_id").alias("sample"), *names, "near")
    any_other = other_class(seed, "other", classes, "truth")
    draw = uniform(seed, "order", "id")
    if mechanism == "impulse":
        done = select_preserving(points, count, [draw, F.col("id")], "depth").withColumn("new", any_other)
    elif mechanism == "boundary":
        done = select_preserving(points, count, [F.desc("boundary"), draw, F.col("id")], "depth").join(near, ["sample", *names])
        done = done.withColumn("new", F.when(F.size("near") > 0, F.element_at("near", pick(seed, "near", F.size("near"), "id") + 1)).otherwise(any_other))
    else:
        centre = points.join(near, ["sample", *names]).orderBy(draw, "id").limit(1).first()
        sizes = {r.truth: r.n for r in points.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes, few as shown
        fits = [t for t in dict.fromkeys([*centre.near, *classes]) if sum(min(s, s - 1) for c, s in sizes.items() if c != t) >= count]
        if not fits:
            raise ValueError(INFEASIBLE)
        d2 = sum(((F.col(a) - centre[a]) * (F.col(a) - centre[a]) for a in names), F.lit(0))
        done = select_preserving(points, count, [d2, draw, F.col("id")], "depth", F.col("truth") != fits[0]).withColumn("new", F.lit(fits[0]))
    changed = done.where("selected").select(F.col("sample").alias("mask_id"), *names, "new")
    return cells.join(changed, ["mask_id", *names], "left").withColumn("corrupted", F.coalesce("new", "value")).drop("new")


def corrupt_field(points: DataFrame, mechanism: str, noise: float, classes: list[str], dims: int, seed: int = 1, proximity: str = "boundary_proximity") -> DataFrame:
    """points (sample, id, x, y, truth, boundary_proximity) with label and corrupted; exactly floor(noise n) labels
    change. random: anywhere; boundary: nearest to a boundary first; patch: nearest to one of 16 centres, each with its
    class; region: nearest to one centre."""
    n = points.count()
    count = int(noise * n + 1e-9)
    if mechanism not in ("random", "boundary", "patch", "region"):
        raise ValueError("noise_type is random, boundary, patch or region")
    if not 0 <= noise < 1:
        raise ValueError(f"a share of labels is 0 or more and under 1, not {noise}")
    draw = uniform(seed, "order", "id")
    new = other_class(seed, "other", classes, "truth")
    if mechanism in ("random", "boundary"):
        done = select_preserving(points, count, ([F.col(proximity)] if mechanism == "boundary" else []) + [draw, F.col("id")], proximity).withColumn("new", new)
    else:
        k = 16 if mechanism == "patch" else 1
        centres = points.orderBy(uniform(seed, "centre", "id"), "id").limit(k).select(*(F.col(a).alias(f"c{a}") for a in axes(dims)), F.col("id").alias("centre"))
        d2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in axes(dims)), F.lit(0.0))
        near = points.crossJoin(F.broadcast(centres)).withColumn("d2", d2).groupBy("sample", "id").agg(F.min_by("centre", F.struct("d2", "centre")).alias("centre"), F.min("d2").alias("d2"))  # 16 centres at most
        wide = points.join(near, ["sample", "id"]).withColumn("target", F.element_at(F.array(*map(F.lit, classes)), pick(seed, "target", len(classes), "centre") + 1))
        done = select_preserving(wide, count, [F.col("d2"), draw, F.col("id")], proximity).withColumn("new", F.when(F.col("target") != F.col("truth"), F.col("target")).otherwise(new))
    label = F.when(F.col("selected"), F.col("new")).otherwise(F.col("truth"))
    return done.select(*points.columns, label.alias("label"), F.col("selected").alias("corrupted"))


def contaminate(points: DataFrame, share: float, minority: dict[str, str], area: str = "area", seed: int = 1) -> DataFrame:
    """points with label: of each specimen and area exactly round(share n) points (half to even) get the area's
    minority class."""
    pairs = F.create_map(*(F.lit(x) for kv in minority.items() for x in kv))
    hit = first_of_groups(points, ["sample", area], uniform(seed, "minority", "id"), F.bround(share * F.col("fm_n")), out="fm_hit")
    return hit.withColumn("label", F.when(F.col("fm_hit"), F.element_at(pairs, F.col(area).cast("string"))).otherwise(F.col("truth"))).drop("fm_hit")


#: The recipe of sixty scenarios: shares of labels that change, mechanisms, replicates (fixed values), and centres of patches.
NOISE, MECHANISMS, REPLICATES, PATCHES = (0.05, 0.10, 0.15, 0.25, 0.40), ("random", "boundary", "patch", "region"), 3, 16


def scenario_design(spark) -> DataFrame:
    """scenario (from 1), scenario_id, mechanism, noise and replicate of the recipe's sixty scenarios."""
    rows = [(m, e, r) for e in NOISE for m in MECHANISMS for r in range(1, REPLICATES + 1)]
    named = [(k, f"{m}_{round(100 * e):02d}_r{r}", m, e, r) for k, (m, e, r) in enumerate(rows, 1)]
    return spark.createDataFrame(named, "scenario int, scenario_id string, mechanism string, noise double, replicate int")


def corrupt_scenarios(points: DataFrame, design: DataFrame, classes: list[int], dims: int, seed: int = 1040000) -> DataFrame:
    """scenario, sample, id, truth and label of each point of each scenario of a design (scenario, mechanism, noise; some hundred
    rows). points: sample, id, coordinates, truth, boundary (whether it lies at one) and adjacent (another class close by).
    min(n - 1, round(noise n)) labels change (half to even), each class of each specimen keeps its anchor. random: anywhere, to any other
    class; boundary: points at boundaries first, to the adjacent class; patch: points nearest to one of 16 centres first, to the
    class adjacent to that centre, or to their own adjacent one where that is theirs; region: the same with one centre.

    All scenarios are one plan, keyed by scenario: each batch of points goes through the whole design, so the number
    of jobs doesn't depend on the number of scenarios. Centres are the first points in a hashed order, 16 for each scenario."""
    names = axes(dims)
    planned = design.select("scenario", "mechanism", "noise").withColumn("fm_slot", F.row_number().over(Window.orderBy("scenario")) - 1)  # some hundred rows
    planned, rows = small(planned)
    if rows is None:
        raise ValueError("a design has 20,000 scenarios at most")
    ends = points.agg(F.count(F.lit(1)).alias("fm_n"), *(f(a).alias(f"fm_{p}{a}") for a in names for p, f in (("lo", F.min), ("hi", F.max))))
    ends, bounds = small(ends)
    scaled = points.crossJoin(ends)  # one row
    scaled = scaled.select(
        F.col("sample").cast("string").alias("sample"), "id", F.col("truth").cast("int").alias("truth"), F.col("boundary").alias("fm_edge"), F.col("adjacent").cast("int").alias("fm_near"), F.when(F.col("boundary"), 0.0).otherwise(1.0).alias("fm_depth"),
        *(((F.col(a) - F.col(f"fm_lo{a}")) / F.greatest(F.col(f"fm_hi{a}") - F.col(f"fm_lo{a}"), F.lit(2.220446049250313e-16))).alias(f"fm_{a}") for a in names),
    )
    scaled = cut(scaled)
    first = scaled.orderBy(uniform(seed, "centre", "id"), "id").limit(PATCHES * len(rows)).select(F.struct(*(f"fm_{a}" for a in names), F.col("fm_near").alias("near")).alias("c"), uniform(seed, "centre", "id").alias("u"), "id")
    # At most 16 a scenario; where there are fewer points, scenarios share them.
    pool = first.agg(F.array_sort(F.collect_list(F.struct("u", "id", "c"))).alias("fm_pool"))
    k = F.when(F.col("mechanism") == "patch", PATCHES).when(F.col("mechanism") == "region", 1).otherwise(0)
    place = lambda j: F.get("fm_pool", ((F.col("fm_slot") * PATCHES + j) % F.size("fm_pool")).cast("int"))["c"]
    centres = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), place))
    count = F.least(F.col("fm_n") - 1, F.bround(F.col("noise") * F.col("fm_n")).cast("long"))
    _, plan = small(planned.crossJoin(pool).crossJoin(ends).select("scenario", "mechanism", count.alias("fm_count"), centres.alias("fm_centres")))
    if plan is None:
        raise ValueError("a design's centres take 32 MB at most")
    sizes = small(scaled.groupBy("sample", "truth").agg(F.min_by("id", F.struct(-F.col("fm_depth"), "id")).alias("fm_anchor")))[0]
    done = selected_by_key(scaled, Keyed(plan, names, seed), sizes, bounds[0]["fm_n"])
    others = F.array_except(F.array(*map(F.lit, classes)), F.array("truth"))
    anywhere = F.element_at(others, pick(seed, "other", F.size(others), "scenario", "id") + 1)
    return done.select("scenario", "sample", "id", "truth", F.when(F.col("selected"), F.coalesce("fm_new", anywhere)).otherwise(F.col("truth")).alias("label"))
