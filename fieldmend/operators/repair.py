"""Repair of categorical labels on points, specimen by specimen.

Every point is ordered along a Hilbert curve in several rotated charts. Along each curve, evidence for each class
travels from both sides and fades with the path length; a point's own label gives it none. A label changes to the
class with the largest mean margin over the charts where that margin reaches a barrier made of the charts'
disagreement, the classes' sizes and the point's isolation. Specimens with two classes take a ballot among the
nearest neighbours instead.

points: sample, id (unique in a specimen), x, y (z), code (1-based place of the label in its list of levels).
Specimens never share evidence. Large specimens are cut into runs of the curve, so no task holds one as a whole;
results do not depend on the cut. All orders end in id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmend.functions.geometry import CHARTS, axes, chart_cells, hilbert_code, robust_unit, specimens
from fieldmend.functions.quantiles import percentiles
from fieldmend.operators.knn import nearest_lists
from fieldmend.session import cut, few, small

SCALE = 5.0
FLOOR = 1e-12
#: Decay lengths per anchored segment: exp(-300) is negligible, exp(300) is a double.
SEGMENT = 300
#: Points of a specimen that one task may walk along; larger ones are cut into runs.
RUN_ROWS = 200_000
PATH = ["sample", "chart"]


def chart_codes(unit: DataFrame, dims: int) -> DataFrame:
    """unit in each chart with hcode, the place on the curve."""
    cells = chart_cells(unit, dims)
    return cells.withColumn("hcode", hilbert_code([F.col(f"a{k}") for k in range(dims)])).drop(*(f"a{k}" for k in range(dims)))


def distance(a: dict, b: dict) -> Column:
    return F.sqrt(reduce(lambda s, x: s + x, [(a[k] - b[k]) * (a[k] - b[k]) for k in a]))


def path_steps(coded: DataFrame, dims: int, largest: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """coded with run, step_in and step_out: path lengths to the neighbours on the curve, null at its ends. largest: the points
    of the largest specimen, if known. Up to run_rows a path is one run; beyond it Spark sorts all paths by ranges of about
    equal numbers of rows, each of which is a run (of each path that is in it)."""
    names = [f"u{a}" for a in axes(dims)]
    here = {c: F.col(c) for c in names}
    along = Window.partitionBy(*PATH, "run").orderBy("hcode", "id")
    back, ahead = ({c: f(c).over(along) for c in names} for f in (F.lag, F.lead))
    if largest is not None and largest <= run_rows:
        return coded.withColumn("run", F.lit(0)).withColumns({"step_in": distance(back, here), "step_out": distance(here, ahead)})
    coded = cut(coded.repartitionByRange(*PATH, "hcode", "id").withColumn("run", F.spark_partition_id()))
    end = F.struct("hcode", "id", *names)
    ends = coded.groupBy(*PATH, "run").agg(F.min(end).alias("first"), F.max(end).alias("last"))
    over = Window.partitionBy(*PATH).orderBy("run")
    beyond = {f"{way}_{c}": f(end).over(over)[c] for c in names for way, f, end in (("before", F.lag, "last"), ("after", F.lead, "first"))}
    ends, _ = small(ends.select(*PATH, "run", *(v.alias(k) for k, v in beyond.items())))
    joined = coded.join(ends, [*PATH, "run"])
    back = {c: F.coalesce(back[c], F.col(f"before_{c}")) for c in names}
    ahead = {c: F.coalesce(ahead[c], F.col(f"after_{c}")) for c in names}
    return joined.withColumns({"step_in": distance(back, here), "step_out": distance(here, ahead)}).drop(*beyond)


def path_scale(stepped: DataFrame, largest: int | None = None) -> DataFrame:
    """stepped with ref (median of the positive steps of its path), iso, and act_f and act_r (normalised steps)."""
    refs = percentiles(stepped, PATH, {"median": F.when(F.col("step_in") > FLOOR, F.col("step_in"))}, [0.5], largest)
    refs, _ = small(refs.where(F.col("median")[0].isNotNull()).select(*PATH, F.col("median")[0].alias("ref")))
    joined = stepped.join(refs, PATH, "left").withColumn("ref", F.coalesce("ref", F.lit(1.0)))
    ref = F.greatest("ref", F.lit(FLOOR))
    left, right = F.greatest("step_in", F.lit(FLOOR)), F.greatest("step_out", F.lit(FLOOR))
    gap = F.when(F.col("step_in").isNull(), right).when(F.col("step_out").isNull(), left).otherwise(F.sqrt(left * right))
    return joined.withColumns({
        "iso": F.greatest(F.lit(1.0), F.coalesce(gap, F.col("ref")) / ref),
        "act_f": F.coalesce(F.col("step_in"), F.lit(0.0)) / ref,
        "act_r": F.coalesce(F.col("step_out"), F.lit(0.0)) / ref,
    })


def path_place(scaled: DataFrame, whole: bool = False) -> DataFrame:
    """scaled with seg and off: the path length up to the point in decay lengths, in whole segments and the rest. whole: each
    path is one run."""
    along = Window.partitionBy(*PATH, "run").orderBy("hcode", "id").rowsBetween(Window.unboundedPreceding, 0)
    local = scaled.withColumn("local", F.sum("act_f").over(along))
    if whole:
        local = local.withColumn("start", F.lit(0.0))
    else:
        ends = scaled.groupBy(*PATH, "run").agg(F.sum("act_f").alias("total"))
        before = Window.partitionBy(*PATH).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        starts, _ = small(ends.select(*PATH, "run", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("start")))
        local = local.join(starts, [*PATH, "run"])
    placed = local.withColumn("t", (F.col("start") + F.col("local")) / SCALE).withColumn("seg", F.floor(F.col("t") / SEGMENT))
    return placed.withColumn("off", F.col("t") - F.col("seg") * SEGMENT).drop("local", "start")


def enclosure(placed: DataFrame, classes: int, whole: bool = False) -> DataFrame:
    """placed with e1 .. eC, the two-sided evidence for each class: sums of exp(-path length) over the points of the
    class on either side, without the point itself. Sums run within a segment, from its anchor, and within a run; the runs of
    the segment before and after, and the segments before and after, add what they have in all. whole: each path is one run."""
    keys, parts = [*PATH, "seg"], [*PATH, "seg", "run"]
    rise, fall = F.exp("off"), F.exp(-F.col("off"))
    of = lambda c, v: F.when(F.col("code") == c, v).otherwise(0.0)
    every = range(1, classes + 1)
    totals = placed.groupBy(*(keys if whole else parts)).agg(*(F.sum(of(c, v)).alias(f"{n}{c}") for c in every for n, v in (("up", rise), ("down", fall))))
    joined, carried = placed, {c: (F.lit(0.0), F.lit(0.0)) for c in every}
    if not whole:
        totals = cut(totals)
        runs = Window.partitionBy(*keys).orderBy("run")
        earlier, later = runs.rowsBetween(Window.unboundedPreceding, -1), runs.rowsBetween(1, Window.unboundedFollowing)
        sums = {f"{n}_{c}": F.coalesce(F.sum(f"{n}{c}").over(w), F.lit(0.0)) for c in every for n, w in (("up", earlier), ("down", later))}
        joined = joined.join(totals.select(*parts, *(v.alias(k) for k, v in sums.items())), parts)
        carried = {c: (F.col(f"up_{c}"), F.col(f"down_{c}")) for c in every}
        totals = totals.groupBy(*keys).agg(*(F.sum(f"{n}{c}").alias(f"{n}{c}") for c in every for n in ("up", "down")))
    before = totals.select(*PATH, (F.col("seg") + 1).alias("seg"), *(F.col(f"up{c}").alias(f"from{c}") for c in every))
    after = totals.select(*PATH, (F.col("seg") - 1).alias("seg"), *(F.col(f"down{c}").alias(f"to{c}") for c in every))
    joined = joined.join(before, keys, "left").join(after, keys, "left")
    up = Window.partitionBy(*parts).orderBy("hcode", "id").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*parts).orderBy(F.desc("hcode"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    far = float(F_EXP)
    out = joined.withColumns({f"sf{c}": F.coalesce(F.sum(of(c, rise)).over(up), F.lit(0.0)) for c in every})
    out = out.withColumns({f"sr{c}": F.coalesce(F.sum(of(c, fall)).over(down), F.lit(0.0)) for c in every})
    field = {}
    for c in every:
        f = fall * (F.col(f"sf{c}") + carried[c][0] + F.coalesce(F.col(f"from{c}"), F.lit(0.0)) * far)
        r = rise * (F.col(f"sr{c}") + carried[c][1] + F.coalesce(F.col(f"to{c}"), F.lit(0.0)) * far)
        field[f"e{c}"] = f + r + 2.0 * F.sqrt(F.greatest(f * r, F.lit(0.0)))
    spent = [f"{n}{c}" for c in every for n in ("sf", "sr", "from", "to")] + ([] if whole else list(sums))
    return out.withColumns(field).drop(*spent)


#: exp(-SEGMENT)
F_EXP = 2.718281828459045**-SEGMENT


def share_margins(field: DataFrame, classes: int) -> DataFrame:
    """field with m1 .. mC: each class's share of the evidence less that of the point's label, in single precision."""
    every = range(1, classes + 1)
    total = F.greatest(reduce(lambda a, b: a + b, [F.col(f"e{c}") for c in every]), F.lit(FLOOR))
    own = reduce(lambda a, c: F.when(F.col("code") == c, F.col(f"e{c}")).otherwise(a), every, F.lit(0.0))
    return field.withColumn("total", total).withColumn("own", own / F.col("total")).withColumns({f"m{c}": (F.col(f"e{c}") / F.col("total") - F.col("own")).cast("float") for c in every}).drop("total", "own")


def over_charts(margins: DataFrame, classes: int, dims: int) -> DataFrame:
    """sample, id, code, and over the charts: means and dispersions (arrays by class) and isolation."""
    every = range(1, classes + 1)
    as_double = lambda c: F.col(f"m{c}").cast("double")
    spread = lambda c: 2.0 * F.sqrt(F.var_pop(as_double(c))) / F.sqrt(F.lit(float(CHARTS[dims])))
    return margins.groupBy("sample", "id", "code").agg(
        F.array(*(F.avg(as_double(c)) for c in every)).alias("margin"),
        F.array(*(spread(c) for c in every)).alias("dispersion"),
        F.percentile(F.col("iso").cast("float").cast("double"), 0.5).alias("isolation"),
    )


def class_deficit(points: DataFrame) -> DataFrame:
    """sample, deficits (map of observed code to deficit) and rare (the deficit of a class that is not observed)."""
    counts = points.groupBy("sample", "code").agg(F.count(F.lit(1)).cast("double").alias("c"))
    middle = counts.groupBy("sample").agg(F.greatest(F.percentile("c", 0.5), F.lit(1.0)).alias("middle"), F.map_from_entries(F.collect_list(F.struct("code", "c"))).alias("counts"))
    return middle.select("sample", F.transform_values("counts", lambda _, c: F.sqrt(F.col("middle") / F.greatest(c, F.lit(1.0)))).alias("deficits"), F.sqrt("middle").alias("rare"))


DIAGNOSTICS = ["candidate", "margin_score", "required", "atlas_dispersion", "isolation"]


def decide(evidence: DataFrame) -> DataFrame:
    """evidence with the candidate, whether it is taken (refined), and what the decision rests on."""
    taken = (F.col("candidate") != F.col("code")) & (F.col("margin_score") >= F.col("required"))
    return evidence.select(
        "sample", "id", "code", F.when(taken, F.col("candidate")).otherwise(F.col("code")).alias("refined"), *DIAGNOSTICS,
        (F.col("margin_score") - F.col("required")).alias("repair_margin"), taken.alias("changed"),
    )


def multiclass_evidence(unit: DataFrame, dims: int, classes: int, largest: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """The evidence of the charts. largest: the points of the largest specimen, if known."""
    whole = largest is not None and largest <= run_rows
    # Read twice by what follows.
    stepped = cut(path_steps(chart_codes(unit, dims), dims, largest, run_rows))
    placed = path_place(path_scale(stepped, largest), whole)
    field = enclosure(placed if whole else cut(placed), classes, whole)
    deficits, _ = small(class_deficit(unit))
    joined = over_charts(share_margins(field, classes), classes, dims).join(deficits, "sample")
    best = F.array_max("margin")
    # The label itself has margin 0: another class must be strictly better; the first of equals stands.
    rival = F.when(best > F.element_at("margin", F.col("code")), F.array_position("margin", best).cast("int")).otherwise(F.col("code"))
    out = joined.withColumn("candidate", rival)
    dispersion = F.element_at("dispersion", F.col("candidate"))
    deficit = F.coalesce(F.try_element_at("deficits", F.col("candidate")), F.col("rare"))
    return out.select(
        "sample", "id", "code", "candidate", F.element_at("margin", F.col("candidate")).alias("margin_score"),
        (dispersion / deficit * F.col("isolation")).alias("required"), dispersion.alias("atlas_dispersion"), "isolation",
    )


def binary_evidence(unit: DataFrame, dims: int) -> DataFrame:
    """A ballot among the nearest 2^(dims + 4) neighbours, in scaled coordinates; a tie goes to the label."""
    scaled = unit.select("sample", "id", "code", *(F.col(f"u{a}").alias(a) for a in axes(dims)))
    lists = nearest_lists(scaled, dims, 2 ** (dims + 4), carry="code", lists=("vote",))
    mine = F.size(F.filter("vote", lambda v: v == F.col("own")))
    joined = lists.select("sample", "id", F.col("own").cast("int").alias("code"), mine.alias("mine"), (F.size("vote") - mine).alias("other"))
    mine, other = F.col("mine"), F.col("other")
    return joined.select(
        "sample", "id", "code", F.when(other > mine, 3 - F.col("code")).otherwise(F.col("code")).cast("int").alias("candidate"),
        F.greatest(other - mine, F.lit(0)).cast("double").alias("margin_score"), F.lit(1.0).alias("required"),
        F.lit(0.0).alias("atlas_dispersion"), F.lit(1.0).alias("isolation"),
    )


def repair(points: DataFrame, dims: int, classes: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """sample, id, code, refined and diagnostics of each point. classes is the length of the level list."""
    points = points.select("sample", "id", *axes(dims), F.col("code").cast("int").alias("code"))
    stats, rows = specimens(points, dims)
    kept = (~F.col("spread")) | (F.col("n") < 20) | (F.col("observed") < 2)
    way = F.when(kept, "kept").when(F.col("top") == 2, "binary").otherwise("charts")
    stats = stats.withColumn("way", way)
    # Of few specimens it is known which ways they go, and the others are left out of the plan.
    ways = {"kept": 0, "binary": 0, "charts": 0} if rows is None else {}
    for r in rows or []:
        name = "kept" if not r["spread"] or r["n"] < 20 or r["observed"] < 2 else "binary" if r["top"] == 2 else "charts"
        ways[name] = max(ways.get(name, 0), r["n"])
    known = robust_unit(points.join(stats.select("sample", "way"), "sample"), dims, stats)
    if rows is None:
        known = cut(known)
    parts = []
    if "kept" in ways or not ways:
        still = known.where("way = 'kept'").select("sample", "id", "code", F.col("code").alias("candidate"), *(F.lit(v).alias(c) for c, v in zip(DIAGNOSTICS[1:], (0.0, 0.0, 0.0, 1.0), strict=True)))
        parts.append(still)
    if "binary" in ways:
        parts.append(binary_evidence(known.where("way = 'binary'").drop("way"), dims))
    if "charts" in ways:
        parts.append(multiclass_evidence(known.where("way = 'charts'").drop("way"), dims, classes, None if rows is None else ways["charts"], run_rows))
    return decide(reduce(DataFrame.unionByName, parts))


def repair_labels(points: DataFrame, dims: int, levels: list[str] | None = None, **controls) -> DataFrame:
    """The public form: points with label (text) in, refined and candidate (text) and the diagnostics out. Without
    levels these are the distinct labels in binary order. The repair has no controls: any that is given raises, before
    anything is read."""
    if controls:
        raise ValueError(f"the repair takes no controls, but was given {', '.join(sorted(controls))}")
    from fieldmend.sources.points import encoded, validate_points

    validate_points(points, dims)
    if levels is None:
        levels = few(points.select("label").distinct(), "labels")
    names = F.array(*map(F.lit, levels))
    done = repair(encoded(points, levels), dims, len(levels))
    name = lambda c: F.element_at(names, F.col(c)).alias(c)
    rest = [c for c in done.columns if c not in ("sample", "id", "code", "refined", "candidate")]
    return done.select("sample", "id", F.element_at(names, F.col("code")).alias("label"), name("refined"), name("candidate"), *rest)
