"""Refiners on the nearest-neighbour graph of each specimen. Edges: sample, src, dst, d2, rank, as from knn.nearest;
points: sample, id, code; lists: sample, id, own, vote, as from knn.nearest_lists with carry="code"."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmend.functions.geometry import axes
from fieldmend.operators.knn import nearest_lists
from fieldmend.session import cut


def _votes(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with the label of dst, which they may have brought along (knn.nearest with carry)."""
    if "vote" in edges.columns:
        return edges
    return edges.join(points.select("sample", F.col("id").alias("dst"), F.col("code").alias("vote")), ["sample", "dst"])


def _counts(votes, classes):
    """The votes for each of these classes."""
    return F.transform(classes, lambda c: F.struct(F.size(F.filter(votes, lambda v: v == c)).alias("n"), c.alias("c")))


def modal_labels(lists: DataFrame) -> DataFrame:
    """sample, id, code and refined: the most frequent label of the neighbours; of equals the one met first by distance."""
    votes = F.col("vote")
    # Distinct labels come in the order in which they are met.
    ranked = F.transform(_counts(votes, F.array_distinct(votes)), lambda x, i: F.struct((-x["n"]).alias("n"), i.alias("i"), x["c"].alias("c")))
    best = F.coalesce(F.array_min(ranked)["c"], F.col("own"))
    return lists.select("sample", "id", F.col("own").cast("int").alias("code"), best.cast("int").alias("refined"))


def modal(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points with refined, the modal label, from edges."""
    counts = _votes(edges, points).groupBy("sample", "src", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    best = counts.groupBy("sample", F.col("src").alias("id")).agg(F.min_by("vote", F.struct(-F.col("n"), F.col("first"))).alias("best"))
    return points.join(best, ["sample", "id"], "left").withColumn("refined", F.coalesce("best", "code").cast(points.schema["code"].dataType)).drop("best")


def strict_majority_labels(lists: DataFrame) -> DataFrame:
    """sample, id, code and refined: another label where it has more than half of the k neighbours and the point's own,
    itself counted, has less. Ties go to the own label, then to the lowest code."""
    votes = F.concat("vote", F.array("own"))
    order = F.transform(_counts(votes, F.array_distinct(votes)), lambda x: F.struct((-x["n"]).alias("n"), (x["c"] != F.col("own")).alias("other"), x["c"].alias("c")))
    mine = F.size(F.filter("vote", lambda v: v == F.col("own"))) + 1
    half = F.size("vote") / 2.0
    done = lists.withColumns({"best": F.array_min(order), "mine": mine, "half": half})
    refined = F.when((F.col("mine") < F.col("half")) & (-F.col("best.n") > F.col("half")), F.col("best.c")).otherwise(F.col("own"))
    return done.select("sample", "id", F.col("own").cast("int").alias("code"), refined.cast("int").alias("refined"))


@dataclass(frozen=True)
class VoteSettings:
    """Controls of the iterated vote; current_support None: 0.25 min(1, sqrt(12 / classes))."""

    iterations: int = 3
    consensus: float = 0.56
    preserve: float = 0.12
    margin: float = 0.10
    weighted: bool = True
    current_support: float | None = None

    def checked(self, classes: int) -> VoteSettings:
        support = 0.25 * min(1.0, (12 / classes) ** 0.5) if self.current_support is None else self.current_support
        if self.iterations < 1 or not 0.5 <= self.consensus < 1 or self.preserve < 0 or not 0 <= self.margin < 1 or not 0 <= support <= 1:
            raise ValueError(f"vote settings out of their bounds: {self}")
        return replace(self, current_support=support)

    @classmethod
    def of(cls, control: dict) -> VoteSettings:
        unknown = set(control) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"the vote has no settings {', '.join(sorted(unknown))}")
        return cls(**control)


#: Named settings.
KNN_VOTE = VoteSettings(1, 0.5, 0.0, 0.0, False, 1.0)
POTTS_LIKE = VoteSettings(8, 0.56, 0.35, 0.10, False)


def _foreign(leaf: pa.Table) -> pa.Table:
    """The points of other leaves that the points of a leaf vote by."""
    ids = pc.unique(leaf.column("dst").combine_chunks().flatten())
    away = ids.filter(pc.invert(pc.is_in(ids, value_set=leaf.column("id").combine_chunks())))
    return pa.table({"sample": pa.repeat(leaf.column("sample")[0], len(away)), "id": away, "leaf": pa.repeat(leaf.column("leaf")[0], len(away))})


def _sweeper(s: VoteSettings, names: list[str]):
    """One sweep over a leaf: its points with their neighbours (left), the labels of these and of itself (right), with the coordinates
    that weights are worked out from."""

    def sweep(leaf: pa.Table, labels: pa.Table) -> pa.Table:
        labels = labels.rename_columns([c.removeprefix("o_") for c in labels.column_names]).sort_by("id")
        ids, code = labels.column("id").to_numpy(), labels.column("label").to_numpy()
        mine = np.searchsorted(ids, leaf.column("id").to_numpy())
        near = leaf.column("dst").combine_chunks()
        n, src = len(leaf), np.repeat(np.arange(len(leaf)), np.diff(near.offsets.to_numpy()))
        dst = np.searchsorted(ids, near.flatten().to_numpy())
        w = np.ones(len(src))
        if s.weighted:
            places = [labels.column(a).to_numpy() for a in names]
            # As in the search, so that distances are the same to the last digit.
            d2, band = reduce(lambda p, q: p + q, [(at_[mine[src]] - at_[dst]) ** 2 for at_ in places]), np.full(n, 1e-12)
            np.maximum.at(band, src, d2)
            w = np.exp(-d2 / band[src])
        classes, at = np.unique(code, return_inverse=True)
        votes = np.bincount(src * len(classes) + at[dst], weights=w, minlength=n * len(classes)).reshape(n, len(classes))
        rows, current = np.arange(n), at[mine]
        held, weight = votes[rows, current], votes.sum(axis=1)
        own, total = held + s.preserve * weight, weight * (1 + s.preserve)
        votes[rows, current] = 0.0
        best = votes.argmax(axis=1)  # of equals the lowest code
        first = votes[rows, best]
        votes[rows, best] = 0.0
        second = votes.max(axis=1)
        wins = first > own
        top, runner = np.where(wins, first, own), np.where(wins, np.maximum(own, second), first)
        some = np.where(total > 0, total, 1.0)
        confidence = np.where(total > 0, top / some, 1.0)
        take = wins & (total > 0) & (held / np.where(weight > 0, weight, 1.0) <= s.current_support) & (confidence >= s.consensus) & ((top - runner) / some >= s.margin)
        out = leaf.select(["sample", "leaf", "id"]).append_column("current", pa.array(code[mine], pa.int64()))
        out = out.append_column("next", pa.array(np.where(take, classes[best], code[mine]), pa.int64())).append_column("confidence", pa.array(confidence))
        for c in [*names, "to"]:
            out = out.append_column(c, labels.column(c).take(pa.array(mine)))
        return out

    return sweep


def vote_in_leaves(lists: DataFrame, classes: int, settings: VoteSettings | None = None) -> tuple[DataFrame, list[int]]:
    """sample, id, refined, confidence (of the last sweep) and the number of changes of each sweep. lists: sample, id, own, dst,
    leaf and, for weights, coordinates, as from knn.nearest_lists. The lists are dealt by leaf once and stay where they are over
    all sweeps; a sweep sends each point's label to its own leaf, and those that other leaves vote by to these too. Sweeps end when
    one changes nothing. Distances are worked out from coordinates in each sweep, as they would be most of what the lists take."""
    s = (settings or VoteSettings()).checked(classes)
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [a for a in axes(3) if a in lists.columns] if s.weighted else []
    lists = cut(lists.select("sample", "leaf", "id", "own", *names, "dst"))
    # Kept by the executors; what a lost one held is dealt again from the checkpoint. Only once it is there do plans know how
    # it is dealt, and that it is sorted.
    dealt = lists.drop("own", *names).repartition(n, "sample", "leaf").sortWithinPartitions("sample", "leaf").persist()
    dealt.count()
    asked = dealt.select("sample", "leaf", "id", "dst").groupBy("sample", "leaf").applyInArrow(_foreign, "sample string, id long, leaf string")
    asked = asked.groupBy("sample", "id").agg(F.collect_list("leaf").alias("to"))
    state = lists.select("sample", "leaf", "id", F.col("own").cast("long").alias("label"), *names).join(asked, ["sample", "id"], "left")
    # A sweep reads it twice, for the point's own leaf and for others.
    state = cut(state.withColumn("to", F.coalesce("to", F.array().cast("array<string>"))))
    changes = []
    sweep = _sweeper(s, names)
    kinds = "sample string, leaf string, id long, current long, next long, confidence double, " + "".join(f"{a} double, " for a in names) + "to array<string>"
    for _ in range(s.iterations):
        home = state.select("sample", "leaf", "id", "label", *names, "to")
        away = state.where(F.size("to") > 0).select("sample", F.explode("to").alias("leaf"), "id", "label", *names, F.lit(None).cast("array<string>").alias("to"))
        sent = home.unionByName(away).select(*(F.col(c).alias(f"o_{c}") for c in home.columns))
        swept = dealt.select("sample", "leaf", "id", "dst").groupBy("sample", "leaf").cogroup(sent.groupBy("o_sample", "o_leaf"))
        swept = cut(swept.applyInArrow(sweep, kinds))
        changes.append(swept.where("next <> current").count())
        state = swept.select("sample", "leaf", "id", F.col("next").alias("label"), *names, "to")
        if not changes[-1]:
            break
    dealt.unpersist()
    return swept.select("sample", "id", F.col("next").cast("int").alias("refined"), "confidence"), changes


def refine(points: DataFrame, dims: int, classes: int, settings: VoteSettings | None = None, k: int | None = None) -> tuple[DataFrame, list[int]]:
    """The iterated vote over the k nearest points, or each specimen's automatic number of them: points with refined and
    confidence, and the number of changes of each sweep. With less than two classes nothing changes and confidence is 1;
    a specimen of fewer than three points raises."""
    (settings or VoteSettings()).checked(max(classes, 1))
    if classes < 2:
        return points.withColumns({"refined": F.col("code"), "confidence": F.lit(1.0)}), []
    least = points.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct("n", "sample")).alias("least")).first()["least"]
    if least is not None and least["n"] < 3:
        raise ValueError(f"Specimen {least['sample']} has {least['n']} points; the vote takes three at least.")
    done, changes = vote_in_leaves(nearest_lists(points, dims, k, "code", ("dst",), classes, leaf=True, at=True), classes, settings)
    return points.join(done, ["sample", "id"]), changes


def potts_energy(points: DataFrame, pairs: DataFrame, label: str, unary: float = 5.0) -> DataFrame:
    """energy per specimen: unary times the labels that differ from code, and one for each pair (a, b) that differs."""
    moved = points.groupBy("sample").agg(F.count_if(F.col(label) != F.col("code")).alias("moved"))
    side = lambda c: points.select("sample", F.col("id").alias(c), F.col(label).alias(f"l{c}"))
    cut_ = pairs.join(side("a"), ["sample", "a"]).join(side("b"), ["sample", "b"]).groupBy("sample").agg(F.count_if(F.col("la") != F.col("lb")).alias("cuts"))
    return moved.join(cut_, "sample", "left").select("sample", "moved", F.coalesce("cuts", F.lit(0)).cast("long").alias("cuts"), (unary * F.col("moved") + F.coalesce("cuts", F.lit(0))).alias("energy"))
