"""Filter interaction audit: what each of five filters removes, in each of their 120 orders.

Every document's failures are a number of five bits. Direct replay: documents are crossed with the table of 120 orders, which is
broadcast (120 rows, however many documents there are), each order is exploded into its five steps, the first
failing step is found, and conditional sums per part, order and step are added up within each task before anything is
shuffled: a task sends 600 rows per part at most, so parts of any size are alike. A filter's Shapley sum is a window over the
120 orders of that result.

Filters: A, too few words; B, too few distinct words; C, too many of A-Z; D, marks; E, the text of a smaller doc_id again. For
E, texts are grouped by their SHA-256 to their smallest doc_id (added up within tasks first), and a row is the first of its text
if the pair of digest and doc_id is found among these: the pair is the key of the join, so that copies of one
text, however many, are spread over all tasks.

Defined results: a null text is empty, a null source the part ''; a null doc_id has no smaller ones and no labels; rows that
repeat doc_id and text are all first; a document with several label rows counts as labelled if any is 1; repeated rows
count each; without documents there are no parts and no rows; other columns are passed over, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Fewest words, least percentage of distinct words, largest percentage of capitals, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bit k: fails the k-th filter), good and toxic (labels) of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    n = F.size("words")
    conditions = [n < WORDS, 100 * F.size(F.array_distinct("words")) < DISTINCT * n, 100 * capitals > CAPITALS * F.length("text"), F.col("text").rlike(MARKS)]
    own = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    rows = rows.select("doc_id", "part", own.cast("int").alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).where("doc_id is not null")
    first = first.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    again = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    rows = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(again, 1 << 4).otherwise(0)).alias("failed"))
    return rows.join(known, "doc_id", "left").select("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """place and filter_order of the 120 orders, and the bits b1 to b5 of their steps."""
    rows = [(place, "".join(o), *(1 << FILTERS.index(f) for f in o)) for place, o in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "place int, filter_order string, b1 int, b2 int, b3 int, b4 int, b5 int")


def replay(failed: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, from failures: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    table = F.broadcast(orders(failed.sparkSession))
    crossed = failed.crossJoin(table)
    fails = [F.col("failed").bitwiseAND(F.col(f"b{k}")) != 0 for k in range(1, 6)]
    first: Column = F.lit(6)
    for k in range(5, 0, -1):
        first = F.when(fails[k - 1], k).otherwise(first)
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in range(1, 6))))
    each = crossed.select("part", "place", "failed", "good", "toxic", first.alias("first"), steps.alias("s"))
    failing, removed = F.col("failed").bitwiseAND(F.col("s.bit")) != 0, F.col("first") == F.col("s.step")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long"))

    found = each.groupBy("part", "place", F.col("s.step").alias("step"), F.col("s.bit").alias("bit")).agg(
        total(F.col("first") > F.col("s.step")).alias("kept"),
        total(removed).alias("removed"),
        total(failing & (F.col("first") < F.col("s.step"))).alias("redundant"),
        total(F.col("failed") == F.col("s.bit")).alias("unique_fails"),
        total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    found = found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return found.join(F.broadcast(orders(failed.sparkSession).select("place", "filter_order")), "place").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of all documents."""
    return replay(failures(docs, labels))
