"""Line deduplication by overlapping three-line windows, by DataFrame functions alone.

A text is split at line feeds. Each three consecutive lines, not all blank, form a window. Of equal windows in
the whole table the first (by doc_id, then the text's hash, then place) covers nothing; every later one covers its three
lines, and covered lines go. A later window that overlaps the first one in its own text covers lines of that too ("a a a a b"
by lines leaves "a b"). Texts of fewer than three lines have no windows and stay as they are.

With `alone`, shorter passages are windows too: each line, and each two consecutive lines, of `alone` words together
or more (words end at ASCII white space), and each text of one or two lines as a whole. They are found, held against
each other and covered in the same way.

Lines are compared by 64-bit hashes, three in a row, so unequal windows are taken as equal only where all three
hashes agree. Counting and first places are pre-aggregated before the shuffle, and only windows that repeat are
joined back, so common windows are no hot keys of an aggregation and a skewed join can be split.

Defined results: a null text stays null and has no lines; an empty text is one blank line; rows with equal
doc_id and text are the same document, so none counts as the other's repeat and both are treated alike; every
input row gives one row; a text that loses all its lines becomes empty; other columns are kept, whatever their names, but
for those called fm_lines and fm_removed, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, unpacked


def windows(docs: DataFrame, size: int, alone: int | None = None) -> DataFrame:
    """fm_doc, fm_text, at, span (lines), key1, key2 of each window of docs (doc_id, text)."""
    lines = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("fm_doc"), F.xxhash64("text").alias("fm_text"), F.split("text", "\n", -1).alias("lines")
    )
    def line(x):
        words = [] if alone is None else [F.regexp_count(x, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("words")]
        return F.struct(F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("blank"), *words)

    if alone is None:
        lines = lines.where(F.size("lines") >= size)
    hashed = lines.select("fm_doc", "fm_text", F.transform("lines", line).alias("lines"))
    n = F.size("lines")

    def window(i, span):
        here = [F.element_at("lines", i + 1 + k) for k in range(span)]
        blank = here[0]["blank"]
        for x in here[1:]:
            blank = blank & x["blank"]
        keys = [F.xxhash64(F.lit(seed), *(x["h"] for x in here)).alias(f"key{seed}") for seed in (1, 2)]
        return F.struct(i.alias("at"), F.lit(span).alias("span"), blank.alias("blank"), *keys)

    def short(span):
        """The windows of fewer lines: those of enough words, or the whole text."""
        starts = F.slice(F.sequence(F.lit(0), n), F.lit(1), F.greatest(n - span + 1, F.lit(0)))
        enough = F.filter(starts, lambda i: (n == span) | (sum((F.element_at("lines", i + 1 + k)["words"] for k in range(1, span)), F.element_at("lines", i + 1)["words"]) >= alone))
        return F.transform(enough, lambda i: window(i, span))

    # Windows are made before the explode: its rows would otherwise each carry all lines of their text.
    if alone is None:
        made = F.transform(F.sequence(F.lit(0), n - size), lambda i: window(i, size))
    else:
        starts = F.slice(F.sequence(F.lit(0), n), F.lit(1), F.greatest(n - size + 1, F.lit(0)))
        made = F.concat(F.transform(starts, lambda i: window(i, size)), *map(short, range(1, size)))
    each = hashed.select("fm_doc", "fm_text", F.inline(made))
    return each.where(~F.col("blank")).drop("blank")


def dedup_lines(docs: DataFrame, size: int = 3, alone: int | None = None) -> DataFrame:
    """docs with repeated lines cut out of text, and with fm_lines and fm_removed (counts) added."""
    found = windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, alone)
    place = F.struct("fm_doc", "fm_text", "at")
    repeated = found.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    repeated = stored(repeated, "windows")
    later = found.join(repeated, ["key1", "key2"]).where(place > F.col("first"))
    covered = later.groupBy("fm_doc", "fm_text").agg(F.collect_set(F.struct("at", "span")).alias("fm_at"))
    text = F.col("text").cast("string")
    rows = packed(docs, F.col("doc_id").cast("long").alias("fm_id"), F.xxhash64(text).alias("fm_key"))
    both = rows.join(covered, F.col("fm_id").eqNullSafe(F.col("fm_doc")) & (F.col("fm_key") == F.col("fm_text")), "left")
    gone = F.flatten(F.transform("fm_at", lambda a: F.sequence(a["at"], a["at"] + a["span"] - 1)))
    text = F.col("fm_row.text")
    both = both.withColumn("fm_split", F.split(text.cast("string"), "\n", -1))
    both = both.withColumn("fm_keep", F.when(F.col("fm_at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("fm_split") - 1), gone)))
    left = F.array_join(F.transform("fm_keep", lambda i: F.element_at("fm_split", i + 1)), "\n")
    n = F.when(text.isNotNull(), F.size("fm_split")).otherwise(0)
    columns = [c for c in docs.columns if c not in ("fm_lines", "fm_removed")]
    return both.select(
        *unpacked(both, columns, text=F.when(F.col("fm_keep").isNull(), text).otherwise(left)),
        n.cast("long").alias("fm_lines"),
        F.when(F.col("fm_keep").isNull(), 0).otherwise(n - F.size("fm_keep")).cast("long").alias("fm_removed"),
    )
