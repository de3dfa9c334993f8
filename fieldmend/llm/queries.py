"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filteraudit, fingerprint, jaccard, langid, linededup, packing, periodic, pii, quality, tokenfile, toxicity, warc
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))

    def joined(these):
        return F.array_join(F.transform(these, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, pii.KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.write_index(warc.write_archives(pages))
    return warc.read_pages(pages, index)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("fm_lines").alias("n_lines"), F.col("fm_removed").alias("n_removed"), "text")


def predicted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return predicted(scored).select("doc_id", "held_out", "score", "predicted", "exact", "fuzzy", "quoted", "distinct_terms")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents")), least=6, times=4)
    # The longest run; of equally long ones the first, then the shortest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(each, "").alias("listed"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), folds=3, held=1)


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op10: classes of documents that bands of their walks from anchors bring together and whose texts are then
    found to be at most a twentieth apart. Of such pairs of 100 to 20,000 characters more than nine of ten are found (tested)."""
    return fingerprint.near_copy_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing, "op2_pii": op2_pii, "op3_token_files": op3_token_files, "op4_warc": op4_warc, "op5_decontaminate": op5_decontaminate, "op6_line_dedup": op6_line_dedup, "op7_quality": op7_quality, "op8_jaccard": op8_jaccard, "op9_toxicity": op9_toxicity, "op10_fingerprint": op10_fingerprint, "op11_periodic": op11_periodic, "op12_filter_audit": op12_filter_audit, "op13_language": op13_language, "near_copies": near_copies}
