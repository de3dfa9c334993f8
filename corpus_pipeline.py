"""From documents to packed training sequences: five stages, each over all that the one before kept.

1. quality: documents that the classifier rejects (score below 0.3) go.
2. line_dedup: later repeats of three-line windows, of one or two lines of 50 words or more, and of whole texts of
   one or two lines are cut; a document that loses all its text to earlier ones goes.
3. near_duplicates: of each component of documents with a similarity of 0.8 on five-word shingles one stays.
4. decontamination: documents that hold a ten-word window of the benchmark go.
5. packing: best-fit packing of what is left into sequences of 4096 tokens and 64 documents at most.

Stages 1 to 4 return the columns of documents, n_chars being that of the text as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmend.llm import decontaminate, jaccard, linededup, packing, quality
from fieldmend.llm.common import new_folder, table
from fieldmend.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(docs, alone=50)
    kept = done.where((F.col("fm_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1, max_documents=64)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
