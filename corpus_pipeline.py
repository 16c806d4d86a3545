"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it
as Parquet under the shared folder and reads it back for the next one.  All
but the last return the columns of ``documents``.

1. toxicity    documents whose score reaches the threshold go
2. near_dedup  one document of each near-duplicate group stays (smallest id)
3. secrets     every secret span is replaced by a mark; n_chars follows
4. mixing      documents are repeated or left out to meet the sources' targets
5. packing     what is left, as pieces in windows of several sizes

Stage 2 tells documents by id and text: different texts under one id, or
without an id, are documents of their own; equal rows are copies of one.
Rows without words are never duplicates.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadkit.llm.graph import kept, some_ids
from loadkit.llm.minhash_dedup import NO_ID, near_duplicates
from loadkit.llm.mixing import mix
from loadkit.llm.secrets import redact
from loadkit.llm.tier_packing import pack_tiers
from loadkit.llm.toxicity import THRESHOLD, toxicity_scores

#: Ids packed together: a quarter of the operator's own block, so that the last stage's workers hold less at a time.
PACK_BLOCK = 1 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_scores(docs, labels, keep_columns=True)
    return scored.filter(F.col("__toxic_score") < THRESHOLD).drop("__toxic_score")


def text_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__node``: its id; for rows without an id, and ids with several texts, a number of id and text.

    So rows are one node only if id and text are equal.
    """
    named = docs.withColumns({"__id": F.col("doc_id").cast("long"),
                              "__text": F.xxhash64("text", F.col("text").isNull())})
    several = some_ids(named.groupBy("__id").agg(F.min("__text").alias("low"), F.max("__text").alias("high"))
                       .filter("low < high and __id is not null").select("__id", F.lit(True).alias("__several")))
    own = F.xxhash64("__id", "__text").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    node = F.when(F.col("__id").isNull() | F.col("__several"), own).otherwise(F.col("__id"))
    return named.join(several, "__id", "left").withColumn("__node", node).select("__node", *docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = text_nodes(docs)
    found = kept(near_duplicates(named, id_column="__node"), "pipeline-near")
    gone = some_ids(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__node")).distinct())
    left = named.join(gone, "__node", "left_anti")
    several = (found.filter("kept and row_count > 1 and n_shingles > 0")
               .select(F.col("doc_id").alias("__node")).distinct())
    if several.limit(1).count():
        several = some_ids(several)
        once = left.join(several, "__node", "left_semi").dropDuplicates(["__node"])
        left = left.join(several, "__node", "left_anti").unionByName(once)
    return left.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_tiers(docs, block=PACK_BLOCK)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
