"""The registered queries of the operators in this folder, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadkit.llm import chat, minhash_dedup, mixing, vector_codes
from loadkit.llm.bfd_packing import pack_best_fit
from loadkit.llm.bpe import encoding_report
from loadkit.llm.fingerprints import edited_report
from loadkit.llm.fm_quality import quality_scores
from loadkit.llm.llr_rules import quality_rules
from loadkit.llm.minhash_dedup import near_duplicates
from loadkit.llm.periodic import run_report
from loadkit.llm.secrets import secret_report
from loadkit.llm.tier_packing import pack_tiers
from loadkit.llm.toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op4_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality_rules(table(spark, sf_dir, "documents"), labels.filter("quality = 1").select("doc_id"))


def op8_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_report(table(spark, sf_dir, "documents"))


def op9_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op10_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tiers(table(spark, sf_dir, "documents"))


def op11_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


def op13_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_fm_quality": op1_fm_quality,
    "op2_bfd_packing": op2_bfd_packing,
    "op3_source_mixing": op3_source_mixing,
    "op4_toxicity_kernel": op4_toxicity_kernel,
    "op5_randomness_secrets": op5_randomness_secrets,
    "op6_bbit_minhash": op6_bbit_minhash,
    "op7_ngram_llr": op7_ngram_llr,
    "op8_oph_fingerprints": op8_oph_fingerprints,
    "op9_chat_events": op9_chat_events,
    "op10_tier_packing": op10_tier_packing,
    "op11_bpe_backtracking": op11_bpe_backtracking,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_resident_lloyd": op13_resident_lloyd,
}

ORACLE: dict[str, str] = {
    "op6_bbit_minhash": minhash_dedup.SQL,
    "op9_chat_events": chat.SQL,
    "op13_resident_lloyd": vector_codes.SQL,
}
