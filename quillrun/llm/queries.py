"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, fingerprints, lm, mixing, piece_codec, quality, simhash, token_counts, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.log_of_turns(_table(spark, sf_dir, "conversations"))
    return chat.render(chat.fold_events(log))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 100, among all vectors."""
    found = ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)
    return found.withColumn("distances", F.transform("distances", lambda d: F.round(d, 9)))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_tokens(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.kept_with_members(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexities(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(_table(spark, sf_dir, "documents"), decoded=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_nearest_neighbours,
        op3_document_fingerprints,
        op4_token_output,
        op5_quality_classifier,
        op6_token_counts,
        op7_simhash_dedup,
        op8_lm_scoring,
        op9_sentencepiece,
        op10_mixing,
    )
}
ORACLES = {"op1_chat_formatting": chat.ORACLE, "op2_nearest_neighbours": ann.oracle(), "op3_document_fingerprints": fingerprints.oracle(), "op7_simhash_dedup": simhash.oracle()}
