"""One query for each operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_automaton, decontamination, embedding_dedup, html_extract, language_id, license_scan, line_dedup, minhash_dedup, resharding, suffix_dedup
from tessera.llm.common import table
from tessera.llm.oracles import ORACLE  # noqa: F401


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents."""
    done = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.filter("contaminated").drop("contaminated")


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards, where ids lie by their hash, to 40 of near equal size."""
    put = resharding.reshard(table(spark, sf_dir, "documents"), 32, 40)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    profiles = language_id.learn(docs.filter("NOT held_out"))
    return language_id.identify(docs, profiles, ["doc_id", "held_out"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("doc").alias("doc_id"), "n_lines", "n_removed", F.md5("kept").alias("kept_md5"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id", "kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(
        table(spark, sf_dir, "documents"), "text", ["doc_id"], public_tokenizers.path("word_bpe_49k.json"),
        bpe_automaton.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove(table(spark, sf_dir, "documents")))


QUERIES = {"op1_license_scan": op1_license_scan, "op2_html_extract": op2_html_extract, "op3_decontamination": op3_decontamination, "op4_resharding": op4_resharding, "op5_embedding_dedup": op5_embedding_dedup, "op6_language_id": op6_language_id, "op7_line_dedup": op7_line_dedup, "op8_minhash_dedup": op8_minhash_dedup, "op9_bpe": op9_bpe, "op10_suffix_dedup": op10_suffix_dedup}
