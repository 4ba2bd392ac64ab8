"""A corpus pipeline of five text operators: each stage works on all that the one before it kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of
``documents`` (the last returns tokens). run() applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_automaton, decontamination, language_id, line_dedup, minhash_dedup
from tessera.llm.common import cut, cut_table, documents, same_document, sized, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose n-grams stand on average this far from every language's places are in none of them.
LEAST_SCORE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the labelled languages; lang becomes the predicted one."""
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    said = language_id.identify(docs, profiles, ["doc_id", "text", "source", "n_chars"])
    good = said.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return good.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that had nothing else goes, since each of its lines stands in another."""
    done = line_dedup.dedup(docs, extra=["lang", "source"])
    left = done.filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", "")) != ""))
    return left.select(F.col("doc").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    marks = minhash_dedup.classes(docs)
    rest = without(docs, marks.filter(~F.col("kept")).select("doc", "th"))
    twice = marks.filter("kept").groupBy("doc", "th").count().filter("count > 1").select("doc", "th")
    if twice.isEmpty():
        return rest.select(*COLUMNS)
    # of rows alike in id and text, which are in one class, too, the one with the smallest other columns
    more = ["lang", "source", "n_chars"]
    keyed = documents(rest, "doc_id", "text", *(F.col(c) for c in more))
    twice = cut(twice.withColumnsRenamed({"doc": "d2", "th": "t2"}))
    alike = keyed.join(twice, same_document("d2", "t2"), "left_semi").groupBy("doc", "th").agg(F.min(F.struct(*more, "text")).alias("x")).select("doc", "x.text", *(f"x.{c}" for c in more))
    both = keyed.join(sized(twice), same_document("d2", "t2"), "left_anti").select("doc", "text", *more).unionByName(alike)
    return both.withColumnRenamed("doc", "doc_id").select(*COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.matches(documents(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc", "th")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, and the digest of what they decode to."""
    return bpe_automaton.encode_decode(
        docs, "text", ["doc_id", "lang", "source"], public_tokenizers.path("word_bpe_49k.json"),
        lambda ids, decoded, n: (n, ids, bpe_automaton.digests(ids, decoded, n)[2]), "n_tokens bigint, token_ids binary, decoded_sha256 string", cached=100_000,  # its workers share memory with other stages
    )


STAGES = [("language_id", languages), ("line_dedup", lines), ("minhash_dedup", near_duplicates), ("decontamination", clean_of_benchmarks), ("bpe", tokens)]
#: Rank-order profiles, sketches of word shingles and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_table(docs) if k else docs, sf_dir)
    return docs
