"""Shared pieces of the text operators: words, lineage cuts, sized broadcasts, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything of ASCII that is neither a digit nor a lower-case letter ends a word (fixed value).
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most keys that a semi-join may broadcast; beyond that it shuffles.
BROADCAST_KEYS = 500_000
#: Rows of an Arrow batch that Python gets.
ARROW_ROWS = 500
#: A key with more than this part of the rows is dealt with by itself.
HOT_KEYS = 1000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null counts as empty, and an empty text has no words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def word_hashes(text: Column) -> Column:
    """xxhash64 of each word of a text, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the one spark.checkpoint.dir names. Only a session on one machine may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed table of columns, for larger results; the folder is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands freed memory of this process back to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that stay small where rows hold whole texts. Arrow's memory is given back at the end.

    Spark reads the batch limit when a plan runs, which may be long after this, so the session's limit is lowered to ARROW_ROWS and stays so.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def keep_keys(df: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df whose key is in keys: a broadcast of at most ``limit`` counted keys, else a shuffled semi-join."""
    few = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), key, "left_semi")


def split_by_keys(df: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key is in keys and perhaps others, the rest): only the first part needs a shuffle to meet what the keys have.

    At most ``limit`` counted keys are broadcast; beyond that all rows are in the first part.
    """
    if keys.limit(limit + 1).count() > limit:
        return df, None
    return df.join(F.broadcast(keys), key, "left_semi"), df.join(F.broadcast(keys), key, "left_anti")


def join_keys(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str = "n", keep: bool = False) -> DataFrame:
    """rows with the columns of keyed, which has each key (one column or several) and how many rows have it; keys that keyed hasn't go.

    Keys with over 1 / HOT_KEYS of the rows, fewer than HOT_KEYS by that, are broadcast, so that no task gets all rows of a
    key; the others are shuffled. Both sides are read several times: they should be written tables or cheap. ``keep``: n stays.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot, cold = keyed.filter(F.col(n) > total / HOT_KEYS), keyed.filter(F.col(n) <= total / HOT_KEYS)
    if not keep:
        hot, cold = hot.drop(n), cold.drop(n)
    if hot.isEmpty():
        return rows.join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti").join(cold, key))


def told_apart(rows: DataFrame, node: str, more: str) -> DataFrame:
    """rows with another ``node``, made of both, where different values of ``more`` share one: hashes of 64 bits collide among billions. Column more goes; null nodes stay."""
    twice = cut(rows.filter(F.col(node).isNotNull()).groupBy(node).agg(F.min(more).alias("a"), F.max(more).alias("b")).filter("a <> b").select(node))
    if twice.isEmpty():
        return rows.drop(more)
    few = sized(twice)
    again = rows.join(few, node, "left_semi").withColumn(node, F.xxhash64(node, more))
    return again.unionByName(rows.join(few, node, "left_anti")).drop(more)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Connected components of (a long, b long): (node, comp) with comp the smallest node of the component.

    Alternating large-star and small-star rounds, each written to the checkpoint folder. Every round groups edges by
    one end with partial minima; no component is ever gathered in one task, and a node with over 1 / HOT_KEYS of the
    edges is joined by itself. Empty edges give an empty result; loops and repeated edges do no harm.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    size = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = e.agg(*size).first()
    for _ in range(most_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_keys(both.filter("v > u"), cut(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # a node has few smaller neighbours now
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        e = cut(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        now = e.agg(*size).first()
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rolling(hashes: str, k: int) -> Column:
    """Hashes of the k words from each place of an array column of word hashes on; the last k - 1 places are of fewer words."""
    h = F.col(hashes)
    return F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))


def part_of(array: Column, start: Column, length: Column) -> Column:
    """Elements of an array from a place (from 0) on. They are read one by one: slice() copies the whole array for each part."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda j: F.get(array, start + j))).otherwise(F.slice(array, 1, 0))


def sized(df: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, as counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def documents(df: DataFrame, doc: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """(doc, th, text) and more: th, the text's hash, tells rows with one id apart."""
    return df.select(F.col(doc).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def same_document(other_doc: str, other_th: str) -> Column:
    """A join condition: rows (doc, th) with those of other names; null ids are equal."""
    return (F.col("th") == F.col(other_th)) & F.col("doc").eqNullSafe(F.col(other_doc))


def without(df: DataFrame, gone: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of df that aren't among the documents (doc, th) of gone."""
    keys = cut(gone.select(F.col("doc").alias("__doc"), F.col("th").alias("__th")).distinct())
    return df.join(sized(keys), F.col(doc).eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__th")), "left_anti")
