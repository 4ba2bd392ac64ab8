"""Logs of numbered JSON entries, replayed in order or followed as a stream, and partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.objects import ObjectStore

#: Rows of a file of a partitioned table, about.
ROWS = 5_000_000
ENTRY = "version int, timestamp long, operation struct<op: string, path: string, partitionValues: string>"


def entry_key(version: int) -> str:
    return f"_delta_log/{version:020d}.json"


def append(store: ObjectStore, version: int, entry: str) -> None:
    """Adds a version; one that exists is an error, and of several writers of one version just one succeeds."""
    store.put(entry_key(version), entry.encode(), overwrite=False)


def replay(spark: SparkSession, base: str, schema: str = ENTRY) -> DataFrame:
    """All entries in order of version."""
    return spark.read.schema(schema).json(f"{base.rstrip('/')}/_delta_log/*.json").orderBy("version")


def follow(spark: SparkSession, base: str, schema: str = ENTRY) -> DataFrame:
    """Entries as a stream, as their files appear."""
    return spark.readStream.schema(schema).json(f"{base.rstrip('/')}/_delta_log")


def write_partitioned(df: DataFrame, path: str, by: str, rows: int = ROWS) -> None:
    """column=value folders, values URL-encoded by Spark. A value's rows are counted and dealt to as many tasks and files of about ``rows`` as it takes, so one value may have most rows."""
    files = df.groupBy(F.col(by).alias("__by")).agg(F.ceil(F.count("*") / rows).alias("__files"))  # a row for each folder
    dealt = df.join(files, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "__files"))
    dealt.repartition(by, "__salt").drop("__salt", "__by", "__files").write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(by).parquet(path)


def read_partition(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """Rows of the folders that a condition on the partition column chooses; others aren't listed."""
    return spark.read.parquet(path).filter(condition)
