"""Secondary indexes: from a key to any number of values.

A built index is a Parquet table of (key, place, value), ranged and sorted by key: a lookup is a pushed filter on sorted
files, and a key with very many values never becomes one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import normal_key

ENTRY = "key string, place long, value string"


@dataclass
class Index:
    spark: SparkSession
    path: str
    collected: list[tuple[str, str]] = field(default_factory=list)
    built: bool = False

    def add(self, key: str, value: str) -> None:
        self.collected.append((key, value))

    def build(self) -> bool:
        """Writes what was collected; False if nothing was."""
        if not self.collected:
            return False
        rows = [(k, n, v) for n, (k, v) in enumerate(self.collected)]
        return self.build_from(self.spark.createDataFrame(rows, ENTRY))

    def build_from(self, entries: DataFrame) -> bool:
        """Writes entries (key, place, value) of any number; null keys aren't indexed."""
        entries = entries.filter("key IS NOT NULL")
        # ranged by value, too: one key may have most of the entries
        entries.repartitionByRange("key", "place").sortWithinPartitions("key", "place").write.mode("overwrite").parquet(self.path)
        self.built = True
        return True

    def find(self, key: str | None) -> DataFrame:
        """(value) in the order they were added; none for a null or unknown key."""
        if self.built:
            return self.spark.read.schema(ENTRY).parquet(self.path).filter(F.col("key") == F.lit(key)).orderBy("place").select("value")
        return self.spark.createDataFrame([(v,) for k, v in self.collected if key is not None and k == key], "value string")

    def lookup(self, key: str | None) -> list[str]:
        return [r[0] for r in self.find(key).collect()]

    def rows(self, key: str | None, table: DataFrame, primary: str) -> DataFrame:
        """The table's rows whose primary key the index has under a key."""
        return table.join(self.find(key).withColumnRenamed("value", "__value").distinct(), F.col(primary).cast("string") == F.col("__value"), "left_semi")


def entries_of(table: DataFrame, key: Column, value: Column, place: Column) -> DataFrame:
    """Index entries of a table's rows, in the order that ``place`` gives them."""
    return table.select(key.cast("string").alias("key"), place.cast("long").alias("place"), value.cast("string").alias("value"))


@dataclass
class IndexManager:
    spark: SparkSession
    base: str
    indexes: dict[str, Index] = field(default_factory=dict)

    def register(self, name: str) -> Index:
        return self.indexes.setdefault(name, Index(self.spark, f"{self.base.rstrip('/')}/{name}"))

    def add(self, name: str, key: str, value: str) -> None:
        """An unknown index is no error."""
        if name in self.indexes:
            self.indexes[name].add(key, value)

    def build(self, name: str) -> bool:
        return name in self.indexes and self.indexes[name].build()

    def lookup(self, name: str, key: str | None) -> list[str]:
        return self.indexes[name].lookup(key) if name in self.indexes else []


class CityIndex:
    """An index whose keys are trimmed and in lower case; blank cities aren't indexed."""

    def __init__(self, spark: SparkSession, path: str):
        self.index = Index(spark, path)

    @staticmethod
    def normal(city: str | None) -> str | None:
        return (city or "").strip("".join(map(chr, range(33)))).lower() or None

    def add(self, city: str | None, customer: str) -> None:
        if key := self.normal(city):
            self.index.add(key, customer)

    def build(self) -> bool:
        return self.index.build()

    def build_from(self, table: DataFrame, city: str, customer: str, place: str) -> bool:
        found = entries_of(table, normal_key(F.col(city)), F.col(customer), F.col(place))
        return self.index.build_from(found.filter("key <> ''"))

    def customers(self, city: str | None) -> list[str]:
        return self.index.lookup(self.normal(city))
