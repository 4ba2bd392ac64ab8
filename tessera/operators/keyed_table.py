"""Keyed tables with a declared schema over a folder of Parquet files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.functions.scalar import trim_controls
from tessera.operators.dataflow import key_range, project, project_with_key
from tessera.operators.index import Index, entries_of
from tessera.session import exists

#: The closed list of column types, with the Python class that a value must have.
TYPES: dict[str, tuple[DataType, type]] = {"STRING": (StringType(), str), "INTEGER": (IntegerType(), int), "LONG": (LongType(), int), "DOUBLE": (DoubleType(), float), "BOOLEAN": (BooleanType(), bool)}
LIMITS = {"INTEGER": 1 << 31, "LONG": 1 << 63}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    required: bool = False


@dataclass(frozen=True)
class TableSchema:
    key: str
    columns: tuple[ColumnDef, ...]

    def __post_init__(self) -> None:
        if self.key not in [c.name for c in self.columns]:
            raise ValueError(f"the key {self.key} is not a column")
        if unknown := [c.kind for c in self.columns if c.kind not in TYPES]:
            raise ValueError(f"no such types: {unknown}")

    @property
    def struct(self) -> StructType:
        return StructType([StructField(c.name, TYPES[c.kind][0], not c.required, {"key": c.name == self.key}) for c in self.columns])

    def problems(self, record: dict) -> list[str]:
        """What is wrong with a record; values aren't converted, so a whole number is no double."""
        out = []
        key = record.get(self.key)
        if key is None or not str(key).strip("".join(map(chr, range(33)))):
            out.append(f"{self.key}: blank key")
        for c in self.columns:
            value = record.get(c.name)
            if value is None:
                if c.required:
                    out.append(f"{c.name}: required")
            elif type(value) is not TYPES[c.kind][1] or (c.kind in LIMITS and not -LIMITS[c.kind] <= value < LIMITS[c.kind]):
                out.append(f"{c.name}: not {c.kind}")
        out += [f"{name}: unknown column" for name in record if name not in {c.name for c in self.columns}]
        return out

    def frame_problems(self, df: DataFrame) -> list[str]:
        """What is wrong with a frame's columns as such."""
        have = {f.name: f.dataType for f in df.schema.fields}
        known = {c.name: c for c in self.columns}
        out = [f"{c.name}: required" for c in self.columns if c.name not in have and c.required]
        out += [f"{name}: not {known[name].kind}" for name, kind in have.items() if name in known and kind != TYPES[known[name].kind][0]]
        return out + [f"{name}: unknown column" for name in have if name not in known]

    def errors(self, df: DataFrame) -> Column:
        """array<string> of what is wrong with each row: a blank key, a null in a required column."""
        key = F.col(self.key)
        blank = key.isNull() | (trim_controls(key.cast("string")) == "")
        found = [F.when(blank, F.lit(f"{self.key}: blank key"))]
        found += [F.when(F.col(c.name).isNull(), F.lit(f"{c.name}: required")) for c in self.columns if c.required and c.name in df.columns]
        return F.array_compact(F.array(*found))


#: A schema for examples and tests.
CUSTOMER = TableSchema("id", (ColumnDef("id", "STRING", True), ColumnDef("name", "STRING", True), ColumnDef("email", "STRING", True), ColumnDef("age", "INTEGER"), ColumnDef("city", "STRING")))


class KeyedTable:
    """Rows by key. Appended batches are files; nothing is overwritten, so a key inserted twice is there twice."""

    def __init__(self, spark: SparkSession, name: str, schema: TableSchema, path: str):
        self.spark, self.name, self.schema, self.path = spark, name, schema, path

    def insert(self, record: dict) -> None:
        self.insert_batch([record])

    def insert_batch(self, records: Sequence[dict]) -> None:
        """Validates all records, then appends them at once."""
        if not records:
            raise ValueError("an empty batch")
        if wrong := [(k, p) for k, r in enumerate(records) if (p := self.schema.problems(r))]:
            raise ValueError(f"invalid records: {wrong[:10]}")
        rows = [tuple(r.get(c.name) for c in self.schema.columns) for r in records]
        self._append(self.spark.createDataFrame(rows, self.schema.struct))

    def insert_frame(self, df: DataFrame) -> None:
        """Appends a frame of any size. An invalid row fails the write before anything of it is committed."""
        if wrong := self.schema.frame_problems(df):
            raise ValueError(f"invalid columns: {wrong}")
        found = self.schema.errors(df)
        checked = df.withColumn(self.schema.key, F.when(F.size(found) == 0, F.col(self.schema.key)).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.array_join(found, ", ")))))
        missing = {c.name: F.lit(None).cast(TYPES[c.kind][0]) for c in self.schema.columns if c.name not in df.columns}
        self._append(checked.withColumns(missing).select(*(c.name for c in self.schema.columns)) if missing else checked.select(*(c.name for c in self.schema.columns)))

    def _append(self, df: DataFrame) -> None:
        # sorted files have narrow key statistics, so that lookups skip row groups
        df.sortWithinPartitions(self.schema.key).write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema.struct).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema.struct)

    def find(self, key: object) -> DataFrame:
        """The row with a key, or none; any one of several."""
        return self.frame().filter(F.col(self.schema.key) == F.lit(key)).limit(1)

    def scan(self, start: object = None, end: object = None, columns: list[str] | None = None, end_inclusive: bool = True, with_key: bool = True) -> DataFrame:
        """Rows in key order. The end is inclusive or not; the projection adds the key or not."""
        if unknown := [c for c in columns or () if c not in {x.name for x in self.schema.columns}]:
            raise ValueError(f"unknown columns: {unknown}")
        found = key_range(self.frame(), self.schema.key, start, end, end_inclusive).orderBy(self.schema.key)
        return project_with_key(found, self.schema.key, columns) if with_key else project(found, columns)

    def create_index(self, path: str, column: str) -> Index:
        """An index of the rows so far, from a column's values to keys, in key order; null values aren't indexed."""
        if column not in {x.name for x in self.schema.columns}:
            raise ValueError(f"unknown columns: {[column]}")
        index = Index(self.spark, path)
        index.build_from(entries_of(self.frame().orderBy(self.schema.key), F.col(column), F.col(self.schema.key), F.monotonically_increasing_id()))
        return index

    def delete(self, key: object) -> bool:
        """False if there is no such key; rows can't be deleted."""
        if self.find(key).isEmpty():
            return False
        raise NotImplementedError("rows of a keyed table can't be deleted")

    def stats(self) -> dict:
        return {"name": self.name, "key": self.schema.key, "columns": [c.name for c in self.schema.columns], "column_count": len(self.schema.columns)}

    def close(self) -> None:
        """Nothing is held open."""
