"""Readers: rows, CSV, JSON Lines, JSON arrays, Parquet, and any format by a Python data source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType


def rows(spark: SparkSession, values: Iterable, schema: StructType | str, slices: int | None = None) -> DataFrame:
    """An in-memory collection; ``slices`` asks for so many partitions: contiguous chunks of equal size but for the last ones, order kept."""
    values = list(values)
    df = spark.createDataFrame(values, schema)
    if not slices:
        return df
    whole = StructType([*df.schema.fields, StructField("__at", LongType())])
    each = max(1, -(-len(values) // slices))
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(values)], whole)
    return df.repartitionById(slices, F.floor(F.col("__at") / each).cast("int")).sortWithinPartitions("__at").drop("__at")


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, delimiter: str = ",", header: bool = False, encoding: str = "UTF-8", escape: str = "\\") -> DataFrame:
    """Delimited text by Spark's splittable reader: all strings unless a schema is given; fields are trimmed.

    Blank lines are skipped and short rows padded with nulls; csv_exact() has the line dialect to the letter.
    """
    reader = spark.read.options(sep=delimiter, header=header, encoding=encoding, quote='"', escape=escape, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return (reader.schema(schema) if schema else reader).csv(path)


def parse_line(line: str, delimiter: str = ",") -> list[str]:
    """Fields of one line: a backslash takes the next character as it is, quotes toggle and vanish, fields are trimmed.

    Inside quotes the delimiter is ordinary. A blank line has no fields.
    """
    if not line.strip():
        return []
    fields, quoted = [""], False
    for escaped, quote, end, other in re.findall(rf'\\(.)|(")|({re.escape(delimiter)})|(.)', line, re.S):
        if quote:
            quoted = not quoted
        elif end and not quoted:
            fields.append("")
        else:
            fields[-1] += escaped or end or other
    return [f.strip("".join(map(chr, range(33)))) for f in fields]


def csv_exact(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False) -> DataFrame:
    """(fields array<string>): every line by parse_line(), a blank one as an empty array. The header is the line at each file's byte 0, whatever other lines say."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # a task reads its blocks one after another, line by line
        for batch in batches:
            out = []
            for line, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not header or block == before or block[1]:
                    out.append(parse_line(line, delimiter))
                before = block
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["fields"])

    return lines.mapInArrow(run, "fields array<string>")


def csv_header(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> list[str] | None:
    """Names of the first line; None without a header."""
    return csv(spark, path, delimiter=delimiter, header=True).columns if header else None


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; lines that aren't JSON objects are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that are arrays of objects. A file is one task: large data belong in JSON Lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_tree(spark: SparkSession, path: str) -> DataFrame:
    """(value variant): lines as untyped trees; lines that aren't JSON are left out."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("value")).filter("value IS NOT NULL")


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


class Split(InputPartition):
    def __init__(self, at: object):
        self.at = at


class Written(WriterCommitMessage):
    def __init__(self, what: object):
        self.what = what


def custom_format(
    name: str, schema: str, splits: Callable[[dict], Iterable], read: Callable[[object, dict], Iterator[tuple]],
    write: Callable[[Iterator, dict], object] | None = None, commit: Callable[[list, dict], None] | None = None,
) -> type[DataSource]:
    """A data source from functions: the splits of a load's options, and the rows of a split.

    write() stores one partition's rows and says what it wrote; commit() gets what all partitions said, once, when all are
    done. Register it with spark.dataSource.register(); it is spark.read.format(name) and df.write.format(name).
    """

    class Writer(DataSourceWriter):
        def __init__(self, options: dict):
            self.options = options

        def write(self, iterator: Iterator) -> Written:
            return Written(write(iterator, self.options))

        def commit(self, messages: list) -> None:
            if commit:
                commit([m.what for m in messages if m is not None], self.options)

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[Split]:
            return [Split(at) for at in splits(self.options)]

        def read(self, partition: Split) -> Iterator[tuple]:
            return read(partition.at, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(dict(self.options))

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            if write is None:
                raise NotImplementedError(f"{name} can't be written")
            return Writer(dict(self.options))

    return Source
