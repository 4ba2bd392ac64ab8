"""Parquet footers as a table, row groups chosen by their statistics, and what a plan's scan did."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import file_system

#: Stores that tasks can read by ranges; of files elsewhere Spark hands over the whole content.
RANGED = {"file", "s3", "s3a", "gs", "hdfs"}
FOOTER = "file string, row_group int, row_group_rows long, column string, type string, min_value string, max_value string, null_count long, value_count long"


def _open(path: str, content: bytes | None) -> pq.ParquetFile:
    if content is not None:
        return pq.ParquetFile(io.BytesIO(content))
    if path.startswith("file:"):
        return pq.ParquetFile(re.sub("^file:/+", "/", path))
    fs, at = pa.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return pq.ParquetFile(fs.open_input_file(at))


def _ranged(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.makeQualified(p).toUri().getScheme() in RANGED


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, row group and column, with the column's statistics as text (null where there are none).

    Spark lists the files; tasks read their footers, by ranges where the store allows. The rows are as many as the footers'.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select("path", F.lit(None).cast("binary").alias("content")) if _ranged(spark, path) else files.select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                meta = _open(name, content.as_py()).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        known = s is not None and s.has_min_max
                        out.append((name, g, group.num_rows, col.path_in_schema, col.physical_type, _text(s.min) if known else None, _text(s.max) if known else None, s.null_count if s is not None and s.has_null_count else None, col.num_values))
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in FOOTER.split(", ")])

    return files.mapInArrow(read, FOOTER)


def _text(value: object) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def totals(stats: DataFrame) -> DataFrame:
    """(files, row_groups, rows, columns) of footers()."""
    groups = stats.groupBy("file", "row_group").agg(F.first("row_group_rows").alias("n"), F.count("*").alias("c"))
    return groups.agg(F.countDistinct("file").alias("files"), F.count("*").alias("row_groups"), F.sum("n").alias("rows"), F.max("c").alias("columns"))


def may_hold(stats: DataFrame, column: str, low: Column | None = None, high: Column | None = None, above: Column | None = None, kind: str = "double") -> DataFrame:
    """Row groups (file, row_group) that may hold a row with low <= column <= high, or column > above; values are read as ``kind``.

    Without statistics, or without the column, a row group is kept; one that has nulls only is left out.
    """
    own = stats.filter(F.col("column") == column)
    least, most = F.col("min_value").try_cast(kind), F.col("max_value").try_cast(kind)
    out = F.lit(True)
    if low is not None:
        out = out & (most >= low)
    if high is not None:
        out = out & (least <= high)
    if above is not None:
        out = out & (most > above)
    nulls_only = F.col("null_count") == F.col("value_count")
    keep = own.filter(~F.coalesce(nulls_only, F.lit(False)) & F.coalesce(out, F.lit(True))).select("file", "row_group")
    missing = stats.groupBy("file", "row_group").agg(F.max((F.col("column") == column).cast("int")).alias("has")).filter("has = 0").select("file", "row_group")
    return keep.union(missing)


def read_row_groups(spark: SparkSession, chosen: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """Rows of just the chosen row groups (file, row_group); a task reads a file's chosen groups one after another."""
    files = chosen.groupBy("file").agg(F.array_sort(F.collect_list("row_group")).alias("groups"))  # a file's row groups are few
    one = files.select("file").first()
    if one is None:
        return spark.createDataFrame([], schema)
    if _ranged(spark, one[0]):
        content = files.select("file", F.lit(None).cast("binary").alias("content"), "groups")
    else:
        paths = [r[0] for r in files.select("file").collect()]  # names of files only
        content = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content").join(files, "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, groups in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                file = _open(name, data.as_py())
                for g in groups:
                    yield from file.read_row_group(g, columns=columns).select(columns).to_batches()

    return content.mapInArrow(read, schema)


def naive_read(spark: SparkSession, path: str) -> DataFrame:
    """Everything, for comparison with filtered reads."""
    return spark.read.parquet(path)


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Runs df and sums the metrics of its file scans: rows they gave, files, bytes."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    out: dict[str, int] = {}

    def walk(node) -> None:
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.nodeName().startswith(("Scan ", "FileScan")):
            for name in ("numOutputRows", "numFiles", "filesSize"):
                if node.metrics().contains(name):
                    out[name] = out.get(name, 0) + node.metrics().apply(name).value()
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())

    walk(qe.executedPlan())
    return out
