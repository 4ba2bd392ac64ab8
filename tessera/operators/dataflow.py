"""Lazy map, filter and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each row, with just the given columns."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def filtered(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold."""
    for c in conditions:
        df = df.filter(c)
    return df


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The listed columns only; all without a list. Unknown columns are an error."""
    return df.select(*columns) if columns else df


def project_with_key(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """The key first, then the listed columns; all without a list."""
    return df.select(key, *(c for c in columns if c != key)) if columns else df


def greater_than(df: DataFrame, column: str, value: float | int | str, columns: list[str] | None = None) -> DataFrame:
    """Rows with column > value; the filter precedes the projection, so the column needn't be projected. Nulls are out."""
    return project(df.filter(F.col(column) > value), columns)


def key_range(df: DataFrame, key: str, start: object = None, end: object = None, end_inclusive: bool = True) -> DataFrame:
    """Rows with start <= key and key <= end (< end unless inclusive); a bound of None is open."""
    if start is not None:
        df = df.filter(F.col(key) >= start)
    if end is not None:
        df = df.filter(F.col(key) <= end if end_inclusive else F.col(key) < end)
    return df


def map_udf(function: Callable[[pd.Series], pd.Series], returns: str) -> Callable[..., Column]:
    """An opaque function as a vectorised one. Prefer column expressions: a UDF isn't pushed to the scan."""
    return F.pandas_udf(function, returns)


def task_results(df: DataFrame, task: Callable[[Iterator[pd.DataFrame]], object], kind: str) -> DataFrame:
    """(partition int, result ``kind``, error string): what a task made of each partition, or how it failed; a failure of one doesn't end the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        try:
            result, error = task(batches), None
        except Exception as e:  # the task's own, whatever it is
            result, error = None, f"{type(e).__name__}: {e}"
        yield pd.DataFrame({"partition": [number], "result": pd.Series([result], dtype=object), "error": [error]})

    return df.mapInPandas(run, f"partition int, result {kind}, error string")


def map_partitions(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A computation over a partition's batches."""
    return df.mapInPandas(function, schema)
