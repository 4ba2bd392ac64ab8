"""Scalar functions that the operators use, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_controls(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normal_key(c: Column) -> Column:
    """An index key: trimmed and in lower case."""
    return F.lower(trim_controls(c))


def field(c: Column, separator: str, n: int) -> Column:
    """The n-th (from 0) part of a separated text; null if there are fewer."""
    return F.get(F.split(c, f"\\Q{separator}\\E", -1), n)


def whole_quotient(a: Column, b: Column | int) -> Column:
    """Division of integers that stays integral, toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def hex_text(c: Column) -> Column:
    """Text of statistics written as 0x...; other text unchanged."""
    return F.when(c.startswith("0x"), F.decode(F.unhex(F.substring(c, 3, 1 << 30)), "UTF-8")).otherwise(c)


def byte_range(content: Column, start: int, end: int = -1) -> Column:
    """Bytes start to end of a binary column, both inclusive; -1: to the end. Bounds outside the content raise an error."""
    size = F.length(content)
    last = size - 1 if end == -1 else F.lit(end)
    fine = (F.lit(start) >= 0) & (F.lit(start) < size) & (last >= start) & (last < size)
    return F.when(fine, F.substring(content, F.lit(start + 1), last - start + 1)).otherwise(F.raise_error(F.concat(F.lit(f"range {start}..{end} outside an object of "), size.cast("string"), F.lit(" bytes"))))


def numbered(prefix: str, c: Column, digits: int, suffix: str = "") -> Column:
    """prefix, the number with leading zeros, suffix."""
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), digits, "0"), F.lit(suffix))


def bucket(key: Column, n: int) -> Column:
    """A stable bucket from 0 to n - 1; buckets are disjoint and cover all keys."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
