import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import dataflow
from tessera.sources import files


def values(df):
    return [r[0] for r in df.collect()]


def ints(spark, xs, slices=None):
    return files.rows(spark, [(x,) for x in xs], "v int", slices)


def test_even_to_string(spark):
    assert values(dataflow.mapped(ints(spark, [1, 2, 3, 4, 5]).filter("v % 2 = 0"), v=F.col("v").cast("string"))) == ["2", "4"]


def test_empty(spark):
    assert values(ints(spark, []).filter("v > 0")) == []


def test_lazy(spark):
    failing = ints(spark, [1, 2, 3]).select(F.raise_error(F.lit("ran")).alias("v"))
    with pytest.raises(PySparkException):
        failing.collect()


def test_chain_with_whole_division(spark):
    x = ints(spark, [1, 2, 3, 4, 5]).select((F.col("v") * 2).alias("v")).filter("v > 5")
    assert values(x.select(scalar.whole_quotient(F.col("v"), 2))) == [3, 4, 5]
    assert values(ints(spark, [-7, 7]).select(scalar.whole_quotient(F.col("v"), 2))) == [-3, 3]


def test_nulls_and_upper(spark):
    df = files.rows(spark, [("a",), (None,), ("b",), (None,), ("c",)], "v string")
    assert values(df.filter(F.col("v").isNotNull()).select(F.upper("v"))) == ["A", "B", "C"]


def test_chained_filters_are_one(spark):
    df = dataflow.filtered(ints(spark, range(1, 7)), F.col("v") % 2 == 0, F.col("v") > 2, F.col("v") < 6)
    assert values(df) == [4]
    assert df._jdf.queryExecution().executedPlan().toString().count("Filter") == 1


def test_repeatable(spark):
    df = ints(spark, [1, 2, 3, 4, 5], slices=4).select((F.col("v") * 2).alias("v"))
    assert sorted(values(df)) == sorted(values(df)) == [2, 4, 6, 8, 10]


def test_unknown_column(spark):
    with pytest.raises(AnalysisException):
        dataflow.project(ints(spark, [1]), ["w"])


def test_partition_functions(spark):
    def thrice(batches):
        for b in batches:
            yield pd.DataFrame({"v": b["v"] * 3})

    x = dataflow.map_partitions(spark.range(4).select(F.col("id").alias("v")), thrice, "v long")
    assert sorted(values(x.filter("v % 2 = 0").selectExpr("v + 5"))) == [5, 11]
    assert values(ints(spark, [3]).select(dataflow.map_udf(lambda s: s + 1, "int")("v"))) == [4]


def test_ranges(spark):
    df = files.rows(spark, [(f"key{k}", k) for k in range(10)], "k string, id int")
    assert [r.id for r in dataflow.key_range(df, "k", "key3", "key7", end_inclusive=False).collect()] == [3, 4, 5, 6]
    assert dataflow.key_range(df, "k", "key3", "key7").count() == 5
    assert dataflow.key_range(df, "k", None, None).count() == 10


def test_filter_before_projection(spark):
    df = files.rows(spark, [(1, 40), (2, None), (3, 30)], "id int, age int")
    assert values(dataflow.greater_than(df, "age", 35, ["id"])) == [1]


def test_scalars(spark):
    df = files.rows(spark, [("\t a b \n",)], "s string")
    assert values(df.select(scalar.trim_controls(F.col("s")))) == ["a b"]
    assert values(files.rows(spark, [("0x4a30",), ("x",)], "s string").select(scalar.hex_text(F.col("s")))) == ["J0", "x"]
    assert values(files.rows(spark, [(7,)], "s int").select(scalar.numbered("part-", F.col("s"), 5, ".parquet"))) == ["part-00007.parquet"]
    data = files.rows(spark, [(b"0123456789",)], "b binary")
    assert bytes(values(data.select(scalar.byte_range(F.col("b"), 2, 5)))[0]) == b"2345"
    assert bytes(values(data.select(scalar.byte_range(F.col("b"), 7)))[0]) == b"789"
    for start, end in ((-1, 3), (10, 12), (5, 4), (0, 10)):
        with pytest.raises(PySparkException):
            data.select(scalar.byte_range(F.col("b"), start, end)).collect()


def test_buckets_partition_the_keys(spark):
    b = spark.range(1000).select(scalar.bucket(F.col("id"), 7).alias("b")).groupBy("b").count().collect()
    assert sum(r["count"] for r in b) == 1000 and {r.b for r in b} == set(range(7))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab \\",', max_size=6), min_size=1, max_size=5))
def test_lines_of_quoted_fields(fields):
    line = ",".join('"' + f.replace("\\", "\\\\").replace('"', '\\"') + '"' for f in fields)
    assert files.parse_line(line) == [f.strip() for f in fields]


def test_line_dialect():
    assert files.parse_line('a, b ,"c, d",e\\,f') == ["a", "b", "c, d", "e,f"]
    assert files.parse_line('"say ""hi"""') == ["say hi"]
    assert files.parse_line("  ") == []
    assert files.parse_line("a\t\tb", "\t") == ["a", "", "b"]
