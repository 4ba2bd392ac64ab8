import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators.index import CityIndex, Index, IndexManager
from tessera.operators.keyed_table import CUSTOMER, ColumnDef, KeyedTable, TableSchema
from tessera.session import scratch

SCORE = TableSchema("id", (ColumnDef("id", "STRING", True), ColumnDef("name", "STRING", True), ColumnDef("region", "STRING"), ColumnDef("score", "INTEGER")))


def scores(prefix, n):
    return [{"id": f"{prefix}{i:03d}", "name": f"Customer {prefix}{i:03d}", "region": f"Region {prefix}", "score": 100 + i} for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def regions(spark):
    t = KeyedTable(spark, "regions", SCORE, scratch(spark))
    for p in "ABCD":
        t.insert_batch(scores(p, 50))
    return t


def test_point(regions):
    assert regions.find("B050").first().name == "Customer B050"
    assert regions.find("missing").count() == 0


def test_closed_and_half_open_ranges(regions):
    assert regions.scan("B020", "C030").count() == 61
    assert regions.scan("B020", "C030", end_inclusive=False).count() == 60
    assert regions.scan(None, None).count() == 200
    ids = [r.id for r in regions.scan("A010", "A020").collect()]
    assert ids == sorted(ids) and len(ids) == 11


def test_projections(regions):
    assert regions.scan("A001", "A002", ["name", "region"]).columns == ["id", "name", "region"]
    assert regions.scan("A001", "A002", ["name"], with_key=False).columns == ["name"]
    with pytest.raises(ValueError):
        regions.scan(columns=["nosuch"])


def test_scan_reads_only_what_it_needs(regions):
    plan = regions.scan("B020", "C030", ["score"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,B020)" in plan and "ReadSchema: struct<id:string,score:int>" in plan


def test_key_order_is_text_order(spark):
    t = KeyedTable(spark, "c", CUSTOMER, scratch(spark))
    rows = spark.range(1, 10001).select(F.format_string("CUST%04d", "id").alias("id"), F.lit("n").alias("name"), F.lit("e").alias("email"), F.lit(20).alias("age"))
    t.insert_frame(rows)
    assert t.scan("CUST0001", "CUST9999").count() == 10000
    assert t.scan("CUST2000", "CUST3000", ["name", "city"]).count() == 1001


def test_validation(spark):
    good = {"id": "1", "name": "a", "email": "e", "age": 3, "city": None}
    assert CUSTOMER.problems(good) == []
    for change, said in (({"id": " \t"}, "blank key"), ({"name": None}, "name: required"), ({"x": 1}, "unknown column"), ({"age": 1.5}, "age: not INTEGER"), ({"age": True}, "age: not INTEGER"), ({"age": 1 << 40}, "age: not INTEGER"), ({"email": None}, "email: required")):
        assert any(said in p for p in CUSTOMER.problems(good | change))
    t = KeyedTable(spark, "c", CUSTOMER, scratch(spark))
    for batch in (None, []):
        with pytest.raises(ValueError):
            t.insert_batch(batch)
    with pytest.raises(ValueError):
        t.insert_batch([good, {"id": ""}])
    assert t.frame().count() == 0
    t.insert(good)
    t.insert(good)
    assert t.frame().count() == 2 and t.find("1").count() == 1
    frame = spark.createDataFrame([("2", "b", "e"), ("3", None, "e")], "id string, name string, email string")
    with pytest.raises(PySparkException):
        t.insert_frame(frame)
    with pytest.raises(ValueError, match="age: not INTEGER"):
        t.insert_frame(frame.withColumn("age", F.lit(1).cast("long")))
    assert t.frame().count() == 2
    with pytest.raises(ValueError):
        TableSchema("k", (ColumnDef("a", "STRING"),))


def test_delete_and_stats(regions):
    assert regions.delete("nobody") is False
    with pytest.raises(NotImplementedError):
        regions.delete("A001")
    assert regions.stats()["column_count"] == 4
    regions.close()


@settings(max_examples=8, deadline=None)
@given(st.tuples(st.integers(0, 60), st.integers(0, 60)), st.booleans())
def test_any_range(regions, bounds, inclusive):
    lo, hi = (f"B{x:03d}" for x in bounds)
    want = [f"{p}{i:03d}" for p in "ABCD" for i in range(1, 51) if lo <= f"{p}{i:03d}" and (f"{p}{i:03d}" <= hi if inclusive else f"{p}{i:03d}" < hi)]
    assert [r.id for r in regions.scan(lo, hi, end_inclusive=inclusive).collect()] == want


def test_index(spark):
    index = Index(spark, scratch(spark))
    assert index.build() is False
    for n in (1, 2, 4):
        index.add("new_york", f"customer_{n}")
    index.add("los_angeles", "a,b")
    assert index.lookup("new_york") == ["customer_1", "customer_2", "customer_4"]
    assert index.build() is True
    assert index.lookup("new_york") == ["customer_1", "customer_2", "customer_4"]
    assert index.lookup("los_angeles") == ["a,b"] and index.lookup("x") == [] and index.lookup(None) == []


def test_manager_and_cities(spark):
    m = IndexManager(spark, scratch(spark))
    assert m.register("city") is m.register("city")
    m.add("city", "paris", "1")
    m.add("nosuch", "paris", "1")
    assert m.build("nosuch") is False and m.build("city") is True and m.lookup("city", "paris") == ["1"] and m.lookup("nosuch", "x") == []
    cities = CityIndex(spark, scratch(spark))
    for n, c in enumerate(["New York", "Boston", " ", "new york ", None, "Chicago", "NEW YORK"], 1):
        cities.add(c, str(n))
    assert cities.build() and cities.customers(" New York") == ["1", "4", "7"] and cities.customers(None) == [] and cities.customers("Rome") == []


def test_index_from_table_and_fetch(spark):
    table = spark.createDataFrame([(k, f"c{k}", ["New York", "Boston ", None][k % 3]) for k in range(9)], "n long, id string, city string")
    cities = CityIndex(spark, scratch(spark))
    cities.build_from(table, "city", "id", "n")
    assert cities.customers("boston") == ["c1", "c4", "c7"]
    assert cities.index.rows("new york", table, "id").count() == 3
