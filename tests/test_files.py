import pytest
from pyspark.sql import functions as F

from tessera.operators.dataflow import greater_than
from tessera.plans import parquet_stats
from tessera.session import scratch
from tessera.sources import files
from tessera.sources.objects import ObjectStore, merged_listing
from tessera.streaming import log


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_csv(spark, tmp_path):
    p = write(tmp_path / "c", "x.csv", "9,red kite,kite@birds,61,Wye Valley\n8,wren,wren@birds,10,Fair Isle\n7,barn owl,owl@birds,35,Fen\n")
    got = [tuple(r) for r in files.csv(spark, p).collect()]
    assert len(got) == 3 and got[1] == ("8", "wren", "wren@birds", "10", "Fair Isle")
    assert files.csv_header(spark, p, header=False) is None


def test_tsv_with_header(spark, tmp_path):
    p = write(tmp_path / "t", "x.tsv", "ring\tbird\tspan\n9\tred kite\t61\n8\twren\t10\n")
    assert files.csv_header(spark, p, "\t") == ["ring", "bird", "span"]
    assert files.csv(spark, p, delimiter="\t", header=True).count() == 2
    assert [r.fields[1] for r in files.csv_exact(spark, p, "\t", header=True).collect()] == ["red kite", "wren"]


def test_header_is_the_first_line_only(spark, tmp_path):
    for k in range(5):
        p = write(tmp_path / "h", f"{k}.csv", "ring,bird\n" + f"{k},wren\nring,bird\n" * (k % 3))
    got = [tuple(r.fields) for r in files.csv_exact(spark, p, header=True).collect()]
    assert sorted(got) == sorted(x for k in range(5) for x in [(str(k), "wren"), ("ring", "bird")] * (k % 3))
    long = write(tmp_path / "l", "x.csv", "ring,bird\n" + "1,wren\n" * 40000)
    small_blocks = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small_blocks}
    try:
        for k, v in small_blocks.items():
            spark.conf.set(k, v)
        assert files.csv_exact(spark, long, header=True).filter("fields[0] = '1'").count() == files.csv_exact(spark, long, header=True).count() == 40000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_slices(spark):
    got = files.rows(spark, [(k,) for k in range(10)], "k int", slices=4).rdd.glom().collect()
    assert [[r.k for r in part] for part in got] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    assert files.rows(spark, [], "k int", slices=3).count() == 0


def test_exact_csv_keeps_blank_lines(spark, tmp_path):
    p = write(tmp_path / "e", "x.csv", 'a,b\n\n"x, y",z\n')
    assert [r.fields for r in files.csv_exact(spark, p).collect()] == [["a", "b"], [], ["x, y", "z"]]


def test_json(spark, tmp_path):
    p = write(tmp_path / "j", "x.json", '{"id": 1, "name": "a"}\nnot json\n\n{"id": 2, "name": "b"}\n{"id": 3, "name": null}\n')
    assert [tuple(r) for r in files.json_lines(spark, p, "id int, name string").collect()] == [(1, "a"), (2, "b"), (3, None)]
    tree = files.json_tree(spark, p).select(F.try_variant_get("value", "$.name", "string"))
    assert sorted(str(r[0]) for r in tree.collect()) == ["None", "a", "b"]
    q = write(tmp_path / "a", "x.json", '[\n{"bird": "barn owl", "place": "Fen"},\n{"bird": "wren", "place": "Fair Isle"}\n]\n')
    assert {tuple(r) for r in files.json_array(spark, q, "bird string, place string").collect()} == {("barn owl", "Fen"), ("wren", "Fair Isle")}


def test_custom_format_error_reaches_the_caller(spark):
    def broken(at, options):
        raise RuntimeError("split is broken")
        yield

    spark.dataSource.register(files.custom_format("broken", "a int", lambda o: [1], broken))
    with pytest.raises(Exception, match="split is broken"):
        spark.read.format("broken").load().collect()


@pytest.fixture
def bands(spark):
    """Three row groups: ages 20-30, 40-50, 60-70."""
    path = scratch(spark)
    for k, low in enumerate((20, 40, 60)):
        spark.range(k * 100 + 1, k * 100 + 101).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Customer_"), "id").alias("name"), (F.lit(low) + F.col("id") % 11).cast("int").alias("age")).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize(("value", "rows", "groups"), [(35, 200, 2), (50, 100, 1), (15, 300, 3), (70, 0, 0)])
def test_pruning(spark, bands, value, rows, groups):
    naive = parquet_stats.naive_read(spark, bands).filter(F.col("age") > value)
    found = greater_than(spark.read.parquet(bands), "age", value, ["id", "name"])
    assert naive.count() == found.count() == rows
    stats = parquet_stats.footers(spark, bands)
    chosen = parquet_stats.may_hold(stats, "age", above=F.lit(value))
    assert chosen.count() == groups
    read = parquet_stats.read_row_groups(spark, chosen, ["id", "age"], "id string, age int")
    assert read.filter(F.col("age") > value).count() == rows
    assert parquet_stats.scan_metrics(found)["numOutputRows"] <= groups * 100


def test_pushdown_and_column_pruning(spark, bands):
    plan = greater_than(spark.read.parquet(bands), "age", 35, ["age"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,35)" in plan and "ReadSchema: struct<age:int>" in plan


def test_footer_totals_and_missing_statistics(spark, bands):
    stats = parquet_stats.footers(spark, bands)
    t = parquet_stats.totals(stats).first()
    assert (t.files, t.row_groups, t.rows, t.columns) == (3, 3, 300, 3)
    assert parquet_stats.may_hold(stats, "nosuch", above=F.lit(1)).count() == 3
    path = scratch(spark)
    spark.range(5).select(F.lit(None).cast("int").alias("v")).coalesce(1).write.parquet(path)
    assert parquet_stats.may_hold(parquet_stats.footers(spark, path), "v", above=F.lit(1)).count() == 0


def test_objects(spark):
    store = ObjectStore(spark, scratch(spark))
    assert store.list() == []
    for k in ("prefix-1", "prefix-2", "other-1", "d/e/f"):
        store.put(k, b"0123456789")
    assert store.get("prefix-1") == b"0123456789" and store.size("other-1") == 10
    assert store.get_range("prefix-1", 2, 5) == b"2345" and store.get_range("prefix-1", 7) == b"789"
    for a, b in ((-1, 2), (10, 11), (4, 3), (0, 10)):
        with pytest.raises(ValueError):
            store.get_range("prefix-1", a, b)
    assert store.list("prefix-") == ["prefix-1", "prefix-2"] and store.list("prefix-1") == []
    assert store.list() == ["d/e/f", "other-1", "prefix-1", "prefix-2"]
    with pytest.raises(FileNotFoundError, match="Failed to retrieve object: test-key"):
        store.get("test-key")
    store.put("prefix-1", b"new")
    assert store.get("prefix-1") == b"new"
    with pytest.raises(FileExistsError):
        store.put("prefix-1", b"x", overwrite=False)
    store.delete("prefix-1")
    store.delete("prefix-1")
    assert store.list("prefix-") == ["prefix-2"]
    assert len(store.list_from()) == 2 and len(store.list_from(recursive=True)) == 3
    assert store.list_status().filter("is_directory").count() == 1


def test_object_scan(spark):
    store = ObjectStore(spark, scratch(spark))
    birds = ["wren:10", "robin:14", "barn owl:35", "jay:34", "red kite:61"]
    for n, x in enumerate(birds, 1):
        store.put(f"ring-{n}", f"ring-{n}:{x}".encode())
    store.put("ring-empty", b"")
    store.put("log-1", b"x")
    found = store.scan("ring-", partitions=3)
    text = found.select(F.decode("content", "UTF-8").alias("t"))
    assert {r[0] for r in text.select(F.split("t", ":")[1]).collect()} == {x.split(":")[0] for x in birds}
    assert sorted(r[0] for r in text.filter(F.split("t", ":")[2].cast("int") > 34).select(F.split("t", ":")[2]).collect()) == ["35", "61"]
    keys = found.select("key")
    assert merged_listing(keys, keys.limit(2), keys).count() == 5


def test_objects_are_replaced_whole(spark):
    from concurrent.futures import ThreadPoolExecutor

    store = ObjectStore(spark, scratch(spark))
    store.put("a", b"0" * 5000)
    seen = set()

    def work(n):
        if n % 2:
            store.put("a", str(n % 10).encode() * 5000)
        else:
            seen.add(store.get("a"))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(work, range(60)))
    assert all(len(x) == 5000 and len(set(x)) == 1 for x in seen) and store.list() == ["a"]


def test_keys_that_spark_skips(spark):
    store = ObjectStore(spark, scratch(spark))
    keys = ["_a", ".b", "_c/d", "e/_f/g", "k=1/h", "_k=1/i", "j._COPYING_", "plain"]
    for k in keys:
        store.put(k, k.encode())
    assert sorted((r.key, bytes(r.content).decode()) for r in store.scan().collect()) == sorted((k, k) for k in keys)
    assert [r.key for r in store.scan("_c/").collect()] == ["_c/d"] and [r.key for r in store.scan("e/_f/").collect()] == ["e/_f/g"]
    assert store.list("_") == ["_a", "_c/d", "_k=1/i"]


def test_log(spark):
    store = ObjectStore(spark, scratch(spark))
    for v in (2, 0, 1):
        log.append(store, v, f'{{"version": {v}, "timestamp": {v}, "operation": {{"op": "add", "path": "p{v}"}}}}')
    with pytest.raises(FileExistsError):
        log.append(store, 1, "{}")
    assert [r.version for r in log.replay(spark, store.base).collect()] == [0, 1, 2]
    stream = log.follow(spark, store.base).writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", scratch(spark)).start()
    stream.awaitTermination(60)
    assert spark.table("followed").count() == 3


def test_partitions(spark):
    path = scratch(spark)
    df = spark.createDataFrame([(1, "Fair Isle"), (2, "a/b"), (3, "Fair Isle"), (4, None)], "id int, city string")
    log.write_partitioned(df, path, "city")
    found = log.read_partition(spark, path, F.col("city") == "Fair Isle")
    assert sorted(r.id for r in found.collect()) == [1, 3] and spark.read.parquet(path).count() == 4
    hot = scratch(spark)
    log.write_partitioned(spark.range(1000).selectExpr("id", "IF(id < 900, 'x', 'y') AS city"), hot, "city", rows=100)
    assert spark.read.parquet(hot).filter("city = 'x'").select(F.input_file_name()).distinct().count() > 3
    assert "PartitionFilters: [isnotnull(city" in found._jdf.queryExecution().executedPlan().toString()
