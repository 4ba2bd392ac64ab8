"""The engine's queries over the driver's tables, and the SQL that checks each."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import dataflow
from tessera.operators.index import CityIndex, Index, IndexManager, entries_of
from tessera.operators.keyed_table import CUSTOMER, ColumnDef, KeyedTable, TableSchema
from tessera.plans import parquet_stats
from tessera.session import scratch, table
from tessera.sources import files
from tessera.sources.objects import ObjectStore, merged_listing
from tessera.streaming import log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


C_TABLE = TableSchema("c_name", (ColumnDef("c_custkey", "LONG", True), ColumnDef("c_name", "STRING", True), ColumnDef("c_nationkey", "INTEGER"), ColumnDef("c_acctbal", "DOUBLE"), ColumnDef("c_mktsegment", "STRING")))


def _append_customers(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """The customer table as a keyed table, appended in three batches."""
    t = KeyedTable(spark, "customer", C_TABLE, scratch(spark))
    for k in range(3):
        t.insert_frame(table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 == k))
    return t


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, write: Callable[[SparkSession, str], str]) -> str:
    """The path of what ``write`` has written, once in an application, so that queries that read it do just that."""
    own = spark.sparkContext.applicationId, sf_dir, write.__name__
    if own not in _WRITTEN:
        _WRITTEN[own] = write(spark, sf_dir)
    return _WRITTEN[own]


def _customers(spark: SparkSession, sf_dir: str) -> KeyedTable:
    def customers(spark: SparkSession, sf_dir: str) -> str:
        return _append_customers(spark, sf_dir).path

    return KeyedTable(spark, "customer", C_TABLE, _once(spark, sf_dir, customers))


# sources


@query("SELECT CAST(i AS VARCHAR) AS v FROM range(1, 6) t(i) WHERE i % 2 = 0")
def parallelize_filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.rows(spark, [(i,) for i in range(1, 6)], "i long", slices=2)
    return dataflow.mapped(df.filter(F.col("i") % 2 == 0), v=F.col("i").cast("string"))


@query("SELECT CAST(i AS BIGINT) AS v, CAST((i - 1) // 3 AS INTEGER) AS slice, CAST((i - 1) % 3 AS BIGINT) AS place FROM range(1, 9) t(i)")
def parallelize_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight values in three slices: contiguous, in order within each."""
    df = files.rows(spark, [(i,) for i in range(1, 9)], "v long", slices=3).select("v", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at"))
    return df.select("v", "slice", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


@query("SELECT * FROM nation")
def parquet_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parquet(spark, f"{sf_dir}/nation.parquet")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = table(spark, sf_dir, "customer"), scratch(spark)
    c.write.csv(path)
    return files.csv(spark, path, c.schema)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def tsv_header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = table(spark, sf_dir, "customer"), scratch(spark)
    c.write.options(sep="\t", header=True).csv(path)
    assert files.csv_header(spark, path, "\t") == c.columns
    return files.csv(spark, path, c.schema, delimiter="\t", header=True)


@query("SELECT c_custkey, c_name, upper(c_mktsegment) AS segment FROM customer")
def csv_exact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with escaped delimiters and quotes, by the exact dialect."""
    c, path = table(spark, sf_dir, "customer"), scratch(spark)
    c.select(F.format_string('%d ,"%s",  a\\,b , "%s"', "c_custkey", "c_name", "c_mktsegment")).write.text(path)
    f = files.csv_exact(spark, path).filter((F.size("fields") == 4) & (F.col("fields")[2] == "a,b"))
    return f.select(F.col("fields")[0].cast("long").alias("c_custkey"), F.col("fields")[1].alias("c_name"), F.upper(F.col("fields")[3]).alias("segment"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation UNION ALL SELECT 'key', 'name' FROM nation WHERE n_regionkey = 1")
def csv_header_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file has a header, and some lines that say the same: those are data."""
    n, path = table(spark, sf_dir, "nation"), scratch(spark)
    lines = n.select(F.concat_ws(",", "n_nationkey", "n_name").alias("v"), F.col("n_regionkey").alias("at")).unionByName(n.filter("n_regionkey = 1").select(F.lit("key,name").alias("v"), F.col("n_nationkey").alias("at")))
    lines.withColumnRenamed("v", "key,name").repartitionByRange(3, "at").select("key,name").write.option("header", True).option("quote", "").csv(path)
    f = files.csv_exact(spark, path, header=True)
    return f.select(F.col("fields")[0].alias("key"), F.col("fields")[1].alias("name"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch(spark)
    c.write.json(path)
    return files.json_lines(spark, path, c.schema)


@query("SELECT c_custkey, c_name FROM customer")
def jsonl_skip_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch(spark)
    c.select(F.to_json(F.struct("*")).alias("value")).union(c.select(F.concat(F.lit("not json "), "c_name"))).write.text(path)
    return files.json_lines(spark, path, c.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), scratch(spark)
    store = ObjectStore(spark, path)
    rows = n.orderBy("n_nationkey").collect()  # the 25 nations
    store.put("array/nations.json", ("[\n" + ",\n".join(f'{{"n_nationkey": {r[0]}, "n_name": "{r[1]}"}}' for r in rows) + "\n]\n").encode())
    return files.json_array(spark, f"{path}/array", n.schema)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_tree_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "props")).alias("value")).write.text(path)
    tree = files.json_tree(spark, path)
    return tree.select(F.try_variant_get("value", "$.event_id", "long").alias("event_id"), F.try_variant_get(F.try_parse_json(F.try_variant_get("value", "$.props", "string")), "$.k", "int").alias("k"))


@query("SELECT i AS n, i * i AS square FROM range(0, 40) t(i)")
def custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's format with splits of its own."""
    source = files.custom_format("squares", "n long, square long", lambda o: range(0, int(o["upto"]), 10), lambda at, o: ((n, n * n) for n in range(at, at + 10)))
    spark.dataSource.register(source)
    return spark.read.format("squares").option("upto", 40).load()


@query("SELECT n_nationkey AS n, n_name AS name FROM nation")
def custom_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's storage: written by partitions, read back by its own splits."""
    folder = scratch(spark)
    folder = folder if ":" in folder else f"file://{folder}"

    def at(folder: str) -> tuple[pa.fs.FileSystem, str]:
        """The shared folder, in whichever store it is."""
        scheme, _, path = folder.partition(":")
        return pa.fs.FileSystem.from_uri(f"{scheme}://{path}" if scheme == "file" and not path.startswith("//") else folder)

    def write(rows: Iterator, options: dict) -> str:
        fs, path = at(options["folder"])
        fs.create_dir(path)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{path}/{name}") as f:
            for r in rows:
                f.write(f"{r[0]}\t{r[1]}\n".encode())
        return name

    def commit(names: list, options: dict) -> None:
        fs, path = at(options["folder"])
        with fs.open_output_stream(f"{path}/_manifest") as f:
            f.write("\n".join(names).encode())

    def splits(options: dict) -> list[str]:
        fs, path = at(options["folder"])
        return fs.open_input_stream(f"{path}/_manifest").read().decode().split()

    def read(name: str, options: dict) -> Iterator[tuple]:
        fs, path = at(options["folder"])
        for line in fs.open_input_stream(f"{path}/{name}").read().decode().splitlines():
            n, name = line.split("\t")
            yield int(n), name

    spark.dataSource.register(files.custom_format("manifest", "n int, name string", splits, read, write, commit))
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name")).repartition(3).write.format("manifest").option("folder", folder).mode("append").save()
    return spark.read.format("manifest").option("folder", folder).load()


# scalar functions


@query("""SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS trimmed, list_extract(string_split(c_name, '#'), 2) AS part, CAST(list_extract(string_split(c_name, '#'), 2) AS INTEGER) AS parsed,
 CAST(c_custkey AS VARCHAR) AS shown, c_custkey * 2 + 1 AS v, 'a b&c' AS text, 'a%20b%26c' AS encoded, lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS padded, octet_length(encode(c_name)) AS bytes, 'x' || c_mktsegment || ',y' AS joined FROM customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    digits = scalar.field(F.col("c_name"), "#", 1)
    return c.select(
        "c_custkey", scalar.normal_key(F.concat(F.lit(" \t"), "c_mktsegment", F.lit("\n"))).alias("trimmed"), digits.alias("part"), digits.cast("int").alias("parsed"), F.col("c_custkey").cast("string").alias("shown"),
        (F.col("c_custkey") * 2 + 1).alias("v"), scalar.hex_text(F.lit("0x6120622663")).alias("text"), F.regexp_replace(F.url_encode(F.lit("a b&c")), "\\+", "%20").alias("encoded"), scalar.numbered("", F.col("c_custkey"), 20).alias("padded"),
        F.length(F.encode("c_name", "UTF-8")).cast("long").alias("bytes"), F.array_join(F.split(F.concat(F.lit("x"), "c_mktsegment", F.lit(",y")), ","), ",").alias("joined"),
    )


# map, filter, projection


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 3 + 5 AS INTEGER) AS v FROM lineitem WHERE (l_linenumber * 3) % 2 = 0")
def map_filter_map_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dataflow.mapped(table(spark, sf_dir, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), t=F.col("l_linenumber") * 3)
    return dataflow.mapped(x.filter(F.col("t") % 2 == 0), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), v=F.col("t") + 5)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 AND l_returnflag = 'R'")
def chained_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.filtered(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 10, F.col("l_discount") < 0.05, F.col("l_returnflag") == "R").select("l_orderkey", "l_quantity")


@query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NOT NULL")
def null_filter_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("s", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.filter(F.col("s").isNotNull()).select("c_custkey", F.upper("s").alias("segment"))


@query("SELECT c_custkey // 2 AS half, c_custkey % 2 AS rest FROM customer")
def whole_quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(scalar.whole_quotient(F.col("c_custkey"), 2).alias("half"), (F.col("c_custkey") % 2).alias("rest"))


@query("SELECT c_name, c_acctbal FROM customer")
def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.project(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


@query("SELECT c_name, c_mktsegment FROM customer")
def project_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.project_with_key(table(spark, sf_dir, "customer"), "c_name", ["c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price FROM lineitem")
def udf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pandas_udf(net, "double")("l_extendedprice", "l_discount").alias("price"))


@query("SELECT n_nationkey, lower(n_name) AS name FROM nation")
def map_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n_nationkey": pdf["n_nationkey"], "name": pdf["n_name"].str.lower()})

    return dataflow.map_partitions(table(spark, sf_dir, "nation"), lower, "n_nationkey int, name string")


@query("""SELECT i::INTEGER AS partition, CASE WHEN i < 2 THEN (SELECT sum(n_regionkey) FROM nation WHERE n_nationkey % 3 = i)::VARCHAR END AS result, CASE WHEN i = 2 THEN 'ValueError: no such task' END AS error FROM range(0, 3) t(i)""")
def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each partition with a result of its own; the last one fails."""

    def task(batches: Iterator[pd.DataFrame]) -> str:
        whole = pd.concat(batches)
        if (whole["n_nationkey"] % 3 == 2).any():
            raise ValueError("no such task")
        return str(whole["n_regionkey"].sum())

    dealt = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").repartitionById(3, F.col("n_nationkey") % 3)
    return dataflow.task_results(dealt, task, "string")


# keyed tables


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_name = 'Customer#000000042'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).find("Customer#000000042")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'nobody'")
def point_lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).find("nobody").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_name >= 'Customer#000000003' AND c_name < 'Customer#000000007'")
def range_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).scan("Customer#000000003", "Customer#000000007", ["c_custkey"], end_inclusive=False, with_key=False)


@query("SELECT c_name, c_mktsegment FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000049'")
def range_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return dataflow.project_with_key(dataflow.key_range(c, "c_name", "Customer#000000010", "Customer#000000049"), "c_name", ["c_mktsegment"]).orderBy("c_name")


@query("SELECT c_name, c_acctbal FROM customer WHERE c_name >= 'Customer#000000100'")
def range_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).scan("Customer#000000100", None, ["c_acctbal"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def batch_insert_union_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append_customers(spark, sf_dir).scan()


@query("SELECT c_name AS value FROM customer WHERE c_mktsegment = 'MACHINERY'")
def table_create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).create_index(scratch(spark), "c_mktsegment").find("MACHINERY")


@query("""SELECT * FROM (VALUES ('1', ''), ('', 'id: blank key'), (' ', 'id: blank key'), (NULL, 'id: blank key, id: required'), ('5', 'name: required'), ('6', 'email: required')) t(id, errors)""")
def schema_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = files.rows(spark, [("1", "a", "a@x", 3, "c"), ("", "b", "b@x", 1, None), (" ", "c", "c@x", None, None), (None, "d", "d@x", 4, "e"), ("5", None, "e@x", 5, "f"), ("6", "f", None, None, None)], "id string, name string, email string, age int, city string")
    return bad.select("id", F.array_join(CUSTOMER.errors(bad), ", ").alias("errors"))


@query("SELECT * FROM (VALUES ('missing', FALSE, 'no-op'), ('present', TRUE, 'NotImplementedError')) t(key, found, outcome)")
def delete_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a missing key does nothing; a present one can't be deleted."""
    t = KeyedTable(spark, "t", CUSTOMER, scratch(spark))
    t.insert({"id": "present", "name": "n", "email": "e", "age": None, "city": None})
    said = []
    for key in ("missing", "present"):
        try:
            said.append((key, t.delete(key), "no-op"))
        except NotImplementedError as e:
            said.append((key, True, type(e).__name__))
    return files.rows(spark, said, "key string, found boolean, outcome string")


@query("SELECT * FROM (VALUES ('customer', 'c_name', 5, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment')) t(name, key, column_count, columns)")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = KeyedTable(spark, "customer", C_TABLE, scratch(spark)).stats()
    return files.rows(spark, [(stats["name"], stats["key"], stats["column_count"], ",".join(stats["columns"]))], "name string, key string, column_count int, columns string")


# pruned reads and footers


@query("""SELECT 'equal' AS bound, count(DISTINCT (c_custkey - 1) // 50) AS kept, count(*) AS found FROM customer WHERE c_name = 'Customer#000000077'
UNION ALL SELECT 'range', count(DISTINCT (c_custkey - 1) // 50), count(*) FROM customer WHERE c_custkey BETWEEN 40 AND 140
UNION ALL SELECT 'absent', count(DISTINCT (c_custkey - 1) // 50), count(*) FROM customer WHERE c_custkey > 10000000""")
def row_group_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of the customer table, fifty keys each, that statistics leave, and the rows that match."""
    path = scratch(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("(c_custkey - 1) div 50").alias("g"))
    c.repartitionByRange("g").sortWithinPartitions("g", "c_custkey").write.partitionBy("g").parquet(path)
    stats = parquet_stats.footers(spark, path)
    key, low, high = F.lit("Customer#000000077"), F.lit(40), F.lit(140)
    equal = parquet_stats.may_hold(stats, "c_name", low=key, high=key, kind="string").agg(F.lit("equal").alias("bound"), F.count("*").alias("kept"))
    ranged = parquet_stats.may_hold(stats, "c_custkey", low=low, high=high, kind="long").agg(F.lit("range").alias("bound"), F.count("*").alias("kept"))
    absent = parquet_stats.may_hold(stats, "c_custkey", above=F.lit(10_000_000), kind="long").agg(F.lit("absent").alias("bound"), F.count("*").alias("kept"))
    written = spark.read.parquet(path)
    found = written.agg(F.count_if(F.col("c_name") == key).alias("equal"), F.count_if(F.col("c_custkey").between(low, high)).alias("range"), F.count_if(F.col("c_custkey") > 10_000_000).alias("absent")).unpivot([], ["equal", "range", "absent"], "bound", "found")
    return equal.union(ranged).union(absent).join(found, "bound")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 35")
def filter_gt_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.greater_than(table(spark, sf_dir, "part"), "p_size", 35, ["p_partkey", "p_name"])


@query("SELECT p_partkey, p_size FROM part WHERE NULLIF(p_size, 50) > 35")
def filter_gt_int_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.greater_than(table(spark, sf_dir, "part").withColumn("p_size", F.nullif("p_size", F.lit(50))), "p_size", 35, ["p_partkey", "p_size"])


@query("SELECT 1::BIGINT AS files, count(*)::BIGINT AS \"rows\", 5::BIGINT AS columns, min(c_custkey)::BIGINT AS least, max(c_custkey)::BIGINT AS most FROM customer")
def footer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = parquet_stats.footers(spark, f"{sf_dir}/customer.parquet")
    least, most = (f(F.when(F.col("column") == "c_custkey", F.col(c)).try_cast("long")) for f, c in ((F.min, "min_value"), (F.max, "max_value")))
    rows = F.sum(F.when(F.col("column") == "c_custkey", F.col("row_group_rows")))
    return stats.agg(F.countDistinct("file").alias("files"), rows.alias("rows"), F.countDistinct("column").alias("columns"), least.alias("least"), most.alias("most"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 AND c_custkey <= 200")
def row_group_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Just the row groups that may hold the keys, of files sorted by key."""

    def sorted_customers(spark: SparkSession, sf_dir: str) -> str:
        path = scratch(spark)
        table(spark, sf_dir, "customer").repartitionByRange(8, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(path)
        return path

    stats = parquet_stats.footers(spark, _once(spark, sf_dir, sorted_customers))
    chosen = parquet_stats.may_hold(stats, "c_custkey", high=F.lit(200), above=F.lit(100), kind="long")
    found = parquet_stats.read_row_groups(spark, chosen, ["c_custkey", "c_name"], "c_custkey long, c_name string")
    return found.filter((F.col("c_custkey") > 100) & (F.col("c_custkey") <= 200))


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part")
def naive_full_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_stats.naive_read(spark, f"{sf_dir}/part.parquet").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


# secondary indexes


def _segments(spark: SparkSession, sf_dir: str) -> Index:
    index = Index(spark, scratch(spark))
    index.build_from(entries_of(table(spark, sf_dir, "customer"), scalar.normal_key(F.concat(F.lit(" "), "c_mktsegment")), F.col("c_name"), F.col("c_custkey")))
    return index


def _built_segments(spark: SparkSession, sf_dir: str) -> Index:
    def segments(spark: SparkSession, sf_dir: str) -> str:
        return _segments(spark, sf_dir).path

    return Index(spark, _once(spark, sf_dir, segments), built=True)


@query("SELECT lower(trim(c_mktsegment)) AS key, count(*) AS n, min(c_name) AS first_value, max(c_name) AS last_value FROM customer GROUP BY 1")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = spark.read.parquet(_segments(spark, sf_dir).path)
    return built.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


@query("SELECT c_name AS value FROM customer WHERE lower(trim(c_mktsegment)) = 'machinery'")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built_segments(spark, sf_dir).find("machinery")


@query("SELECT c_name, c_acctbal FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def index_fetch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built_segments(spark, sf_dir).rows("building", table(spark, sf_dir, "customer"), "c_name").select("c_name", "c_acctbal")


@query("SELECT lower(trim(c_mktsegment)) AS city, count(*) AS customers FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def city_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys trimmed and in lower case; blank and null ones aren't indexed."""
    index = CityIndex(spark, scratch(spark))
    city = F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, " ")).otherwise(F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("\t")))
    index.build_from(table(spark, sf_dir, "customer").withColumn("city", city), "city", "c_name", "c_custkey")
    return spark.read.parquet(index.index.path).groupBy(F.col("key").alias("city")).agg(F.count("*").alias("customers"))


@query("SELECT * FROM (VALUES ('city', 'rome', 'a,b'), ('city', 'oslo', 'c'), ('type', 'x', 'a')) t(name, key, found)")
def index_manager(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several indexes by name, before and after they are built."""
    m = IndexManager(spark, scratch(spark))
    for name, key, value in (("city", "rome", "a"), ("type", "x", "a"), ("city", "rome", "b"), ("city", "oslo", "c")):
        m.register(name)
        m.add(name, key, value)
    m.add("nosuch", "rome", "z")
    before = [(n, k, ",".join(m.lookup(n, k))) for n, k in (("city", "rome"), ("city", "oslo"), ("type", "x"), ("nosuch", "rome"), ("city", "bonn"))]
    assert m.build("city") and m.build("type") and not m.build("nosuch")
    after = [(n, k, ",".join(m.lookup(n, k))) for n, k, _ in before]
    assert before == after
    return files.rows(spark, [x for x in after if x[2]], "name string, key string, found string")


# objects


def _nations(spark: SparkSession, sf_dir: str) -> ObjectStore:
    """An object for each nation: nation-<key> holds key:name:region."""
    store = ObjectStore(spark, scratch(spark))
    for r in table(spark, sf_dir, "nation").collect():  # the 25 nations
        store.put(f"nation-{r['n_nationkey']}", f"{r['n_nationkey']}:{r['n_name']}:{r['n_regionkey']}".encode())
    store.put("other-1", b"x")
    store.put("nation-empty", b"")
    return store


@query("SELECT 'nation-' || n_nationkey AS key FROM nation WHERE n_nationkey BETWEEN 10 AND 19 OR n_nationkey = 1")
def object_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nations(spark, sf_dir).list("nation-1")  # not the prefix itself, which is an object, too
    return files.rows(spark, [(k,) for k in [*found, "nation-1"]], "key string")


@query("SELECT 'nation-' || n_nationkey AS key, CAST(strlen(n_nationkey || ':' || n_name || ':' || n_regionkey) AS BIGINT) AS length FROM nation")
def object_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).scan("nation-").select("key", "length")


@query("SELECT n_nationkey || ':' || n_name || ':' || n_regionkey AS content FROM nation WHERE n_nationkey = 7")
def object_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rows(spark, [(_nations(spark, sf_dir).get("nation-7").decode(),)], "content string")


@query("SELECT n_nationkey, substr(n_nationkey || ':' || n_name || ':' || n_regionkey, 3, 4) AS part FROM nation")
def object_range_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nations(spark, sf_dir).scan("nation-", partitions=3)
    return found.select(F.substring_index("key", "-", -1).cast("int").alias("n_nationkey"), F.decode(scalar.byte_range(F.col("content"), 2, 5), "UTF-8").alias("part"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey > 2")
def object_text_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _nations(spark, sf_dir).scan("nation-").select(F.decode("content", "UTF-8").alias("t"))
    return text.filter(scalar.field(F.col("t"), ":", 2).cast("int") > 2).select(scalar.field(F.col("t"), ":", 1).alias("name"))


@query("SELECT 'nation-' || n_nationkey AS key FROM nation")
def object_list_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nations(spark, sf_dir).scan("nation-").select("key")
    shard = scalar.bucket(F.col("key"), 3)
    return merged_listing(*(found.filter(shard.isin(k, (k + 1) % 3)) for k in range(3)))


@query("SELECT '_delta_log/' || n_nationkey || '.json' AS key, n_name AS name FROM nation UNION ALL SELECT * FROM (VALUES ('_x', 'x'), ('.y', 'y'), ('_z/.z/z', 'z'), ('k=1/_f', 'f')) t(key, name)")
def object_scan_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of names that Spark's own sources skip."""
    store = ObjectStore(spark, scratch(spark))
    for r in table(spark, sf_dir, "nation").collect():  # the 25 nations
        store.put(f"_delta_log/{r['n_nationkey']}.json", r["n_name"].encode())
    for key, name in (("_x", b"x"), (".y", b"y"), ("_z/.z/z", b"z"), ("k=1/_f", b"f"), ("_empty", b"")):
        store.put(key, name)
    assert store.scan("_delta_log/").count() == 25
    return store.scan().select("key", F.decode("content", "UTF-8").alias("name"))


@query("SELECT 'nation-' || n_nationkey AS key FROM nation WHERE n_nationkey >= 5")
def object_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    for k in (0, 1, 2, 3, 4, 4, 99):
        store.delete(f"nation-{k}")
    return store.scan("nation-").select("key")


@query("SELECT * FROM (VALUES ('a.txt', 1::BIGINT, FALSE, 1, 4096::BIGINT), ('b', 0::BIGINT, TRUE, 1, 4096::BIGINT)) t(name, length, is_directory, replication, block_size)")
def object_list_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ObjectStore(spark, scratch(spark))
    store.put("dir/a.txt", b"x")
    store.put("dir/b/c.txt", b"yz")
    status = store.list_status("dir")
    return status.select(F.substring_index("uri", "/", -1).alias("name"), F.when(F.col("is_directory"), 0).otherwise(F.col("length")).cast("long").alias("length"), "is_directory", "replication", "block_size")


@query("SELECT * FROM (VALUES (FALSE, 'a.txt'), (TRUE, 'a.txt'), (TRUE, 'c.txt')) t(recursive, name)")
def object_list_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ObjectStore(spark, scratch(spark))
    store.put("dir/a.txt", b"x")
    store.put("dir/b/c.txt", b"yz")
    return files.rows(spark, [(r, p.rpartition("/")[2]) for r in (False, True) for p in store.list_from("dir", r)], "recursive boolean, name string")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 5")
def object_parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet that lies among a store's objects: footers and columns are read by ranges."""
    store = ObjectStore(spark, scratch(spark))
    table(spark, sf_dir, "part").write.parquet(f"{store.base}/tables/part")
    return files.parquet(spark, f"{store.base}/tables/part", "p_partkey", "p_size").filter(F.col("p_size") < 5)


@query("SELECT count(*) AS total, count(DISTINCT c_name) AS keys, 1::BIGINT AS buckets_of_a_key FROM customer")
def hash_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_name", scalar.bucket(F.col("c_name"), 7).alias("b"))
    by_key = c.groupBy("c_name").agg(F.count("*").alias("n"), F.countDistinct("b").alias("d"))
    return by_key.agg(F.sum("n").alias("total"), F.count("*").alias("keys"), F.max("d").alias("buckets_of_a_key"))


# logs and partitions


@query("SELECT i::INTEGER AS version, (1000 + i)::BIGINT AS timestamp, 'add' AS op, 'part-' || i || '.parquet' AS path FROM range(0, 5) t(i)")
def log_append_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ObjectStore(spark, scratch(spark))
    for v in (3, 0, 2, 4, 1):
        log.append(store, v, f'{{"version": {v}, "timestamp": {1000 + v}, "operation": {{"op": "add", "path": "part-{v}.parquet"}}}}')
    return log.replay(spark, store.base).select("version", "timestamp", "operation.op", "operation.path")


@query("SELECT i::INTEGER AS version, 1::BIGINT AS writers, 7::BIGINT AS refused, 1::BIGINT AS entries FROM range(0, 4) t(i)")
def log_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight writers of each version at once: one succeeds, and its entry is the one that is there."""
    store = ObjectStore(spark, scratch(spark))

    def write(job: tuple[int, int]) -> tuple[int, str | None]:
        version, writer = job
        try:
            log.append(store, version, f'{{"version": {version}, "timestamp": {writer}, "operation": {{"op": "add", "path": "w{writer}"}}}}')
        except FileExistsError:
            return version, None
        return version, f"w{writer}"

    with ThreadPoolExecutor(8) as pool:
        said = files.rows(spark, list(pool.map(write, [(v, w) for v in range(4) for w in range(8)])), "version int, path string")
    counts = said.groupBy("version").agg(F.count("path").alias("writers"), F.count_if(F.col("path").isNull()).alias("refused"))
    there = log.replay(spark, store.base).select("version", "operation.path").join(said, ["version", "path"]).groupBy("version").agg(F.count("*").alias("entries"))
    return counts.join(there, "version")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'FURNITURE'")
def partitioned_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    log.write_partitioned(table(spark, sf_dir, "customer"), path, "c_mktsegment")
    return log.read_partition(spark, path, F.col("c_mktsegment") == "FURNITURE").select("c_custkey", "c_name")


@query("SELECT i::INTEGER AS version, 'add' AS op FROM range(0, 3) t(i)")
def log_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream, as far as it goes."""
    store, out = ObjectStore(spark, scratch(spark)), scratch(spark)
    for v in range(3):
        log.append(store, v, f'{{"version": {v}, "timestamp": {v}, "operation": {{"op": "add", "path": "p{v}"}}}}')
    stream = log.follow(spark, store.base).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    stream.awaitTermination()
    return spark.read.schema(log.ENTRY).parquet(out).select("version", "operation.op")
