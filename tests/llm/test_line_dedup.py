import duckdb
from pyspark.sql import functions as F

from tessera.llm import line_dedup
from tessera.llm.queries import op7_line_dedup


def test_whole_table_against_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{small}/documents.parquet'")
    got = op7_line_dedup(spark, small).toPandas().sort_values("doc_id")
    want = con.sql(line_dedup.SQL).df().sort_values("doc_id")
    assert got.values.tolist() == want[got.columns.tolist()].values.tolist() and got.n_removed.sum() > 0


def test_edges(spark):
    rows = [(i, f"Boiler\n own {i} \n\n boiler2 ", f"s{i}") for i in range(12)] + [(None, "Boiler\nx", None), (100, None, "s1"), (100, "", None), (100, "Boiler", "s1"), (100, "Boiler", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS line", "2 AS kept")
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    kept = {(r.doc, r.text): r.kept for r in got}
    assert kept[None, "Boiler\nx"] == "Boiler\nx"  # null ids come first
    assert kept[0, rows[0][1]] == " own 0 \n\n boiler2 " and kept[5, rows[5][1]] == " own 5 \n"
    assert kept[100, "Boiler"] == "" and kept[100, ""] == ""
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_threshold_is_exact(spark):
    for sites, gone in ((9, 0), (10, 9)):
        df = spark.range(sites * 50).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\n"), "id").alias("text"), (F.col("id") % sites).cast("string").alias("source"))
        assert line_dedup.dedup(df).filter("n_removed > 0").count() == (sites * 50 - 1 if gone else 0)


def test_many_sites_are_estimated(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\n"), "id").alias("text"), F.col("id").cast("string").alias("source"))
    assert line_dedup.dedup(df, sites=3000).agg(F.sum("n_removed")).first()[0] == 4999
    assert line_dedup.dedup(df, sites=5001).agg(F.sum("n_removed")).first()[0] == 0


def test_very_long_text(spark):
    rows = [(k, "\n".join(f"line {j} of {k}" if j % 1000 else "the same everywhere" for j in range(60000 if k == 0 else 5)), f"s{k}") for k in range(12)]
    got = {r.doc: (r.n_lines, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {k: (60000, 59) if k == 0 else (5, 1) for k in range(12)}
