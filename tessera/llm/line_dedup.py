"""Removal of boilerplate lines by their spread over distinct sites.

Each line's hash gets a HyperLogLog sketch of the sites that have it; sketches merge as partial aggregates. Lines whose
estimate is far above or below the threshold are decided by it; lines near it get an exact distinct count. A line that
stands on enough sites is boilerplate: it stays where it stands first (smallest document id, text hash and place) and
goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, cut_table, documents, join_keys, same_document, split_by_keys

#: Sites that make a line boilerplate, binary logarithm of a sketch's registers, and the relative error within which an estimate isn't trusted.
SITES, LG_K, MARGIN = 10, 10, 0.15


def line_hashes(text: F.Column) -> F.Column:
    """Hash of each line, surrounding white space aside; null for a blank one."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")))
    return F.transform(bare, lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(lines: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """(line, n, first): lines (line, site, doc, th, at) that stand on ``sites`` distinct sites or more, how often, and where first.

    Null sites count as no site. Only lines that occur often enough to be on so many sites are sketched.
    """
    often = lines.groupBy("line").agg(F.count("site").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    often = cut(often.filter(F.col("n") >= sites).select("line", "n", F.hll_sketch_estimate("sketch").alias("about")))
    sure = often.filter(F.col("about") > sites * (1 + margin)).select("line", "n")
    near = often.filter(F.col("about").between(sites * (1 - margin), sites * (1 + margin))).select("line", "n")
    exact = join_keys(lines.select("line", "site").filter("site IS NOT NULL").distinct(), near, "line").groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= sites)
    found = cut(sure.unionByName(near.join(exact.select("line"), "line", "left_semi")))
    first = join_keys(lines.select("line", "doc", "th", "at"), found, "line").groupBy("line").agg(F.min(F.struct("doc", "th", "at")).alias("first"))
    return found.join(first, "line").select("line", "n", "first")


def dedup(df: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, extra: list[str] | None = None) -> DataFrame:
    """(doc, th, text, n_lines, n_removed, kept) and extra columns for every row, kept being the text without its boilerplate lines.

    Lines end at line feeds and are compared without surrounding white space; blank lines are never boilerplate. A null
    text counts as empty: one blank line. Rows alike in id and text are one document, and each keeps or loses the same
    lines. Null ids come first in order.
    """
    extra = extra or []
    rows = documents(df, doc, text, F.col(site).cast("string").alias("site"), F.struct(F.lit(0).alias("_"), *extra).alias("extra"))
    lines = rows.select("doc", "th", "site", F.posexplode(line_hashes(F.col("text"))).alias("at", "line")).filter("line IS NOT NULL")
    lines = cut_table(lines)
    hit = join_keys(lines, cut(boilerplate(lines, sites)), "line")
    hit = hit.filter(~(F.struct("doc", "th", "at").eqNullSafe(F.col("first"))))
    gone = cut(hit.select("doc", "th", "at").distinct().groupBy("doc", "th").agg(F.collect_list("at").alias("gone")).withColumnsRenamed({"doc": "d2", "th": "t2"}))
    touched, rest = split_by_keys(rows.select("doc", "th", "text", "extra"), gone.select(F.col("t2").alias("th")).distinct(), "th")
    out = touched.join(gone, same_document("d2", "t2"), "left").select("doc", "th", "text", "extra", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    if rest is not None:
        out = out.unionByName(rest.select("doc", "th", "text", "extra", F.array().cast("array<int>").alias("gone")))
    split = out.select("doc", "th", "text", "extra", "gone", F.split("text", "\n").alias("l"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.filter("l", lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return split.select("doc", "th", "text", F.size("l").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept"), *(F.col("extra")[c].alias(c) for c in extra))


#: What dedup() gives, as doc_id, n_lines, n_removed and the MD5 of the kept text, in SQL.
SQL = f"""
WITH raws AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), bare AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raws
), spread AS (SELECT line, min(row(doc_id, place)) AS head FROM bare WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), marked AS (SELECT bare.doc_id, bare.place, bare.raw, spread.line IS NOT NULL AND row(bare.doc_id, bare.place) <> spread.head AS gone FROM bare LEFT JOIN spread ON bare.line = spread.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, md5(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""
