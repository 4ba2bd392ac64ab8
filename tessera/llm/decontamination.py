"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document is as long as a benchmark item and begins where an item would if a shingle that both have stood in
its place: one common shingle is enough, and a window without any can't be similar to an item. Every such window gets a
SimHash fingerprint, as the items do. Items are entered in tables of fingerprint blocks under all values within a block's
share of the radius, so a look-up of a window's blocks finds every item of its size within the radius (pigeonhole),
whichever item the shingle was of. Found pairs are verified by the weighted similarity of their shingles: sum of smaller
counts over sum of larger counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, keep_keys, part_of, rolling, same_document, sized, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which fingerprints may differ: over four standard deviations above what pairs at the threshold differ by.
BLOCKS, RADIUS = 8, 23
BLOCK_BITS = 64 // BLOCKS


def simhash(grams: Column) -> Column:
    """64 bits: whether most of the grams' hashes have a bit set; a gram counts as often as it occurs."""
    ones = lambda b: F.aggregate(grams, F.lit(0), lambda s, g: s + F.shiftrightunsigned(g, b).bitwiseAND(F.lit(1)).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size(grams), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return out


def _block(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of windows (w, size, fp) and items (item, size, ifp) of one size whose fingerprints differ by RADIUS bits at most; each once."""
    share = RADIUS // BLOCKS
    masks = [sum(1 << b for b in c) for r in range(share + 1) for c in combinations(range(BLOCK_BITS), r)]
    tables = items.select("item", "size", "ifp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _block(F.col("ifp"), k).alias("v")) for k in range(BLOCKS)))).alias("x"))
    tables = tables.select("item", "size", "ifp", "x.k", F.explode(F.array(*(F.col("x.v").bitwiseXOR(F.lit(m).cast("long")) for m in masks))).alias("v"))
    looked = windows.select("w", "size", "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)))).alias("x")).select("w", "size", "fp", "x.k", "x.v")
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = F.lit(True)  # the first table that finds the pair
    for k in range(BLOCKS - 1):
        first = first & ((F.col("k") <= k) | (F.bit_count(_block(differ, k)) > share))
    return looked.join(sized(tables), ["size", "k", "v"]).filter((F.bit_count(differ) <= RADIUS) & first).select("w", "item")


def matches(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc, th, item, similarity) of documents (doc, th, text) and the items that they hold a similar window of.

    Items without words or with a null id match nothing; an item shorter than a shingle is one shingle. A document
    shorter than an item is one window. The best window of a pair counts. A shingle is looked up by the sizes of its
    items and its places in them, not by item, so one that most items have makes no more rows than there are such.
    """
    items = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("h")).filter((F.size("h") > 0) & F.col("item").isNotNull())
    items = items.withColumn("size", F.size("h")).withColumn("k", F.least("size", F.lit(shingle)))
    hashed = docs.select("doc", "th", word_hashes(F.col("text")).alias("h")).select("doc", "th", F.size("h").alias("n"), "h")  # the size apart: else all of h is copied for each place of a text
    out = None
    for k in sorted(r[0] for r in items.select("k").distinct().collect()):  # at most ``shingle`` values
        own = cut(items.filter(F.col("k") == k).select("item", "size", F.col("h")).select("item", "size", F.expr(f"size - {k} + 1").alias("m"), rolling("h", k).alias("g")).withColumn("g", F.expr("slice(g, 1, m)")))
        places = cut(own.select("size", "m", F.posexplode("g").alias("at", "gram")).distinct())
        grams = hashed.select("doc", "th", "n", F.posexplode(rolling("h", k)).alias("p", "gram")).filter(F.col("p") + k <= F.col("n"))
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("n") - F.col("size")))
        starts = cut(grams.join(sized(places), "gram").select("doc", "th", "size", "m", start.alias("start")).distinct())
        starts = starts.groupBy("doc", "th").agg(F.collect_list(F.struct("size", "m", "start")).alias("s")).withColumnsRenamed({"doc": "d2", "th": "t2"})  # a document has fewer than words times sizes
        some = keep_keys(docs, starts.select(F.col("t2").alias("th")).distinct(), "th").dropDuplicates(["doc", "th"])
        some = some.select("doc", "th", word_hashes(F.col("text")).alias("h")).select("doc", "th", F.size("h").alias("n"), rolling("h", k).alias("g"))
        joined = some.join(starts, same_document("d2", "t2"))  # a text's shingles travel once, however many windows it has
        window = F.transform("s", lambda x: F.struct(x["size"].alias("size"), x["start"].alias("start"), part_of(F.col("g"), x["start"], F.least(x["m"], F.col("n") - k + 1 - x["start"])).alias("g")))
        windows = joined.select("doc", "th", F.explode(window).alias("x")).select("doc", "th", "x.*").filter("size(g) > 0")
        windows = cut(windows.select("doc", "th", F.struct("doc", "th", "start", "size").alias("w"), "size", "g", simhash(F.col("g")).alias("fp")))
        found = within_radius(windows, own.select("item", "size", simhash(F.col("g")).alias("ifp")))
        counts = lambda df, by, name: df.select(*by, F.explode("g").alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias(name))
        both = found.join(windows.select("w", "g"), "w").select("w", "item", "g")
        left = counts(both, ["w", "item"], "a").withColumn("b", F.lit(0).cast("long"))
        right = counts(found.join(own.select("item", "g"), "item").select("w", "item", "g"), ["w", "item"], "b").select("w", "item", "gram", F.lit(0).cast("long").alias("a"), "b")
        grams = left.unionByName(right).groupBy("w", "item", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        like = grams.groupBy("w", "item").agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")).filter(F.col("similarity") >= similarity)
        got = like.groupBy("w.doc", "w.th", "item").agg(F.max("similarity").alias("similarity"))
        out = got if out is None else out.unionByName(got)
    kinds = f"doc {docs.schema['doc'].dataType.simpleString()}, th long, item {benchmark.schema[item].dataType.simpleString()}, similarity double"
    return docs.sparkSession.createDataFrame([], kinds) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, best_similarity for every row.

    best_item is the smallest of the most similar items, null without one, and best_similarity then 0. Null texts count
    as empty and are clean. Rows with one id are told apart by their text; repeated rows have the same result each.
    """
    rows = documents(docs, doc, text)
    found = matches(rows, benchmark, **how)
    best = found.groupBy("doc", "th").agg(F.count("*").alias("n_items"), F.min(F.struct((-F.col("similarity")).alias("s"), "item")).alias("b"))
    best = best.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), "n_items", F.col("b.item").alias("best_item"), (-F.col("b.s")).alias("best_similarity"))
    out = rows.select("doc", "th").join(best, same_document("d2", "t2"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best_item", F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"))
