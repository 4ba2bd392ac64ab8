"""Resharding by minimum-cost flow.

Documents lie in old shards; the new shards have given capacities. A flow from the old shards' sizes to the new capacities
that moves the fewest bytes is solved over the shards alone. Each old shard's documents are then laid along a line in
blocks (large documents first) and cut where its flows say: the first and longest stretch stays in place, the rest moves.
Only shards that a moved block touches are rewritten, in a new generation of files; a manifest says which generation has
each shard's files, and is written last.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm.common import cut, join_keys

#: Expected most documents of a block.
BLOCK_ROWS = 20_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
MANIFEST = "shard int, generation int, rows long, bytes long"


def cheapest(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The amounts on edges (from, to, most, cost) of the largest flow from source to sink that costs least.

    Successive shortest paths in the residual network.
    """
    heads: list[list[int]] = [[] for _ in range(nodes)]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    for a, b, most, c in edges:
        for x, y, r, p in ((a, b, most, c), (b, a, 0, -c)):
            heads[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)
    while True:
        far: list[float] = [float("inf")] * nodes
        by = [-1] * nodes
        far[source], queue, queued = 0, deque([source]), [False] * nodes
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in heads[x]:
                if room[e] and far[x] + price[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[x] + price[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if by[sink] < 0:
            return room[1::2]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flows (from, to) -> amount that ship all supply within the capacities at the least cost. Raises ValueError if the capacities don't hold it."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the shards")
    source, sink = n + m, n + m + 1
    between = [(i, j) for i in range(n) for j in range(m)]
    edges = [(i, n + j, supply[i], cost[i][j]) for i, j in between]
    edges += [(source, i, s, 0) for i, s in enumerate(supply)] + [(n + j, sink, c, 0) for j, c in enumerate(capacity)]
    return {pair: x for pair, x in zip(between, cheapest(n + m + 2, edges, source, sink), strict=False) if x}


def fewest_moved(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """As min_cost_flow() where a byte that stays in its shard costs nothing and any other 1.

    All that moves passes one node between old and new shards, so the network has as many edges as shards, not as pairs
    of them; what enters and leaves that node is paired off in order.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the shards")
    hub, source, sink = n + m, n + m + 1, n + m + 2
    stay = [(i, n + i, supply[i], 0) for i in range(min(n, m))]
    leave, enter = [(i, hub, s, 1) for i, s in enumerate(supply)], [(hub, n + j, c, 0) for j, c in enumerate(capacity)]
    edges = [*stay, *leave, *enter, *((source, i, s, 0) for i, s in enumerate(supply)), *((n + j, sink, c, 0) for j, c in enumerate(capacity))]
    amounts = cheapest(n + m + 3, edges, source, sink)
    flows = {(i, i): x for i, x in enumerate(amounts[: len(stay)]) if x}
    out = [[i, x] for i, x in enumerate(amounts[len(stay) : len(stay) + n]) if x]
    to = [[j, x] for j, x in enumerate(amounts[len(stay) + n : len(stay) + n + m]) if x]
    while out:
        (i, x), (j, y) = out[-1], to[-1]
        flows[i, j] = flows.get((i, j), 0) + min(x, y)
        for line, left in ((out, x - y), (to, y - x)):
            if left > 0:
                line[-1][1] = left
            else:
                line.pop()
    return flows


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def assign(rows: DataFrame, old: Column, old_shards: int, shards: int, block_rows: int = BLOCK_ROWS, slack: int = 0) -> DataFrame:
    """Adds old_shard, shard and slot to rows that have a long ``size`` of one at least; sizes of the shards come out near equal.

    ``old`` is a row's shard so far, 0 to old_shards - 1; a shard may have ``slack`` bytes over its even share. Rows alike in every column are counted before they are dealt
    out, so any number of copies spreads over blocks. No task holds more than a block; only old shards' sums
    (old_shards numbers) come to the driver. An empty table stays empty. All columns of rows decide the order, so the
    result doesn't depend on partitions.
    """
    names = rows.columns
    copies = rows.groupBy(*names).agg(F.count("*").alias("__n"))
    # one row for each copy, a thousand copies to a step so that no array grows with the number of copies
    steps = copies.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / 1000))))
    units = steps.withColumn("__copy", F.explode(F.sequence(F.col("__step") * 1000, F.least(F.col("__n"), F.col("__step") * 1000 + 1000) - 1))).drop("__n")
    units = cut(units.withColumn("old_shard", old.cast("int")))
    sums = {r["old_shard"]: (r["b"], r["n"]) for r in units.groupBy("old_shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    supply = [sums.get(k, (0, 0))[0] for k in range(old_shards)]
    flows = fewest_moved(supply, [c + slack for c in even(sum(supply), shards)])
    parts = max(1, -(-sum(n for _, n in sums.values()) // (old_shards * block_rows)))

    block = ["old_shard", "__class", "__part"]  # larger documents first, so that the cuts fall among small ones
    units = units.withColumn("__class", F.floor(F.log2("size")).cast("int")).withColumn("__part", F.pmod(F.xxhash64(*names, "__step"), F.lit(parts)).cast("int"))
    # a table of blocks, smaller than the rows by block_rows
    line = Window.partitionBy("old_shard").orderBy(F.desc("__class"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = units.groupBy(*block).agg(F.sum("size").alias("__b")).withColumn("__begin", F.coalesce(F.sum("__b").over(line), F.lit(0))).drop("__b")
    inside = Window.partitionBy(*block).orderBy(F.desc("size"), *names, "__copy")
    place = F.col("__begin") * 2 + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("size")  # twice the middle of the document

    stretches = []
    for i in range(old_shards):
        at = 0
        for j, amount in sorted(((j, a) for (k, j), a in flows.items() if k == i), key=lambda x: (x[0] != i, x[0])):
            stretches.append((i, at * 2, (at + amount) * 2, j))
            at += amount
    cuts = rows.sparkSession.createDataFrame(stretches or [(0, 0, 1, 0)], "__o int, __from long, __to long, shard int")  # at most old_shards + shards rows
    put = units.join(begins, block).withColumn("__place", place)
    put = put.join(F.broadcast(cuts), (F.col("old_shard") == F.col("__o")) & (F.col("__place") >= F.col("__from")) & (F.col("__place") < F.col("__to")))
    order = Window.partitionBy("shard").orderBy("old_shard", F.desc("__class"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    put = cut(put.select(*names, *block, "__copy", "shard"))
    first = put.groupBy("shard", *block).agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    slot = F.col("__first") + F.row_number().over(Window.partitionBy("shard", *block).orderBy(F.desc("size"), *names, "__copy")) - 1
    return put.join(first, ["shard", *block]).withColumn("slot", slot.cast("long")).select(*names, "old_shard", "shard", "slot")


def measured(docs: DataFrame, doc: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """doc_id, size and text_crc32 of documents: a null text has the crc32 of no bytes and the size of a bare row."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.col(doc).alias("doc_id"), (F.length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *more)


def hash_shard(shards: int, doc: str = "doc_id") -> Column:
    """Where rows lie by their id alone; null ids lie together."""
    return F.pmod(F.xxhash64(doc), F.lit(shards))


def reshard(docs: DataFrame, old_shards: int, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot of every document under the law ``bytes``.

    Null ids lie in one old shard together, as do repeated rows; both are spread like others.
    """
    return assign(measured(docs), hash_shard(old_shards), old_shards, shards)


def _manifest(spark: SparkSession, base: str) -> tuple[int, dict[int, tuple[int, int, int]]]:
    """(the latest generation, -1 without one; each shard's generation of files, rows and bytes)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifests")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [int(p.getName()) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return -1, {}
    rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifests/{max(whole):06d}").collect()  # one row a shard
    return max(whole), {r["shard"]: (r["generation"], r["rows"], r["bytes"]) for r in rows}


def rewrite(docs: DataFrame, base: str, shards: int, old: Column | None = None, old_shards: int = 0, doc: str = "doc_id", text: str = "text", file_bytes: int = 1 << 27, slack: int = 0) -> list[int]:
    """Puts whole rows of docs into shards of near equal bytes as files under ``base``; returns the shards that it wrote.

    ``old`` says where a row lies so far, 0 to old_shards - 1; without it, nowhere. A shard is written if a row comes to
    it or leaves it, if docs has other rows of it than its files (by number and bytes), or if it has none; the files of others stay as they are and stay in use. New files go to a
    folder of the new generation and are found only once its manifest is written, so a job that fails halfway changes
    nothing and docs may be what read_shards() gives. Rows alike in all columns are as many as before. Files have
    about ``file_bytes`` of rows; ``slack`` is as in assign(), so that shards that are near enough stay.
    """
    spark = docs.sparkSession
    before, files = _manifest(spark, base)
    if old is None:
        old, old_shards, files = F.lit(0), 1, {}
    docs = docs.withColumn("__old", old.cast("int")).drop("__shard", "__slot")
    row = F.sha2(F.to_json(F.struct(*docs.columns)), 256)  # equal rows are any one of them
    plan = cut(assign(measured(docs, doc, text, row.alias("__row"), F.col("__old")), F.col("__old"), old_shards, shards, slack=slack).drop("__old"))
    moved = plan.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("k")).distinct()
    held = {r[0]: (r[1], r[2]) for r in plan.groupBy("old_shard").agg(F.count("*"), F.sum("size")).collect()}  # one row a shard, as all that is collected here
    other = {k for k in range(shards) if k not in files or held.get(k) != files[k][1:]}
    touched = sorted(({r[0] for r in moved.collect()} | other) & set(range(shards)))
    rows = plan.filter(F.col("shard").isin(touched)).select("__row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), "size")
    amount = rows.agg(F.sum("size")).first()[0] or 0
    own = docs.withColumn("__row", row).drop("__old").dropDuplicates(["__row"]).join(rows.groupBy("__row").agg(F.count("*").alias("__n")), "__row")
    put = join_keys(rows.drop("size"), own, "__row", "__n").drop("__row")
    put = put.repartitionByRange(int(amount // file_bytes) + len(touched) + 1, "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    put.write.partitionBy("__shard").parquet(f"{base}/generation-{before + 1:06d}")
    have = rows.groupBy("__shard").agg(F.lit(before + 1), F.count("*"), F.sum("size")).collect()
    now = [tuple(r) for r in have] + [(k, *files[k]) for k in range(shards) if k not in touched]
    spark.createDataFrame(sorted(now), MANIFEST).coalesce(1).write.parquet(f"{base}/manifests/{before + 1:06d}")
    return touched


def read_shards(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All rows that rewrite() has laid out under ``base``, of the documents' schema, with __shard and __slot."""
    latest, files = _manifest(spark, base)
    out = spark.createDataFrame([], StructType([*schema.fields, StructField("__slot", LongType()), StructField("__shard", IntegerType())]))
    whole = StructType([*schema.fields, StructField("__slot", LongType()), StructField("__shard", IntegerType())])
    for g in sorted({x[0] for x in files.values()}):
        folder = f"{base}/generation-{g:06d}"
        paths = [f"{folder}/__shard={k}" for k, x in sorted(files.items()) if x[0] == g]
        out = out.unionByName(spark.read.schema(whole).option("basePath", folder).parquet(*paths))
    return out
