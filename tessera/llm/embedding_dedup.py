"""Near-duplicate vectors by iterative quantisation.

Rotations are learned (on a bounded sample) that turn centred, projected vectors into balanced binary codes with little
quantisation error. A code is cut into blocks, each as many bits wide as the number of vectors has binary digits, so that
a vector shares a block with as many unlike ones however many there are. Every vector stands in a table for each block,
under the block and under all that differ from it in one bit: tables of m blocks retrieve all pairs within 2m - 1 bits,
and those further apart that nearly agree in some block. Pairs are reranked by the cosine of the original vectors in
double precision.

How many of the pairs at the threshold the tables retrieve is measured on the sample, and there are as many tables as it
takes. Where the most are too few, as with vectors that have a large common mean, all vectors are compared with one
another, tile by tile.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import acos, ceil, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, join_keys, sized, told_apart

#: Vectors that the rotation is learned from, at most in expectation.
SAMPLE = 20_000
#: Bits of the narrowest and the widest block, the fewest tables and the most.
LEAST_WIDTH, MOST_WIDTH, LEAST_TABLES, MOST_TABLES = 12, 32, 4, 16
SIMILARITY = 0.95
#: Share of the pairs at the threshold that the tables have to retrieve, and sampled vectors that it is measured on.
LEAST_RECALL, MEASURED = 0.97, 2000
#: Vectors of a tile, in expectation, and those of them that are compared at a time.
TILE, STRIPE = 4096, 512


@dataclass(frozen=True)
class Tables:
    """``blocks`` tables, each of a block of ``width`` bits; whole blocks are packed into words of 64 bits."""

    width: int
    blocks: int

    @property
    def each(self) -> int:
        return 64 // self.width

    @property
    def words(self) -> int:
        return -(-self.blocks // self.each)

    @property
    def radius(self) -> int:
        """Most bits by which codes may differ to be reranked: all that is retrieved for sure, and five deviations over what pairs at the threshold differ by."""
        bits, p = self.width * self.blocks, acos(SIMILARITY) / pi
        return max(2 * self.blocks - 1, ceil(bits * p + 5 * sqrt(bits * p * (1 - p))))

    def word(self, k: int) -> str:
        return f"w{k // self.each}"

    def block(self, word: Column, k: int) -> Column:
        return F.shiftrightunsigned(word, k % self.each * self.width).bitwiseAND(F.lit((1 << self.width) - 1))


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection): codes are the signs of (x - centre) @ projection. x: unit vectors.

    Principal directions first, then the rotation and the codes are improved in turn. Beyond the vectors' dimensions
    further rotations are learned from other beginnings.
    """
    d = x.shape[1]
    if bits > d:
        parts = [learn_rotation(x, min(d, bits - at), rounds, seed + at) for at in range(0, bits, d)]
        return parts[0][0], np.concatenate([projection for _, projection in parts], axis=1)
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov((x - centre).T)) if len(x) > 1 else np.eye(d))
    basis = vectors[:, np.argsort(-values)][:, :bits]
    v = (x - centre) @ basis
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        code = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(code.T @ v)
        turn = (a @ b).T
    return centre, basis @ turn


def _double(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def valid(vector: str) -> Column:
    """Whether a vector can link: not null, of finite components, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))


def codes(unit: DataFrame, centre: np.ndarray, projection: np.ndarray, tables: Tables) -> DataFrame:
    """(node, w0, w1, ...) of (node, v): the code's words as longs."""
    place = np.array([k % tables.each * tables.width + b for k in range(tables.blocks) for b in range(tables.width)], np.uint64)
    begins = [k * tables.each * tables.width for k in range(tables.words)]

    @F.pandas_udf("array<long>")
    def code(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.empty((0, len(centre)))
        bits = np.left_shift((((x - centre) @ projection) >= 0).astype(np.uint64), place)
        return pd.Series(list(np.add.reduceat(bits, begins, axis=1, dtype=np.uint64).view(np.int64)), dtype=object)

    return unit.select("node", code("v").alias("c")).select("node", *(F.col("c")[k].alias(f"w{k}") for k in range(tables.words)))


def candidates(coded: DataFrame, tables: Tables) -> DataFrame:
    """(a, b), a < b, once each: codes within the tables' radius that agree in some block but for one bit.

    One side stands in each table under its block, the other under every block that differs from its own in one bit at
    most; a pair counts in the first table that retrieves it.
    """
    words = [f"w{k}" for k in range(tables.words)]
    own = [F.struct(F.lit(k).alias("t"), tables.block(F.col(tables.word(k)), k).alias("key")) for k in range(tables.blocks)]
    each = coded.select("node", *words, F.explode(F.array(*own)).alias("x")).select("node", *words, "x.t", "x.key")
    masks = F.array(*(F.lit(m).cast("long") for m in (0, *(1 << b for b in range(tables.width)))))
    left = each.withColumnsRenamed({"node": "a", **{w: f"a{w}" for w in words}})
    right = each.withColumnsRenamed({"node": "b", **{w: f"b{w}" for w in words}}).withColumn("m", F.explode(masks)).withColumn("key", F.col("key").bitwiseXOR(F.col("m"))).drop("m")
    differ = {w: F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")) for w in words}
    first = F.lit(True)
    for k in range(tables.blocks - 1):
        first = first & ((F.col("t") <= k) | (F.bit_count(tables.block(differ[tables.word(k)], k)) > 1))
    apart = reduce(Column.__add__, (F.bit_count(x) for x in differ.values()))
    return left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (apart <= tables.radius) & first).select("a", "b")


def near_pairs(x: np.ndarray, similarity: float = SIMILARITY, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three sets of pairs to measure on, of unit vectors x: near ones of the sample; and sampled vectors with what they become if turned, until the cosine is ``similarity``, the way two others differ or any way."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:MEASURED]]
    a, b = np.nonzero(np.triu(x @ x.T >= similarity, 1))
    some = rng.permutation(len(a))[:MEASURED]
    pairs = [(x[a[some]], x[b[some]])]
    for way in (x[rng.permutation(len(x))] - x[rng.permutation(len(x))], rng.normal(size=x.shape)):
        way = way - (way * x).sum(axis=1, keepdims=True) * x
        far = np.linalg.norm(way, axis=1)
        at = far > 1e-6
        pairs.append((x[at], similarity * x[at] + np.sqrt(1 - similarity**2) * way[at] / far[at, None]))
    return [p for p in pairs if len(p[0])]


def measured_recall(pairs: list[tuple[np.ndarray, np.ndarray]], centre: np.ndarray, projection: np.ndarray, tables: Tables) -> float:
    """The share of near pairs that the tables retrieve: the least of the sets'."""
    shares = []
    for a, b in pairs:
        differ = (((a - centre) @ projection >= 0) != ((b - centre) @ projection >= 0)).reshape(len(a), tables.blocks, -1).sum(axis=2)
        shares.append(((differ.min(axis=1) <= 1) & (differ.sum(axis=1) <= tables.radius)).mean())
    return float(min(shares, default=0.0))


def fitted(x: np.ndarray, n: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, Tables] | None:
    """Centre, projection and tables for n vectors, of which x are a sample: the fewest tables that retrieve LEAST_RECALL; None if none do."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, n.bit_length()))
    pairs = near_pairs(x, similarity)
    centre, projection = learn_rotation(x, width * MOST_TABLES)
    for blocks in range(LEAST_TABLES, MOST_TABLES + 1):
        tables = Tables(width, blocks)
        own = projection[:, : width * blocks]
        if measured_recall(pairs, centre, own, tables) >= LEAST_RECALL:
            return centre, own, tables
    return None


def tiled(unit: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b, once each: all pairs of unit vectors (node, v) of equal length whose cosine is, or but for rounding would be, ``similarity``.

    Every two tiles of a length's vectors meet in a task of bounded size: exact, but quadratic in the vectors of a length.
    """
    of = unit.select("node", F.size("v").alias("d"), F.transform("v", lambda x: x.cast("float")).alias("v"))
    tiles = of.groupBy("d").agg(F.floor(F.count("*") / TILE + 1).alias("m"))
    of = of.join(sized(tiles), "d").withColumn("own", F.pmod("node", "m"))
    each = of.select("d", "own", "node", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    each = each.select("d", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "node", "v")
    stripe = STRIPE

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]]
        found = [(np.empty(0, np.int64),) * 2]
        if len(left) and len(right):
            x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            least = similarity - (x.shape[1] + 4) * 2.0**-23  # single precision errs by less
            for at in range(0, len(x), stripe):
                p, q = np.nonzero(x[at : at + stripe] @ y.T >= least)
                a, b = left["node"].to_numpy()[p + at], right["node"].to_numpy()[q]
                once = a < b if same else np.ones(len(a), bool)
                found.append((np.minimum(a, b)[once], np.maximum(a, b)[once]))
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return each.groupBy("d", "i", "j").applyInPandas(compare, "a long, b long")


def link(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Null or zero vectors, and those with null or non-finite components, link with nothing; others with those of their
    length. A length of over ``TILE`` different vectors, and the most frequent one, has a rotation and tables of its own;
    the vectors of rarer ones are all compared. Equal vectors are linked by their count, not by pairs, and searched for once.
    Two rows with one id are two vectors; a null id is no component's smallest id unless it is alone (component_id null,
    kept true). An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(valid(vector), _double(vector)).alias("v"))
    rows = cut(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("more", F.xxhash64(F.lit(1), "v")))
    rows = told_apart(rows, "node", "more")
    kinds = rows.filter("v IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    # by the largest component first, so that no square overflows or vanishes
    kinds = kinds.withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("v", F.transform("v", lambda x: x / F.col("most")))
    kinds = kinds.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    kinds = cut(kinds.withColumn("v", F.transform("v", lambda x: x / F.col("norm"))))
    lengths = {r[0]: r[1] for r in kinds.groupBy(F.size("v")).count().collect()}
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    retrieved, indexed = [], []
    for length, n in sorted(lengths.items()):
        if n <= TILE and n < max(lengths.values()):
            continue  # few beside others: one tile
        unit = kinds.filter(F.size("v") == length).select("node", "v")
        some = [r[0] for r in unit.filter(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1_000_003)) < 1_000_003 * sample / n).select("v").collect()]
        if not some:
            some = [r[0] for r in unit.select("v").limit(100).collect()]
        if fit := fitted(np.array(some), n, similarity):
            retrieved.append(candidates(cut(codes(unit, *fit)), fit[2]))
            indexed.append(length)
    if len(indexed) < len(lengths):
        retrieved.append(tiled(kinds.filter(~F.size("v").isin(indexed)).select("node", "v"), similarity))
    pairs = reduce(DataFrame.unionByName, retrieved)
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.join(kinds.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("copies").alias("na")), "a").join(kinds.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("nb")), "b")
    linked = cut(pairs.filter(cosine >= similarity).select("a", "b", "na", "nb"))
    degree = linked.select("a", "nb").unionAll(linked.select("b", "na")).toDF("node", "d").groupBy("node").agg(F.sum("d").alias("d"))
    comps = components(linked)
    label = cut(kinds.select("node", "copies", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    lowest = cut(label.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    of = join_keys(label, lowest, "comp").join(degree, "node", "left")
    of = cut(of.select("node", "copies", (F.coalesce("d", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"))
    done = join_keys(rows.filter("node IS NOT NULL").select("vec_id", "node"), of, "node", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
