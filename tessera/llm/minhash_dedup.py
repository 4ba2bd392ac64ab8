"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its word shingles, a shingle's weight being the number of binary digits of its count, so that
a phrase repeated hundreds of times doesn't outweigh the rest of a text. Each element has a region as wide as its weight;
hashed darts fall into the regions as a Poisson process over rank, the same darts for the same element in every document.
Darts are thrown up to the rank where k log k + 2k of them are expected in the whole document, so the cost doesn't grow
with k times the document. Each dart hits one of k coordinates; the earliest dart of each coordinate is the signature, and
two signatures agree in a coordinate with the probability of the documents' weighted Jaccard similarity.

Documents that share a band's key are candidates, and only they are compared, exactly, by counting common elements with
matrix products. First each is compared with the smallest of all it shares a key with; then, in each key's documents that
this hasn't joined to one class yet, those outside the largest class with all others, ``BLOCK`` against ``BLOCK`` to a task.
Only verified pairs link, so weak candidates never chain into groups. Tasks give a spanning forest of the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, cut_table, documents, give_back, join_keys, keep_keys, map_arrow, same_document, told_apart, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: With these a pair at the threshold becomes a candidate with probability 0.9997.
BANDS, BAND_ROWS = 20, 5
#: Documents that are compared in one task, as one block against another.
BLOCK = 512
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def elements(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Unit strips of a document's weighted shingles, sorted: a shingle that occurs c times has as many as c has binary digits."""
    w = hashes.view(np.uint64)
    if not len(w):
        return w
    n = min(shingle, len(w))
    s = mixed(w[: len(w) - n + 1] + M3)
    for k in range(1, n):
        s = mixed(s * M3 + w[k : len(w) - n + 1 + k])
    s = np.sort(s)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    if len(first) == len(s):
        return s
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.concatenate((first, [len(s)]))))
    more = (nth & (nth + 1)) == 0  # the 1st, 2nd, 4th, 8th ... occurrence
    s, nth = s[more], nth[more]
    again = nth > 0
    s[again] = mixed(s[again] + nth[again].astype(np.uint64) * M3)
    return np.sort(s)


def signature(strips: np.ndarray, k: int = BANDS * BAND_ROWS, widths: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart of each of k coordinates; strips: at least one.

    Strips are one wide. ``widths`` (over 0, to 1) makes some narrower, for weights that aren't whole numbers: a dart
    that falls beyond a strip's width misses the region and doesn't count.
    """
    reach = (k * log(k) + 2 * k) / (len(strips) if widths is None else widths.sum())
    while True:
        live, rank, nth, thrown, wide = strips, np.zeros(len(strips)), 0, [], widths
        while len(live):
            nth += 1
            dart = mixed(live + np.array([nth], np.uint64) * M2)
            rank = rank - np.log(((dart >> np.uint64(11)) + np.uint64(1)) * 2.0**-53)
            within = rank <= reach
            live, rank, dart = live[within], rank[within], dart[within]
            if wide is None:
                thrown.append((rank, dart))
            else:
                wide = wide[within]
                inside = (mixed(dart + M2) >> np.uint64(11)) * 2.0**-53 < wide
                thrown.append((rank[inside], dart[inside]))
        rank, dart = np.concatenate([r for r, _ in thrown]), np.concatenate([d for _, d in thrown])
        late_first = np.argsort(-rank)
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        at = (mixed(dart[late_first] + M3) % np.uint64(k)).astype(np.int64)
        out[at], hit[at] = mixed(dart[late_first] + M1), True  # the earliest comes last
        if hit.all():
            return out
        reach *= 2


def bands(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    s = sig.reshape(-1, rows)
    out = np.arange(1, len(s) + 1, dtype=np.uint64) * M3
    for k in range(rows):
        out = mixed(out * M1 + s[:, k])
    return out.view(np.int64)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each of left has in common with each of right; each array's elements are distinct."""
    sizes = np.array([len(x) for x in [*left, *right]])
    each = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.argsort(each, kind="stable")
    each, row = each[by], row[by]
    first = np.concatenate(([True], each[1:] != each[:-1]))
    column = np.cumsum(first) - 1
    shared = np.diff(np.concatenate((np.flatnonzero(first), [len(each)])))[column] > 1
    row, column = row[shared], column[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    for begin in range(0, column[-1] + 1, columns):
        a, b = np.searchsorted(column, [begin, begin + columns])
        m = np.zeros((len(sizes), min(columns, column[-1] + 1 - begin)), np.float32)
        m[row[a:b], column[a:b] - begin] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join two parts not joined before."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc, th, sig, more, bands) of documents; sig and more tell different weighted sets apart and are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2)
            values, offsets = h.values.to_numpy(), h.offsets.to_numpy()
            sigs, more, found = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if a == b:
                    sigs.append(None)
                    more.append(None)
                    found.append([])
                    continue
                strips = elements(values[a:b], shingle)
                digest = hashlib.blake2b(strips.tobytes(), digest_size=16).digest()
                sigs.append(int.from_bytes(digest[:8], "little", signed=True))
                more.append(int.from_bytes(digest[8:], "little", signed=True))
                found.append(bands(signature(strips)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.int64()), pa.array(more, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc", "th", "sig", "more", "bands"])

    return map_arrow(rows, run, f"doc {rows.schema['doc'].dataType.simpleString()}, th long, sig long, more long, bands array<long>")


def _strips(rows: DataFrame, shingle: int) -> DataFrame:
    """(sig, strips) of (sig, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1)
            values, offsets = h.values.to_numpy(), h.offsets.to_numpy()
            found = [elements(values[a:b], shingle).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["sig", "strips"])

    return map_arrow(rows, run, "sig long, strips binary")


def compared(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """A spanning forest (a, b) of the links between the documents (grp, i, j, is_left, comp, sig, strips) of one task.

    In each part (grp, i, j) those on the left are compared with the others, but for those of one class ``comp`` already.
    """
    out: list[tuple[int, int]] = []
    for _, part in pdf.groupby(["grp", "i", "j"], sort=False):
        sets = [np.frombuffer(x, np.uint64) for x in part["strips"]]
        sigs, comp, is_left = part["sig"].to_numpy(), part["comp"].to_numpy(), part["is_left"].to_numpy()
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        if not len(right):
            continue
        size = np.array([len(s) for s in sets], np.float32)
        for begin in range(0, len(left), BLOCK):  # blocks are of BLOCK in expectation
            some = left[begin : begin + BLOCK]
            inter = common_counts([sets[x] for x in some], [sets[x] for x in right])
            like = inter >= np.float32(similarity - 1e-9) * (size[some][:, None] + size[right][None] - inter)
            a, b = np.nonzero(like & (comp[some][:, None] != comp[right][None]))
            pairs = np.stack((some[a], right[b]), axis=1)
            out += [(int(sigs[x]), int(sigs[y])) for x, y in forest(len(sets), pairs)]
    give_back()
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _verified(parts: DataFrame, strips: DataFrame, tasks: int, similarity: float) -> DataFrame:
    """Links (a, b) of compared() for parts (grp, i, j, is_left, comp, sig, alone); a part that isn't small has a task ``alone``."""
    task = F.when(F.col("alone"), F.xxhash64("grp", "i", "j")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(tasks)))
    return parts.join(strips, "sig").withColumn("task", task).drop("alone").groupBy("task").applyInPandas(lambda pdf: compared(pdf, similarity), "a long, b long")


def _spread(members: DataFrame, block: int) -> DataFrame:
    """Parts for _verified() of members (grp, sig, comp, is_minor, n, minors): blocks of minor members against blocks of all."""
    members = members.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("nm", F.ceil(F.col("minors") / block).cast("int"))
    of = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    left = members.filter("is_minor").withColumn("i", of("nm")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("is_left", F.lit(True))
    right = members.withColumn("j", of("nb")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nm") - 1))).withColumn("is_left", F.lit(False))
    columns = ["grp", "i", "j", "is_left", "comp", "sig", (F.col("n") > block // 8).alias("alone")]
    return left.select(*columns).unionByName(right.select(*columns))


def links(keys: DataFrame, strips_of: Callable[[DataFrame], DataFrame], similarity: float, block: int) -> DataFrame:
    """(node, comp) for the sigs of (sig, key) that are linked to another: pairs that share a key, of at least ``similarity``."""
    xor = [F.bit_xor(F.xxhash64("sig", F.lit(k))).alias(f"x{k}") for k in range(2)]
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("sig").alias("low"), *xor).filter("n > 1")
    # keys of the very same documents, as most keys of a few near copies are, count once
    shared = cut(shared.groupBy("n", "low", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n", "low"))
    members = cut_table(join_keys(keys, shared, "key"))
    strips = cut_table(strips_of(members.select("sig").distinct()))

    # each with the smallest of all that it shares a key with
    lowest = cut(members.groupBy("sig").agg(F.min("low").alias("grp")))
    stars = lowest.filter("sig <> grp").withColumn("i", F.lit(0)).join(lowest.filter("sig <> grp").groupBy("grp").agg(F.count("*").alias("n")), "grp")
    stars = stars.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("j", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int"))
    alone = (F.col("n") > block // 8).alias("alone")
    heads = stars.select("grp", "i", "n", "nb").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    parts = heads.select("grp", "i", "j", F.lit(True).alias("is_left"), F.col("grp").alias("comp"), F.col("grp").alias("sig"), alone)
    parts = parts.unionByName(stars.select("grp", "i", "j", F.lit(False).alias("is_left"), F.col("sig").alias("comp"), "sig", alone))
    tasks = lowest.count() // block + 1
    first = components(_verified(parts, strips, tasks, similarity))

    # the keys whose documents are in several classes yet; a pair that was compared above is done
    named = cut(lowest.join(first.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "grp", F.coalesce("comp", "sig").alias("comp")))
    inside = cut_table(members.join(named.withColumnRenamed("grp", "star"), "sig"))
    counted = inside.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max((F.col("star") != F.col("low")).cast("int")).alias("other"))
    counted = counted.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("major"), F.max("c").alias("most"), F.max("other").alias("other"))
    open_keys = cut(counted.filter("comps > 1 AND (n > 2 OR other = 1)").select("key", "n", "major", (F.col("n") - F.col("most")).alias("minors")))
    rest = join_keys(inside.select("key", "sig", "comp"), open_keys, "key", "n", keep=True)
    rest = rest.select(F.col("key").alias("grp"), "sig", "comp", (F.col("comp") != F.col("major")).alias("is_minor"), "n", "minors")
    tasks = (open_keys.agg(F.sum("n")).first()[0] or 0) // block + 1
    more = _verified(_spread(rest, block), strips, tasks, similarity)
    at = named.select("sig", "comp")
    more = more.join(at.toDF("a", "u"), "a").join(at.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    second = components(more).toDF("comp", "wider")
    return named.join(second, "comp", "left").select(F.col("sig").alias("node"), F.coalesce("wider", "comp").alias("comp"))


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc, th, class_id, kept) for every row: class_id the smallest id of the documents reachable by links, kept the row it stands for.

    Two documents link if their weighted shingles' similarity is at least ``similarity``; a text of fewer words than a
    shingle is one shingle. A document without words (null and empty texts too) is a class of its own. Exact copies are
    compared once. Null ids are larger than others. Of rows alike in id and text each has the same result.
    """
    rows = documents(docs, doc, text)
    hashed = rows.select("doc", "th", word_hashes(F.col("text")).alias("h"))
    every = told_apart(cut_table(_signed(hashed, shingle)), "sig", "more")
    signed = every.filter("sig IS NOT NULL")
    reps = cut(signed.groupBy("sig").agg(F.first("doc").alias("doc"), F.first("th").alias("th"), F.count("*").alias("n")))
    keys = cut_table(signed.select("sig", F.explode("bands").alias("key")).distinct())

    def strips_of(sigs: DataFrame) -> DataFrame:
        of = cut(sigs.join(reps.drop("n"), "sig").withColumnsRenamed({"doc": "d2", "th": "t2"}))
        some = keep_keys(hashed.select("doc", "th", "h"), of.select(F.col("t2").alias("th")).distinct(), "th").dropDuplicates(["doc", "th"])
        return _strips(some.join(of, same_document("d2", "t2")).select("sig", "h"), shingle)

    found = links(keys, strips_of, similarity, block)
    named = cut(reps.select("sig", "n").join(found, F.col("sig") == F.col("node"), "left").select("sig", "n", F.coalesce("comp", "sig").alias("comp")))
    labelled = cut(join_keys(signed.select("doc", "th", "sig"), named, "sig").select("doc", "th", "comp"))
    best = cut(labelled.groupBy("comp").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th")).alias("best"), F.count("*").alias("n")))
    out = join_keys(labelled, best, "comp").select("doc", "th", F.col("best.doc").alias("class_id"), (F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("th") == F.col("best.th"))).alias("kept"))
    return out.unionByName(every.filter("sig IS NULL").select("doc", "th", F.col("doc").alias("class_id"), F.lit(True).alias("kept")))
