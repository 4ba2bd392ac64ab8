"""Removal of long byte strings that occur more than once, by bucket-pointer refinement of suffixes.

Two equal strings of ``length`` bytes contain the same rarest ``GRAM``-byte gram (the one with the smallest hash), so
suffixes fall into initial buckets by that gram:

1. Each text is cut into segments: the runs of string starts that share their rarest gram. A segment is a bucket's
   entry; it carries a 128-bit BLAKE2b digest of all its bytes, by which entries count as equal, and its place.
2. Spark counts entries of each bucket and entries with equal bytes. A bucket with one entry holds nothing repeated; in
   a bucket whose entries are all equal, everything is repeated. Only buckets of differing entries need sorting, and of
   each set of equal entries one is enough.
3. The bytes of those are brought together by bucket and their suffixes refined: start from 8-byte grams, then split
   each bucket by the bucket pointers of the suffixes 8, 16, 32 ... bytes later, which the pass before has refined, until
   ``length`` bytes are compared. Suffixes alone in their bucket drop out.
4. A bucket of over ``MOST_ENTRIES`` different entries is first refined across tasks, by the same rule: equal strings have
   the bucket's gram at one offset, so its suffixes are split by ranges of that offset and by the identifier of the bytes
   that all strings of a range share before and after the gram. Parts that are small enough then go to step 3; larger ones
   are split again by narrower ranges, of one offset and hence of equal strings at last. No part is sorted by one task
   unless it is small, and none is treated otherwise for its size.
5. Repeated starts go back to the entries' places, and each text loses the bytes that they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, cut_table, give_back, join_keys, keep_keys, map_arrow, sized, split_by_keys

LENGTH, GRAM = 400, 128
#: Different entries of a bucket that are sorted in one task, entries brought together in one, and ranges of offsets that a range is split into.
MOST_ENTRIES, TOGETHER, SPLIT = 500, 500, 8
#: What tells entries of different bytes apart.
KIND = ["bucket", "own", "own2"]
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of two."""
    with np.errstate(over="ignore"):
        x = a * K1
        x ^= x >> np.uint64(31)
        x += b * K2
        x ^= x >> np.uint64(29)
        x *= K3
        x ^= x >> np.uint64(32)
    return x


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as integers."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """Fingerprints of the gram (a power of two of bytes) from each place on."""
    h, size = eights(data), 8
    while size < gram:
        h, size = mix(h[:-size], h[size:]), size * 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[:n], x[width - size :][:n])


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(bucket, the two halves of the bytes' digest, first start, last start, whether strings of the segment may equal each other)."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none.astype(bool)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    low = sliding_min(h, width)  # of the string from each start on
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.concatenate((first[1:], [len(low)])) - 1
    if (long := last - first >= width).any():  # periodic text: pieces of at most width starts
        pieces = [np.arange(a, b + 1, width) if cut_ else np.array([a]) for a, b, cut_ in zip(first, last, long, strict=True)]
        first = np.concatenate(pieces)
        last = np.concatenate((first[1:], [len(low)])) - 1
    bucket = low[first]
    own = np.frombuffer(b"".join([digest16(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    again = np.zeros(len(first), bool)
    inner = np.sort(h)
    twice = inner[1:][inner[1:] == inner[:-1]]
    if len(twice):
        for k in np.flatnonzero(np.isin(bucket, twice)):
            again[k] = np.count_nonzero(h[first[k] : last[k] + width] == bucket[k]) > 1
    return bucket.view(np.int64), own[:, 0], own[:, 1], first, last, again


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, whether the string of ``length`` bytes from each of its starts occurs again.

    Suffixes of all texts are refined together. pointer[i] is where the bucket of suffix i begins in suffix order.
    """
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes from each place to the end of its text
    pointer = np.zeros(len(data), np.int64)

    def refine(active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Splits the buckets of active suffixes, which come by bucket and key; returns those still not alone."""
        old = pointer[active]
        outer = np.concatenate(([True], old[1:] != old[:-1]))
        inner = outer | np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(inner)
        where = np.cumsum(inner) - 1
        begin = np.flatnonzero(outer)[np.cumsum(outer) - 1]
        pointer[active] = old + at[where] - begin
        return active[np.diff(np.concatenate((at, [len(active)])))[where] > 1]

    def later(active: np.ndarray, off: int) -> np.ndarray:
        """Refines by the pointers of the suffixes ``off`` bytes later; a pointer takes less than 31 bits."""
        key = pointer[active + off]
        by = np.argsort(pointer[active] << 31 | key)
        return refine(active[by], key[by])

    if not len(data) >= 8:
        return [np.zeros(0, bool) for _ in texts]
    active = np.flatnonzero(left >= 8)
    grams = eights(data)[active].view(np.int64)
    by = np.argsort(grams)
    active = refine(active[by], grams[by])
    size = 8
    while size * 2 <= length:
        active = later(active[left[active] >= size * 2], size)
        size *= 2
    starts = active[left[active] >= length]
    if size < length:
        starts = later(starts, length - size)
    found = np.zeros(len(data), bool)
    found[starts] = True
    return [found[e - s : e - length + 1] if s >= length else np.zeros(0, bool) for e, s in zip(ends, sizes, strict=True)]


def runs(flags: np.ndarray, length: int = LENGTH) -> list[int]:
    """First and last start of each run of flags, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


def merged(runs: list[int], reach: int = 1) -> list[int]:
    """First and last start of each run, in turn and in order, of runs of which one may begin up to ``reach`` after another's last start or lie in it."""
    out: list[int] = []
    for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and a <= out[-1] + reach:
            out[-1] = max(out[-1], b)
        else:
            out += a, b
    return out


def _entries(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [segments(t.as_py() or b"", length, gram) for t in batch.column(2)]
            n = [len(g[0]) for g in got]
            at = pa.array(np.repeat(np.arange(len(n)), n))
            cols = [np.concatenate([g[k] for g in got]) for k in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:5]), pa.array(cols[5])],
                names=["doc", "th", *KIND, "lo", "hi", "again"],
            )

    return map_arrow(docs, run, f"doc {docs.schema['doc'].dataType.simpleString()}, th long, bucket long, own long, own2 long, lo int, hi int, again boolean")


def _bytes_of(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(bucket, own, own2, n, bytes) of entries given by (doc, th, lo, hi)."""
    wanted = places.groupBy("doc", "th").agg(F.collect_list(F.struct(*KIND, "n", "lo", "hi")).alias("w"))
    some = keep_keys(docs, places.select("th").distinct(), "th").dropDuplicates(["doc", "th"])
    both = some.join(wanted.withColumnsRenamed({"doc": "d2", "th": "t2"}), F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    each = both.select("data", F.explode("w").alias("w"))
    return each.select(*(f"w.{c}" for c in KIND), "w.n", F.expr(f"substring(data, w.lo + 1, w.hi - w.lo + {length})").alias("data"))


def sorted_runs(entries: DataFrame, keys: list[str], by: str, tasks: int, length: int) -> DataFrame:
    """keys, n and runs (first and last starts in turn) of entries (keys, n, data) with repeated starts; those alike in ``by`` meet in a task.

    All strings of an entry with n > 1 are repeated.
    """
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields}

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(pdf["data"].tolist(), length)
        said = [[0, len(f) - 1] if n > 1 else runs(f) for f, n in zip(found, pdf["n"], strict=True)]
        give_back()
        return pdf[[*keys, "n"]].assign(runs=said)[[bool(x) for x in said]]

    dealt = entries.withColumn("task", F.pmod(F.xxhash64(by), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(refine, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "n")) + ", runs array<int>")


def pieces(data: bytes, bucket: int, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(place of the bucket's gram, first start, last start) of runs of starts whose strings have their first such gram there."""
    places = np.flatnonzero(gram_hashes(data, gram).view(np.int64) == bucket)
    out, begin = [], 0
    for p in places.tolist():
        end = min(p, len(data) - length)
        if end >= begin:
            out.append((p, begin, end))
            begin = end + 1
    return out


def _ranges(entries: DataFrame, width: int, within: DataFrame | None, length: int, gram: int) -> DataFrame:
    """(bucket, own, own2, n, part, body, lo, hi): starts of entries whose gram is ``width`` offsets' range away, by what their strings share.

    part is the identifier of the bytes around the gram that all strings of a range share, body that of all their bytes.
    ``within`` has the parts of the ranges before that are still too large; None: all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, o, o2, n, t in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for p, first, last in pieces(t, b, length, gram):
                    for begin in range((p - last) // width * width, p - first + 1, width):
                        lo, hi = max(first, p - begin - width + 1), min(last, p - begin)
                        shared = t[p - begin : p - min(begin + width - 1, length - gram) + length]
                        before = begin // (width * SPLIT) * width * SPLIT  # of the range before
                        wide = t[p - before : p - min(before + width * SPLIT - 1, length - gram) + length]
                        body = digest16(t[lo : hi + length] + (p - lo).to_bytes(4, "little"))
                        out.append((b, o, o2, n, _part(b, width, begin, shared), _part(b, width * SPLIT, before, wide), body, lo, hi))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 3 + [pa.int32()] * 2
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[*KIND, "n", "part", "wide", "body", "lo", "hi"])

    each = map_arrow(entries, run, "bucket long, own long, own2 long, n long, part binary, wide binary, body binary, lo int, hi int")
    if within is not None:
        each = each.join(sized(within.withColumnRenamed("part", "wide")), "wide", "left_semi")
    return each.drop("wide")


def _part(bucket: int, width: int, begin: int, shared: bytes) -> bytes:
    return digest16(f"{bucket} {width} {begin} ".encode() + shared)


def split_refined(entries: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(bucket, own, own2, n, runs) as sorted_runs(), for buckets of any number of entries: by ranges of the gram's offset, narrower and narrower.

    An entry with n > 1 is repeated whole, so what its ranges come to isn't brought back to it; the runs found in the ranges of any
    other entry become one row.
    """
    width = 1
    while width * SPLIT < length - gram + 1:
        width *= SPLIT
    within, out = None, []
    while width:
        each = cut_table(_ranges(entries, width, within, length, gram))
        kinds = cut_table(each.groupBy("part", "body").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("rows"), *(F.first(c).alias(c) for c in (*KIND, "lo", "hi"))))
        of = cut(kinds.groupBy("part").agg(F.sum("n").alias("times"), F.sum("rows").alias("rows"), F.count("*").alias("kinds")).filter("times > 1"))
        once = each.filter("n = 1")
        alike = join_keys(once, of.filter("kinds = 1").select("part", "rows"), "part", "rows")
        out.append(alike.select(*KIND, F.array("lo", "hi").alias("runs")))
        small = of.filter((F.col("kinds") > 1) & (F.col("kinds") <= most))
        tasks = (small.agg(F.sum("kinds")).first()[0] or 0) // TOGETHER + 1
        few = kinds.join(small.select("part"), "part").join(entries.select(*KIND, "data"), KIND)
        few = few.select("part", "body", "n", F.expr(f"substring(data, lo + 1, hi - lo + {length})").alias("data"))
        marks = cut(sorted_runs(few, ["part", "body"], "part", tasks, length).drop("n").join(kinds.select("part", "body", "rows"), ["part", "body"]))
        again = join_keys(once, marks, ["part", "body"], "rows")
        out.append(again.select(*KIND, F.transform("runs", lambda x: x + F.col("lo")).alias("runs")))
        within = cut(of.filter(F.col("kinds") > most).select("part"))
        if within.isEmpty():
            break
        width //= SPLIT

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pa.array([merged(r) for r in batch.column(3).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], runs], names=[*KIND, "runs"])

    found = reduce(DataFrame.unionByName, out).groupBy(*KIND).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    parts = map_arrow(found, one, "bucket long, own long, own2 long, runs array<int>").withColumn("n", F.lit(1).cast("long"))
    return parts.unionByName(entries.filter("n > 1").select(*KIND, "n", F.array(F.lit(0), F.length("data") - length).alias("runs")))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_ENTRIES) -> DataFrame:
    """(doc, th, runs): starts, in documents (doc, th, data), of strings that also start somewhere else; a row for each segment that has some, with the first and last of each run in turn."""
    entries = cut_table(_entries(docs, length, gram))
    ends = [f(c).alias(f"{name}_{c}") for c in ("own", "own2") for name, f in (("least", F.min), ("last", F.max))]
    full = entries.groupBy("bucket").agg(F.count("*").alias("n"), *ends, F.max("again").alias("any"))
    several = cut(full.filter("n > 1 OR any").select("bucket", "n", F.expr("least_own <> last_own OR least_own2 <> last_own2 OR any").alias("mixed")))
    hits = cut_table(join_keys(entries, several, "bucket").select("doc", "th", *KIND, "lo", "hi", "mixed"))
    mixed = hits.filter("mixed")
    # entries with equal bytes: any of them will do
    kinds = cut(mixed.groupBy(*KIND).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "th", "lo", "hi"))))
    tasks = kinds.count() // TOGETHER + 1
    large = cut(kinds.groupBy("bucket").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > most).select("bucket"))
    some = large.isEmpty()
    marks = sorted_runs(_bytes_of(docs, kinds if some else kinds.join(large, "bucket", "left_anti"), length), KIND, "bucket", tasks, length)
    if not some:
        marks = marks.unionByName(split_refined(cut_table(_bytes_of(docs, kinds.join(large, "bucket", "left_semi"), length)), length, gram, most))
    hit = join_keys(mixed, cut(marks), KIND)
    part = hit.select("doc", "th", F.transform("runs", lambda x: x + F.col("lo")).alias("runs"))
    return hits.filter("NOT mixed").select("doc", "th", F.array("lo", "hi").alias("runs")).unionByName(part)


def remove(df: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST_ENTRIES) -> DataFrame:
    """One row for each row: (doc, data, spans, kept), where spans are the removed byte ranges [begin, end) of the text's UTF-8 and kept is the rest.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another
    row's. A null text counts as empty; texts shorter than ``length`` lose nothing; of repeated rows each loses all of
    a text that is long enough. Rows with the same id are told apart by their text.
    """
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    docs = df.select(F.col(doc).alias("doc"), F.xxhash64(data).alias("th"), data.alias("data"))
    found = repeats(docs, length, gram, most)
    marks = found.groupBy("doc", "th").agg(F.flatten(F.collect_list("runs")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for each in batch.column(2).to_pylist():
                starts = merged(each, length)
                out.append([{"begin": a, "end": b + length} for a, b in zip(starts[::2], starts[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], names=["d2", "t2", "spans"])

    kind = docs.schema["doc"].dataType.simpleString()
    spans = cut(map_arrow(marks, run, f"d2 {kind}, t2 long, spans array<struct<begin:int,end:int>>"))
    none = F.array().cast(spans.schema["spans"].dataType)
    hit, rest = split_by_keys(docs, spans.select(F.col("t2").alias("th")).distinct(), "th")
    joined = hit.join(spans, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left").select("doc", "data", F.coalesce("spans", none).alias("spans"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for whole, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                edges = [0, *(x for s in gone for x in (s["begin"], s["end"])), None]
                view = memoryview(whole.as_buffer())
                kept.append(b"".join([view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=["doc", "data", "spans", "kept"])

    joined = map_arrow(joined, cut_out, f"doc {kind}, data binary, spans array<struct<begin:int,end:int>>, kept binary")
    return joined if rest is None else joined.unionByName(rest.select("doc", "data", none.alias("spans"), F.col("data").alias("kept")))


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text of what remove() returns; in kept_text bytes of a character cut in two are U+FFFD."""
    size, left = F.length("data").cast("long"), F.length("kept").cast("long")
    return removed.select(
        F.col("doc").alias("doc_id"), size.alias("n_bytes"), (size - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, digest of the rest) of each text, by a table of all its strings; for tests."""
    times: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            times[t[k : k + length]] = times.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                gone[k : k + length] = True
        rest = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum() + 0), hashlib.sha256(rest).hexdigest()))
    return out
