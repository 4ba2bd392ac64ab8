import random
from collections import Counter

import numpy as np
import pytest
from helpers import texts

from tessera.llm import suffix_dedup
from tessera.llm.queries import op10_suffix_dedup


def result(df):
    return Counter(tuple(r)[:5] for r in df.collect())


def wanted(rows, length=400):
    found = suffix_dedup.brute_force([(t or "").encode() for _, t in rows], length)
    return Counter((d, *x) for (d, _), x in zip(rows, found, strict=True))


def test_whole_table(spark, small):
    assert result(op10_suffix_dedup(spark, small)) == wanted(texts(spark, small))


@pytest.mark.parametrize("most", [1, 3, 4000])
def test_edges(spark, most):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefg ") for _ in range(900))
    rows = [(1, None), (2, ""), (3, "a" * 1500), (4, "abc" * 300), (5, "x" + "abc" * 200), (6, base[100:700] + "Z" + base[:420]), (6, base), (6, base), (None, "q" * 399), (None, base[:400]), (7, base[:399]), (8, "é" * 700), (9, base[300:]), (10, "".join(rng.choice("xyz") for _ in range(3000)))]
    rows += [(20 + k, "".join(rng.choice("0123456789") for _ in range(500)) + base[200:650] + "".join(rng.choice("0123456789") for _ in range(300))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS data")
    assert result(suffix_dedup.digest(suffix_dedup.remove(df, most=most))) == wanted(rows)
    assert suffix_dedup.remove(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_other_lengths(spark, seed):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 300)))) for k in range(40)]
    rows += [(50 + k, rows[k][1][20:120]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffix_dedup.digest(suffix_dedup.remove(df, length=40, gram=16))) == wanted(rows, 40)


@pytest.mark.parametrize(("length", "gram", "size", "step"), [(40, 16, 300, 1), (400, 128, 1500, 9)])
def test_texts_that_differ_in_one_byte(spark, length, gram, size, step):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(size))
    rows = [(k, base[:k] + "X" + base[k + 1 :]) for k in range(0, size, step)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffix_dedup.digest(suffix_dedup.remove(df, length=length, gram=gram))) == wanted(rows, length)


def test_refinement_is_a_count_of_strings():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 99, rng.integers(0, 90), dtype=np.uint8)) for _ in range(60)]
    found = suffix_dedup.repeated_starts(parts, 20)
    times = Counter(p[k : k + 20] for p in parts for k in range(len(p) - 19))
    for p, f in zip(parts, found, strict=True):
        assert f.tolist() == [times[p[k : k + 20]] > 1 for k in range(len(p) - 19)]


@pytest.mark.parametrize(("length", "gram", "size"), [(40, 16, 130), (400, 128, 1100)])
def test_large_buckets(spark, length, gram, size):
    """One passage in many contexts, periodic ones too: buckets of many different entries, split again and again."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(length * 3 // 4))
    around = ["".join(rng.choice("xyz") for _ in range(size)) for _ in range(4)] + ["pq" * size]
    rows = []
    for k in range(60):
        a, b = rng.choice(around), rng.choice(around)
        rows.append((k, a[: rng.randrange(size)] + str(k % 7) * rng.randrange(3) + passage + b[rng.randrange(size) :]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 5):
        assert result(suffix_dedup.digest(suffix_dedup.remove(df, length=length, gram=gram, most=most))) == wanted(rows, length)


@pytest.mark.parametrize("copies", [1, 4])
def test_near_copies_get_a_row_for_each_segment(spark, copies):
    """However often a bucket is split, what is found goes back to its entries once."""
    rng = random.Random(11)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    each = [base[:at] + "XY" + base[at + 2 :] for at in (rng.randrange(1400) for _ in range(40))]
    rows = [(k, each[k // copies]) for k in range(40 * copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.selectExpr("doc_id AS doc", "xxhash64(encode(text, 'UTF-8')) AS th", "encode(text, 'UTF-8') AS data")
    n = sum(len(suffix_dedup.segments(t.encode())[0]) for _, t in rows)
    assert 0 < suffix_dedup.repeats(docs, most=2).count() <= n
    assert result(suffix_dedup.digest(suffix_dedup.remove(df, most=2))) == wanted(rows)


def test_very_long_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = " ".join(word() for _ in range(40000))
    rows = [(1, base), (2, base[5000:60000] + " ".join(word() for _ in range(20000))), (3, base[:300000:2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(suffix_dedup.remove(df)).collect()}
    assert got == {1: (len(base), 55000, 1), 2: (len(rows[1][1]), 55000, 1), 3: (150000, 0, 0)}


def test_kept_text(spark):
    rows = [(1, "é" * 500), (2, None), (3, "plain"), (4, "ab" + "é" * 300 + "cd")]
    got = {r.doc_id: r.kept_text for r in suffix_dedup.digest(suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "plain" and got[4] == "abcd"


def test_planted_passages(spark):
    """Passages of over 50 words in three documents each: those of 400 bytes or more go whole, shorter ones and other documents stay."""
    rng = random.Random(3)
    words = lambda n, least, most: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most))) for _ in range(n))
    rows, size = [(k, words(200, 2, 9)) for k in range(60)], {}
    for k in range(0, 36, 3):
        passage = words(rng.randint(51, 70), *((7, 11) if k % 2 else (2, 6)))
        for j in range(k, k + 3):
            at = rng.randrange(1000)
            rows[j], size[j] = (j, f"{rows[j][1][:at]} {passage} {rows[j][1][at:]}"), len(passage)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = suffix_dedup.digest(suffix_dedup.remove(df)).cache()
    assert result(done) == wanted(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in done.collect()}
    assert {j for j in got if got[j][1]} == {j for j in size if size[j] >= 400} and {s >= 400 for s in size.values()} == {True, False}
    assert all(got[j][1] >= size[j] for j in size if size[j] >= 400) and all(got[j][0] == len(t) for j, t in rows)
