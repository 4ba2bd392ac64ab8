from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import classes, documents, shingles, similarity, words

from tessera.llm import minhash_dedup
from tessera.llm.queries import op8_minhash_dedup


def weights(text):
    return Counter({g: c.bit_length() for g, c in shingles(words(text)).items()})


def brute(rows):
    sets = [weights(t) for _, t in rows]
    holds = defaultdict(list)
    links = set()
    for k, s in enumerate(sets):
        for j in {j for g in s for j in holds[g]}:
            if min(sum(s.values()), sum(sets[j].values())) >= 0.8 * max(sum(s.values()), sum(sets[j].values())) and similarity(s, sets[j]) >= 0.8:
                links.add((j, k))
        for g in s:
            holds[g].append(k)
    comp = classes(range(len(rows)), links)
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return {rows[k][0]: least[c] for k, c in comp.items()}


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in documents(spark, small).collect()]
    got = op8_minhash_dedup(spark, small).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


@pytest.mark.parametrize("block", [512, 12])
def test_large_group_in_blocks(spark, block):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for n in range(150):
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            w[at] = f"x{n}y{at}"
        rows.append((n, " ".join(w)))
    got = minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = brute(rows)
    assert sum(want[r.doc] == r.class_id for r in got) >= 0.98 * len(rows)
    assert all(want[r.class_id] == want[r.doc] for r in got)  # never more than the links join


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**62, (40, 1100)).astype(np.uint64)
    agree = np.mean([(minhash_dedup.signature(np.sort(r[:1000])) == minhash_dedup.signature(np.sort(r[100:]))).mean() for r in x])
    assert abs(agree - 900 / 1100) < 0.02
    weighted = minhash_dedup.elements(np.array([1, 2, 3, 4, 5] * 9, np.int64))
    assert len(weighted) == sum(c.bit_length() for c in Counter(tuple(([1, 2, 3, 4, 5] * 9)[i : i + 5]) for i in range(41)).values())


def test_weights_that_are_no_whole_numbers():
    """Elements of real weights: signatures agree as often as the sums of smaller and larger weights have it."""
    rng = np.random.default_rng(4)
    agree, want = [], []
    for _ in range(60):
        ids = np.sort(rng.integers(1, 2**62, 300).astype(np.uint64))
        a, b = rng.uniform(0.05, 1, 300), rng.uniform(0.05, 1, 300)
        agree.append((minhash_dedup.signature(ids, widths=a) == minhash_dedup.signature(ids, widths=b)).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.03
    ids = np.sort(rng.integers(1, 2**62, 50).astype(np.uint64))
    assert (minhash_dedup.signature(ids) == minhash_dedup.signature(ids, widths=np.ones(50))).all()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (None, "a b"), (5, "x"), (5, "x"), (6, "!!"), (7, "again and " * 30000)]
    got = sorted((str(r.doc), str(r.class_id), r.kept) for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sig", "2 AS h")).collect())
    assert got == sorted([("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "3", False), ("None", "3", False), ("5", "5", True), ("5", "5", True), ("6", "6", True), ("7", "7", True)])
    assert minhash_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_phrase_repeated_is_not_a_copy(spark):
    rows = [(k, " ".join(f"a{k}b{j}" for j in range(60)) + " is so" * 300) for k in range(5)]
    assert minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").count() == 5
