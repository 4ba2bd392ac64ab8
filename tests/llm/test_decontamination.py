import pytest
from helpers import shingles, similarity, texts, words

from tessera.llm import decontamination
from tessera.llm.queries import op3_decontamination


def brute(rows, items):
    """For each document, the best similarity of any item-sized window to each item, where 0.8 or more."""
    own = [(i, words(t)) for i, t in items]
    out = {}
    for d, t in rows:
        w, found = words(t), {}
        for i, iw in own:
            if not iw:
                continue
            want, n = shingles(iw), min(5, len(iw))
            if sum((shingles(w, n) & want).values()) * 2 < sum(want.values()):
                continue
            best = max((similarity(shingles(w[s : s + len(iw)], n), want) for s in range(max(1, len(w) - len(iw) + 1))), default=0)
            if best >= 0.8:
                found[i] = best
        out[d] = found
    return out


def test_whole_table(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute(texts(spark, small), items)
    rows = op3_decontamination(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d in want if want[d]) and rows
    for r in rows:
        assert r.n_items == len(want[r.doc_id])
        assert r.best_similarity == pytest.approx(max(want[r.doc_id].values(), default=0))


def test_edited_passages(spark):
    item = [f"w{k}" for k in range(60)]
    edited = {
        1: item,
        2: [*item[:30], "new", *item[31:]],  # one word replaced in the middle
        3: item[4:],  # cut at the start
        4: [*item[:28], "in", *item[28:]],  # one word more
        5: item[:35],  # too little of it
        6: [x for k, x in enumerate(item) if k % 6],  # every sixth word gone
    }
    rows = [(d, " ".join(["before it"] * 9 + e + ["after it"] * 9)) for d, e in edited.items()] + [(7, None), (8, ""), (None, " ".join(item)), (9, "A B"), (9, "A B")]
    items = [(1, " ".join(item)), (2, ""), (3, None), (4, "a b"), (None, "before it before it before it")]
    want = brute(rows, [x for x in items if x[0] is not None])
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_items", "'x' AS th"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_items, r.best_similarity) == (len(want[r.doc_id]), pytest.approx(max(want[r.doc_id].values(), default=0))), r
    assert want[1] and want[2] and want[3] and not want[5] and not want[6] and want[9]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontamination.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(rows) and none.filter("contaminated").count() == 0


def test_a_shingle_of_one_item_finds_the_others(spark):
    """Items of one size that begin alike: each is found wherever any of their shingles stands."""
    items = [(k, " ".join(["how", "many", "of", "these", "are", "there", *(f"i{k}w{j}" for j in range(30))])) for k in range(50)]
    rows = [(1, "x " * 7 + items[3][1] + " y" * 9), (2, items[7][1].replace("how many", "how few")), (3, "how many of these are there " * 400), (4, " ".join(items[k][1] for k in range(20, 40)))]
    want = brute(rows, items)
    got = {r.doc_id: r for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d: (r.n_items, r.best_item) for d, r in got.items()} == {d: (len(w), min(w, key=lambda i: (-w[i], i)) if w else None) for d, w in want.items()}
    assert set(want[1]) == {3} and set(want[2]) == {7} and not want[3] and len(want[4]) == 20


def test_very_long_text(spark):
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "some other words here now " * 60000 + item + " some other words here now" * 60000), (2, "w1 w2 w3 w4 w5 " * 30000)]
    got = {r.doc_id: r for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (got[1].n_items, got[1].best_item, got[1].best_similarity) == (1, 7, 1.0) and not got[2].contaminated


def test_all_fingerprints_within_the_radius(spark):
    import random

    rng = random.Random(3)
    items = [rng.getrandbits(64) - (1 << 63) for _ in range(20)]
    windows, want = [], set()
    for n in range(400):
        i = rng.randrange(20)
        flip = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 40)))
        code = ((items[i] & (2**64 - 1)) ^ flip) & (2**64 - 1)
        windows.append((n, 5, code - (1 << 64) if code >> 63 else code))
    for n, _, c in windows:
        want |= {(n, k) for k, x in enumerate(items) if ((c ^ x) & (2**64 - 1)).bit_count() <= decontamination.RADIUS}
    found = decontamination.within_radius(spark.createDataFrame(windows, "w int, size int, fp long"), spark.createDataFrame([(k, 5, x) for k, x in enumerate(items)], "item int, size int, ifp long")).collect()
    assert sorted((r.w, r.item) for r in found) == sorted(want)


def test_native(spark, small):
    plan = op3_decontamination(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
