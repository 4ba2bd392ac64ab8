import numpy as np
import pytest

from tessera.llm import embedding_dedup
from tessera.llm.queries import op5_embedding_dedup


def brute(vectors):
    from helpers import classes

    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [i for i, _ in vectors]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if near[a, b]]
    comp = classes(range(len(ids)), pairs)
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, ids[k]), ids[k])
    return {ids[k]: (int(near[k].sum()) - 1, least[comp[k]]) for k in range(len(ids))}


def clusters(seed, n=40, most=12, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        c = rng.normal(size=d)
        rows += [list(map(float, c + rng.normal(size=d) * rng.uniform(0.02, 0.2))) for _ in range(rng.integers(1, most))]
    rows += rows[:7]  # equal vectors
    return [(k, v) for k, v in enumerate(rows)]


def test_recall_against_brute_force(spark):
    vectors = clusters(1)
    want = brute(vectors)
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == set(want)
    assert all(got[k].n_links <= want[k][0] for k in want)  # no link below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(got[k].component_id == want[k][1] for k in want) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("mean", [1.0, 3.0])
def test_recall_with_a_common_mean(spark, monkeypatch, mean):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(150):
        x = rng.normal(size=64) + mean
        step = rng.normal(size=64)
        step -= (step @ x) / (x @ x) * x
        vectors += [x, 0.96 * x + 0.28 * np.linalg.norm(x) / np.linalg.norm(step) * step]  # of cosine 0.96
    vectors = [(k, list(map(float, v))) for k, v in enumerate(vectors)]
    want = brute(vectors)
    monkeypatch.setattr(embedding_dedup, "TILE", 70, raising=False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_whole_table(spark, small):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute(vectors)
    assert {r.vec_id: (r.n_links, r.component_id) for r in op5_embedding_dedup(spark, small).collect()} == want


def test_each_length_is_searched(spark):
    parts = [clusters(4, n=12, d=64), clusters(5, n=4, d=48), clusters(6, n=2, d=32)]
    vectors, want = [], {}
    for k, part in enumerate(parts):
        part = [(1000 * k + n, v) for n, v in part]
        vectors += part
        want |= brute(part)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == set(want) and sum(n for k, (n, _) in want.items() if k >= 1000) > 20
    assert {k: x for k, x in got.items() if k >= 1000} == {k: x for k, x in want.items() if k >= 1000}
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_edges(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, -1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS v")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect())
    alone = [(str(k), 0, k, True) for k in (1, 2, 3, 4, 5, 9, 10)]
    assert got == sorted([*alone, ("6", 3, 6, True), ("6", 3, 6, True), ("None", 3, 6, False), ("8", 3, 6, False)])
    far = spark.createDataFrame([(1, [1e-200, 0.0]), (2, [1e200, 1e198]), (3, [0.0, 1e-300])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.link(far).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding_dedup.link(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept


@pytest.mark.parametrize(("width", "blocks"), [(16, 4), (12, 7)])
def test_tables_find_all_that_agree_in_a_block(spark, width, blocks):
    rng = np.random.default_rng(5)
    tables = embedding_dedup.Tables(width, blocks)
    base = rng.integers(0, 2, (30, width * blocks))
    codes = [base[n % 30] ^ (rng.random(width * blocks) < rng.uniform(0, 0.25)) for n in range(240)]
    want = set()
    for a, x in enumerate(codes):
        for b, y in enumerate(codes):
            diff = (x ^ y).reshape(blocks, width).sum(axis=1)
            if a < b and diff.sum() <= tables.radius and diff.min() <= 1:
                want.add((a, b))
            assert not (a < b and diff.sum() <= 2 * blocks - 1) or (a, b) in want  # complete to that radius
    unit = spark.createDataFrame([(n, [float(b) for b in c]) for n, c in enumerate(codes)], "node long, v array<double>")
    coded = embedding_dedup.codes(unit, np.full(width * blocks, 0.5), np.eye(width * blocks), tables)
    found = [(r.a, r.b) for r in embedding_dedup.candidates(coded, tables).collect()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("rank", [12, 64])
def test_recall_of_pairs_at_the_threshold(spark, rank):
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(rank, 64))
    vectors = []
    for _ in range(400):
        x, step = rng.normal(size=rank) @ basis, rng.normal(size=rank) @ basis
        x /= np.linalg.norm(x)
        step -= (step @ x) * x
        vectors += [x, 0.951 * x + np.sqrt(1 - 0.951**2) * step / np.linalg.norm(step)]
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    linked = {r.vec_id: r.n_links for r in embedding_dedup.link(df).collect()}
    assert sum(linked[2 * k] > 0 for k in range(400)) >= 0.95 * 400


def test_candidates_grow_with_the_vectors():
    """The share of unlike pairs that a table retrieves falls as their number grows."""
    rng = np.random.default_rng(2)
    made = []
    for n in (2000, 8000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre, projection, tables = embedding_dedup.fitted(x[:2000], n)
        code = ((x - centre) @ projection >= 0).reshape(n, tables.blocks, tables.width)[:, 0]
        counts = np.unique(code @ (1 << np.arange(tables.width)), return_counts=True)[1]
        made.append((counts**2).sum() / n)
    assert made[1] < 1.5 * made[0]
