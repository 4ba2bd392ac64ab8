import random

import pytest
from helpers import classes

from tessera.llm.common import components, join_keys


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 200)] + [(5, 5), (7, 8), (7, 8)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = classes({x for e in edges for x in e}, edges)
    alone = {k for k in want if all(a == b for a, b in edges if k in (a, b))}
    assert sorted((r.node, r.comp) for r in got) == sorted((k, c) for k, c in want.items() if k not in alone)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(3000)], "k int, v int")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("k < 5").selectExpr("k", "n", "k * 2 AS x")
    got = join_keys(rows, keyed, "k").collect()
    assert sorted((r.k, r.v, r.x) for r in got) == sorted((r.k, r.v, r.k * 2) for r in rows.collect() if r.k < 5)
    assert join_keys(rows.limit(0), keyed.limit(0), "k").count() == 0
