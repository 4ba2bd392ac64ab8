import hashlib

import corpus_pipeline
import plain
from helpers import shingles, similarity, texts, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.session import scratch


def test_stages(spark, small):
    """Each stage against a plain reading of it, on what the one before it kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = scratch(spark)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == columns
    before, after = (dict(x.select("doc_id", "text").collect()) for x in kept["language_id"])
    assert before == after  # all clean texts stay
    before, after = (dict(x.select("doc_id", "text").collect()) for x in kept["minhash_dedup"])
    own = {d: shingles(words(t)) for d, t in after.items()}
    for d, t in before.items():
        if d not in after:
            assert any(similarity(shingles(words(t)), s) > 0.3 for s in own.values())
    items = [shingles(words(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, after = (dict(x.select("doc_id", "text").collect()) for x in kept["decontamination"])
    gone = set(before) - set(after)
    for d, t in before.items():
        share = max(sum((shingles(words(t)) & i).values()) / sum(i.values()) for i in items)
        assert share > 0.8 if d in gone else share < 1
    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.limit(40).collect():
        ids = t.encode(after[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_plain_stages(spark, small):
    """run() against the same stages in plain Python."""
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = plain.without_items(plain.near_duplicates(plain.lines(plain.languages(rows))), items)
    want = plain.tokens(left, Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")))
    got = [(r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.token_ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(rows)


def test_rejects_and_keeps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bad = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", 0), (9003, "ខ្មែរ ភាសា", None, None, None)], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.languages(spark, docs.unionByName(bad), small).select("doc_id").collect()} == {d for d, _ in texts(spark, small)}
    twice = docs.unionByName(docs.limit(20))
    left = corpus_pipeline.near_duplicates(spark, twice, small)
    assert left.count() == left.select("doc_id").distinct().count() == corpus_pipeline.near_duplicates(spark, docs, small).count()


def test_run_and_empty(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and out.filter(F.col("n_tokens") * 4 != F.length("token_ids")).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
