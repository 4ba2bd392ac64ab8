import hashlib

import numpy as np
import public_tokenizers
import pytest
from helpers import texts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe_automaton
from tessera.llm.queries import op9_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def both(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False), len(ids)


def test_whole_table(spark, small, library):
    rows = {r.doc_id: r for r in op9_bpe(spark, small).collect()}
    for d, t in texts(spark, small):
        ids, decoded, n = both(library, t)
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "a", "ΑΣ ΟΔΟΣ.", "<|endoftext|> hi<|startoftext|><|x|>", "it's I'LL don't 'S", "aaaa aaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaa", "x\x1cy z\x85w v", "日本語テキスト 123٣½", "é é İstanbul ǅ ﬁ", "👍🏽 ok", "a" * 5000, "​﻿", "co­op"])
def test_as_the_library(library, text):
    c = bpe_automaton.codec(PATH)
    assert c.encode(text) == both(library, text)
    assert c.decode(c.encode(text)[0]) == c.encode(text)[1]


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(text=st.text(st.characters(codec="utf-8", exclude_categories=["Cn"]), max_size=40))
def test_any_text(library, text):
    assert bpe_automaton.codec(PATH).encode(text) == both(library, text)


def test_arcs_are_the_merges_own():
    """Of a small merge list, the paths that the automaton accepts are just what merging in order gives."""
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b"), ("ab", "ab")]
    names = ["a", "b", *("".join(m) for m in merges)]
    ids = {n: k for k, n in enumerate(names)}
    auto = bpe_automaton.Automaton(len(names), [(ids[a], ids[b], ids[a + b]) for a, b in merges])

    def merged(word):
        parts = list(word)
        for a, b in merges:
            out = []
            while parts:
                if parts[:2] == [a, b]:
                    out.append(a + b)
                    parts = parts[2:]
                else:
                    out.append(parts.pop(0))
            parts = out
        return parts

    def paths(word, last=None):
        if not word:
            return [[]]
        return [[n, *p] for n in names if word.startswith(n) and auto.made[ids[n]] and (last is None or auto.fill({}, ids[last], ids[n]) >= 0) for p in paths(word[len(n) :], n)]

    for size in range(1, 9):
        for k in range(1 << size):
            word = "".join("ab"[k >> b & 1] for b in range(size))
            assert paths(word) == [merged(word)]


def test_edges(spark, library):
    df = spark.createDataFrame([(1, None), (1, None), (None, "hi"), (2, "long " * 30000)], "doc_id long, text string").selectExpr("*", "'x' AS ids_sha256")
    got = bpe_automaton.encode_decode(df, "text", ["doc_id"], PATH, lambda ids, said, n: (n, said), "n long, said string").collect()
    assert sorted((str(r.doc_id), r.n) for r in got) == [("1", 0), ("1", 0), ("2", 30000), ("None", 1)]
    assert bpe_automaton.encode_decode(df.limit(0), "text", ["doc_id"], PATH, lambda ids, said, n: (n,), "n long").count() == 0
