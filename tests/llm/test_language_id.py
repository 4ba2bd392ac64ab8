import zlib

from helpers import documents

from tessera.llm import language_id
from tessera.llm.queries import op6_language_id


def test_held_out_accuracy(spark, small):
    docs = {r.doc_id: r for r in documents(spark, small).collect()}
    rows = op6_language_id(spark, small).collect()
    assert len(rows) == len(docs)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_whole_table_by_plain_profiles(spark, small):
    """Learning and predictions against plain Python."""
    import plain

    rows = [r.asDict() for r in documents(spark, small).collect()]
    known = plain.profiles(rows)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in op6_language_id(spark, small).collect()}
    want = {r["doc_id"]: plain.language(r["text"], known) for r in rows}
    assert got == {d: (lang, round(score, 9)) for d, (lang, score) in want.items()}


def brute_distance(text, profiles, lang):
    from collections import Counter

    flat = "".join(c if c.isalpha() else " " for c in text.lower())
    flat = f" {' '.join(flat.split())} "
    grams = Counter(c for c in flat if c != " ")
    for n in (2, 3):
        grams.update(flat[k : k + n] for k in range(len(flat) - n + 1))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    own = sorted(grams, key=lambda g: (-grams[g], code(g)))[:300]
    k = profiles.languages.index(lang)
    place = {int(c): int(p) for c, p in zip(profiles.codes, profiles.places[:, k], strict=False) if p < 300}
    return 1 - sum(abs(place[code(g)] - n) if code(g) in place else 300 for n, g in enumerate(own)) / (300 * len(own))


def test_distance_is_out_of_place(spark, small):
    profiles = language_id.learn(documents(spark, small))
    for r in documents(spark, small).limit(15).collect():
        lang, score = profiles.predict(r.text)
        assert abs(score - brute_distance(r.text, profiles, lang)) < 1e-9
        assert score >= max(brute_distance(r.text, profiles, x) for x in profiles.languages) - 1e-9


def test_languages_of_copies_are_learned(spark):
    langs = [f"l{k:02}" for k in range(20)]
    rows = [(n, f"{chr(97 + k)}{chr(98 + k)} {chr(99 + k)}", lang) for k, lang in enumerate(langs) for n in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.learn(df, texts=5).languages == langs


def test_edges(spark):
    rows = [(1, None, "xx"), (2, "", "xx"), (3, "123 !?", "xx"), (None, "aa bb aa", "xx"), (5, "cc dd cc", "yy"), (5, "cc dd cc", "yy"), (6, "Ab " * 50000, None), (7, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'z' AS lang_pred")
    profiles = language_id.learn(df)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.identify(df, profiles, ["doc_id"]).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (None, "xx", True), (5, "yy", True), (6, "xx", True)} <= got
    assert profiles.predict("zzz")[0] == "xx"  # a tie goes to the first
    nothing = language_id.learn(df.limit(0))
    assert nothing.predict("abc") == ("und", 0.0) and language_id.identify(df.limit(0), nothing, ["doc_id"]).count() == 0
