from helpers import texts, words

from tessera.llm import license_scan
from tessera.llm.queries import op1_license_scan

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
NOTICE = "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and associated files"


def brute(text):
    w, starts, labels = words(text), [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_whole_table(spark, small):
    rows = op1_license_scan(spark, small).collect()
    want = {d: brute(t) for d, t in texts(spark, small)}
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, f"foo {NOTICE} bar MIT License mit-license!"), (3, "x"), (3, "x"), (None, "Apache Licénse apache\nlicense"), (4, "mit " * 5 + "license license"), (5, "The Apache License. " * 300)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS t", "'y' AS n_words", "1 AS w")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for d, t in rows if d == r.doc_id and len(words(t)) == r.n_words)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
    third = next(r for r in got if r.doc_id == 3 and r.n_words > 1)
    notice = [s for s in third.spans if not s.base]
    assert notice[0].label == "mit" and notice[0].start == 1 and 0.9 < notice[0].coverage < 1
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


APACHE = "you may not use this file except in compliance with the license you may obtain a copy of the license at"


def common(a, b):
    """The longest common subsequence, for brute force."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_notices_stand_in_order(spark):
    w = APACHE.split()
    rng = __import__("random").Random(5)
    texts = {
        1: APACHE,
        2: "a copy of the license at obtain compliance with except in the license you may obtain",  # its words, not in order
        3: " ".join(w[10:] + w[:10]),
        4: " ".join(x for k, x in enumerate(w) if k not in (5, 15)),
        5: " ".join([*w[:9], "all", "of", *w[9:]]),
        6: " ".join("other" if k in (4, 9) else x for k, x in enumerate(w)),
        7: " ".join("other" if k % 3 == 1 else x for k, x in enumerate(w)),
        8: f"{APACHE} {APACHE} and {APACHE}",
        9: " ".join(rng.sample(w, len(w))),
        10: " x ".join(w),
        11: " ".join(["license you may obtain"] * 4000),
    }
    rows = [(k, f"before this {t} after that") for k, t in texts.items()]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, r in got.items():
        found = [s for s in r.spans if s.label == "apache"]
        own = dict(rows)[k].split()
        assert bool(found) == (k in (1, 4, 5, 6, 8)), k
        for s in found:
            assert s.coverage == common(own[s.start : s.end], w) / len(w) and s.end - s.start <= 1.25 * len(w)
    assert (got[1].spans[0].start, got[1].spans[0].end, got[1].score) == (2, 2 + len(w), 1.0)
    assert [s.start for s in got[8].spans] == [2, 2 + len(w), 3 + 2 * len(w)]


def test_very_long_text(spark):
    rows = [(1, "mit license " * 60000 + "general public license")]
    r = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (120003, 60001, 0, 120000, "gpl,mit")


def test_repeated_rows_with_phrases(spark):
    text = f"The MIT License, GNU General Public License. {NOTICE} 2 clause BSD"
    want = license_scan.scan(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (want.n_base, want.base_labels, want.labels) == (2, "gpl,mit", "bsd,gpl,mit")
    for copies in (2, 3):
        rows = [(3, text)] * copies + [(None, "general public x")] * copies
        got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r for r in got if r.doc_id == 3] == [want] * copies
        assert [r.n_base for r in got if r.doc_id is None] == [0] * copies


def test_native(spark, small):
    plan = op1_license_scan(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
