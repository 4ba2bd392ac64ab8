"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the places of those k-grams in license templates. Each hit
votes for a diagonal (place in the document minus place in the template). Votes are summed by diagonal, and neighbouring
diagonals of a template are merged into a span, since a word more or less shifts the rest of a text by a diagonal: as many
as the words that may be missing, no more. The words of the spans are then aligned with the template's, in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, keep_keys, rolling, same_document, sized, word_hashes, words

#: Words of a gram: of phrases, that have to stand as they are, and of notices, that may differ.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: The share of a notice's words that a span must have, in order.
COVERAGE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    notice: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def gram(self) -> int:
        return NOTICE_GRAM if self.notice else PHRASE_GRAM

    @property
    def drift(self) -> int:
        """Words that may differ, and so diagonals that a span may cross."""
        return ceil(len(self.words) * (1 - COVERAGE) - 1e-9) if self.notice else 0

    @property
    def votes(self) -> int:
        """Fewest votes of a span; a word that differs costs up to a gram's length."""
        return max(1, len(self.words) - self.gram + 1 - self.gram * self.drift)


# Phrases and well-known public license notices, in lower case without punctuation.
TEMPLATES = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("bsd", "bsd license"),
    Template("bsd", "3 clause bsd"),
    Template("bsd", "2 clause bsd"),
    Template("isc", "isc license"),
    Template("mpl", "mozilla public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("cc-by", "cc by"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("reserved", "all rights reserved"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", notice=True),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", notice=True),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", notice=True),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", notice=True),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", notice=True),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", notice=True),
    Template("unlicense", "this is free and unencumbered software released into the public domain", notice=True),
]


def _places(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(gram, t, at): where each gram of the templates stands."""
    out = []
    for k in (PHRASE_GRAM, NOTICE_GRAM):
        rows = [(n, t.words) for n, t in enumerate(templates) if t.gram == k]
        h = spark.createDataFrame(rows, "t int, w array<string>").select("t", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
        out.append(h.select("t", F.size("h").alias("n"), F.posexplode(rolling("h", k)).alias("at", "gram")).filter(F.col("at") + k <= F.col("n")).select("gram", "t", "at"))
    return out[0].unionByName(out[1])


def diagonals(hashed: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, th, t, diagonal, votes) of documents (doc, th, h): the different places that vote for each diagonal, gathered before and after the shuffle.

    The grams of both lengths are looked up in one pass. A repeated row's places count once; a diagonal has at most as
    many as its template has words.
    """
    h = F.col("h")
    grams = F.transform(h, lambda x, i: F.array(*(F.when(i + k <= F.size(h), F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k)))) for k in (PHRASE_GRAM, NOTICE_GRAM))))
    each = hashed.select("doc", "th", F.posexplode(grams).alias("p", "own")).select("doc", "th", "p", F.explode("own").alias("gram"))
    hits = each.join(sized(places), "gram").select("doc", "th", "t", "at", (F.col("p") - F.col("at")).alias("diagonal"))
    return hits.groupBy("doc", "th", "t", "diagonal").agg(F.size(F.collect_set("at")).cast("long").alias("votes"))


def in_order(words_of: Column, template: Column) -> Column:
    """Most of the template's words that stand in the others in the same order: the length of their longest common subsequence, row by row."""

    def following(row: Column, word: Column) -> Column:
        cell = lambda done, j: F.when(F.get(template, j) == word, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.get(done, j)))
        return F.aggregate(F.sequence(F.lit(0), F.size(template) - 1), F.array(F.lit(0)), lambda done, j: F.concat(done, F.array(cell(done, j))))

    return F.array_max(F.aggregate(words_of, F.array_repeat(F.lit(0), F.size(template) + 1), following))


def scan(docs: DataFrame, templates: list[Template] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    A span has label, base, start, end (words, end exclusive) and coverage; one inside a longer span counts only for base
    phrases. Phrases must stand word by word, wherever they stand, overlapping too; of a notice a fifth of the words may
    be missing or others, the rest stand in order. score is the largest coverage, 0 without a span. Null and empty texts
    have no words. Rows with one id are told apart by their text; repeated rows have the same result each.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    rows = documents(docs, doc, text)
    hashed = rows.select("doc", "th", word_hashes(F.col("text")).alias("h"))
    kinds = "t int, label string, base boolean, tw array<string>, len int, drift int, least int"
    info = spark.createDataFrame([(n, t.label, t.base, t.words, len(t.words), t.drift, t.votes) for n, t in enumerate(templates)], kinds)

    # a diagonal by itself, and with those after it as far as a text may drift
    most = max((t.drift for t in templates), default=0)
    ahead = Window.partitionBy("doc", "th", "t").orderBy("diagonal")  # the diagonals of one template in one document
    after = F.filter(F.collect_list(F.struct("diagonal", "votes")).over(ahead.rangeBetween(0, most)), lambda x: x["diagonal"] <= F.col("diagonal") + F.col("drift"))
    found = diagonals(hashed, _places(spark, templates)).join(F.broadcast(info), "t").withColumn("after", after)  # as many rows as templates
    found = found.withColumn("total", F.aggregate("after", F.lit(0).cast("long"), lambda s, x: s + x["votes"])).filter(F.col("total") >= F.col("least"))
    ends = F.array_distinct(F.array(F.col("diagonal"), F.array_max(F.transform("after", lambda x: x["diagonal"]))))
    found = found.withColumn("last", F.explode(ends)).select("doc", "th", "t", "label", "base", "tw", "diagonal", F.greatest(F.lit(0), "diagonal").alias("start"), (F.col("last") + F.col("len")).alias("end"))

    # align the words of the spans, from the documents that have any
    found = cut(found.groupBy("doc", "th").agg(F.collect_list(F.struct("t", "label", "base", "tw", "diagonal", "start", "end")).alias("f")).withColumnsRenamed({"doc": "d2", "th": "t2"}))
    some = keep_keys(rows, found.select(F.col("t2").alias("th")).distinct(), "th").dropDuplicates(["doc", "th"])
    spans = some.join(found, same_document("d2", "t2")).select("doc", "th", words(F.col("text")).alias("w"), "f")
    spans = spans.select("doc", "th", F.explode(F.transform("f", lambda s: F.struct(s.alias("s"), F.slice("w", s["start"] + 1, F.greatest(F.lit(0), s["end"] - s["start"])).alias("own")))).alias("x"))
    spans = spans.select("doc", "th", "x.s.*", "x.own")
    coverage = F.when(F.col("own") == F.col("tw"), 1.0).when(F.col("t").isin([n for n, t in enumerate(templates) if t.notice]), in_order(F.col("own"), F.col("tw")) / F.size("tw")).otherwise(0.0)
    spans = spans.select("doc", "th", "t", "label", "base", "diagonal", F.col("start").cast("long").alias("start"), (F.col("start") + F.size("own")).cast("long").alias("end"), coverage.alias("coverage"))
    spans = cut(spans.filter(F.when(F.col("t").isin([n for n, t in enumerate(templates) if t.notice]), F.col("coverage") >= COVERAGE).otherwise(F.col("coverage") == 1.0)))
    # of a notice's spans near one another the one that fits best: most words, shortest, first
    fit = F.struct("coverage", (F.col("start") - F.col("end")).alias("_short"), (-F.col("diagonal")).alias("_first"))
    spans = spans.withColumn("fit", fit)
    of_notice = Window.partitionBy("doc", "th", "t").orderBy("diagonal").rangeBetween(-most, most)
    spans = spans.withColumn("best", F.max("fit").over(of_notice)).filter(F.col("t").isin([n for n, t in enumerate(templates) if not t.notice]) | (F.col("fit") == F.col("best")))
    # "cc by" says nothing where it is a part of "cc by nc"
    by = Window.partitionBy("doc", "th").orderBy("start")
    earlier, same = F.max("end").over(by.rangeBetween(Window.unboundedPreceding, -1)), F.max("end").over(by.rangeBetween(0, 0))
    spans = spans.withColumn("within", F.coalesce(earlier >= F.col("end"), F.lit(False)) | (same > F.col("end"))).filter("base OR NOT within")

    names = lambda of: F.array_join(F.array_sort(F.collect_set(of)), ",")
    base_start = F.when(F.col("base"), F.col("start"))
    spans = spans.groupBy(F.col("doc").alias("d2"), F.col("th").alias("t2")).agg(
        F.count(base_start).alias("n_base"), F.min(base_start).alias("first_word"), F.max(base_start).alias("last_word"), names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"), F.max("coverage").alias("score"), F.array_sort(F.collect_list(F.struct("start", "end", "label", "base", "coverage"))).alias("spans"),
    )
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,end:bigint,coverage:double>>")
    out = rows.select("doc", "th", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(spans, same_document("d2", "t2"), "left")
    return out.select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("label", "base", "start", "end", "coverage")))), none).alias("spans"),
    )
