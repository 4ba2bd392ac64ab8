"""Language identification by rank-order profiles.

A text's profile is the ranked list of its most frequent letter n-grams (one to ``longest`` letters, runs of anything
else being one boundary sign). The language is the one whose profile has the smallest out-of-place distance: the sum,
over the text's n-grams, of how far each stands from its place in the language's profile, and of ``size`` for an n-gram
that the language's profile doesn't have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

UNKNOWN = "und"
#: N-grams in a profile, letters in the longest n-gram, and texts of a language that profiles are learned from (expected number).
PROFILE_SIZE, LONGEST, TRAINING_TEXTS = 300, 3, 3000
#: More labels than this aren't languages.
MOST_LANGUAGES = 1000
BITS = 21  # of a code point; three fit a long
BOUNDARY = 32


class _Letters:
    """Whether a code point is a letter, built once in each worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(c).isalpha() for c in range(0x110000)])
        return cls.table


def ngrams(text: str | None, longest: int = LONGEST) -> np.ndarray:
    """Codes of all letter n-grams of the whole text; none if it has no letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _Letters.get()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    signs = np.where(letter, codes, BOUNDARY).astype(np.int64)
    signs = np.concatenate(([BOUNDARY], signs, [BOUNDARY]))
    signs = signs[np.concatenate(([True], (signs[1:] != BOUNDARY) | (signs[:-1] != BOUNDARY)))]
    grams, found = signs, [signs[signs != BOUNDARY]]
    for n in range(1, longest):
        grams = (grams[:-1] << BITS) | signs[n:]
        found.append(grams)
    return np.concatenate(found)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(grams):
        return grams, grams
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.concatenate((first, [len(grams)])))


def ranked(grams: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    codes, counts = counted(grams)
    if len(codes) > size:  # no n-gram rarer than the size-th can be in the profile
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:size]


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray  # all n-grams of any profile, in order
    places: np.ndarray  # (n-gram, language) -> place in the language's profile, or size
    size: int = PROFILE_SIZE
    longest: int = LONGEST

    @classmethod
    def of(cls, lists: dict[str, list[int]], size: int, longest: int) -> Profiles:
        codes = np.array(sorted({c for x in lists.values() for c in x}), dtype=np.int64)
        places = np.full((len(codes) + 1, len(lists)), size, np.int64)  # the last row: in no profile
        for k, lang in enumerate(sorted(lists)):
            places[np.searchsorted(codes, lists[lang]), k] = np.arange(len(lists[lang]))
        return cls(sorted(lists), codes, places, size, longest)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / largest possible distance; ``und`` and 0 without letters or languages."""
        own = ranked(grams, self.size) if len(grams := ngrams(text, self.longest)) and self.languages else []
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        far = np.abs(self.places[at] - np.arange(len(own))[:, None]) * (self.places[at] < self.size) + self.size * (self.places[at] == self.size)
        total = far.sum(axis=0)
        best = int(np.argmin(total))
        return self.languages[best], 1.0 - float(total[best]) / (self.size * len(own))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE, longest: int = LONGEST, texts: int = TRAINING_TEXTS) -> Profiles:
    """Profiles of the languages of labelled documents.

    Each language's different texts are sampled by a hash to ``texts`` in expectation (all, if it has fewer), and count
    once however many rows have them; rows with a null label or text teach nothing. To the driver come only ``size`` n-grams of each language.
    """
    rows = docs.select(F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang")).filter("__lang IS NOT NULL AND __text IS NOT NULL")
    have = {r[0]: r[1] for r in rows.groupBy("__lang").agg(F.count_distinct(F.xxhash64("__text"))).limit(MOST_LANGUAGES + 1).collect()}
    if len(have) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: not a column of languages")
    if not have:
        return Profiles.of({}, size, longest)
    share = F.create_map(*(F.lit(x) for name, n in have.items() for x in (name, texts / n)))[F.col("__lang")]
    chosen = rows.filter(F.pmod(F.xxhash64("__text"), F.lit(1_000_003)) < share * 1_000_003).select("__lang", "__text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, Counter] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = counted(ngrams(value, longest))
                totals.setdefault(name, Counter()).update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
            for name, found in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "code", "n"])

    grams = map_arrow(chosen, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    lists: dict[str, list[int]] = {}
    for r in grams.withColumn("place", place).filter(F.col("place") <= size).orderBy("lang", "place").collect():
        lists.setdefault(r["lang"], []).append(r["code"])
    return Profiles.of(lists, size, longest)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """Adds lang_pred and score to the ``keep`` columns; one row for each row.

    The whole text is used. A null or empty text, or one without letters, gives ``und`` and 0. Ties between languages go
    to the first in alphabetical order. No shuffle; the profiles are a few thousand numbers.
    """
    kept = docs.select(*keep).schema
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [profiles.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*keep, "lang_pred", "score"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "lang_pred string, score double"])
    return map_arrow(source, run, ddl)
