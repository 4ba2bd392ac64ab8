"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled, rule by rule, into a deterministic automaton over tokens that accepts exactly the correct
tokenizations. At the start one state loops on every symbol. The gadget of a rule (u, v) -> uv finds the state q that u
leads to, gives u a copy of q without its v arc, and adds an arc uv, from wherever u could be read, to the state that v
leads to. All arcs with one label lead to one state, so a state has its parent, the label that its gadget deleted and
the time of that gadget; the arcs of a state are those of its parent without the deleted one, and an added arc uv
exists where u existed at that time. A state's row of the transition table says, for each label met, which state its arc
leads to, or that it has none; rows are filled from the gadgets as words are read and kept.

A word is encoded by the table, place by place: the labels that end at a place are found by a trie of their ends, and the
one whose arc the state at its beginning has is taken. Paths of the automaton are unique and each beginning of one is one,
so every place has one state, and no step is undone. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

#: Characters that count as white space for the tokenizer's patterns (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: str.split() also splits at these, which the tokenizer takes for ordinary characters.
SPACES = re.compile(f"[{SPACE}]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Most entries of a generation of each cache of a worker.
CACHED = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@functools.cache
def category_range(kind: str) -> str:
    """The inside of a character class of the code points whose general category begins with ``kind``.

    As unicodedata has it; what its Unicode version leaves unassigned, as the later tables of regex have it.
    """
    later, out, begin = regex.compile(rf"\p{{{kind}}}"), [], None
    for c in range(0x110001):
        known = unicodedata.category(chr(c)) if c < 0x110000 else ""
        # beyond, regex calls whole planes letters
        if known[:1] == kind or (known == "Cn" and c < 0x20000 and later.match(chr(c))):
            begin = c if begin is None else begin
        elif begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


class Automaton:
    """States of the tokenization automaton of a merge list; tokens are their ids."""

    def __init__(self, n_tokens: int, merges: list[tuple[int, int, int]]):
        """merges: (u, v, uv) in order of priority."""
        self.state = [0] * n_tokens  # where the arcs of a label lead
        self.left, self.right, self.born = [-1] * n_tokens, [-1] * n_tokens, [-1] * n_tokens
        self.parent, self.deleted, self.time = [-1], [-1], [-1]
        self.gadget: dict[int, int] = {}  # (owner label, deleted label) -> time: the deletions along a state's parents
        self.made = [True] * n_tokens
        for _, _, uv in merges:
            if not self.made[uv]:
                raise ValueError("two rules make one token")
            self.made[uv] = False
        for time, (u, v, uv) in enumerate(merges):
            if not (self.made[u] and self.made[v] and self._arc(u, v)):
                continue  # earlier gadgets left no such arcs: the rule never applies
            self.made[uv] = True
            q, r = self.state[u], self.state[v]
            self.parent.append(q)
            self.deleted.append(v)
            self.time.append(time)
            self.state[u] = len(self.parent) - 1
            self.state[uv] = r
            self.left[uv], self.right[uv], self.born[uv] = u, v, time
            self.gadget[u << 20 | v] = time
        self.clear()

    def clear(self) -> None:
        """The transition table as far as it's filled in: of each state and of the start, label -> state, or -1 for none."""
        self.rows: list[dict[int, int]] = [{} for _ in self.parent]
        self.start: dict[int, int] = {}
        self.filled = 0

    def fill(self, row: dict[int, int], last: int, token: int) -> int:
        """The transition by ``token`` from the state that ``last`` leads to; -1: from the start, where every label has an arc."""
        self.filled += 1
        row[token] = to = self.state[token] if last < 0 or self._arc(last, token) else -1
        return to

    def _arc(self, last: int, token: int) -> bool:
        left, right, born, gadget = self.left, self.right, self.born, self.gadget
        owner, before = last, len(born) * 2
        while owner >= 0:  # the parents of state[last], by the label whose gadgets made them
            label, until = token, len(born) * 2
            while label >= 0:  # token has its arc where its left part had one when it was made, and so on
                time = gadget.get(owner << 20 | label)
                if time is not None and time < before and time <= until:
                    return False
                label, until = left[label], born[label]
            owner, before = right[owner], born[owner]
        return True


class Recent(dict):
    """What was made lately: two generations of ``most`` entries; the older one is forgotten when the newer is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        known = self.old.get(key)
        if known is None:
            known = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = known
        return known


class Codec:
    """Encodes and decodes as the tokenizer of a file does, without added special tokens."""

    def __init__(self, path: str, cached: int = CACHED):
        spec = json.loads(open(path, encoding="utf-8").read())  # a driver- and worker-local vocabulary file
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if set(steps) - {"NFC", "Replace", "Lowercase"} or spec["decoder"] is not None:
            raise ValueError("a normalizer or decoder that isn't known")
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps  # what Replace makes one space ends a run of letters anyway
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \\p{L} and \\p{N} stand inside classes there
        self.words = re.compile(pattern.replace("\\p{L}", category_range("L")).replace("\\p{N}", category_range("N")).replace("\\s", SPACE))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.label[i] = t
        self.automaton = Automaton(size, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.letters, self.vocab = byte_letters(), vocab
        end = len(self.suffix)
        labels = {t: i for t, i in vocab.items() if self.automaton.made[i]}
        # tries of the labels' ends, for the last place of a word and for others: the label, or -1 where it goes on
        final = {t[:-end]: i for t, i in labels.items() if t.endswith(self.suffix)}
        inner = {t: i for t, i in labels.items() if not t.endswith(self.suffix)}
        self.final, self.inner = ({t[k:]: -1 for t in x for k in range(len(t))} | x for x in (final, inner))
        self.spaced = [f" {t}" for t in self.label]
        self.word = Recent(lambda w: array("I", self._path(w)).tobytes(), cached)
        self.chunk = Recent(self._chunk, cached)

    def _path(self, word: str) -> list[int]:
        """The automaton's accepted path for one word."""
        text = "".join([self.letters[b] for b in word.encode()])
        n, auto, ends = len(text), self.automaton, self.inner
        if auto.filled > 4 * CACHED:
            auto.clear()
        table = auto.rows
        rows, last, came = [auto.start], [-1], [0]  # of each place: its state's transitions, the label that led there, and from where
        for end in range(1, n + 1):
            if end == n:
                ends = self.final
            begin = end - 1
            while True:
                token = ends.get(text[begin:end])
                if token is None:
                    raise ValueError("no path: the vocabulary lacks a byte")
                if token >= 0:
                    known = rows[begin]
                    to = known.get(token)
                    if to is None:
                        to = auto.fill(known, last[begin], token)
                    if to >= 0:
                        break
                begin -= 1
            rows.append(table[to])
            last.append(token)
            came.append(begin)
        path, at = [], n
        while at:
            path.append(last[at])
            at = came[at]
        return path[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space or special tokens."""
        text = chunk if chunk.isascii() or not self.nfc else unicodedata.normalize("NFC", chunk)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        if text.isalpha():  # all letters: one word of the pattern
            return self.word[text]
        if text[-1] in ",.!?;:" and text[:-1].isalpha():
            return self.word[text[:-1]] + self.word[text[-1]]
        return b"".join([self.word[w] for w in self.words.findall(text)])

    def encode(self, text: str | None) -> tuple[bytes, str, int]:
        """Ids as little-endian unsigned 32-bit integers, the decoded text, and the number of tokens."""
        text = text or ""
        if "<" in text and self.split_special:
            ids = b""
            for part in self.split_special.split(text):
                ids += self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(self.chunk.__getitem__, self._runs(part)))
        else:
            ids = b"".join(map(self.chunk.__getitem__, self._runs(text)))
        return ids, self.decode(ids), len(ids) // 4

    def _runs(self, text: str) -> list[str]:
        return [x for x in SPACES.split(text) if x] if NOT_SPACE.search(text) else text.split()

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, joined as the library's decode does for a tokenizer without a decoder."""
        arcs = array("I")  # machines are little-endian here, as Arrow's are
        arcs.frombytes(ids)
        return "".join(map(self.spaced.__getitem__, arcs))[1:]


@functools.lru_cache(maxsize=2)
def codec(path: str, cached: int = CACHED) -> Codec:
    return Codec(path, cached)


def encode_decode(df: DataFrame, text: str, keep: list[str], tokenizer: str, emit: Callable[[bytes, str, int], tuple], schema: str, cached: int = CACHED) -> DataFrame:
    """Encodes and decodes every text; ``emit(ids, decoded, n)`` makes the columns of ``schema`` beside those kept.

    A null text counts as empty and gives no tokens. Rows that are repeated are each encoded. ``keep`` columns pass
    unchanged, nulls too. No shuffle; a worker holds one batch of texts, the automaton and two bounded caches.
    """
    kept = df.select(*keep).schema
    names = [x.split(" ")[0] for x in schema.split(", ")]
    source = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, cached)
        for batch in batches:
            if batch.num_rows:
                rows = [emit(*c.encode(t.as_py())) for t in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x) for x in zip(*rows, strict=True))], names=[*keep, *names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), schema])
    return map_arrow(source, run, ddl)


def digests(ids: bytes, decoded: str, n: int) -> tuple:
    return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
