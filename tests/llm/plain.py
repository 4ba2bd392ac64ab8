"""The pipeline's stages in plain Python over lists of rows, by the methods' definitions."""

import hashlib
import zlib
from collections import Counter, defaultdict

from helpers import classes, shingles, similarity, words

COLUMNS = ["doc_id", "text", "lang", "source"]


def grams(text):
    signs = " "
    for c in (text or "").lower():
        if c.isalpha() or signs[-1] != " ":
            signs += c if c.isalpha() else " "
    signs += "" if signs[-1] == " " else " "
    if signs == " ":
        return []
    return [c for c in signs if c != " "] + [signs[k : k + n] for n in (2, 3) for k in range(len(signs) - n + 1)]


def ranked(found, size=300):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(found, key=lambda g: (-found[g], code(g)))[:size]


def profiles(rows):
    texts = defaultdict(set)
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            texts[r["lang"]].add(r["text"])
    return {lang: {g: k for k, g in enumerate(ranked(Counter(g for t in own for g in grams(t))))} for lang, own in sorted(texts.items())}


def language(text, known, size=300):
    own = ranked(Counter(grams(text)))
    if not own:
        return "und", 0.0
    far = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in known.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(own))


def languages(rows):
    known = profiles(rows)
    said = [(r, language(r["text"], known)) for r in rows]
    return [r | {"lang": lang} for r, (lang, score) in said if lang != "und" and score >= 0.2]


def lines(rows, sites=10):
    spread, first = defaultdict(set), {}
    bare = lambda x: x.strip(" \t\x0b\f\r")
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for k, x in enumerate(r["text"].split("\n")):
            if bare(x):
                first.setdefault(bare(x), (r["doc_id"], k))
                if r["source"] is not None:
                    spread[bare(x)].add(r["source"])
    out = []
    for r in rows:
        split = r["text"].split("\n")
        left = [x for k, x in enumerate(split) if not bare(x) or len(spread[bare(x)]) < sites or first[bare(x)] == (r["doc_id"], k)]
        if len(left) == len(split) or "".join(left).split():
            out.append(r | {"text": "\n".join(left)})
    return out


def near_duplicates(rows):
    sets = [Counter({g: c.bit_length() for g, c in shingles(words(r["text"])).items()}) for r in rows]
    holds, links = defaultdict(list), set()
    for k, s in enumerate(sets):
        links |= {(j, k) for j in {j for g in s for j in holds[g]} if similarity(s, sets[j]) >= 0.8}
        for g in s:
            holds[g].append(k)
    least = {}
    of = classes(range(len(rows)), links)
    for k, c in of.items():
        least[c] = min(least.get(c, rows[k]["doc_id"]), rows[k]["doc_id"])
    return [r for k, r in enumerate(rows) if r["doc_id"] == least[of[k]]]


def without_items(rows, items):
    own = [words(t) for t in items]
    out = []
    for r in rows:
        w = words(r["text"])
        whole = shingles(w)
        hit = False
        for i in own:
            want, n = shingles(i), min(5, len(i))
            if sum((whole & want).values()) >= 0.5 * sum(want.values()):
                hit = hit or any(similarity(shingles(w[s : s + len(i)], n), want) >= 0.8 for s in range(max(1, len(w) - len(i) + 1)))
        if not hit:
            out.append(r)
    return out


def tokens(rows, tokenizer):
    out = []
    for r in rows:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((r["doc_id"], r["lang"], r["source"], len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(decoded.encode()).hexdigest()))
    return out
