import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(TO_LOWER))


def shingles(w, n=5):
    n = min(n, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in documents(spark, folder).select("doc_id", "text").collect()]


def classes(keys, links):
    """The smallest key reachable from each."""
    up = {k: k for k in keys}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}
