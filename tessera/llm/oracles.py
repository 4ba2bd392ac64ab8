"""SQL (DuckDB) for the operators that SQL can express on whole tables."""

from __future__ import annotations

from tessera.llm import decontamination, embedding_dedup, license_scan, line_dedup, minhash_dedup

#: Words of a text column, as a list.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license() -> str:
    """Every place of every phrase and of every notice that stands word by word (none of the tables has an altered notice)."""
    values = ", ".join(f"({n}, '{t.label}', {t.base}, '{t.text}', {len(t.words)})" for n, t in enumerate(license_scan.TEMPLATES))
    return f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), t(n, label, base, phrase, len) AS (VALUES {values}
), p AS (SELECT doc_id, len, unnest(range(0, greatest(len(w) - len + 1, 0))) AS place, w FROM w, (SELECT DISTINCT len FROM t) WHERE len(w) >= len
), f AS (SELECT doc_id, place, label, base, t.len FROM (SELECT doc_id, place, len, array_to_string(w[place + 1 : place + len], ' ') AS said FROM p) JOIN t ON t.phrase = said
), s AS (SELECT * FROM f WHERE base OR NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.place <= f.place AND o.place + o.len >= f.place + f.len AND o.len > f.len))
SELECT w.doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (WHERE base) AS n_base, min(place) FILTER (WHERE base) AS first_word, max(place) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  CASE WHEN count(label) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score
FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""


_GRAMS = "list_transform(range(0, len({0}) - {1} + 1), lambda k: array_to_string({0}[k + 1 : k + {1}], ' '))"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark
), dg AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS x FROM d
), ds AS (SELECT doc_id, n, p, array_to_string(list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {decontamination.SHINGLE - 1} FOLLOWING), ' ') AS g FROM dg QUALIFY p + {decontamination.SHINGLE} <= n
), its AS (SELECT item_id, len(w) AS size, len(w) - {decontamination.SHINGLE - 1} AS m, unnest(range(0, len(w) - {decontamination.SHINGLE - 1})) AS o, unnest({_GRAMS.format("w", decontamination.SHINGLE)}) AS g FROM i WHERE len(w) >= {decontamination.SHINGLE}
), hits AS (SELECT doc_id, n, p, o, item_id, size, m FROM ds JOIN its USING (g)
), pairs AS (SELECT doc_id, item_id FROM hits GROUP BY doc_id, item_id, m HAVING count(*) >= ceil({decontamination.SIMILARITY} * m - 1e-9)
), starts AS (SELECT DISTINCT doc_id, item_id, m, greatest(0, least(p - o, n - size)) AS s FROM hits SEMI JOIN pairs USING (doc_id, item_id)
), a AS (SELECT starts.doc_id, item_id, s, g, count(*) AS a FROM starts JOIN ds ON ds.doc_id = starts.doc_id AND ds.p BETWEEN s AND s + m - 1 GROUP BY ALL
), b AS (SELECT doc_id, item_id, s, g, count(*) AS b FROM starts JOIN its USING (item_id) GROUP BY ALL
), sim AS (SELECT doc_id, item_id, s, sum(least(coalesce(a, 0), coalesce(b, 0))) / sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS v FROM a FULL JOIN b USING (doc_id, item_id, s, g) GROUP BY ALL
), best AS (SELECT doc_id, item_id, max(v) AS v FROM sim WHERE v >= {decontamination.SIMILARITY} GROUP BY ALL)
SELECT doc_id, count(*) AS n_items, min(row(-v, item_id))[2] AS best_item, max(v)::DOUBLE AS best_similarity FROM best GROUP BY doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {embedding_dedup.SIMILARITY}
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN comp ON a = vec_id
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), x AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS x FROM d
), g AS (SELECT doc_id, array_to_string(list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {minhash_dedup.SHINGLE - 1} FOLLOWING), ' ') AS g FROM x QUALIFY p + least(n, {minhash_dedup.SHINGLE}) <= n
), wt AS MATERIALIZED (SELECT doc_id, g, floor(log2(count(*)) + 1e-9)::BIGINT + 1 AS c FROM g GROUP BY ALL
), tot AS (SELECT doc_id, sum(c) AS t FROM wt GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT i.a, i.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, sum(least(p.c, q.c)) AS i FROM wt p JOIN wt q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) i
  JOIN tot ta ON ta.doc_id = i.a JOIN tot tb ON tb.doc_id = i.b WHERE i.i >= {minhash_dedup.SIMILARITY} * (ta.t + tb.t - i.i) - 1e-9
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), cls AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT a AS doc_id, c AS class_id, a = c AS kept FROM cls
"""

ORACLE = {"op1_license_scan": _license(), "op3_decontamination": DECONTAMINATION, "op5_embedding_dedup": EMBEDDINGS, "op7_line_dedup": line_dedup.SQL, "op8_minhash_dedup": MINHASH}
