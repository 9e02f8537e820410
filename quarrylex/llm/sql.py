"""SQL of the training-data operators that it can express: decontamination and exact links between embeddings.

The others have none: co-training, compression models, hashing of weighted shingles, multiple-instance learning, rolling
hashes, code-point spans of patterns and packing aren't SQL. Tests hold them against brute force instead.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, w[i:i + 12] AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ph AS (SELECT DISTINCT terms, len(terms) AS size FROM runs),
words AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
sizes AS (SELECT DISTINCT size FROM ph),
slides AS (SELECT doc_id, i AS start, size, w[i:i + size - 1] AS terms FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT s.doc_id, s.start, s.size, s.terms FROM slides s JOIN ph USING (terms)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS p FROM m) GROUP BY doc_id),
own AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m JOIN runs USING (terms) GROUP BY doc_id),
off AS (SELECT terms, size, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS off FROM ph),
df AS (SELECT term, count(*) AS c FROM words WHERE term IN (SELECT term FROM off) GROUP BY term),
ranked AS (SELECT terms, size, term, off, row_number() OVER (PARTITION BY terms ORDER BY coalesce(c, 0), off) AS r FROM off LEFT JOIN df USING (term)),
anchors AS (SELECT DISTINCT r.terms, r.size, p.doc_id, p.pos - r.off AS start FROM ranked r JOIN words p USING (term) WHERE r.r <= r.size - ceil(r.size * 0.9) + 1),
within AS (SELECT a.terms, a.doc_id, a.start, a.size, count(DISTINCT o.off) AS n FROM anchors a JOIN off o USING (terms) JOIN words p ON p.doc_id = a.doc_id AND p.term = o.term AND abs(p.pos - a.start - o.off) <= 3 GROUP BY ALL),
c3 AS (SELECT DISTINCT terms, doc_id FROM within WHERE n >= ceil(size * 0.9)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM c3 JOIN runs USING (terms) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS lo FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(lo, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(lo, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE: dict[str, str] = {"op5_decontaminate": OP5, "op9_embeddings": OP9}
