"""SQL for the registered queries, in the dialect of the side-by-side check."""

from __future__ import annotations

ALNUM = r"[\p{L}\p{N}]+"
BASE = rf"""toks AS (SELECT doc_id, lang, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(text, '{ALNUM}') AS w FROM documents)),
low AS (SELECT doc_id, lang, lower(tok) AS term, pos FROM toks),
own AS (SELECT doc_id, lang, tok AS term, pos FROM toks WHERE tok <> lower(tok)),
posts AS (SELECT * FROM low UNION ALL SELECT * FROM own),
lens AS (SELECT doc_id, lang, len(regexp_extract_all(text, '{ALNUM}')) AS n FROM documents),
nn AS (SELECT count(*)::DOUBLE AS n FROM documents),
st AS (SELECT term, count(*)::DOUBLE AS tc, count(DISTINCT doc_id)::DOUBLE AS df FROM posts GROUP BY term),
idf AS (SELECT term, tc, df, CASE WHEN ln(n / df) > 0 THEN ln(n / df) ELSE 1.0 END AS w FROM st, nn)"""


def post(term: str, weight: float = 1.0) -> str:
    return f"(SELECT p.doc_id, p.pos, i.w * {weight} AS w FROM posts p JOIN idf i USING (term) WHERE term = '{term}')"


def where(test: str) -> str:
    """Postings of all terms that a test on the vocabulary selects."""
    return f"(SELECT p.doc_id, p.pos, i.w FROM posts p JOIN idf i USING (term) WHERE {test})"


def per_doc(p: str) -> str:
    return f"(SELECT doc_id, max(pos) AS pos, sum(w) AS w FROM {p} GROUP BY doc_id)"


def both(a: str, b: str) -> str:
    return f"(SELECT a.doc_id, greatest(a.pos, b.pos) AS pos, a.w + b.w AS w FROM {per_doc(a)} a JOIN {per_doc(b)} b USING (doc_id))"


def either(a: str, b: str) -> str:
    return f"(SELECT * FROM {a} UNION ALL SELECT * FROM {b})"


def minus(a: str, b: str) -> str:
    return f"(SELECT * FROM {a} WHERE doc_id NOT IN (SELECT doc_id FROM {b}))"


def left_or(a: str, b: str) -> str:
    return f"(SELECT * FROM {a} UNION ALL SELECT * FROM {b} WHERE doc_id IN (SELECT doc_id FROM {a}))"


def once(a: str, b: str) -> str:
    return either(minus(a, b), minus(b, a))


def pair(a: str, b: str, test: str, pos: str = "greatest(a.pos, b.pos)") -> str:
    return f"(SELECT doc_id, pos, max(w) AS w FROM (SELECT a.doc_id, {pos} AS pos, (a.w + b.w) * 3 AS w FROM {a} a JOIN {b} b ON a.doc_id = b.doc_id AND {test}) GROUP BY doc_id, pos)"


def phrase(a: str, b: str, d: int = 1) -> str:
    return pair(a, b, f"(b.pos - a.pos IN (0, {d}))", "b.pos")


def scored(p: str, norm: str = "ln(n + 1.0)", extra: str = "") -> str:
    return f"WITH {BASE} SELECT s.doc_id, round(s.w / {norm}, 6) AS score FROM (SELECT doc_id, sum(w) AS w FROM {p} GROUP BY doc_id) s JOIN lens USING (doc_id) {extra}"


def among(*words: str) -> str:
    return "(SELECT doc_id FROM low WHERE term IN (" + ", ".join(f"'{w}'" for w in words) + "))"


OF, THAT, WITH, BY, AND, IS, THE = (post(w) for w in ("of", "that", "with", "by", "and", "is", "the"))
FIRST_LOWER = "regexp_matches(term, '^[a-z]')"

ORACLE: dict[str, str] = {
    "bool_term": scored(OF), "bool_and": scored(both(OF, THAT)), "bool_or": scored(either(OF, WITH)), "bool_ior": scored(left_or(THAT, WITH)), "bool_xor": scored(once(THAT, WITH)), "bool_not": scored(minus(THAT, WITH)),
    "nested_boolean": scored(either(both(OF, THAT), minus(AND, IS))), "grouping": scored(both(OF, either(WITH, BY))), "required_one": scored(left_or(WITH, BY)), "required_both": scored(both(WITH, BY)),
    "adj_phrase": scored(phrase(OF, THE)), "adj_three": scored(phrase(phrase(OF, THE), AND)), "adj_distance": scored(phrase(OF, THE, 2)),
    "near_any": scored(pair(THAT, WITH, "abs(b.pos - a.pos) <= 5")), "near_plus": scored(pair(THAT, WITH, "b.pos - a.pos BETWEEN 0 AND 5")), "near_minus": scored(pair(THAT, WITH, "b.pos - a.pos BETWEEN -5 AND 0")),
    "and_of_phrases": scored(both(phrase(OF, THE), WITH)), "term_weight": scored(either(post("of", 2.5), post("with", 0.5))), "exact_case": scored(both(post("The"), OF)), "field_query": scored(both(OF, WITH)),
    "filter_lang": scored(OF, extra="WHERE lang = 'en'"), "filter_langs": scored(post("de"), extra="WHERE lang IN ('fr', 'es')"),
    "incl_filter": scored(OF, extra=f"WHERE doc_id IN {among('with', 'by')} AND doc_id IN {among('that')}"), "excl_filter": scored(OF, extra=f"WHERE doc_id NOT IN {among('with', 'by')}"),
    "freetext": scored(either(either(WITH, AND), BY)),
    "wildcard_multi": scored(where(f"{FIRST_LOWER} AND regexp_matches(term, '^ther.*$')")), "wildcard_single": scored(where("regexp_matches(term, '^th.$')")), "wildcard_alpha": scored(where(r"regexp_matches(term, '^a\p{L}d$')")),
    "wildcard_digit": scored(where(r"regexp_matches(term, '^1\p{Nd}$')")), "regex_term": scored(where("regexp_matches(term, '^ther.*on$')")), "literal_term": scored(post("The")),
    "range_numeric": scored(where(r"regexp_matches(term, '^[0-9]{1,18}$') AND TRY_CAST(term AS BIGINT) BETWEEN 1 AND 50")),
    "range_alpha": scored(where(r"regexp_matches(term, '^\p{L}') AND NOT regexp_matches(term, '\p{Lu}') AND regexp_matches(term, '\p{Ll}') AND lower(term) BETWEEN 'thea' AND 'theb'")),
    "wildcard_and": scored(both(where("regexp_matches(term, '^ther.*$')"), WITH)),
}


def ranked(form: str) -> str:
    weighted = f"(SELECT p.doc_id, p.pos, {form} AS w FROM posts p JOIN st USING (term), nn WHERE term IN ('of', 'with'))"
    return scored(weighted)


for _name, _form in {
    "none": "1.0", "basic": "1.0 / tc", "evolved": "ln(1.0 + n / df)", "sparck72": "ln(n / df + 1.0)", "croft79": "CASE WHEN n > df THEN ln((n - df) / tc) ELSE 1.0 END", "inquery": "ln((n + 0.5) / df) / ln(n + 1.0)", "bm25": "ln(1.0 + (n - df + 0.5) / (df + 0.5))",
}.items():
    ORACLE[f"rank_{_name}"] = ranked(_form)
ORACLE["rank_croft79"] = ORACLE["rank_croft79"].replace("round(s.w / ", "round(CASE WHEN s.w < 0 THEN 1e-10 ELSE s.w END / ")
for _name, _norm in {"none": "1.0", "raw": "n", "log2": "log2(n + 1.0)", "average": "(n / (SELECT avg(n) FROM lens))"}.items():
    ORACLE[f"length_{_name}"] = scored(either(OF, WITH), _norm)

DIGEST = "SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS digest FROM ({})"
ASCII_PUNCT = r"""!"#%&''()*+,\-/:;<=>?@\[\\\]^_`{|}~"""
TAIL_PUNCT = r"""!"$%&''()*,\-./:;<=>?@\[\\\]^_`{|}~"""
PUNCT_TOKENS = rf"""list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(regexp_replace(x, '^[{ASCII_PUNCT}]+', ''), '[{TAIL_PUNCT}]+$', '')), lambda x: regexp_matches(x, '[^\p{{P}}\p{{S}}\s]'))"""
VOCABULARY = f"SELECT DISTINCT unnest(regexp_extract_all(text, '{ALNUM}')) AS token FROM documents"
LOW = f"SELECT DISTINCT lower(token) AS term FROM ({VOCABULARY})"
ASCII_LOW = f"SELECT term FROM ({LOW}) WHERE regexp_matches(term, '^[a-z]+$')"
_A, _B = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝŸàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIIDNOOOOOOUUUUYYaaaaaaceeeeiiiidnoooooouuuuyy"
ORACLE |= {
    "tok_alnum": DIGEST.format(f"SELECT doc_id, regexp_extract_all(text, '{ALNUM}') AS w FROM documents"),
    "tok_punct": DIGEST.format(f"SELECT doc_id, {PUNCT_TOKENS} AS w FROM documents"),
    "tok_unigram": DIGEST.format(r"SELECT doc_id, regexp_extract_all(text, '\S') AS w FROM documents"),
    "tok_length": DIGEST.format(f"SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '{ALNUM}'), lambda x: length(x) >= 3), lambda x: substr(x, 1, 8)) AS w FROM documents"),
    "tok_components": rf"""SELECT DISTINCT token, part FROM (SELECT token, unnest(list_filter(string_split_regex(token, '[\p{{P}}\p{{S}}]+'), lambda x: x <> '')) AS part FROM (SELECT DISTINCT unnest({PUNCT_TOKENS}) AS token FROM documents) WHERE regexp_matches(token, '[^\p{{P}}\p{{S}}][\p{{P}}\p{{S}}]+[^\p{{P}}\p{{S}}]')) WHERE part <> token""",
    "case_classes": rf"SELECT CASE WHEN u AND NOT l THEN 'upper' WHEN u AND l THEN 'mixed' WHEN l THEN 'lower' WHEN d THEN 'digits' ELSE 'none' END AS kind, count(*) AS n, min(token) AS first FROM (SELECT token, regexp_matches(token, '\p{{Lu}}') AS u, regexp_matches(token, '\p{{Ll}}') AS l, regexp_matches(token, '^\p{{Nd}}+$') AS d FROM ({VOCABULARY})) GROUP BY 1",
    "accents": f"SELECT token, translate(token, '{_A}', '{_B}') AS bare FROM ({VOCABULARY}) WHERE translate(token, '{_A}', '{_B}') <> token",
    "stop_flags": f"SELECT term FROM ({LOW}) WHERE term IN ('a','about','an','are','as','at','be','by','com','edu','for','from','how','i','in','is','it','of','on','that','the','this','to','was','what','when','where','which','who','why','will','with')",
    "soundex_std": f"""SELECT term, rpad(upper(substr(term, 1, 1)) || substr(regexp_replace(translate(substr(sq, 2), 'BPFVCSKGJQXZDTLMNRAEIOUHWY', '11112222222233455600000000'), '0', '', 'g'), 1, 3), 4, '0') AS key
        FROM (SELECT term, {{squeezed}} AS sq FROM ({ASCII_LOW}))""",
    "soundex_alt": f"SELECT term, substr(term, 1, 1) || substr(translate(regexp_replace(upper(substr(term, 2)), '[^BCDFGJKLMNPQRSTVXZ]', '', 'g'), 'BPFVCSKGJQXZDTLMNR', '111122222222334556'), 1, 5) AS key FROM ({ASCII_LOW})",
    "soundex_expansion": None,
    "term_stats": f"WITH {BASE} SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM low GROUP BY term",
    "case_variants": f"WITH {BASE} SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM own GROUP BY term",
    "document_lengths": f"WITH {BASE} SELECT doc_id, n::BIGINT AS term_count, lang FROM lens",
    "document_numbers": "SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) AS doc_id FROM orders",
    "key_dictionary": "SELECT o_custkey::VARCHAR AS doc_key, max(o_orderkey) AS doc_id, count(*) AS copies FROM orders GROUP BY 1",
    "position_faults": "SELECT 0::BIGINT AS n",
    "ansi_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d000000')::BIGINT AS ansi, strftime(o_orderdate, '%Y%m00000000')::BIGINT AS month FROM orders",
}
_squeeze = "upper(replace(term, 'ß', 'ss'))"
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _squeeze = f"regexp_replace({_squeeze}, '{_c}+', '{_c}', 'g')"
ORACLE["soundex_std"] = ORACLE["soundex_std"].replace("{squeezed}", _squeeze)
_SOUNDEX_BASE = f"SELECT term, upper(substr(term, 1, 1)) || substr(regexp_replace(translate(regexp_replace(substr({_squeeze}, 2), '[^A-Z]', '', 'g'), 'BPFVCSKGJQXZDTLMNRAEIOUHWY', '11112222222233455600000000'), '0', '', 'g'), 1, 3) AS key, term_count, doc_count FROM (SELECT translate(term, '{_A}', '{_B}') AS term, term AS real, term_count, doc_count FROM all_terms)"
ORACLE["soundex_expansion"] = f"WITH {BASE}, all_terms AS (SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM posts GROUP BY term) SELECT real AS term, term_count, doc_count FROM ({_SOUNDEX_BASE.replace('SELECT term, upper', 'SELECT real, upper', 1)}) WHERE regexp_matches(real, '^t') AND rpad(key, 4, '0') = 'T600'"


def _plural(rules: list[tuple[int, str, int, str]]) -> str:
    cases = " ".join(f"WHEN length(term) > {above} AND regexp_matches(term, '{end}$') THEN substr(term, 1, length(term) - {n}) || '{add}'" for above, end, n, add in rules)
    return f"SELECT term, stem FROM (SELECT term, CASE {cases} ELSE term END AS stem FROM ({LOW})) WHERE stem <> term"


_CONS = "bcdfghjklmnpqrstvwxz"
PLURAL_RULES = {
    "en": [(3, "[^ea]ies", 3, "y"), (3, "ies", 0, ""), (4, "(sh|ch|ss|x)es", 2, ""), (3, "[^aeiou]es", 1, ""), (2, "es", 0, ""), (2, "[us]s", 0, ""), (2, r"[^\p{P}]s", 1, "")],
    "es": [(4, "eses", 2, ""), (4, "ces", 3, "z"), (4, "[oaeóáé]s", 2, ""), (4, "[oaeóáéòàè]", 1, "")],
    "de": [(6, "nen", 3, ""), (5, "e[nsr]", 2, ""), (5, "se", 2, ""), (4, "[nsre]", 1, "")],
    "it": [(5, "[ih][ei]", 2, ""), (5, "[ei]", 1, ""), (5, "i[oa]", 2, ""), (5, "[oa]", 1, "")],
    "nl": [(4, f"[{_CONS}]en", 2, ""), (4, f"[{_CONS.replace('j', '')}]s", 1, "")],
    "sv": [(4, "[bcdfghjklmnoprtvy]s", 1, "")], "no": [(4, "[bcdfghjklmnoprtvyz]s", 1, "")], "da": [(4, "[abcdfghjklmnoprtvyzå]s", 1, "")],
    "pt": [(2, "[õã]es", 3, "ão"), (5, "res", 2, ""), (4, "les", 2, ""), (2, "es", 1, ""), (4, "[eé]is", 3, "el"), (4, "óis", 3, "ol"), (2, "ais", 3, "al"), (3, "is", 2, "il"), (2, "is", 0, ""), (2, "ns", 2, "m"), (2, "s", 1, "")],
    "gl": [(5, "ões", 3, "ãn"), (3, "ães", 3, "ão"), (5, "res", 2, ""), (4, "les", 2, ""), (2, "es", 1, ""), (4, "[éeè]is", 3, "el"), (4, "[óo]is", 3, "ol"), (3, "ais", 3, "al"), (2, "is", 0, ""), (3, "ís", 2, "il"), (2, "ns", 1, ""), (2, "s", 1, "")],
    "xx": [(2, r"[^\p{P}]s", 1, "")],
}
for _lang, _rules in PLURAL_RULES.items():
    ORACLE[f"stem_plural_{_lang}"] = _plural(_rules)
_COUNT = "(SELECT doc_id, count(*)::DOUBLE AS w FROM low WHERE term = '{}' GROUP BY doc_id)"
_FULL = f"(SELECT doc_id, coalesce(a.w, 0) AS l, coalesce(b.w, 0) AS r FROM {_COUNT.format('that')} a FULL JOIN {_COUNT.format('with')} b USING (doc_id))"
ORACLE |= {
    "weights_or": f"WITH {BASE} SELECT doc_id, l + r AS score FROM {_FULL}", "weights_and": f"WITH {BASE} SELECT doc_id, l + r AS score FROM {_FULL} WHERE l > 0 AND r > 0",
    "weights_xor": f"WITH {BASE} SELECT doc_id, l + r AS score FROM {_FULL} WHERE (l > 0) <> (r > 0)", "weights_not": f"WITH {BASE} SELECT doc_id, l AS score FROM {_FULL} WHERE l > 0 AND NOT r > 0",
    "set_or": f"WITH {BASE} SELECT doc_id FROM {_FULL}", "set_and": f"WITH {BASE} SELECT doc_id FROM {_FULL} WHERE l > 0 AND r > 0", "set_xor": f"WITH {BASE} SELECT doc_id FROM {_FULL} WHERE (l > 0) <> (r > 0)", "set_not": f"WITH {BASE} SELECT doc_id FROM {_FULL} WHERE r = 0",
    "relaxed_and": scored(WITH), "strict_and": f"WITH {BASE} SELECT doc_id, 0.0::DOUBLE AS score FROM low WHERE FALSE",
    "stop_phrase": f"WITH {BASE} SELECT DISTINCT a.doc_id FROM low a JOIN low b ON a.doc_id = b.doc_id AND b.pos - a.pos = 2 WHERE a.term = 'of' AND b.term = 'and'",
    "stop_handling": f"WITH {BASE} SELECT term, count(*) AS term_count, 0::BIGINT AS kept FROM posts WHERE lower(term) IN ('a','about','an','are','as','at','be','by','com','edu','for','from','how','i','in','is','it','of','on','that','the','this','to','was','what','when','where','which','who','why','will','with') GROUP BY term",
    "proximity_weight": f"WITH {BASE} SELECT doc_id, round(sum(CASE WHEN gap = 1 THEN 3.0 ELSE 1.0 END)::DOUBLE, 6) AS score FROM (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM low WHERE term IN ('that', 'with')) GROUP BY doc_id",
    "co_occurrence": f"WITH {BASE} SELECT doc_id, round(CASE WHEN l > 0 AND r > 0 THEN (l + r) * 1.2 ELSE l + r END, 6) AS score FROM {_FULL}",
    "frequent_demotion": f"WITH {BASE} SELECT term, count(*) AS term_count FROM low GROUP BY term HAVING count(*) * 100.0 / (SELECT n FROM nn) > 100.0",
    "max_sort_key": f"SELECT doc_id, round(s / max(s) OVER (), 6) AS relative FROM ({scored(either(THAT, WITH)).replace('round(s.w / ln(n + 1.0), 6) AS score', 's.w / ln(n + 1.0) AS s')})",
    "topk_relevance": scored(either(THAT, WITH)) + " ORDER BY round(s.w / ln(n + 1.0), 9) DESC, s.doc_id LIMIT 10", "splice_page": scored(either(THAT, WITH)) + " ORDER BY round(s.w / ln(n + 1.0), 9) DESC, s.doc_id LIMIT 15 OFFSET 10", "sort_none": scored(THAT),
    "sort_date": "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y%m%d000000')::BIGINT AS ansi_date FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' ORDER BY ansi_date, doc_id LIMIT 50",
    "sort_rank": "SELECT o_orderkey AS doc_id, o_custkey AS rank FROM orders WHERE lower(o_orderpriority) LIKE '%high%' ORDER BY o_custkey DESC, doc_id LIMIT 50",
    "sort_item": "SELECT p_partkey AS doc_id, p_size::BIGINT AS size FROM part WHERE list_contains(regexp_extract_all(lower(p_type), '[a-z]+'), 'promo') ORDER BY p_size DESC, doc_id LIMIT 50",
    "filter_date": "SELECT o_orderkey AS doc_id FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND strftime(o_orderdate, '%Y%m%d')::BIGINT BETWEEN 19960000 AND 19970630",
    "filter_date_name": "SELECT o_orderkey AS doc_id FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND year(o_orderdate) >= 1996",
    "restriction_only": f"WITH {BASE} SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM low WHERE term IN ('le', 'la'))",
    "list_filter": f"WITH {BASE} SELECT DISTINCT doc_id FROM low WHERE term = 'with' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "multi_field": r"SELECT p_partkey AS doc_id FROM part WHERE list_contains(regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+'), 'medium') AND list_contains(regexp_extract_all(lower(p_brand), '[\p{L}\p{N}]+'), '13')",
}

_ITEM = "(SELECT text FROM benchmark ORDER BY item_id LIMIT 1)"


def _feedback(weight: str) -> str:
    """Documents' feedback scores: the heaviest terms of the first item, at most 8 % of the documents each."""
    words = f"(SELECT unnest(regexp_extract_all({_ITEM}, '{ALNUM}')) AS w)"
    forms = rf"(SELECT lower(w) AS term FROM {words} WHERE NOT regexp_matches(w, '^\p{{Nd}}+$') UNION ALL SELECT w FROM {words} WHERE regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '\p{{Ll}}'))"
    cand = f"(SELECT term, i.w * count(*) AS weight, i.w AS w FROM {forms} JOIN idf i USING (term) WHERE i.df / (SELECT n FROM nn) <= 0.08 GROUP BY term, i.w)"
    chosen = f"(SELECT term, w FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY weight DESC, term) AS r FROM {cand}) WHERE r <= greatest(10, floor(n * 0.25)))"
    return f"(SELECT p.doc_id, sum(c.w * {weight.format(used=f'(SELECT count(*) FROM {chosen})')}) AS w FROM posts p JOIN {chosen} c USING (term) GROUP BY p.doc_id)"


def _adjusted(base: str, weight: str, norm: str) -> str:
    total = "s.w + coalesce(f.w, 0)"
    return f"WITH {BASE} SELECT s.doc_id, round((CASE WHEN {total} < 0 THEN 1e-10 ELSE {total} END) / {norm}, 6) AS score FROM (SELECT doc_id, sum(w) AS w FROM {base} GROUP BY doc_id) s JOIN lens USING (doc_id) LEFT JOIN {_feedback(weight)} f USING (doc_id)"


ORACLE |= {
    "feedback_pos": f"WITH {BASE} SELECT doc_id, round(w, 6) AS score FROM {_feedback('0.1')} WHERE w > 0",
    "feedback_neg": _adjusted(WITH, "(-greatest(0.1, least(1.0, 1 / (ln({used}) + 1.0))))", "1.0"),
    "feedback_mixed": _adjusted(either(THAT, WITH), "greatest(0.1, least(1.0, 2 / (ln({used}) + 1.0)))", "ln(n + 1.0)"),
    "key_terms": rf"""WITH {BASE}, words AS (SELECT item_id, unnest(regexp_extract_all(text, '{ALNUM}')) AS w FROM benchmark),
        forms AS (SELECT item_id, lower(w) AS term FROM words WHERE NOT regexp_matches(w, '^\p{{Nd}}+$') UNION ALL SELECT item_id, w FROM words WHERE regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '\p{{Ll}}')),
        tf AS (SELECT item_id, term, count(*) AS tf FROM forms GROUP BY 1, 2),
        cand AS (SELECT item_id, term, tf, i.w * tf AS weight FROM tf JOIN idf i USING (term), nn WHERE i.df / nn.n <= 0.5),
        r AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, term) AS rank FROM cand WHERE weight > 0)
        SELECT item_id::VARCHAR AS key, rank::INTEGER AS rank, term, tf, round(weight, 6) AS weight FROM r WHERE rank <= greatest(10, floor(n * 0.2))""",
    "key_phrases": rf"""WITH {BASE}, ph AS (SELECT item_id, lower(trim(regexp_replace(unnest(string_split_regex(text, '[.,]\s*')), '\s+', ' ', 'g'))) AS phrase FROM benchmark),
        c AS (SELECT item_id, phrase, count(*) AS n FROM ph WHERE phrase <> '' GROUP BY 1, 2),
        w AS (SELECT item_id, phrase, n, unnest(regexp_extract_all(phrase, '{ALNUM}')) AS term FROM c),
        s AS (SELECT item_id, phrase, n, bool_or(i.w IS NULL OR length(term) < 2) AS bad, sum(i.w) AS idf FROM w LEFT JOIN idf i USING (term) GROUP BY 1, 2, 3),
        r AS (SELECT item_id, phrase, n, idf * n AS weight, count(*) OVER (PARTITION BY item_id) AS every, row_number() OVER (PARTITION BY item_id ORDER BY idf * n DESC, phrase) AS rank FROM s WHERE NOT bad)
        SELECT item_id::VARCHAR AS key, rank::INTEGER AS rank, phrase, n, round(weight, 6) AS weight FROM r WHERE rank <= greatest(10, floor(every * 0.2))""",
}

_TALKS = "(SELECT conv_id * 1000 + turn AS doc_id, 'en' AS lang, text FROM conversations)"


def _local(name: str, source: str, idf: str = "") -> str:
    base = BASE.replace("FROM documents", f"FROM {source}")
    return f"SELECT '{name}' AS index_name, doc_id, score FROM (" + (f"WITH {base}" + scored(either(THAT, WITH))[len(f'WITH {BASE}') :]) + ")"


_BOTH = "(SELECT 'documents' AS ix, doc_id, text FROM documents UNION ALL SELECT 'talks', conv_id * 1000 + turn, text FROM conversations)"
ORACLE |= {
    "virtual_local_idf": f"{_local('documents', 'documents')} UNION ALL {_local('talks', _TALKS)}",
    "virtual_global_idf": f"""WITH d AS {_BOTH}, t AS (SELECT ix, doc_id, unnest(regexp_extract_all(lower(text), '{ALNUM}')) AS term FROM d), h AS (SELECT * FROM t WHERE term IN ('that', 'with')),
        df AS (SELECT term, ln((SELECT count(*) FROM d) / count(*)::DOUBLE) AS w FROM (SELECT DISTINCT ix, doc_id, term FROM h) GROUP BY term)
        SELECT ix AS index_name, doc_id, round(sum(CASE WHEN w > 0 THEN w ELSE 1.0 END) / ln(max(n) + 1.0), 6) AS score FROM h JOIN df USING (term) JOIN (SELECT ix, doc_id, len(regexp_extract_all(text, '{ALNUM}')) AS n FROM d) USING (ix, doc_id) GROUP BY 1, 2""",
    "search_report": f"WITH {BASE} SELECT 'the' AS term, -1::BIGINT AS term_count, -1::BIGINT AS doc_count, 'stop' AS status UNION ALL SELECT 'that', -1, -1, 'stop' UNION ALL SELECT 'zzzznowhere', -2, -2, 'missing'",
    "merged_report": f"SELECT term, count(*) AS term_count, count(DISTINCT (ix, doc_id)) AS doc_count FROM (SELECT ix, doc_id, unnest(regexp_extract_all(lower(text), '{ALNUM}')) AS term FROM {_BOTH}) WHERE term IN ('that', 'with') GROUP BY term",
    "index_info": f"WITH {BASE} SELECT 'documents' AS index_name, (SELECT count(*) FROM documents) AS n_docs, count(DISTINCT term) AS unique_terms, count(*) AS total_terms FROM low",
    "field_info": "SELECT 1::INTEGER AS field_id, 'text' AS name, TRUE AS stemming, TRUE AS stop_term, TRUE AS term_position",
    "term_info": f"WITH {BASE} SELECT term, 1::INTEGER AS term_type, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM posts WHERE regexp_matches(term, '^there.*$') GROUP BY term",
    "doc_info": f"WITH {BASE} SELECT doc_id, doc_id::VARCHAR AS doc_key, lang, n::BIGINT AS term_count FROM lens WHERE doc_id = 17",
    "retrieve_bytes": "SELECT doc_id::VARCHAR AS doc_key, substr(text, 11, 50) AS chunk FROM documents WHERE doc_id = 17",
    "length_histogram": f"WITH {BASE} SELECT length(term)::BIGINT AS length, count(DISTINCT term) AS terms, count(*) AS occurrences FROM low GROUP BY 1",
    "index_verify": f"WITH {BASE} SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'terms', count(DISTINCT term) FROM posts UNION ALL SELECT 'postings', count(*) FROM posts UNION ALL SELECT 'terms_off', 0 UNION ALL SELECT 'postings_without_document', 0",
}
_TOP = f"({ORACLE['topk_relevance']})"
ORACLE |= {
    "results_json": f"""SELECT '{{"doc_id":' || doc_id || '}}' AS value FROM {_TOP}""", "results_xml": f"SELECT '<result><doc_id>' || doc_id || '</doc_id></result>' AS value FROM {_TOP}", "results_notation": f"""SELECT '{{"doc_id" => ' || doc_id || '}}' AS value FROM {_TOP}""",
    "results_run": f"SELECT '1 Q0 ' || doc_id || ' ' || row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) || ' ' || printf('%.6f', s / max(s) OVER ()) || ' run' AS value FROM ({scored(either(THAT, WITH)).replace('round(s.w / ln(n + 1.0), 6) AS score', 's.w / ln(n + 1.0) AS s')} ORDER BY round(s.w / ln(n + 1.0), 9) DESC, s.doc_id LIMIT 10)",
    "log_counters": "SELECT event_type, count(*) AS n FROM events GROUP BY 1", "log_clients": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "log_times": "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1",
    "log_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY 1", "log_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "log_concurrency": """WITH s AS (SELECT date_trunc('second', ts) AS a, date_trunc('second', ts + to_seconds(floor(value * 60)::BIGINT)) AS b FROM events), st AS (SELECT a AS ts, 1 AS d FROM s UNION ALL SELECT b, -1 FROM s),
        g AS (SELECT ts, sum(d) AS d, count(*) FILTER (d > 0) AS up FROM st GROUP BY ts), r AS (SELECT ts, coalesce(sum(d) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + up AS open FROM g)
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, max(open)::BIGINT AS most FROM r GROUP BY 1""",
    "log_slow": "SELECT event_id, value FROM events WHERE value >= 60", "log_top": "SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 10",
    "log_frequency": "SELECT times, count(*) AS searches FROM (SELECT user_id, count(*) AS times FROM events GROUP BY 1) GROUP BY 1",
    "log_window": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}

_S = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(term, 's$', ''), '^(.{2,64})r$', '\1'), '^(.{2,64})e$', '\1'), '^(.{2,64})é$', '\1')"
ORACLE |= {
    "stem_plural_fr": rf"""SELECT term, stem FROM (SELECT term, CASE WHEN length(term) <= 5 THEN term WHEN term LIKE '%aux' THEN left(term, length(term) - 3) || 'al' WHEN term LIKE '%x' THEN left(term, length(term) - 1)
        WHEN length(s) > 2 AND right(s, 1) = substr(s, length(s) - 1, 1) AND regexp_matches(s, '\p{{L}}$') THEN left(s, length(s) - 1) ELSE s END AS stem FROM (SELECT term, {_S} AS s FROM ({LOW}))) WHERE stem <> term""",
    "typo_expansion": f"WITH {BASE} SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM posts WHERE term LIKE 't%' AND damerau_levenshtein(term, 'ther') <= 1 GROUP BY term",
    "source_index_stream": f"SELECT term, count(*) AS term_count, count(DISTINCT item_id) AS doc_count FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{ALNUM}')) AS term FROM benchmark) GROUP BY term",
}
for _form in ("para", "mbox", "refer", "tagged_text", "tagged_xml", "feed", "medline", "omim", "trec"):
    ORACLE[f"source_{_form}"] = r"SELECT item_id::VARCHAR AS key, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM benchmark"


# --- neighbours: OR multiplies a posting right after another, AND what has added up ------------------------------------------


def _tagged(a: str, b: str) -> str:
    return f"(SELECT doc_id, pos, w, 1 AS side FROM {a} UNION ALL SELECT doc_id, pos, w, 0 FROM {b})"


_ORDER = "OVER (PARTITION BY doc_id ORDER BY pos, side, w{})"


def next_or(a: str, b: str) -> str:
    return f"(SELECT doc_id, pos, CASE WHEN pos = before + 1 THEN w * 3.0 ELSE w END AS w FROM (SELECT *, lag(pos) {_ORDER.format('')} AS before FROM {_tagged(a, b)}))"


def next_and(a: str, b: str) -> str:
    jumps = f"(SELECT *, CASE WHEN side = 0 AND pos = lag(pos) {_ORDER.format('')} + 1 THEN 1 ELSE 0 END AS jump, count(DISTINCT side) OVER (PARTITION BY doc_id) AS sides FROM {_tagged(a, b)})"
    return f"(SELECT doc_id, max(pos) AS pos, sum(w * pow(3.0, n)) AS w FROM (SELECT *, sum(jump) {_ORDER.format(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS n FROM {jumps} WHERE sides = 2) GROUP BY doc_id)"


def _log_scored(p: str) -> str:
    return scored(p).replace("round(s.w / ln(n + 1.0), 6) AS score", "round(ln(s.w / ln(n + 1.0)), 6) AS log_score")


ORACLE |= {"prox_or": scored(next_or(THAT, WITH)), "prox_three": scored(next_or(next_or(OF, THE), AND)), "prox_and": _log_scored(next_and(OF, THE)), "prox_mixed": _log_scored(next_or(next_and(OF, THE), WITH))}

# --- stems by language -------------------------------------------------------------------------------------------------------

_FRENCH = r"""CASE WHEN length(term) <= 5 THEN term WHEN term LIKE '%aux' THEN left(term, length(term) - 3) || 'al' WHEN term LIKE '%x' THEN left(term, length(term) - 1)
    WHEN length(s) > 2 AND right(s, 1) = substr(s, length(s) - 1, 1) AND regexp_matches(s, '\p{L}$') THEN left(s, length(s) - 1) ELSE s END"""


def _case(lang: str) -> str:
    return "CASE " + " ".join(f"WHEN length(term) > {above} AND regexp_matches(term, '{end}$') THEN substr(term, 1, length(term) - {n}) || '{add}'" for above, end, n, add in PLURAL_RULES[lang]) + " ELSE term END"


_STEM = f"CASE lang WHEN 'en' THEN {_case('en')} WHEN 'fr' THEN {_FRENCH} WHEN 'de' THEN {_case('de')} WHEN 'es' THEN {_case('es')} ELSE {_case('xx')} END"
_STEMMED = f"vocab AS (SELECT lang, term, {_STEM} AS stem FROM (SELECT *, {_S} AS s FROM (SELECT DISTINCT lang, term FROM low))), stems AS (SELECT doc_id, stem AS term, pos FROM low JOIN vocab USING (lang, term))"
ORACLE |= {
    "stem_by_language": f"WITH {BASE}, {_STEMMED} SELECT lang, term, stem FROM vocab WHERE stem <> term",
    "stemmed_index": f"WITH {BASE}, {_STEMMED} SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM stems GROUP BY term",
    "default_analysis": f"""WITH {BASE}, {_STEMMED}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM stems WHERE term IN ('and', 'her') GROUP BY term), wt AS (SELECT term, CASE WHEN ln(n / df) > 0 THEN ln(n / df) ELSE 1.0 END AS w FROM df, nn)
        SELECT s.doc_id, round(s.w / ln(n + 1.0), 6) AS score FROM (SELECT doc_id, sum(w) AS w FROM stems JOIN wt USING (term) GROUP BY doc_id) s JOIN lens USING (doc_id)""",
    "report_counters": f"""WITH {BASE}, m AS (SELECT DISTINCT doc_id, lang FROM low WHERE term = 'of'), f AS (SELECT lang NOT IN ('en', 'fr') AS foreign_, doc_id NOT IN {among('with')} AS outside, doc_id IN {among('by')} AS inside FROM m)
        SELECT 'documents' AS index_name, count(*) AS matched, 0::BIGINT AS failed_date, count(*) FILTER (foreign_) AS failed_language, count(*) FILTER (outside) AS not_included, count(*) FILTER (inside) AS excluded, count(*) FILTER (NOT foreign_ AND NOT outside AND NOT inside) AS returned FROM f""",
    "list_filter_file": f"WITH {BASE}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{ALNUM}')) AS term FROM benchmark WHERE item_id % 5 = 0) SELECT DISTINCT doc_id FROM low WHERE term = 'of' AND doc_id IN (SELECT doc_id FROM posts WHERE term IN (SELECT term FROM words WHERE length(term) > 9))",
    "field_filter": r"SELECT p_partkey AS doc_id FROM part WHERE regexp_matches(lower(p_type), '(^|[^\p{L}\p{N}])(promo([^\p{L}\p{N}]|$)|med)') AND NOT list_contains(regexp_extract_all(lower(p_brand), '[\p{L}\p{N}]+'), '13') AND (list_contains(regexp_extract_all(lower(p_brand), '[\p{L}\p{N}]+'), 'brand'))",
    "stop_fielded": f"WITH {BASE} SELECT 2::INTEGER AS field_id, count(DISTINCT doc_id) AS documents, count(*) AS n FROM low WHERE term = 'the'",
    "terms_stop": f"WITH {BASE} SELECT term, 2::INTEGER AS term_type, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM posts WHERE lower(term) IN (SELECT term FROM ({ORACLE['stop_flags']})) GROUP BY term",
    "terms_regular": f"WITH {BASE} SELECT term, 1::INTEGER AS term_type, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM posts WHERE lower(term) NOT IN (SELECT term FROM ({ORACLE['stop_flags']})) GROUP BY term",
    "term_comparison": rf"WITH {BASE} SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count FROM posts WHERE (regexp_matches(term, '^[0-9]{{1,18}}$') AND TRY_CAST(term AS BIGINT) >= 1900) OR (regexp_matches(term, '\p{{Ll}}') AND NOT regexp_matches(term, '\p{{Lu}}') AND lower(term) < 'abc') GROUP BY term",
    "server_info": "SELECT 'documents' AS name, 'nobody' AS administrator",
    "index_list": f"SELECT ix AS index_name, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS unique_terms FROM (SELECT ix, doc_id, unnest(regexp_extract_all(lower(text), '{ALNUM}')) AS term FROM {_BOTH}) GROUP BY ix",
    "stored_index": f"WITH {BASE} SELECT term, count(*) AS n, sum(pos)::BIGINT AS places, max(doc_id) AS last FROM posts GROUP BY term",
    "log_parsed": """SELECT event_id AS process, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_type = 'error' THEN 'search_error' ELSE 'search' END AS kind, event_type || CASE WHEN event_type = 'error' THEN '' ELSE '+all' END AS indexes,
        CASE WHEN event_type <> 'error' THEN 'Word' || user_id || '  of {language:en}' END AS search, CASE WHEN event_type <> 'error' THEN user_id + 7 ELSE -1 END AS found, CASE WHEN event_type <> 'error' THEN printf('%.4f', abs(value))::DOUBLE ELSE -1.0 END AS seconds FROM events""",
    "log_by_index": "SELECT index_name, count(*) FILTER (event_type <> 'error') AS searches, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT event_type, event_type AS index_name FROM events UNION ALL SELECT event_type, 'all' FROM events WHERE event_type <> 'error') GROUP BY 1",
    "log_searches": "SELECT 'word' || user_id || ' of' AS key, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY n DESC, key LIMIT 10",
    "log_script": """SELECT 'search "' || event_type || ',all" "Word' || user_id || '  of {language:en}"' AS value FROM events WHERE event_type <> 'error'""",
    "source_text": f"SELECT item_id::VARCHAR AS key, 'Item ' || item_id AS title, md5(array_to_string(list_transform(range(1, len(w) + 1, 2), lambda i: array_to_string(w[i:i + 1], ' ')), chr(10))) AS digest FROM (SELECT item_id, regexp_extract_all(text, '{ALNUM}') AS w FROM benchmark) WHERE len(w) > 0",
    "source_line": f"SELECT lower(term) AS term, count(*) AS term_count, count(DISTINCT item_id) AS doc_count FROM (SELECT item_id, unnest(list_transform(range(1, len(w) + 1, 2), lambda i: array_to_string(w[i:i + 1], ' '))) AS term FROM (SELECT item_id, regexp_extract_all(text, '{ALNUM}') AS w FROM benchmark)) GROUP BY 1",
    "source_selected": "SELECT item_id::VARCHAR AS key FROM benchmark WHERE item_id % 2 = 0",
}

ORACLE |= {
    "first_classes": f"SELECT CASE WHEN regexp_matches(token, '^[0-9]') THEN 'digit' WHEN regexp_matches(token, '^[A-Z]') THEN 'upper' WHEN regexp_matches(token, '^[a-z]') THEN 'lower' ELSE 'high' END AS kind, count(*) AS n FROM ({VOCABULARY}) GROUP BY 1",
    "charset_recoded": r"SELECT doc_id, md5(text) AS digest FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x{FF}]')",
    "utf8_cleaned": "SELECT doc_id, md5(text || ' ') AS digest FROM documents",
    "stripped_tokens": rf"SELECT token, bare FROM (SELECT token, regexp_replace(token, '[{TAIL_PUNCT}]+$', '') AS bare FROM (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS token FROM documents)) WHERE bare <> token",
    "capped_page": scored(either(THAT, WITH)) + " ORDER BY round(s.w / ln(n + 1.0), 9) DESC, s.doc_id LIMIT 5",
    "federated_page": f"SELECT * FROM ({ORACLE['virtual_local_idf']}) ORDER BY score DESC, index_name, doc_id LIMIT 20",
}
