"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


MARKS = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '{MARKS}', '\1\2\\\3', 'g')) + length(regexp_replace(text, '{MARKS}', '\1\2\\\3', 'g')) + length('<|turn|><|text|><|end|>') AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(a) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g"""

WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
CONTAMINATION = f"""
WITH i AS (SELECT item_id, regexp_extract_all({lower("text")}, {WORD}) AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM i WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower("text")}, {WORD}) AS w FROM documents),
g AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT doc_id, p, k, item_id FROM g JOIN win USING (k, t)),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS x FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, {5 * i // 4 + 1}, 2))::INTEGER >> {3 - 5 * i % 4}) & 31) + 1)::INTEGER, 1)" for i in range(32)
)
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS s FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (html)"""

SPACE = r"'[^\x20\x09-\x0D]+'"
NEAR = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower("text")}, {SPACE}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(w[p : p + 4], ' ')) AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
y AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT b, r FROM r JOIN y ON a = node),
m AS (SELECT node AS doc_id, min(r) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

LINES = f"""
WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, len(regexp_extract_all(t, {SPACE})) AS w FROM o WHERE regexp_matches(t, {SPACE})),
u AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
a AS (SELECT x.doc_id, x.i AS s, min(y.i) AS e FROM u x JOIN u y ON y.doc_id = x.doc_id AND y.i >= x.i AND y.i < x.i + 50 AND y.upto - x.upto + x.w >= 50 GROUP BY 1, 2),
b AS (SELECT x.doc_id, max(y.i) AS s, x.i AS e FROM u x JOIN u y ON y.doc_id = x.doc_id AND y.i <= x.i AND y.i > x.i - 50 AND x.upto - y.upto + y.w >= 50 GROUP BY x.doc_id, x.i),
v AS MATERIALIZED (SELECT doc_id, s, e FROM a UNION SELECT doc_id, s, e FROM b),
x AS MATERIALIZED (SELECT v.doc_id, s, e, string_agg(t, chr(10) ORDER BY i) AS t FROM v JOIN u ON u.doc_id = v.doc_id AND i BETWEEN s AND e GROUP BY 1, 2, 3),
f AS (SELECT t, min((doc_id, s)) AS first FROM x GROUP BY 1),
g AS MATERIALIZED (SELECT DISTINCT x.doc_id, i FROM x JOIN f USING (t) JOIN u ON u.doc_id = x.doc_id AND i BETWEEN s AND e WHERE (x.doc_id, s) > first),
k AS (SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_deleted_lines, coalesce(sum(w) FILTER (g.i IS NOT NULL), 0)::BIGINT AS n_deleted_words FROM u LEFT JOIN g USING (doc_id, i) GROUP BY 1),
z AS (SELECT o.doc_id, string_agg(o.t, chr(10) ORDER BY o.p) AS text FROM o LEFT JOIN l ON l.doc_id = o.doc_id AND l.p = o.p LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted_lines, 0) AS n_deleted_lines, coalesce(n_deleted_words, 0) AS n_deleted_words, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(z.text, '') END AS text
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN z USING (doc_id)"""


EIGHT = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda t: ascii(t)::BIGINT)), lambda c, b: xor(c >> 8, {EIGHT})), 4294967295)"
BASE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {CRC} % 7 = 2 AS held_out, list_concat(regexp_extract_all({lower("text")}, {SPACE}), [chr(10)]) AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, held_out, unnest(w) AS w FROM d), c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 6) AS base_score FROM t LEFT JOIN c USING (w) CROSS JOIN n GROUP BY doc_id"""
QUALITY = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {SPACE}) AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d)),
r AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS k FROM g) WHERE k > 1) GROUP BY 1),
l AS (SELECT doc_id, (count(*) - count(DISTINCT t))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM d) WHERE regexp_matches(t, {SPACE}) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""

NEGATIVES = """
WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower("text")}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
s AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p WHERE regexp_matches(t, '[^\x20\x09]')),
o AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM s CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(k) WHERE len(w) >= k),
g AS MATERIALIZED (SELECT lang, k, w[i : i + k - 1] AS w, count(*) AS f FROM o GROUP BY 1, 2, 3),
m AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM g WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.w, c.f AS a, cut, l.f AS l, r.f AS r, 2000000::HUGEINT * c.f // (l.f + r.f) AS score FROM c JOIN (VALUES (1), (2), (3)) AS t(cut) ON cut < c.k JOIN g l ON l.lang = c.lang AND l.w = c.w[1 : cut] JOIN g r ON r.lang = c.lang AND r.w = c.w[cut + 1 : c.k]),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
h AS (SELECT lang, w[i : j] AS w, max(f) AS longer FROM c JOIN (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS t(i, j) ON j <= k AND j - i + 1 < k GROUP BY 1, 2)
SELECT y.lang, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, array_to_string(y.w, ' ')) AS rank, array_to_string(y.w, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM y JOIN m ON m.lang = y.lang LEFT JOIN h ON h.lang = y.lang AND h.w = y.w WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, array_to_string(y.w, ' ')) <= 2000"""


def url_sql() -> str:
    """The rules of op11 as rows, the vocabulary as one pattern a term."""
    from .registry import URL_RULES
    from .urls import LIMIT, weights

    text = "coalesce(url, '')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    terms = ", ".join(f"('{t}', {w})" for t, w in weights().items())
    edge = r"[^a-z0-9\x80-\x{10FFFF}]"
    return f"""
WITH a AS (SELECT page_id, {lower("url")} AS u, CASE WHEN strpos({text}, '://') > 0 THEN regexp_extract(substr({text}, strpos({text}, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, {lower("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM a),
r AS (SELECT * FROM (VALUES {rules}) AS r(h, p, v)), t AS (SELECT * FROM (VALUES {terms}) AS t(term, w)),
f AS (SELECT page_id, arg_max(h || p, (length(h || p), v)) AS rule, arg_max(v, (length(h || p), v)) AS said FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
x AS (SELECT page_id, sum(w)::BIGINT AS weight, string_agg(term, ',' ORDER BY term) AS terms FROM b JOIN t ON regexp_matches(u, '(^|{edge})' || term || '($|{edge})') GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(weight, 0) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(weight, 0) AS weight, coalesce(terms, '') AS terms FROM b LEFT JOIN f USING (page_id) LEFT JOIN x USING (page_id)"""


def oracle() -> dict[str, str]:
    return {"op2_chat": CHAT, "op3_decontaminate": CONTAMINATION, "op4_warc": WARC, "op7_neardup": NEAR, "op10_linededup": LINES, "op11_urls": url_sql(), "op12_negatives": NEGATIVES, "op13_phrases": PHRASES, "lm_base": BASE, "quality_base": QUALITY}
