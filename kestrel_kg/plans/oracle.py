"""The same queries in DuckDB SQL, written from the operators' rules and not from their plans."""

from __future__ import annotations

from .fixture import CENTRE, PREFERRED, QUESTIONS, SPECS
from ..operators.context import DEFAULT, DIAGNOSIS, DIAGNOSIS_WORDS, TREATMENT, TREATMENT_WORDS
from .queries import ALPHAS, CLINICAL, STEPS, THETA, THETAS

CLAIM_STOP = "['the','and','for','with','как','что','при','для','или','это','по','на','в','и']"
LABEL_STOP = "['a','an','and','by','for','in','of','on','or','the','to','with','в','и','или','при','с','у']"


def norm(x: str) -> str:
    return f"rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '\\s+', ' ', 'g'), ' ([,.;:])', '\\1', 'g'), '([,.;:])', '\\1 ', 'g'), '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def search_text(x: str) -> str:
    """Without the two rules of clinical names, which the test tables don't hold."""
    return f"replace({fold(x)}, 'ё', 'е')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({search_text(x)}, '[a-zа-я0-9]+\\+?')"


def content(x: str) -> str:
    return f"list_sort([t for t in list_distinct(regexp_extract_all(replace(lower({x}), 'ё', 'е'), '[a-zа-я0-9]+\\+?')) if length(t) > 1 and not list_contains({CLAIM_STOP}, t)])"


def words(x: str) -> str:
    return f"[w for w in string_split_regex({x}, '\\s+') if w <> '']"


def crc32(x: str) -> str:
    """DuckDB has none: byte by byte, bit by bit, of an ASCII string."""
    eight = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda t: ascii(t)::BIGINT)), lambda c, b: xor(c >> 8, {eight})), 4294967295)"


CHUNKS = f"""
w AS (SELECT 'doc_' || doc_id AS document_id, {words('text')} AS w FROM documents),
c AS (SELECT document_id, w, unnest(generate_series(0, greatest(ceil((len(w) - 100) / 80.0), 0)::BIGINT)) AS i FROM w WHERE len(w) > 0),
chunks AS (SELECT document_id, document_id || '::chunk-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0') AS chunk_id, i AS chunk_index,
  i * 80 AS start_word, least(i * 80 + 100, len(w)) AS end_word, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS text FROM c)"""

LABELS = """
l AS (SELECT p_brand || ' ' || p_name AS label, [p_name || ' ' || p_brand] AS aliases FROM part UNION ALL SELECT s_name, [] FROM supplier)"""

G = f"""
m AS (SELECT 0 AS a, r_regionkey::BIGINT AS b, r_name AS label, 'Region' AS entity_type, '' AS description, '' AS aliases FROM region
  UNION ALL SELECT 1, n_nationkey, n_name, 'Nation', '', '' FROM nation
  UNION ALL SELECT 2, s_suppkey, s_name, 'Supplier', '', '' FROM supplier
  UNION ALL SELECT 3, p_partkey, p_name || ' ' || p_partkey, CASE WHEN p_partkey % 97 = 0 THEN 'Gadget' WHEN p_partkey % 89 = 0 THEN 'Other' ELSE 'Part' END, p_type, p_brand FROM part),
ent AS MATERIALIZED (SELECT md5({norm('label')}) AS entity_id, row_number() OVER (ORDER BY a, b) - 1 AS ord, label, entity_type, description, aliases FROM m),
it AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49),
sup AS (SELECT n, s_name AS s, p_name || ' ' || p_partkey AS p, round(1 - l_discount, 2) AS confidence, 'order_' || l_orderkey || '::chunk-' || lpad(l_linenumber::VARCHAR, 4, '0') AS source_chunk
  FROM it JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
e AS (SELECT 0 AS kind, n_nationkey::BIGINT AS k, n_name AS s, 'located_in' AS predicate, r_name AS o, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS source_chunk FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1, s_suppkey, s_name, 'based_in', n_name, 1.0, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 2, n, CASE WHEN n % 11 = 3 THEN p ELSE s END, CASE WHEN n % 11 <> 3 AND n % 13 = 5 THEN 'ships' ELSE 'supplies' END,
    CASE WHEN n % 11 = 3 THEN s WHEN n % 13 <> 5 AND n % 17 = 7 THEN s ELSE p END, confidence, source_chunk FROM sup),
rel AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kind, k) - 1 AS relation_index, md5({norm('s')}) AS subject_id, predicate, md5({norm('o')}) AS object_id, confidence, source_chunk, s AS subject_label, o AS object_label FROM e),
edges AS MATERIALIZED (SELECT DISTINCT subject_id AS src, object_id AS dst FROM rel)"""

SPEC = "spec(predicate, domain, range) AS (VALUES " + ", ".join(str(s) for s in SPECS) + ")"
FULL = f"""{G}, {SPEC},
f AS MATERIALIZED (SELECT rel.*, s.entity_type AS st, o.entity_type AS ot, spec.domain, spec.range FROM rel JOIN ent s ON s.entity_id = subject_id JOIN ent o ON o.entity_id = object_id LEFT JOIN spec USING (predicate)),
act AS (SELECT *, CASE WHEN subject_id = object_id THEN 'removed_self_loops' WHEN domain IS NULL THEN 'invalid_predicate_relaxed'
  WHEN (domain = 'Other' OR st = domain) AND (range = 'Other' OR ot = range) THEN 'kept' WHEN (domain = 'Other' OR ot = domain) AND (range = 'Other' OR st = range) THEN 'reversed' ELSE 'domain_range_relaxed' END AS action FROM f)"""
VIOLATIONS = f"""{FULL},
v AS (SELECT 'invalid_entity_type' AS kind, entity_id, NULL::BIGINT AS relation_index, NULL AS predicate, NULL AS subject_id, NULL AS object_id, 'Nation|Other|Part|Region|Supplier' AS expected, entity_type AS actual FROM ent WHERE entity_type NOT IN ('Region','Nation','Supplier','Part','Other')
  UNION ALL SELECT 'self_loop', NULL, relation_index, predicate, subject_id, object_id, '', NULL FROM f WHERE subject_id = object_id
  UNION ALL SELECT 'invalid_predicate', NULL, relation_index, predicate, subject_id, object_id, 'based_in|located_in|related_to|supplies', predicate FROM f WHERE domain IS NULL
  UNION ALL SELECT 'domain_violation', NULL, relation_index, predicate, subject_id, object_id, domain, st FROM f WHERE domain <> 'Other' AND st <> domain
  UNION ALL SELECT 'range_violation', NULL, relation_index, predicate, subject_id, object_id, range, ot FROM f WHERE range <> 'Other' AND ot <> range)"""
DEGREES = f"""{G}, deg AS MATERIALIZED (SELECT entity_id, label, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree, (coalesce(i, 0) + coalesce(o, 0))::BIGINT AS degree FROM ent
  LEFT JOIN (SELECT dst AS entity_id, count(*) AS i FROM edges GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT src AS entity_id, count(*) AS o FROM edges GROUP BY 1) USING (entity_id))"""
SYM = "sym AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
COMPONENTS = f"""{DEGREES}, {SYM}, reach AS (SELECT entity_id AS node, entity_id AS r FROM ent UNION SELECT b, r FROM reach JOIN sym ON a = node),
comp AS MATERIALIZED (SELECT node, min(r) AS component FROM reach GROUP BY 1)"""


def pagerank() -> str:
    out = [f"{G}, n AS (SELECT count(*) AS n FROM ent), od AS MATERIALIZED (SELECT src, count(*) AS o FROM edges GROUP BY 1), r0 AS (SELECT entity_id, 1.0::DOUBLE / n AS r FROM ent, n)"]
    for i in range(1, STEPS + 1):
        out.append(
            f"r{i} AS MATERIALIZED (SELECT e.entity_id, 0.15 / n + 0.85 * (coalesce(g.s, 0) + l.d / n) AS r FROM ent e CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(r), 0) AS d FROM r{i - 1} LEFT JOIN od ON src = entity_id WHERE o IS NULL) l"
            f" LEFT JOIN (SELECT dst, sum(r / o) AS s FROM edges JOIN r{i - 1} ON entity_id = edges.src JOIN od ON od.src = edges.src GROUP BY 1) g ON g.dst = e.entity_id)"
        )
    return ",\n".join(out)


CENTRE_ROW = f"c AS (SELECT entity_id AS node FROM ent WHERE label = '{CENTRE}')"
BALL = f"""{G}, {SYM}, {CENTRE_ROW}, b1 AS (SELECT DISTINCT b AS node FROM sym JOIN c ON a = node WHERE b NOT IN (SELECT node FROM c)),
b2 AS (SELECT DISTINCT b AS node FROM sym JOIN b1 ON a = node WHERE b NOT IN (SELECT node FROM b1) AND b NOT IN (SELECT node FROM c))"""
FIVE = f"{fold('subject_label')}, {fold('predicate')}, {fold('object_label')}, subject_id, object_id, relation_index"


def bm25(docs: str, questions: str, expanded: str = "") -> str:
    """CTEs up to ``scores`` (query, doc, score) of docs (doc, text) and questions (query, question)."""
    return f"""
d AS MATERIALIZED (SELECT doc, {tokens('text')} AS t FROM ({docs})),
len AS MATERIALIZED (SELECT doc, greatest(len(t), 1) AS n FROM d), av AS (SELECT count(*)::DOUBLE AS n, avg(n) AS a FROM len),
tf AS MATERIALIZED (SELECT doc, token, count(*) AS tf FROM (SELECT doc, unnest(t) AS token FROM d) GROUP BY 1, 2),
df AS MATERIALIZED (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS MATERIALIZED (SELECT query, token, count(*) AS k FROM (SELECT query, unnest({tokens('question')}) AS token FROM ({questions})) GROUP BY 1, 2),
scores AS MATERIALIZED (SELECT query, doc, round(sum(k * ln(1 + (av.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len.n / av.a))), 6) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) JOIN len USING (doc) CROSS JOIN av GROUP BY 1, 2)"""


BENCH_Q = "SELECT item_id AS query, text AS question FROM benchmark"
DOC_SCORES = bm25("SELECT doc_id AS doc, text FROM documents", BENCH_Q)
TOP10 = f"{DOC_SCORES}, top AS MATERIALIZED (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores QUALIFY rank <= 10)"
NODE_DOCS = "SELECT entity_id AS doc, concat_ws(' ', label, label, entity_type, nullif(description, ''), nullif(aliases, ''), nullif(aliases, '')) AS text FROM ent"
QUESTION_ROWS = "VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in enumerate(QUESTIONS))
RETRIEVAL = f"""{pagerank()}, qs(query, question) AS ({QUESTION_ROWS}), {bm25(NODE_DOCS, 'SELECT * FROM qs')},
lex AS MATERIALIZED (SELECT query, entity_id AS doc, label, coalesce(score, 0) AS score FROM qs CROSS JOIN ent LEFT JOIN scores USING (query) WHERE scores.doc = entity_id
  UNION ALL SELECT query, entity_id, label, 0 FROM qs CROSS JOIN ent WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query = qs.query AND s.doc = entity_id)),
str AS MATERIALIZED (SELECT query, ent.entity_id AS doc, label, round(r, 9) AS score FROM qs CROSS JOIN r{STEPS} JOIN ent USING (entity_id)),
vec AS MATERIALIZED (SELECT entity_id AS doc, label, {{embed_doc}} FROM ent JOIN ({NODE_DOCS}) x ON x.doc = entity_id),
qv AS (SELECT query, {{embed_question}} FROM qs),
sem AS MATERIALIZED (SELECT query, doc, label, round((q0 * v0 + q1 * v1 + q2 * v2) / (sqrt(q0 * q0 + q1 * q1 + q2 * q2) * sqrt(v0 * v0 + v1 * v1 + v2 * v2)), 6) AS score FROM qv CROSS JOIN vec)"""


def hashed(x: str, name: str) -> str:
    byte = lambda i: f"(('0x' || substr(sha256({x}), {2 * i + 1}, 2))::INTEGER / 255.0::DOUBLE)"
    return ", ".join(f"{byte(i)} AS {name}{i}" for i in range(3))


RETRIEVAL = RETRIEVAL.replace("{embed_doc}", hashed("x.text", "v")).replace("{embed_question}", hashed("question", "q"))
MANY = RETRIEVAL.replace(QUESTION_ROWS, f"{BENCH_Q} UNION ALL SELECT min(p_partkey) + 1000000, p_name FROM part GROUP BY p_name")


def ranked(source: str, limit: int = 10) -> str:
    return f"SELECT query, doc AS entity_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY {source}.score DESC, {fold('label')}, doc) AS rank FROM {source} QUALIFY rank <= {limit}"


def with_rank(source: str) -> str:
    return f"SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, {fold('label')}, doc) AS rank FROM {source}"


VEC = """
ev AS MATERIALIZED (SELECT 'vec_' || lpad(vec_id::VARCHAR, 7, '0') AS entity_id, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
mt AS MATERIALIZED (SELECT a.entity_id AS left_id, b.entity_id AS right_id, greatest(0, least(1, list_cosine_similarity(a.x, b.x))) AS semantic FROM ev a JOIN ev b ON a.label = b.label AND a.entity_id < b.entity_id WHERE greatest(0, least(1, list_cosine_similarity(a.x, b.x))) >= %s),
sm AS (SELECT left_id AS a, right_id AS b FROM mt UNION SELECT right_id, left_id FROM mt),
rc AS (SELECT entity_id AS node, entity_id AS r FROM ev UNION SELECT b, r FROM rc JOIN sm ON a = node),
cp AS MATERIALIZED (SELECT node AS entity_id, min(r) AS component FROM rc GROUP BY 1),
vr AS (SELECT vec_id AS relation_index, entity_id AS subject_id, 'vec_' || lpad(((vec_id * 7 + 1) %% (SELECT max(vec_id) + 1 FROM ev))::VARCHAR, 7, '0') AS object_id FROM ev),
vl AS MATERIALIZED (SELECT * FROM vr WHERE subject_id <> object_id),
dg AS (SELECT entity_id, count(*) AS d FROM (SELECT DISTINCT subject_id AS entity_id, object_id AS x, 0 AS s FROM vl UNION ALL SELECT DISTINCT object_id, subject_id, 1 FROM vl) GROUP BY 1),
mp AS MATERIALIZED (SELECT entity_id, component, first_value(entity_id) OVER (PARTITION BY component ORDER BY coalesce(d, 0) DESC, vec_id, entity_id) AS canonical_id FROM cp JOIN ev USING (entity_id) LEFT JOIN dg USING (entity_id))""" % THETA

HITS = f"""{DEGREES}, qs(query, question) AS ({QUESTION_ROWS}),
h AS MATERIALIZED (SELECT (n % 3)::BIGINT AS query, entity_id AS doc, n // 3 + 1 AS rank FROM (SELECT entity_id, row_number() OVER (ORDER BY degree DESC, {fold('label')}, entity_id) - 1 AS n FROM deg) WHERE n < 9)"""
PREF = "CASE predicate " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PREFERRED)) + f" ELSE {len(PREFERRED)} END"
CONTEXT = f"""{HITS},
lk AS (SELECT subject_id AS doc, object_id AS near, predicate FROM rel UNION ALL SELECT object_id, subject_id, predicate FROM rel),
nb AS (SELECT query, near AS doc, min({PREF}) AS p FROM h JOIN lk USING (doc) WHERE NOT EXISTS (SELECT 1 FROM h h2 WHERE h2.query = h.query AND h2.doc = near) GROUP BY 1, 2),
nk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY p, {fold('label')}, doc) AS k FROM nb JOIN ent ON entity_id = doc),
ctx AS MATERIALIZED (SELECT query, doc, rank AS pos, true AS seed FROM h UNION ALL SELECT query, doc, 3 + k, false FROM nk WHERE k <= 37),
cr AS MATERIALIZED (SELECT s.query, rel.*, row_number() OVER (PARTITION BY s.query ORDER BY {PREF}, NOT (s.seed OR o.seed), {fold('subject_label')}, {fold('predicate')}, {fold('object_label')}, relation_index) AS place
  FROM rel JOIN ctx s ON s.doc = subject_id JOIN ctx o ON o.doc = object_id AND o.query = s.query QUALIFY place <= 50),
el AS (SELECT query, string_agg('- ' || label || ' [' || entity_type || ']' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END || '.' || CASE WHEN aliases <> '' THEN ' Aliases: ' || aliases ELSE '' END, chr(10) ORDER BY pos) AS t, string_agg(label, ', ' ORDER BY pos) FILTER (seed) AS labels FROM ctx JOIN ent ON entity_id = doc GROUP BY 1),
ln AS (SELECT query, place AS pos, subject_label || ' --' || predicate || '--> ' || object_label || ' (confidence=' || printf('%.2f', confidence) || ')' AS l FROM cr),
rl AS (SELECT query, string_agg('- ' || l, chr(10) ORDER BY pos) AS t, string_agg(l, '; ' ORDER BY pos) FILTER (pos <= 5) AS facts FROM ln GROUP BY 1)"""
PAYLOAD = f"""{HITS}, pl AS MATERIALIZED (SELECT query, rel.*, row_number() OVER (PARTITION BY query ORDER BY (sh AND oh) DESC, confidence DESC, {FIVE}) AS pos
  FROM (SELECT query, rel.relation_index AS ri, bool_or(subject_id = doc) AS sh, bool_or(object_id = doc) AS oh FROM rel JOIN h ON doc IN (subject_id, object_id) GROUP BY 1, 2) x JOIN rel ON ri = relation_index QUALIFY pos <= 15)"""
WANT = "want AS MATERIALIZED (SELECT item_id AS query, doc_id AS doc FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
EVAL = f"""{TOP10}, {WANT}, wn AS (SELECT query, count(DISTINCT doc) AS n FROM want GROUP BY 1),
hit AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS k FROM (SELECT DISTINCT query, rank FROM top JOIN want USING (query, doc))),
ev AS MATERIALIZED (SELECT query, coalesce(min(rank) <= 5, false)::INTEGER::DOUBLE AS hit_at_5, coalesce(min(rank) <= 10, false)::INTEGER::DOUBLE AS hit_at_10, coalesce(1.0 / min(rank), 0)::DOUBLE AS rr, coalesce(sum(k::DOUBLE / rank), 0) / least(any_value(n), 10) AS ap FROM wn LEFT JOIN hit USING (query) GROUP BY 1)"""
QA = "qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
PAIRS = "pr AS MATERIALIZED (SELECT round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS s, a.label = b.label AS t FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0)"
COUNTS = "count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn"
F1 = "coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)"
PARTS = f"pe AS MATERIALIZED (SELECT DISTINCT md5({norm(chr(112) + '_brand')} || ' ' || p_name) AS id, {norm(chr(112) + '_brand')} AS b, p_name AS n FROM part)"
PART_KEYS = f"""{PARTS}, vs AS (SELECT id, trim(regexp_replace(v, '[^a-z0-9_]+', ' ', 'g')) AS v FROM (SELECT id, b || ' ' || n AS v FROM pe UNION ALL SELECT id, n || ' ' || b FROM pe)),
ks AS MATERIALIZED (SELECT DISTINCT id, k FROM (SELECT id, unnest([t for t in regexp_extract_all(v, '[a-z0-9]+') if not list_contains({LABEL_STOP}, t)]) AS k FROM vs UNION ALL SELECT id, 'exact:' || v FROM vs)),
bp AS MATERIALIZED (SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM ks a JOIN ks b ON a.k = b.k AND a.id < b.id)"""

# The ratio of two texts: their longest common substring (first in the left one, then in the right one), then the same left and right of it.
# Only pairs whose characters' counts allow 0.85 are followed.
COUNTED = "list_sort(string_split(sv, ''))"
LONGEST = "list_max([struct_pack(k := x % length(a) + 1, i := -(x // length(a)), j := strpos(b, substr(a, (x // length(a) + 1)::INTEGER, (x % length(a) + 1)::INTEGER))) FOR x IN range(0, length(a) * length(a)) IF x // length(a) + x % length(a) < length(a) AND contains(b, substr(a, (x // length(a) + 1)::INTEGER, (x % length(a) + 1)::INTEGER))])"
RATIO = f"""{PART_KEYS},
sv AS MATERIALIZED (SELECT id, array_to_string(list_sort(string_split(any_value(v), ' ')), ' ') AS sv FROM vs GROUP BY id),
oc AS MATERIALIZED (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(sv, '')) AS c FROM sv) GROUP BY 1, 2),
mb AS MATERIALIZED (SELECT left_id, right_id, l.sv AS a, r.sv AS b FROM bp JOIN sv l ON l.id = left_id JOIN sv r ON r.id = right_id
  WHERE 2 * (SELECT sum(least(x.n, y.n)) FROM oc x JOIN oc y ON x.c = y.c WHERE x.id = left_id AND y.id = right_id) >= 0.85 * (length(l.sv) + length(r.sv)) - 1e-9),
sq AS (SELECT left_id, right_id, a, b, 0::BIGINT AS k FROM mb UNION ALL
  SELECT left_id, right_id, unnest([substr(a, 1, (-m.i)::INTEGER), substr(a, (-m.i + m.k + 1)::INTEGER)]), unnest([substr(b, 1, (m.j - 1)::INTEGER), substr(b, (m.j + m.k)::INTEGER)]), unnest([m.k, 0]) FROM (SELECT left_id, right_id, a, b, {LONGEST} AS m FROM sq WHERE a <> '' AND b <> '') WHERE m IS NOT NULL),
mk AS (SELECT left_id, right_id, sum(k) AS m FROM sq GROUP BY 1, 2),
lx AS MATERIALIZED (SELECT left_id, right_id, CASE WHEN a = b THEN 1.0 ELSE 2 * m::DOUBLE / (length(a) + length(b)) END AS lexical FROM mb JOIN mk USING (left_id, right_id))"""
KINDS = "pt AS MATERIALIZED (SELECT pe.id, min(p_partkey) AS ord, CASE min(p_partkey) % 3 WHEN 0 THEN 'Widget' WHEN 1 THEN 'Other' ELSE 'Part' END AS kind, CASE WHEN min(p_partkey) % 4 <> 0 THEN [min(p_partkey) % 5 + 1, min(p_partkey) % 7 + 1] END AS v FROM pe JOIN part ON pe.id = md5(" + norm("p_brand") + " || ' ' || p_name) GROUP BY 1)"
MIXED = f"""{RATIO}, {KINDS},
sx AS (SELECT lx.*, l.kind AS lk, r.kind AS rk, CASE WHEN l.v IS NOT NULL AND r.v IS NOT NULL THEN greatest(0, least(1, list_cosine_similarity(l.v::DOUBLE[], r.v::DOUBLE[]))) ELSE lexical END AS semantic FROM lx JOIN pt l ON l.id = left_id JOIN pt r ON r.id = right_id),
hx AS (SELECT left_id, right_id, lexical, semantic, CASE WHEN lk = rk OR 'Other' IN (lk, rk) THEN 0.1 * semantic + 0.9 * lexical WHEN lexical >= 0.98 THEN lexical ELSE least(lexical, semantic) * 0.75 END AS hybrid FROM sx)"""
MERGED = f"""{RATIO}, se AS (SELECT left_id AS a, right_id AS b FROM lx WHERE round(lexical, 9) >= 0.85 UNION SELECT right_id, left_id FROM lx WHERE round(lexical, 9) >= 0.85),
rx AS (SELECT id AS node, id AS r FROM sv UNION SELECT b, r FROM rx JOIN se ON a = node),
cx AS (SELECT node AS entity_id, min(r) AS component FROM rx GROUP BY 1), po AS (SELECT md5({norm("p_brand")} || ' ' || p_name) AS entity_id, min(p_partkey) AS ord FROM part GROUP BY 1)"""


def canon(x: str) -> str:
    return f"trim(regexp_replace(replace({norm(x)}, 'ё', 'е'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_+]+', ' ', 'g'))"


def oracle() -> dict[str, str]:
    w = lambda ctes, body: f"WITH RECURSIVE {ctes}\n{body}"
    rule_text = f"concat_ws(' ', text, CASE WHEN list_contains(wt, 'the') THEN 'der la' END, CASE WHEN list_contains(wt, 'und') OR list_contains(wt, 'oder') THEN 'and et' END, CASE WHEN list_contains(wt, 'pour') THEN 'for' END)"
    out = {
        "chunk_documents": w(CHUNKS, "SELECT chunk_id, chunk_index::BIGINT AS chunk_index, start_word::BIGINT AS start_word, end_word::BIGINT AS end_word, md5(text) AS text_md5 FROM chunks"),
        "chunk_stats": w(CHUNKS, "SELECT document_id, count(*) AS chunks, max(end_word)::BIGINT AS words FROM chunks GROUP BY 1"),
        "entity_ids": w(LABELS, f"SELECT label, {norm('label')} AS normal, md5({norm('label')}) AS entity_id FROM l"),
        "label_tokens": w(LABELS, f"SELECT label, array_to_string(t, '|') AS tokens, array_to_string(list_sort([x for x in list_distinct(t) if not list_contains({LABEL_STOP}, x)]), '|') AS blocking FROM (SELECT label, regexp_extract_all({norm('label')}, '[a-zа-яё0-9]+') AS t FROM l)"),
        "blocking_keys": w(
            LABELS,
            f"""SELECT key, count(*) AS labels FROM (SELECT DISTINCT rn, key FROM (
              SELECT rn, unnest([t for t in regexp_extract_all(v, '[a-zа-яё0-9]+') if not list_contains({LABEL_STOP}, t)]) AS key FROM v UNION ALL SELECT rn, 'exact:' || v FROM v)) GROUP BY 1""",
        ).replace("\nSELECT key", f", lr AS (SELECT row_number() OVER () AS rn, * FROM l), v AS (SELECT rn, {canon('x')} AS v FROM (SELECT rn, unnest(list_concat([label], aliases)) AS x FROM lr))\nSELECT key", 1),
        "canonical_text": f"SELECT doc_id, md5({canon('text')}) AS canonical_md5 FROM documents",
        "search_tokens": f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
        "content_tokens": f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id, {content('text')} AS t FROM documents)",
        "synonym_expand": f"SELECT doc_id, md5({rule_text}) AS expanded_md5 FROM (SELECT doc_id, text, regexp_extract_all({search_text('text')}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS wt FROM documents)",
        "disclaimers": "SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS clean_md5 FROM conversations",
        "kg_entities": w(G, "SELECT entity_id, ord, label, entity_type, description, aliases FROM ent"),
        "kg_relations": w(G, "SELECT relation_index, subject_id, predicate, object_id, confidence, source_chunk FROM rel"),
        "kg_merge": f"""SELECT md5({norm('label')}) AS entity_id, row_number() OVER (ORDER BY k) - 1 AS ord, label, entity_type, description, aliases FROM (
            SELECT min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS label, coalesce(arg_min(p_type, p_partkey) FILTER (p_partkey % 3 = 0), 'Other') AS entity_type, coalesce(arg_min(p_name, p_partkey) FILTER (p_partkey % 2 = 0), '') AS description,
            (SELECT string_agg(t, '|' ORDER BY f) FROM (SELECT p_type AS t, min(p_partkey) AS f FROM part q WHERE lower(q.p_brand) = lower(any_value(part.p_brand)) GROUP BY 1)) AS aliases FROM part GROUP BY lower(p_brand))""",
        "kg_stats": w(G, "SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM edges) AS edges"),
        "json_extract_entities": """SELECT 'entity' AS kind, event_type AS name, count(*) AS n, 0.0::DOUBLE AS confidence FROM events WHERE event_id % 5 <> 0 GROUP BY 2
            UNION ALL SELECT 'relation', event_type, count(*), sum(CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE FROM events WHERE event_id % 5 <> 0 GROUP BY 2
            UNION ALL SELECT 'rejected', 'a confidence that is no number', count(*), 0.0 FROM events WHERE event_id % 5 = 0""",
        "violations": w(VIOLATIONS, "SELECT * FROM v"),
        "violation_counts": w(
            VIOLATIONS,
            "SELECT count(*) AS violations, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("invalid_entity_type", "self_loop", "invalid_predicate", "domain_violation", "range_violation"))
            + ", (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations, round(greatest(0, 1 - count(*) / greatest((SELECT count(*) FROM ent) + 4 * (SELECT count(*) FROM rel), 1)), 6)::DOUBLE AS consistency FROM v",
        ),
        "auto_repair": w(G, "SELECT CASE WHEN entity_type = 'Gadget' THEN 'Other' ELSE entity_type END AS entity_type, count(*) AS n FROM ent GROUP BY 1 UNION ALL SELECT '~relations', count(*) FROM rel WHERE subject_id <> object_id"),
        "repair_actions": w(FULL, "SELECT action, count(*) AS relations FROM act GROUP BY 1"),
        "repair_relations": w(
            FULL,
            """SELECT relation_index, CASE WHEN action = 'reversed' THEN object_id ELSE subject_id END AS subject_id, CASE WHEN action LIKE '%relaxed' THEN 'related_to' ELSE predicate END AS predicate,
            CASE WHEN action = 'reversed' THEN subject_id ELSE object_id END AS object_id, CASE WHEN action LIKE '%relaxed' THEN least(confidence, 0.45) ELSE confidence END AS confidence, source_chunk,
            CASE WHEN action = 'reversed' THEN '{"repair_action":"reversed","repair_original_subject_id":"' || subject_id || '","repair_original_object_id":"' || object_id || '"}'
              WHEN action LIKE '%relaxed' THEN '{"repair_action":"' || action || '","repair_original_predicate":"' || predicate || '"}' ELSE '{}' END AS metadata FROM act WHERE action <> 'removed_self_loops'""",
        ),
        "repair_dedupe": w(
            G,
            """, d AS (SELECT relation_index, subject_id, predicate, object_id, confidence, source_chunk FROM rel UNION ALL SELECT relation_index + 1000000, subject_id, predicate, object_id, round(1.05 - confidence, 2), source_chunk FROM rel)
            SELECT min(relation_index) AS relation_index, subject_id, predicate, object_id, max(confidence) AS confidence FROM d GROUP BY subject_id, predicate, object_id, source_chunk""",
        ).replace("\n, d AS", ",\nd AS"),
        "reason_shared": w(
            FULL,
            f""", sh AS (SELECT object_id AS t, subject_id AS m, min(relation_index) AS ri FROM f WHERE predicate = 'supplies' AND st = 'Supplier' AND ot = 'Part' GROUP BY 1, 2),
            ft AS (SELECT t, min(ri) AS fa FROM sh GROUP BY 1), nm AS (SELECT entity_id, {fold('label')} AS n FROM ent)
            SELECT a.m AS subject_id, b.m AS object_id, 0.7::DOUBLE AS confidence, arg_min(a.t, (nt.n, fa, a.t)) AS via, '{{"inferred_by":"shared_condition_rule","condition_id":"' || arg_min(a.t, (nt.n, fa, a.t)) || '"}}' AS metadata FROM sh a JOIN sh b ON a.t = b.t JOIN nm na ON na.entity_id = a.m JOIN nm nb ON nb.entity_id = b.m JOIN nm nt ON nt.entity_id = a.t JOIN ft ON ft.t = a.t
            WHERE (na.n, a.m) < (nb.n, b.m) GROUP BY 1, 2""",
        ).replace("\n, sh AS", ",\nsh AS"),
        "reason_suggestions": w(
            FULL,
            f""", sh AS (SELECT DISTINCT object_id AS t, subject_id AS m FROM f WHERE predicate = 'supplies' AND st = 'Supplier' AND ot = 'Part'), nm AS (SELECT entity_id, label, {fold('label')} AS n FROM ent)
            SELECT any_value(na.label) AS subject_label, any_value(nb.label) AS object_label FROM sh a JOIN sh b USING (t) JOIN nm na ON na.entity_id = a.m JOIN nm nb ON nb.entity_id = b.m WHERE (na.n, a.m) < (nb.n, b.m) GROUP BY a.m, b.m""",
        ).replace("\n, sh AS", ",\nsh AS"),
        "infer_types": w(
            f"{G}, {SPEC}",
            f""", oe AS (SELECT entity_id, label, CASE WHEN {crc32('label')} % 4 = 0 THEN 'Other' ELSE entity_type END AS entity_type FROM ent),
            bal AS (SELECT rel.relation_index AS ri, 0 AS side, subject_id AS entity_id, domain AS vote FROM rel JOIN spec USING (predicate) WHERE predicate <> 'related_to' UNION ALL SELECT rel.relation_index, 1, object_id, range FROM rel JOIN spec USING (predicate) WHERE predicate <> 'related_to'),
            cnt AS (SELECT entity_id, vote, count(*) AS votes, min((ri, side)) AS first FROM bal JOIN oe USING (entity_id) WHERE entity_type = 'Other' AND vote <> 'Other' GROUP BY 1, 2),
            top AS (SELECT *, sum(votes) OVER (PARTITION BY entity_id) AS every, row_number() OVER (PARTITION BY entity_id ORDER BY votes DESC, first) AS k FROM cnt)
            SELECT entity_id, vote AS entity_type, votes FROM top WHERE k = 1 AND votes >= 2 AND votes / every >= 0.67""",
        ).replace("\n, oe AS", ",\noe AS"),
        "pagerank_topk": w(
            pagerank(),
            ", ch AS (" + " UNION ALL ".join(f"SELECT {i} AS i, (SELECT sum(abs(a.r - b.r)) FROM r{i} a JOIN r{i - 1} b USING (entity_id)) AS c" for i in range(1, STEPS + 1)) + f"), stop AS (SELECT min(i) AS i FROM ch, n WHERE c < n * 1e-6), pr AS (" + " UNION ALL ".join(f"SELECT {i} AS i, entity_id, r FROM r{i}" for i in range(1, STEPS + 1)) + f")\nSELECT entity_id, label, round(r, 6) AS pagerank FROM pr JOIN stop USING (i) JOIN ent USING (entity_id) ORDER BY r DESC, {fold('label')}, entity_id LIMIT 10",
        ).replace("\n, ch AS", ",\nch AS"),
        "greedy_subgraph": w(
            BALL,
            f""", inb AS (SELECT node FROM c UNION SELECT node FROM b1 UNION SELECT node FROM b2),
            o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {FIVE}) AS k FROM rel WHERE subject_id IN (SELECT node FROM inb) AND object_id IN (SELECT node FROM inb)),
            g AS (SELECT 0::BIGINT AS k, [node] AS nodes, false AS taken FROM c UNION ALL
              SELECT g.k + 1, CASE WHEN len(list_distinct(list_concat(nodes, [subject_id, object_id]))) <= 25 THEN list_distinct(list_concat(nodes, [subject_id, object_id])) ELSE nodes END, len(list_distinct(list_concat(nodes, [subject_id, object_id]))) <= 25 FROM g JOIN o ON o.k = g.k + 1)
            SELECT relation_index, subject_label, predicate, object_label FROM g JOIN o USING (k) WHERE taken""",
        ).replace("\n, inb AS", ",\ninb AS"),
        "display_ranking": w(
            f"{pagerank()}, {DEGREES.removeprefix(G + ', ')}, {CENTRE_ROW}",
            f"""SELECT relation_index, round(s, 6) AS display_score FROM (SELECT relation_index, t, 20.0::DOUBLE * t + CASE predicate WHEN 'supplies' THEN 3.0 WHEN 'based_in' THEN 2.0 WHEN 'located_in' THEN 1.0 ELSE 0.0 END + sqrt(x.degree + y.degree) + 150 * (p.r + q.r) + confidence AS s
            FROM (SELECT *, (subject_id IN (SELECT node FROM c) OR object_id IN (SELECT node FROM c))::INTEGER AS t FROM rel) JOIN deg x ON x.entity_id = subject_id JOIN deg y ON y.entity_id = object_id JOIN r{STEPS} p ON p.entity_id = subject_id JOIN r{STEPS} q ON q.entity_id = object_id) ORDER BY t DESC, s DESC, relation_index LIMIT 50""",
        ),
        "relation_keys": w(
            G,
            """, k AS (SELECT subject_id, upper(predicate) AS relation_type, object_id, predicate, md5('{"metadata": {}, "object_id": "' || object_id || '", "predicate": "' || predicate || '", "source_chunk": ' || coalesce('"' || source_chunk || '"', 'null') || ', "subject_id": "' || subject_id || '"}') AS relation_key FROM rel WHERE subject_id <> object_id)
            SELECT DISTINCT subject_id, relation_type, object_id, relation_key FROM k""",
        ).replace("\n, k AS", ",\nk AS"),
        "quality": w(
            VIOLATIONS,
            """SELECT round(coverage, 6) AS coverage, round(consistency, 6) AS consistency, round(precision, 6) AS precision, round(redundancy, 6) AS redundancy, round(0.3 * coverage + 0.3 * consistency + 0.2 * precision - 0.2 * redundancy, 6) AS quality FROM (
            SELECT (SELECT count(DISTINCT entity_type) FROM ent WHERE entity_type IN ('Region','Nation','Supplier','Part')) / 4.0::DOUBLE AS coverage, greatest(0, 1 - (SELECT count(*) FROM v) / ((SELECT count(*) FROM ent) + 4 * (SELECT count(*) FROM rel)))::DOUBLE AS consistency,
            (SELECT avg(confidence) FROM rel) AS precision, (SELECT count(*) FILTER (aliases <> '')::DOUBLE / (count(*) + count(*) FILTER (aliases <> '')) FROM ent) AS redundancy)""",
        ),
        "pagerank_fixed": w(pagerank(), f"SELECT entity_id, round(r, 9) AS pagerank FROM r{STEPS}"),
        "degrees": w(DEGREES, "SELECT entity_id, in_degree, out_degree, degree FROM deg"),
        "top_degree": w(DEGREES, f"SELECT entity_id, label, degree FROM deg ORDER BY degree DESC, {fold('label')}, entity_id LIMIT 10"),
        "components": w(COMPONENTS, "SELECT node, component FROM comp"),
        "graph_metrics": w(
            COMPONENTS,
            """SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM deg WHERE degree = 0) AS isolated_entities, (SELECT count(DISTINCT component) FROM comp) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) AS largest_component,
            (SELECT count(*) FROM rel) AS relations, round((SELECT count(*) FROM rel) / ((SELECT count(*) FROM ent)::DOUBLE * ((SELECT count(*) FROM ent) - 1)), 9) AS density""",
        ),
        "khop2": w(BALL, "SELECT entity_id, label, depth::BIGINT AS depth FROM (SELECT node, 1 AS depth FROM b1 UNION ALL SELECT node, 2 FROM b2) JOIN ent ON entity_id = node"),
        "subgraph_page": w(BALL, f", inb AS (SELECT node FROM c UNION SELECT node FROM b1 UNION SELECT node FROM b2) SELECT relation_index, subject_label, predicate, object_label FROM rel WHERE subject_id IN (SELECT node FROM inb) AND object_id IN (SELECT node FROM inb) ORDER BY {FIVE} LIMIT 50").replace("\n, inb AS", ",\ninb AS"),
        "path_subgraph": w(BALL, ", inb AS (SELECT node FROM c UNION SELECT node FROM b1) SELECT relation_index, subject_label, predicate, object_label FROM rel WHERE subject_id IN (SELECT node FROM inb) OR object_id IN (SELECT node FROM inb)").replace("\n, inb AS", ",\ninb AS"),
        "blocking_pairs": w(PART_KEYS, "SELECT left_id, right_id FROM bp"),
        "lexical_pairs": w(RATIO, "SELECT left_id, right_id, round(lexical, 6) AS lexical, round(lexical, 6) AS hybrid FROM lx WHERE lexical >= 0.85"),
        "hybrid_pairs": w(MIXED, "SELECT left_id, right_id, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(hybrid, 6) AS hybrid FROM hx WHERE hybrid >= 0.865"),
        "dedup_lexical": w(MERGED, "SELECT entity_id, first_value(entity_id) OVER (PARTITION BY component ORDER BY ord, entity_id) AS canonical_id FROM cx JOIN po USING (entity_id)"),
        "candidate_counts": w(PART_KEYS, "SELECT left_id, count(*) AS candidates FROM bp GROUP BY 1"),
        "semantic_pairs": w(VEC, "SELECT left_id, right_id, round(semantic, 6) AS semantic FROM mt"),
        "canonical_map": w(VEC, "SELECT entity_id, component, canonical_id FROM mp"),
        "dedup_semantic": w(VEC, "SELECT count(*) AS before, count(DISTINCT component) AS after, count(*) - count(DISTINCT component) AS merged FROM mp"),
        "merged_entities": w(
            VEC,
            """, mb AS (SELECT canonical_id, e.entity_id, e.entity_id <> canonical_id AS o, 'chunk_' || (vec_id % 7) AS ch FROM mp JOIN ev e USING (entity_id)),
            al AS (SELECT canonical_id, string_agg(entity_id, '|' ORDER BY entity_id) FILTER (o) AS aliases FROM mb GROUP BY 1), fc AS (SELECT canonical_id, ch, min((o, entity_id)) AS f FROM mb GROUP BY 1, 2), cs AS (SELECT canonical_id, string_agg(ch, '|' ORDER BY f) AS source_chunks FROM fc GROUP BY 1)
            SELECT canonical_id AS entity_id, row_number() OVER (ORDER BY canonical_id) - 1 AS ord, canonical_id AS label, label::VARCHAR AS entity_type, coalesce(aliases, '') AS aliases, source_chunks FROM al JOIN cs USING (canonical_id) JOIN ev ON ev.entity_id = canonical_id""",
        ).replace("\n, mb AS", ",\nmb AS"),
        "redirected_relations": w(VEC, "SELECT min(relation_index) AS relation_index, a.canonical_id AS subject_id, b.canonical_id AS object_id FROM vl JOIN mp a ON a.entity_id = subject_id JOIN mp b ON b.entity_id = object_id WHERE a.canonical_id <> b.canonical_id GROUP BY 2, 3"),
        "bm25_topk": w(TOP10, "SELECT query, doc AS doc_id, score, rank FROM top"),
        "bm25_chunks": w(f"{CHUNKS}, {bm25('SELECT chunk_id AS doc, text FROM chunks', BENCH_Q)}", "SELECT query, doc AS chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores QUALIFY rank <= 5"),
        "semantic_topk": "SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10",
        "hash_embedding": f"SELECT doc_id, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM (SELECT doc_id, {hashed('text', 'v')} FROM documents)",
        "lexical_topk": w(RETRIEVAL, ranked("lex")),
        "structural_topk": w(RETRIEVAL, ranked("str")),
        "semantic_mode_topk": w(RETRIEVAL, ranked("sem")),
        "lexical_structural_topk": w(RETRIEVAL, ", mx AS (SELECT query, doc, lex.label, 0.85 * CASE WHEN max(lex.score) OVER (PARTITION BY query) > 0 THEN lex.score / max(lex.score) OVER (PARTITION BY query) ELSE 0 END + 0.15 * str.score / max(str.score) OVER (PARTITION BY query) AS score FROM lex JOIN str USING (query, doc)) " + ranked("mx")).replace("\n, mx AS", ",\nmx AS"),
        "rrf_topk": w(
            RETRIEVAL,
            f", rk AS (SELECT 0 AS l, * FROM ({with_rank('sem')}) UNION ALL SELECT 1, * FROM ({with_rank('lex')}) UNION ALL SELECT 2, * FROM ({with_rank('str')})) SELECT query, doc AS entity_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, best, seen, doc) AS rank FROM (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank) ORDER BY l) AS s, min(rank) AS best, min((l, rank)) AS seen FROM rk GROUP BY 1, 2) QUALIFY rank <= 10",
        ).replace("\n, rk AS", ",\nrk AS"),
        "mode_compare": "SELECT m AS mode, q::BIGINT AS query, 5::BIGINT AS results, 5::BIGINT AS last_rank FROM (SELECT unnest(['semantic_only','lexical_only','lexical_structural','structural_only','hybrid_rrf']) AS m) CROSS JOIN (SELECT unnest([0, 1, 2]) AS q)",
        "entity_search": w(G, f"SELECT entity_id, label, entity_type FROM ent WHERE contains(lower(concat_ws(' ', label, entity_type, description, aliases)), 'small') ORDER BY {fold('label')}, entity_id LIMIT 20"),
        "entity_search_fields": w(G, f"SELECT entity_id, label, count(*) OVER () AS total FROM ent WHERE contains(lower(label), 'small') OR contains(lower(entity_type), 'small') OR contains(lower(description), 'small') OR contains(lower(aliases), 'small') ORDER BY {fold('label')}, entity_id LIMIT 20"),
        "context_entities": w(CONTEXT, "SELECT query, doc AS entity_id, pos::BIGINT AS pos, seed FROM ctx"),
        "context_relations": w(CONTEXT, "SELECT query, place AS pos, relation_index FROM cr"),
        "context_text": w(CONTEXT, "SELECT query, 'Entities:' || chr(10) || el.t || chr(10) || chr(10) || 'Relations:' || chr(10) || coalesce(rl.t, '- <none>') AS context FROM el LEFT JOIN rl USING (query)"),
        "answer_text": w(CONTEXT, "SELECT query, 'Based only on the graph context, the relevant entities are: ' || labels || '. Supported graph facts: ' || coalesce(facts, 'no local graph relations were found') || '. The context may be insufficient for a complete clinical protocol; details beyond these graph facts are not supported.' AS answer FROM el LEFT JOIN rl USING (query)"),
        "context_payload": w(PAYLOAD, "SELECT query, pos, relation_index FROM pl"),
        "source_chunks": w(PAYLOAD, "SELECT query, row_number() OVER (PARTITION BY query ORDER BY p) AS pos, source_chunk AS chunk_id FROM (SELECT query, source_chunk, min(pos) AS p FROM pl WHERE source_chunk IS NOT NULL GROUP BY 1, 2)"),
        "eval_hit_mrr_map": w(EVAL, "SELECT query, hit_at_5, hit_at_10, round(rr, 6) AS reciprocal_rank, round(ap, 6)::DOUBLE AS average_precision FROM ev"),
        "eval_by_type": w(EVAL, "SELECT 'type_' || (query % 3) AS question_type, count(*) AS questions, round(avg(rr), 6) AS mrr, round(avg(hit_at_10), 6) AS hit_at_10 FROM ev GROUP BY 1"),
        "eval_baselines": w(EVAL, "SELECT 'naive_rag' AS system, count(*) AS questions, round(avg(rr), 6) AS mrr FROM ev"),
        "eval_relevance": w(QA, f"SELECT conv_id, turn, round(coalesce(2 * len(list_intersect(a, b))::DOUBLE / nullif(len(a) + len(b), 0), 0), 6) AS relevance FROM (SELECT conv_id, turn, {content('question')} AS a, {content('answer')} AS b FROM qa)"),
        "eval_faithfulness": w(
            QA,
            f""", cl AS (SELECT conv_id, turn, k, {content('c')} AS c FROM (SELECT conv_id, turn, {content('question')} AS k, unnest(string_split_regex(answer, '[.!?;\\n]+')) AS c FROM qa)),
            ok AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (len(list_intersect(c, k))::DOUBLE / len(c) >= 0.35) AS g FROM cl WHERE len(c) > 0 GROUP BY 1, 2)
            SELECT conv_id, turn, round(coalesce(g::DOUBLE / n, 0), 6) AS faithfulness FROM qa LEFT JOIN ok USING (conv_id, turn)""",
        ).replace("\n, cl AS", ",\ncl AS"),
        "eval_context": w(
            f"{TOP10}, {WANT}",
            """, hs AS (SELECT query, count(DISTINCT rank) AS h FROM top GROUP BY 1), ns AS (SELECT query, count(DISTINCT doc) AS n FROM want GROUP BY 1), ms AS (SELECT query, count(DISTINCT rank) AS g, count(DISTINCT doc) AS c FROM top JOIN want USING (query, doc) GROUP BY 1)
            SELECT query, round(coalesce(coalesce(g, 0)::DOUBLE / h, 0), 6) AS context_precision, round(coalesce(coalesce(c, 0)::DOUBLE / n, 1), 6) AS context_recall FROM hs FULL JOIN ns USING (query) LEFT JOIN ms USING (query)""",
        ).replace("\n, hs AS", ",\nhs AS"),
        "latency_stats": "SELECT event_type AS stage, count(*) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1",
        "pair_confusion": w(PAIRS, f", k AS (SELECT {COUNTS} FROM (SELECT s >= 0.2 AS p, t FROM pr)) SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({F1}, 6) AS f1 FROM k").replace("\n, k AS", ",\nk AS"),
        "ablation_grid": w(PAIRS, f", k AS (SELECT alpha, theta, {COUNTS} FROM (SELECT alpha, theta, alpha * s >= theta AS p, t FROM pr CROSS JOIN (SELECT unnest({list(ALPHAS)})::DOUBLE AS alpha) CROSS JOIN (SELECT unnest({list(THETAS)})::DOUBLE AS theta)) GROUP BY 1, 2) SELECT *, round({F1}, 6) AS f1 FROM k").replace("\n, k AS", ",\nk AS"),
        "dashboard_types": w(G, "SELECT entity_type, count(*) AS entities FROM ent GROUP BY 1"),
        "dashboard_predicates": w(G, "SELECT predicate, count(*) AS relations FROM rel GROUP BY 1 ORDER BY 2 DESC, min(relation_index) LIMIT 10"),
        "dashboard_chunks": w(G, "SELECT (SELECT count(DISTINCT source_chunk) FROM rel) AS source_chunks, (SELECT count(*) FROM ent WHERE aliases <> '') AS aliases"),
        "relation_types": w(G, "SELECT relation_index, upper(predicate) || CASE relation_index % 3 WHEN 0 THEN '_OF' WHEN 1 THEN '' ELSE '_9' END AS relation_type FROM rel"),
    }
    families = {k: "['" + "', '".join(v) + "']" for k, v in (("t", TREATMENT), ("d", DIAGNOSIS), ("o", DEFAULT))}
    asked = "replace(lower(text || CASE conv_id % 4 WHEN 0 THEN ' Treatment?' WHEN 1 THEN ' which TEST' WHEN 2 THEN ' обсле\u0301дование и тёст' ELSE ' ЛЕЧЕНИЕ' END), 'ё', 'е')"
    place = lambda k: f"coalesce(nullif(list_position({families[k]}, p), 0), len({families[k]}) + 1) - 1"
    kinds = "['" + "', '".join(CLINICAL) + "']"
    out["predicate_places"] = f"""SELECT conv_id, turn, p AS predicate, (CASE WHEN regexp_matches(a, '{"|".join(TREATMENT_WORDS)}') THEN {place("t")} WHEN regexp_matches(a, '{"|".join(DIAGNOSIS_WORDS)}') THEN {place("d")} ELSE {place("o")} END)::BIGINT AS place
      FROM (SELECT conv_id, turn, {asked} AS a, {kinds}[((turn + conv_id) % {len(CLINICAL)} + 1)::INTEGER] AS p FROM conversations)"""
    for name in ("lexical", "lexical_structural", "semantic", "rrf"):
        out[f"{name}_many"] = out["semantic_mode_topk" if name == "semantic" else f"{name}_topk"].replace(RETRIEVAL, MANY)
    systems = " UNION ALL ".join(f"SELECT '{s}' AS system, query, entity_id, rank FROM ({out[n]})" for s, n in (("naive_rag", "lexical_many"), ("rank_fusion", "rrf_many"), ("proposed", "lexical_structural_many")))
    out["eval_systems"] = f"""WITH t AS MATERIALIZED ({systems}),
      want AS MATERIALIZED (SELECT min(p_partkey) OVER (PARTITION BY p_name) + 1000000 AS query, md5({norm("p_name || ' ' || p_partkey")}) AS entity_id FROM part), sizes AS (SELECT query, count(DISTINCT entity_id) AS n FROM want GROUP BY 1),
      hit AS (SELECT system, query, rank, row_number() OVER (PARTITION BY system, query ORDER BY rank) AS k FROM t JOIN want USING (query, entity_id)),
      ev AS (SELECT s.system, sizes.query, min(rank) AS best, coalesce(sum(k::DOUBLE / rank ORDER BY rank), 0) / least(any_value(n), 10) AS ap FROM sizes CROSS JOIN (SELECT DISTINCT system FROM t) s LEFT JOIN hit ON hit.system = s.system AND hit.query = sizes.query GROUP BY 1, 2)
      SELECT system, count(*) AS questions, round_even(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_5, round_even(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_10, round_even(avg(coalesce(1.0 / best, 0)), 4) AS mrr, round_even(avg(ap), 4) AS map_at_10 FROM ev GROUP BY 1"""
    return out
