"""SQL for the queries that SQL expresses, over the same tables."""

from __future__ import annotations

from . import embedding_dedup as E
from . import hard_negatives as H
from . import license_rules as L
from . import quality_rules as Q
from . import resampling as R
from . import source_mixing as M
from . import url_filter as U

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _draw(seed: int) -> str:
    return f"CAST(CAST('0x' || substring(h, {1 + 8 * seed}, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


def _copies(draw: str) -> str:
    return f"(CAST(floor(rate) AS BIGINT) + CASE WHEN {draw} < rate - floor(rate) THEN 1 ELSE 0 END)"


OP8 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, sha256(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {list(M.WEIGHTS)}[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(M.WEIGHTS)} + 1 AS INTEGER)] AS weight FROM s),
f AS (SELECT *, {M.MOST_REPEATED} * source_size / weight AS full_at FROM w),
l AS (SELECT *, row_number() OVER o AS place, ({M.SHARE} * sum(source_size) OVER () - {M.MOST_REPEATED} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f WINDOW o AS (ORDER BY full_at, source IS NULL, source)),
g AS (SELECT arg_min(level, place) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least({M.MOST_REPEATED} * source_size, coalesce(weight * (SELECT level FROM g), {M.MOST_REPEATED} * source_size)) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
j AS (SELECT d.*, r.source_size, r.target, r.rate FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
m AS (SELECT source, target, {", ".join(f"abs(sum(size * {_copies(_draw(i))}) - target) AS miss{i}" for i in range(M.SEEDS))} FROM j GROUP BY source, target),
b AS (SELECT source, CASE {" ".join(f"WHEN miss{i} = least({', '.join(f'miss{k}' for k in range(M.SEEDS))}) THEN {i}" for i in range(M.SEEDS))} END AS seed FROM m)
SELECT doc_id, size, source_size, target, size * CASE seed {" ".join(f"WHEN {i} THEN {_copies(_draw(i))}" for i in range(M.SEEDS))} END AS taken FROM j JOIN b ON j.source IS NOT DISTINCT FROM b.source
"""

# -- URL filter: rules, then rounds of propagation written out

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in U.RULES)


_WAYS = {"trust": "along", "pages": "along", "distrust": "against", "pages_back": "against"}


def _rounds() -> str:
    parts = [f"m0 AS MATERIALIZED (SELECT host, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _WAYS)} FROM nodes)"]
    for i in range(U.ROUNDS):
        masses = ", ".join(f"{1 - U.DAMPING} * n.{c} + {U.DAMPING} * (CASE WHEN n.has_{way} THEN 0.0 ELSE s.{c} END + coalesce(f.{c}, 0.0)) AS {c}" for c, way in _WAYS.items())
        flows = ", ".join(f"sum(p.{c} * e.{way}) AS {c}" for c, way in _WAYS.items())
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT n.host, {masses} FROM nodes n JOIN m{i} s ON s.host = n.host LEFT JOIN (SELECT e.dst, {flows} FROM edges e JOIN m{i} p ON p.host = e.src GROUP BY e.dst) f ON f.dst = n.host)")
    return ",\n".join(parts)


_LINKED = U.LINKED.replace("'", "''")
OP5 = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hp AS (SELECT DISTINCT host, path FROM p),
hit AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS decided FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
v AS (SELECT p.page_id, p.html, p.host, p.path, hit.rule, hit.decided FROM p LEFT JOIN hit ON hit.host = p.host AND hit.path = p.path),
h AS (SELECT host, count(*) AS pages, count(CASE WHEN decided = 'allow' THEN 1 END) AS trust, count(CASE WHEN decided = 'block' THEN 1 END) AS distrust FROM v WHERE host <> '' GROUP BY host),
raw AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINKED}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM v WHERE host <> ''),
ties AS (SELECT * FROM (SELECT host AS src, regexp_extract(host, '^[^.]*\\.([^.]+\\..+)$', 1) AS dst FROM h) WHERE dst <> ''),
links AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT src, dst FROM raw WHERE src <> dst UNION ALL SELECT src, dst FROM ties UNION ALL SELECT dst, src FROM ties) GROUP BY src, dst),
shares AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS along, weight / sum(weight) OVER (PARTITION BY dst) AS against FROM links),
edges AS MATERIALIZED (SELECT src, dst, sum(along) AS along, sum(against) AS against FROM (SELECT src, dst, along, 0.0 AS against FROM shares UNION ALL SELECT dst, src, 0.0, against FROM shares) GROUP BY src, dst),
nodes AS MATERIALIZED (SELECT x.*, x.pages AS pages_back, coalesce(l.along > 0, false) AS has_along, coalesce(l.against > 0, false) AS has_against FROM (SELECT * FROM h UNION ALL SELECT DISTINCT dst, 0, 0, 0 FROM links WHERE dst NOT IN (SELECT host FROM h)) x LEFT JOIN (SELECT src, max(along) AS along, max(against) AS against FROM edges GROUP BY src) l ON l.src = x.host),
{_rounds()},
q AS (SELECT host, round(CASE WHEN pages > 0 THEN trust / pages ELSE 0.0 END, 6) AS trust, round(CASE WHEN pages_back > 0 THEN distrust / pages_back ELSE 0.0 END, 6) AS distrust FROM m{U.ROUNDS})
SELECT page_id, v.host, path, rule, coalesce(decided, CASE WHEN coalesce(q.distrust, 0.0) - coalesce(q.trust, 0.0) > {U.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(q.trust, 0.0) AS trust, coalesce(q.distrust, 0.0) AS distrust
FROM v LEFT JOIN q ON q.host = v.host
"""

# -- quality rules

_COMMON = ", ".join(f"CAST(len(list_filter(found, lambda w: w = '{w}')) AS BIGINT)" for w in Q.COMMON_WORDS)
_CLASS_BINS, _COMMON_BINS = len(Q.CLASSES), len(Q.COMMON_WORDS) + 1


def _distance(one: str, two: str, bins: int) -> str:
    terms = []
    for i in range(1, bins + 1):
        p, q = f"({one}[{i}] / CAST(list_sum({one}) AS DOUBLE))", f"({two}[{i}] / CAST(list_sum({two}) AS DOUBLE))"
        terms += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0.0 END" for x in (p, q)]
    return f"CASE WHEN list_sum({one}) > 0 AND list_sum({two}) > 0 THEN sqrt(greatest(0.0, ({' + '.join(terms)}) / 2)) ELSE 0.0 END"


_SUM_CLASSES = f"[{', '.join(f'sum(classes[{i}])' for i in range(1, _CLASS_BINS + 1))}]"
_ENOUGH = f"count(*) >= {Q.LEAST_REFERENCE_DOCS} AND sum(n_words) >= {Q.LEAST_REFERENCE_WORDS}"
OP6 = f"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
x AS (SELECT doc_id, i, hash(list_slice(words, i, i + 7)) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM a WHERE len(words) >= {Q.WINDOW})),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, CAST(sum(least({Q.WINDOW}, coalesce(nxt - i, {Q.WINDOW}))) AS BIGINT) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM t) GROUP BY doc_id),
b AS (SELECT a.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS wide,
  CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS upper, CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS BIGINT) AS digit, CAST(length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g')) AS BIGINT) AS stop,
  list_filter(words, lambda w: w IN ({", ".join(f"'{w}'" for w in Q.COMMON_WORDS)})) AS found FROM a LEFT JOIN c ON c.doc_id = a.doc_id),
d AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  [upper, digit, chars - word_chars, stop, n_symbols, wide, greatest(0, word_chars - upper - digit - stop - n_symbols - wide)] AS classes, [{_COMMON}, n_words - len(found)] AS common,
  n_words < {Q.LEAST_WORDS} OR 100 * n_repeat_words > {Q.MOST_REPEATED} * n_words AS base_failed FROM b),
r AS (SELECT lang AS of, {_SUM_CLASSES} AS ref_classes, [{", ".join(f"sum(common[{i}])" for i in range(1, _COMMON_BINS + 1))}] AS ref_common FROM d WHERE NOT base_failed GROUP BY lang HAVING {_ENOUGH}),
e AS (SELECT {_SUM_CLASSES} AS all_classes FROM d WHERE NOT base_failed HAVING {_ENOUGH}),
j AS (SELECT d.*, coalesce(r.ref_classes, e.all_classes) AS ref_classes, r.ref_common FROM d LEFT JOIN r ON d.lang IS NOT DISTINCT FROM r.of LEFT JOIN e ON true),
m AS (SELECT *, coalesce({_distance("classes", "ref_classes", _CLASS_BINS)}, 0.0) AS cd, coalesce({_distance("common", "ref_common", _COMMON_BINS)}, 0.0) AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words >= {Q.LEAST_JUDGED} AND (cd > {Q.MOST_CLASSES} OR wd > {Q.MOST_COMMON})) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM m
"""

# -- licences

_KNOWN = ", ".join(f"('{name}', '{s}')" for name, s in L.SENTENCES.items())


def _split(wrapped: bool) -> str:
    lines = r"\n[\x20\t\r]*\n" if wrapped else r"\n"
    return rf"string_split(regexp_replace(regexp_replace(text, '([.!?:;])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '{lines}', chr(1), 'g'), chr(1))"


def _matches(line: str) -> str:
    between = rf"(?:\S+ ){{0,{L.MOST_BETWEEN}}}"
    cases = ", ".join(f"CASE WHEN regexp_matches({line}, ' {f' {between}'.join(ids)} ') THEN '{licence}' END" for licence, ids in L.RULES)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _found(wrapped: bool) -> str:
    bare = r"trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return f"SELECT doc_id, list(k.name ORDER BY i) AS ids FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, {_split(wrapped)} AS parts FROM documents WHERE text IS NOT NULL)) JOIN known k ON k.sentence = {bare} GROUP BY doc_id"


_FIRST = "list_filter(a, lambda x, i: list_position(a, x) = i)"
OP10 = f"""
WITH known(name, sentence) AS (VALUES {_KNOWN}), l AS ({_found(False)}), w AS ({_found(True)}),
b AS (SELECT d.doc_id, coalesce(l.ids, []) AS li, coalesce(w.ids, []) AS wi FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN w ON w.doc_id = d.doc_id),
x AS (SELECT doc_id, CASE WHEN len(wi) > len(li) THEN wi ELSE li END AS sentence_ids, list_concat({_matches("' ' || array_to_string(li, ' ') || ' '")}, {_matches("' ' || array_to_string(wi, ' ') || ' '")}) AS a FROM b)
SELECT doc_id, sentence_ids, {_FIRST} AS licenses, a[1] AS license FROM x
"""

# -- vectors

OP11 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {E.THRESHOLD}),
r(node, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c JOIN embeddings ON vec_id = node LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) ON a = node
"""

OP12 = f"""
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({H.STEPS} * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {H.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {H.LEAST_PERCENT} * positive_score <= 100 * score AND score <= positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER o <= {H.NEGATIVES}
"""

# -- resampling: CRC-32 of every distinct word by its table of 256 entries, made from the polynomial

_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_BYTES = "list_transform(range(0, length(hex(encode(word))) // 2), lambda i: CAST(CAST('0x' || substring(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT))"
_GUMBEL = f"CAST(floor(-{R.UNITS} * ln(-ln((CAST('0x' || substring(sha256('{R.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT)"
_RUNS = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP13 = f"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {_STEP} FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS entries FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, {_RUNS.format(_LOWER)} AS words FROM documents), g AS MATERIALIZED (SELECT {_RUNS.format(_LOWER)} AS words FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL), gw AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM g) GROUP BY ALL),
b AS MATERIALIZED (SELECT word, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda s, x: xor(s >> 8, entries[(xor(s, x) & 255) + 1])), 4294967295) % {R.BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM gw), crc),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM dw JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM gw JOIN b USING (word) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor({R.UNITS} * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + {R.BUCKETS}))::DOUBLE / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {R.BUCKETS}))::DOUBLE)) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM dw JOIN b USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + {_GUMBEL} AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {R.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {R.LEAST_WORDS}) AS of FROM x)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= {R.LEAST_WORDS} AND place <= {R.PERCENT} * of // 100 THEN place END AS BIGINT) AS rank FROM o
"""

ORACLES = {"op5_url_filter": OP5, "op6_quality_rules": OP6, "op7_exact_dedup": OP7, "op8_source_mixing": OP8, "op10_license_rules": OP10, "op11_embedding_dedup": OP11, "op12_hard_negatives": OP12, "op13_importance_resampling": OP13}
