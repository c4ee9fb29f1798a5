"""SQL checks of the queries that SQL can express, for the checking database."""

from __future__ import annotations

from searchloom.llm.licenses import PHRASES, TEMPLATES, THRESHOLD
from searchloom.llm.mixing import WEIGHTS
from searchloom.llm.sharding import ROUNDS, SEED, SHARDS
from searchloom.llm.text import plain_words
from searchloom.llm.url_filter import RULES

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _plain(text: str) -> str:
    return f"regexp_extract_all(translate({text}, {_UPPER}), '{_PLAIN}')"


def _rate(rule: str) -> str:
    """Shrunk failure rate of one rule of the host table joined with the prior's sums."""
    mean = f"(p.k_{rule} / p.n)"
    variance = f"(p.s_{rule} / p.n - {mean} * {mean})"
    weight = f"CASE WHEN {variance} > 1e-12 THEN least(greatest({mean} * (1 - {mean}) / {variance} - 1, 2), 1000) ELSE 1000 END"
    return f"(h.k_{rule} + {mean} * ({weight})) / (h.n + ({weight}))"


OP1 = f"""
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS words FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base) x) y),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) s(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT base.doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM base) base LEFT JOIN again USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base::INT)::DOUBLE AS k_base, sum(symbols::INT)::DOUBLE AS k_symbols, sum(dup_lines::INT)::DOUBLE AS k_dup_lines FROM f GROUP BY source),
p AS (SELECT sum(n) AS n, {", ".join(f"sum(k_{r}) AS k_{r}, sum(k_{r} * k_{r} / n) AS s_{r}" for r in ("base", "symbols", "dup_lines"))} FROM h),
v AS (SELECT h.source, ({" OR ".join(f"{_rate(r)} > 0.8" for r in ("base", "symbols", "dup_lines"))}) AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, NOT base AND NOT rejected AS kept, rejected AS host_rejected
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([{", ".join(map(str, WEIGHTS))}])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1)::INT] AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT max((1.5::DOUBLE * total - before) / weight) AS level FROM (
  SELECT (SELECT sum(size)::DOUBLE FROM d) AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight FROM c) x),
t AS (SELECT source, source_size, round(least(cap, w * level), 6) AS target FROM c, l),
k AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN (round(target)::BIGINT // source_size) ELSE 0 END AS whole FROM t),
o AS (SELECT d.*, k.source_size, k.target, k.whole, k.words - k.whole * k.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o"""

_RULES = ", ".join(f"('{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES.items())
OP8 = f"""
WITH r AS (SELECT page_id, html, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, html, url, translate(raw, {_UPPER}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM a),
hd AS (SELECT host, sha256(coalesce(html, '')) AS d, count(*) AS n FROM u WHERE contains(url, '://') GROUP BY ALL),
sp AS (SELECT d FROM hd GROUP BY d HAVING count(*) > 1),
mirror AS (SELECT host FROM hd LEFT JOIN sp ON hd.d = sp.d GROUP BY host HAVING sum(n) >= 20 AND coalesce(sum(n) FILTER (sp.d IS NOT NULL), 0) > 0.5 * sum(n)),
rules(domain, start, rule, says) AS (VALUES {_RULES}),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule FROM u JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY page_id)
SELECT u.page_id, host, path, fit.rule, coalesce(says, CASE WHEN EXISTS (SELECT 1 FROM mirror m WHERE u.host = m.host OR ends_with(u.host, '.' || m.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (page_id) LEFT JOIN rules ON rules.rule = fit.rule"""

_NOTICES = ", ".join(
    f"({i}, '{label}', {len(plain_words(text))}, [{', '.join(repr(t.decode()) for t in sorted(set(plain_words(text))))}])" for i, (label, text) in enumerate(TEMPLATES)
)
_PLACES = " UNION ALL ".join(
    "SELECT doc_id, i - 1 AS place, '{0}' AS label FROM spots WHERE {1}".format(label, " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())))
    for phrase, label in PHRASES.items()
)
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_plain("coalesce(text, '')")} AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
places AS ({_PLACES}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, i, ws, list_distinct(ws) AS tokens FROM (SELECT doc_id, i, {_plain("line")} AS ws FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) x) y),
notices(k, label, size, own) AS (VALUES {_NOTICES}),
hit AS (SELECT doc_id, label, len(list_intersect(own, tokens)) / len(own)::DOUBLE AS share FROM lines, notices
  WHERE len(tokens) > 0 AND len(list_intersect(own, tokens)) >= ceil({THRESHOLD} * len(own) - 1e-9)),
parts AS (SELECT doc_id, ws, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ln, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) - len(ws) AS before FROM (
    SELECT *, sum(CASE WHEN len(tokens) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM lines) x WHERE len(tokens) > 0),
likely AS (SELECT doc_id, part, k, label, size, own FROM (SELECT doc_id, part, list_distinct(flatten(list(ws))) AS tokens FROM parts GROUP BY doc_id, part HAVING count(*) > 1) p, notices
  WHERE len(list_intersect(own, tokens)) >= ceil({THRESHOLD} * len(own) - 1e-9)),
spot AS (SELECT l.*, ln, before + j AS pos, ws[j] AS token FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM parts) w JOIN likely l USING (doc_id, part) WHERE list_contains(own, ws[j])),
runs AS (SELECT a.doc_id, a.label, count(DISTINCT b.token) / len(any_value(a.own))::DOUBLE AS share FROM spot a JOIN spot b ON a.doc_id = b.doc_id AND a.part = b.part AND a.k = b.k
    AND b.pos >= a.pos AND (b.pos - b.ln) - (a.pos - a.ln) < a.size GROUP BY a.doc_id, a.part, a.k, a.label, a.pos
  HAVING max(b.ln) > min(a.ln) AND count(DISTINCT b.token) >= ceil({THRESHOLD} * len(any_value(a.own)) - 1e-9)),
found AS (SELECT * FROM hit UNION ALL SELECT * FROM runs),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) x GROUP BY doc_id),
based AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(based.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, (CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_plain("coalesce(text, '')")} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_plain("coalesce(text, '')")} AS words FROM benchmark),
windows AS (SELECT DISTINCT item, len(w)::INT AS size, array_to_string(w, ' ') AS gram FROM (
  SELECT item, words[i:i + 9] AS w FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0) x) y),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d) x, sizes WHERE i + size - 1 <= len(words)),
hit AS (SELECT doc_id, i, size, item FROM grams JOIN windows USING (size, gram)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM hit) x GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

_ADDED = f"(('0x' || substr(md5('{SEED}:' || (turn % {ROUNDS}) || ':' || CASE WHEN turn % 2 = 0 THEN r ELSE l END), 1, 12))::BIGINT)"
OP11 = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, k: xor(t[(xor(c, k) & 255) + 1], c >> 8))) AS crc FROM d, tab),
m AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)::DOUBLE))::BIGINT + 1 AS a FROM documents) x),
numbered AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY doc_id IS NULL, doc_id, crc, size) - 1 AS num FROM c),
w AS (SELECT doc_id, size, crc, n, a, b, num // b AS l, num % b AS r, 0 AS turn FROM numbered, m
  UNION ALL SELECT doc_id, size, crc, n, a, b, CASE WHEN turn % 2 = 0 THEN (l + {_ADDED}) % a ELSE l END, CASE WHEN turn % 2 = 0 THEN r ELSE (r + {_ADDED}) % b END, turn + 1
  FROM w WHERE turn = 0 OR turn % {ROUNDS} > 0 OR l * b + r >= n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, ((l * b + r) % {SHARDS})::INT AS shard, (l * b + r) // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM w WHERE turn > 0 AND turn % {ROUNDS} = 0 AND l * b + r < n"""

OP13 = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
