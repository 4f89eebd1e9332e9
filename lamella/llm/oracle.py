"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op3_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_count(e) = len(e) AND len(e) > 0
    AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links,
  component_id, component_id = v.vec_id AS kept
FROM v JOIN component ON component.a = v.vec_id
"""

SQL["op7_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM sizes
), met AS (
  SELECT *, source_size * 3 / weight AS full_at,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size * 3 / weight, source COLLATE "binary" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (SELECT arg_min(level, full_at) AS level FROM met WHERE full_at >= level
), rated AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * coalesce(found.level, 0)) AS target,
    CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate, rate - floor(rate) AS fraction,
    ('0x' || substr(md5('mix-0:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM weighed, found
), numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS place FROM sized)
SELECT doc_id, size, source_size, target, fraction,
  (size * (floor(rate) + floor(start + (place + 1) * fraction) - floor(start + place * fraction)))::BIGINT AS taken
FROM numbered n JOIN rated r ON n.source IS NOT DISTINCT FROM r.source
"""

#: Control strings of the chat template, in any order: none overlaps another.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[/ANS]", "[ROLE", "[/ROLE]")
_escaped = "replace(text, '\\', '\\\\')"
for _c in CONTROL:
    _escaped = f"replace({_escaped}, '{_c}', '{_c[0]}\\{_c[1:]}')"

SQL["op8_chat"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), lagged AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    {_escaped} AS escaped FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE role WHEN 'system' THEN 20 WHEN 'user' THEN 22 WHEN 'assistant' THEN 20
    ELSE 23 + length(replace({_escaped.replace('text', 'role', 1)}, ']', '\]')) END)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
    WHEN before = 'assistant' THEN role = 'user' ELSE false END) AS legal
FROM lagged GROUP BY conv_id
"""

SQL["op9_urls"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), canonical AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS url FROM parts
), listed AS (SELECT DISTINCT url FROM canonical WHERE starts_with(host, 'spam')
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
    AS r(h, p, verdict)
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
  FROM parts JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN host <> '' AND url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canonical LEFT JOIN fits USING (page_id)
"""

#: Terms: ASCII digits and letters, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op12_lexical_search"] = rf"""
WITH postings AS (
  SELECT row_at, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM (
    SELECT row_number() OVER () AS row_at, doc_id, unnest(regexp_extract_all({_lower}, '{TERM}')) AS term FROM documents
  ) GROUP BY row_at, term
), sizes AS (SELECT row_at, sum(tf)::BIGINT AS n FROM postings GROUP BY row_at
), whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes
), wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_lower}, '{TERM}')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, whole WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, row_at, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row_at), whole
  GROUP BY item_id, doc_id, row_at
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

_step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
_bytes = "list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)"

SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE crc AS (  -- what each byte does to the rest of a CRC-32
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: {_step})) AS t
), runs AS (
  SELECT doc_id, run, count(*)::BIGINT AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_lower}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) GROUP BY doc_id, run HAVING length(run) >= 7
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || {_bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs), crc
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END::BIGINT AS form_n
  FROM words w LEFT JOIN best USING (word)
), follow AS (
  SELECT word, word AS place FROM formed
  UNION ALL SELECT f.word, g.form FROM follow f JOIN formed g ON f.place = g.word WHERE g.form IS NOT NULL
), last AS (SELECT f.word, place AS root FROM follow f JOIN formed g ON f.place = g.word WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""
