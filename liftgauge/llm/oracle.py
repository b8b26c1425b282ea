"""DuckDB SQL for the queries that SQL can express, over the views of the given tables."""

from liftgauge.llm.url_filter import UNWANTED

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
  FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS body FROM item_starts),
sizes AS (SELECT DISTINCT n FROM wanted),
doc_starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, s, d.n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS body FROM doc_starts) d
  JOIN wanted USING (n, body)),
hit AS (SELECT doc_id, count(DISTINCT s + i) AS n_hit FROM found, range(10) r(i) WHERE i < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit ON hit.doc_id = docs.doc_id LEFT JOIN named ON named.doc_id = docs.doc_id
"""

_UNWANTED = ", ".join(f"'{word}'" for word in UNWANTED)

URL_FILTER = rf"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
keyed AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '') AS key,
  list_has_any(regexp_split_to_array(host, '[.-]'), [{_UNWANTED}]) AS unwanted FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE unwanted),
ruled AS (SELECT *, '.' || host AS under FROM keyed),
named AS (SELECT *, CASE
  WHEN ends_with(under, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with(under, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with(under, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with(under, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM ruled)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""

RANKED_SEARCH = f"""
WITH terms AS (SELECT r, doc_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents)),
counted AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT count(DISTINCT r) AS docs, count(*) AS words FROM terms),
length AS (SELECT r, count(*) AS n FROM terms GROUP BY r),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM size) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted GROUP BY term),
asked AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
scored AS (SELECT item_id, c.r, c.doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN counted c USING (term) JOIN weight USING (term) JOIN length ON length.r = c.r, size GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

SUBSTRING_DEDUP = f"""
WITH words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS body FROM starts),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY body) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM late, range(50) r(i)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT each.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY each.p) AS kept
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p WHERE gone.p IS NULL GROUP BY each.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS kept
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

# The checksum's table is made from its polynomial; each distinct word goes through it byte by byte.
RESAMPLING = f"""
WITH steps AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
corpus AS (SELECT r, unnest(w) AS word FROM docs),
target AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
spelled AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM corpus UNION SELECT word FROM target)),
bytes AS (SELECT word, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM spelled),
bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k
  FROM bytes, steps),
s AS (SELECT k, count(*) AS s FROM corpus JOIN bucket USING (word) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM target JOIN bucket USING (word) GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM corpus) + 10000))
    / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM target) + 10000)))) AS BIGINT) AS g FROM s FULL JOIN t USING (k)),
weighed AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM corpus JOIN bucket USING (word) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed ON weighed.r = docs.r),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * n) // 100 THEN place END AS rank FROM placed
"""

ORACLE_SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op4_url_filter": URL_FILTER,
    "op11_ranked_search": RANKED_SEARCH,
    "op12_substring_dedup": SUBSTRING_DEDUP,
    "op13_resampling": RESAMPLING,
}
