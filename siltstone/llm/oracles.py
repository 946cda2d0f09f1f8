"""DuckDB SQL for the subpackage's queries that SQL can express. The others (secret scan, toxicity, quality, HTML, sharding,
fingerprints, the pipeline) are tested against brute-force versions, held-out labels or exact round trips."""

from __future__ import annotations

from siltstone.llm.mix import SALTS
from siltstone.llm.url_filter import CONTRACT_RULES, DEFAULT_PATTERNS

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
                             WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w),
g AS MATERIALIZED (SELECT doc_id, hash(gram) AS gram FROM s),
n AS MATERIALIZED (SELECT d.doc_id, count(g.gram) AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links FROM n JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _url_filter() -> str:
    rules = ", ".join(f"({_text(v)}, {_text(r)}, {_text(r.partition('/')[0])}, {_text('/' + r.partition('/')[2])})" for v, r in CONTRACT_RULES)
    patterns = ", ".join(f"({_text(p.rule)}, {_text(p.pattern)}, {_text(p.verdict)})" for p in DEFAULT_PATTERNS)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
patterns(pattern, expression, verdict) AS (VALUES {patterns}),
best AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS place
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
other AS (
  SELECT page_id, pattern, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern) AS place
  FROM h JOIN patterns ON regexp_matches({_FOLD.format("host || path")}, expression))
SELECT h.page_id, host, path, best.rule, coalesce(best.verdict, other.verdict, 'allow') AS verdict, CASE WHEN best.rule IS NULL THEN other.pattern END AS pattern
FROM h LEFT JOIN best ON best.page_id = h.page_id AND best.place = 1 LEFT JOIN other ON other.page_id = h.page_id AND other.place = 1
"""


DECONTAMINATE = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
k AS (
  SELECT DISTINCT item_id, len(words[pos:pos + 9]) AS size, array_to_string(words[pos:pos + 9], ' ') AS grams
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS pos FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
sizes AS (SELECT DISTINCT size FROM k),
p AS (
  SELECT doc_id, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS grams
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM d CROSS JOIN sizes)),
m AS (SELECT doc_id, pos, size, item_id FROM p JOIN k USING (size, grams)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM m) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM t),
c AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight FROM c),
l AS (SELECT *, least(CAST(cap AS DOUBLE), max(CAST(rest AS DOUBLE) / rest_weight) OVER () * weight) AS target FROM r),
o AS (
  SELECT doc_id, d.source, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY CAST(floor(sqrt(size)) AS INT),
           CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SALTS}, size, doc_id) AS pos,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('7:' || coalesce('s' || d.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS moved
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(pos * rate + moved) - floor((pos - 1) * rate + moved), 3) AS BIGINT) * size AS taken FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN, "op2_url_filter": _url_filter(), "op3_decontaminate": DECONTAMINATE, "op4_mix": MIX}
