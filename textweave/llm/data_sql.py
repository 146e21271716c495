"""DuckDB SQL of the source mix, the point-in-time join and the divergence audit."""

from __future__ import annotations

from textweave.llm import divergence, mixing

WORD = r"[^\x20\x09-\x0D]+"


def quotas(parties: str, key: str, party: str, votes: str, seats: str) -> str:
    """`seats` of each key by the highest quotients votes / (2 k + 1): every quotient that could win is ranked."""
    return f"""SELECT {key}, {party}, count(*) AS quota FROM (
  SELECT {key}, {party}, {seats} AS seats, row_number() OVER (PARTITION BY {key} ORDER BY v / (2 * k + 1) DESC, {party}, k) AS won
  FROM (SELECT *, {votes}::DOUBLE AS v, unnest(range(CAST(ceil({seats} * ({votes}::DOUBLE / total)) AS BIGINT) + n + 2)) AS k FROM (SELECT *, sum({votes}::DOUBLE) OVER (PARTITION BY {key}) AS total, count(*) OVER (PARTITION BY {key}) AS n FROM {parties} WHERE {votes} > 0))
) WHERE won <= seats GROUP BY {key}, {party}"""


def mix_sql(seed: int = 42) -> str:
    (up, down), cap, block = mixing.SHARE, mixing.CAP, mixing.BLOCK
    a, b, c = mixing.WEIGHTS
    number = lambda text: f"CAST('0x' || substr(md5({text} || ':{seed}'), 1, 8) AS BIGINT)"
    cut = lambda lo, hi: f"greatest(least(start + size, {hi}) - greatest(start, {lo}), 0)"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, [{a}, {b}, {c}][place % 3 + 1] AS weight FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s)),
f AS (SELECT *, coalesce(sum({cap} * source_size) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights, sum(source_size) OVER () AS total, sum(weight) OVER () AS every FROM w
  WINDOW o AS (ORDER BY CAST(source_size AS HUGEINT) * ({a * b * c} // weight), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, {cap} * source_size * {down} * (every - weights) <= weight * ({up} * total - {down} * caps) AS at_limit FROM f),
t AS (SELECT *, CASE WHEN at_limit THEN CAST({cap} * source_size AS DOUBLE)
  ELSE CAST({up} * total - {down} * coalesce(sum({cap} * source_size) FILTER (at_limit) OVER (), 0) AS DOUBLE) * weight / CAST({down} * (every - coalesce(sum(weight) FILTER (at_limit) OVER (), 0)) AS DOUBLE) END AS target FROM l),
p AS (SELECT *, 0 AS g, CAST(({2 * up} * total + {down * block}) // {2 * down * block} AS BIGINT) AS seats, greatest(1, CAST(ceil(source_size / {mixing.SHARD_WORDS}) AS BIGINT), CAST(ceil(n_docs / {mixing.SHARD_DOCS}) AS BIGINT)) AS n_shards FROM t),
q AS ({quotas("p", "g", "place", "target", "seats")}),
x AS (SELECT d.*, place, source_size, target, coalesce(quota, 0) AS blocks, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}') AS h, {number("coalesce(CAST(doc_id AS VARCHAR), '')")} % n_shards AS shard FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN q USING (place)),
sh AS (SELECT place, shard, blocks, CAST(sum(size) AS BIGINT) AS words FROM x GROUP BY ALL),
sq AS ({quotas("sh", "place", "shard", "words", "blocks")}),
k AS (SELECT place, shard, words, least(coalesce(quota, 0) * {block}, {cap} * words) AS want, words // {block} AS whole FROM sh LEFT JOIN sq USING (place, shard)),
r AS (SELECT *, least(whole, (want - passes * words + {block // 2}) // {block}) AS run, CASE WHEN whole > 0 THEN {number("place || ':' || shard")} % whole ELSE 0 END AS first FROM (SELECT *, coalesce(want // nullif(words, 0), 0) AS passes FROM k)),
y AS (SELECT x.*, passes, run, first, whole, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x JOIN r USING (place, shard))
SELECT doc_id, size, source_size, target, CAST(passes * size + {cut(f"first * {block}", f"least((first + run) * {block}, whole * {block})")} + {cut("0", f"(first + run - whole) * {block}")} AS BIGINT) AS taken FROM y
"""


def point_in_time_sql() -> str:
    part = lambda k: f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)"
    return f"""
WITH v AS (SELECT *, event - 60 + {part(1)} % 600 AS arrival, event + {part(2)} % 900 AS expiry FROM (SELECT *, {part(0)} % 50000 AS event FROM (SELECT doc_id, source, n_chars, lang, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IS NOT NULL))),
s AS (SELECT doc_id, min(source) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
a AS (SELECT r, doc_id, source, {part(3)} % 50000 AS t FROM (SELECT row_number() OVER () AS r, doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM labels) LEFT JOIN s USING (doc_id)),
b AS (SELECT r, max({{'event': event, 'arrival': arrival, 'id': v.doc_id, 'n_chars': n_chars, 'lang': lang}}) AS p FROM a JOIN v ON a.source = v.source AND event <= t AND arrival <= t AND t < expiry GROUP BY r)
SELECT doc_id, t, p.id AS version_id, t - p.event AS age, CASE WHEN p IS NULL THEN 'none' WHEN t - p.event > 120 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN t - p.event <= 120 THEN p.n_chars END AS n_chars, CASE WHEN t - p.event <= 120 THEN p.lang END AS lang
FROM a LEFT JOIN b USING (r)
"""


def divergence_sql(top: int = 10) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    frequency = lambda n, total: f"CAST(1 + (CAST({n} AS HUGEINT) + 2) * {divergence.SCALE} // ({total} + 2 * kept) AS HUGEINT)"
    gap = "CAST((p - q) * (p - q) // (p + q) AS BIGINT)"
    rank = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
c AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_term FROM c GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
l AS (SELECT lang, count(*) AS kept, CAST(sum(n_term) AS HUGEINT) AS n_lang FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n_all, 0) AS n_all FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n_all FROM n GROUP BY ALL) USING (lang, source)),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {frequency("coalesce(n, 0)", "n_all")} AS p, {frequency("n_term", "n_lang")} AS q FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
o AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({gap}) AS BIGINT) AS value FROM (SELECT lang, source, term, p FROM f) a JOIN (SELECT lang, source, term, p AS q FROM f) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source),
t AS (SELECT lang, source, term AS item, {gap} AS value FROM f WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {rank} FROM e
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {rank} FROM t) WHERE rank <= {top}
"""
