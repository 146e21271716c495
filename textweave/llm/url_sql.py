"""The URL filter's result as one DuckDB query: the same tree, a common table expression for each step of a level."""

from __future__ import annotations

from textweave.llm import urls


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_case(column: str) -> str:
    """The longest rule's verdict (column 0) or text (1), as a CASE from long to short."""
    whens = []
    for verdict, rule in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1]), reverse=False):
        domain, slash, start = rule.partition("/")
        fits = f"(host = {quoted(domain)} OR ends_with(host, {quoted('.' + domain)})) AND starts_with(path, {quoted(slash + start)})"
        whens.append(f"WHEN {fits} THEN {quoted(verdict if column == 'verdict' else rule)}")
    return f"CASE {' '.join(whens)} END"


def shape(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{urls.HEXADECIMAL}', '*', 'g'), '{urls.DIGITS}', '*', 'g')"


def form(text: str) -> str:
    return rf"regexp_replace({text}, '{urls.LETTERS}', 'a', 'g')"


def level(k: int) -> str:
    """The steps that name the segments of level k, from tree t{k} to t{k + 1}."""
    rest = form(f"array_to_string(shapes[{k + 2}:], '/')")
    return f"""
h{k} AS (SELECT *, shapes[{k + 1}] AS segment FROM t{k} WHERE len(shapes) > {k}),
c{k} AS (SELECT host, template, segment, (len(shapes) > {k + 1})::VARCHAR || {rest} AS rest, sum(n) AS n, sum(n_lab) AS n_lab, sum(n_bad) AS n_bad FROM h{k} GROUP BY ALL),
r{k} AS (SELECT host, template, rest, sum(n) AS n_rest FROM c{k} GROUP BY ALL),
b{k} AS (SELECT host, template, segment, sum(n)::DOUBLE AS n, sum(n_lab)::DOUBLE AS lab, sum(n_bad)::DOUBLE AS bad, sum(n::DOUBLE * n / n_rest) AS fit FROM c{k} JOIN r{k} USING (host, template, rest) GROUP BY host, template, segment),
p{k} AS (SELECT host, template, count(*) AS children, sum(n) AS p_n, sum(lab) AS p_lab, sum(bad) AS p_bad FROM b{k} GROUP BY host, template),
f{k} AS (SELECT host, template, (count(*) - 1)::DOUBLE AS free FROM r{k} GROUP BY host, template),
s{k} AS (SELECT *, p_n * p_n / nullif(n * (p_n - n), 0) * (fit - n * n / p_n) AS apart, free * pow(1 - 2 / nullif(9 * free, 0) + {urls.Z_SHAPE} * sqrt(2 / nullif(9 * free, 0)), 3) AS most,
  abs(bad / nullif(lab, 0) - (p_bad - bad) / nullif(p_lab - lab, 0)) AS gap, p_bad / nullif(p_lab, 0) AS share FROM b{k} JOIN p{k} USING (host, template) JOIN f{k} USING (host, template)),
n{k} AS (SELECT host, template, segment, template || '/' || CASE WHEN children > {urls.MANY_CHILDREN} THEN '*'
  WHEN children > 1 AND (free = 0 OR coalesce(apart <= most, false)) AND coalesce(gap <= {urls.Z_LABEL} * sqrt(share * (1 - share) * (1 / nullif(lab, 0) + 1 / nullif(p_lab - lab, 0))), true) THEN '~' ELSE segment END AS next FROM s{k}),
t{k + 1} AS (SELECT host, shapes, n, n_lab, n_bad, next AS template FROM h{k} JOIN n{k} USING (host, template, segment) UNION ALL SELECT host, shapes, n, n_lab, n_bad, template FROM t{k} WHERE len(shapes) <= {k})"""


#: SQL cannot go on until no path has a further segment: it is written for paths of so many at most.
LEVELS = 8


def url_filter_sql(depth: int = LEVELS) -> str:
    capital, small = urls.CAPITALS, urls.CAPITALS.lower()
    levels = ",".join(level(k) for k in range(depth))
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{capital}', '{small}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
w AS (SELECT *, {rule_case('rule')} AS rule, {rule_case('verdict')} AS ruled, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM v),
x AS (SELECT *, list_transform(parts, lambda s: {shape('s')}) AS shapes FROM w),
t0 AS (SELECT host, shapes, count(*) AS n, count(ruled) AS n_lab, count_if(ruled = 'block') AS n_bad, '' AS template FROM x GROUP BY host, shapes),{levels},
hosts AS (SELECT host, (sum(n_bad) + {urls.PRIOR_WEIGHT} * (SELECT sum(n_bad) / sum(n) FROM t0)) / (sum(n) + {urls.PRIOR_WEIGHT}) AS prior FROM t0 GROUP BY host),
pure AS (SELECT host, template, (sum(n_bad) + {urls.PRIOR_WEIGHT} * any_value(prior)) / (sum(n_lab) + {urls.PRIOR_WEIGHT}) AS purity FROM t{depth} JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity > {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM x JOIN t{depth} USING (host, shapes) JOIN pure USING (host, template)
"""
