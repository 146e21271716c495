"""SQL of ridge models with any number of inputs: Gaussian elimination on sums of products, a CTE a pivot.

The sums are by fold, so that a held-out fold's model comes from those of the others; nothing else is shared with the engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from textweave.plans.audits import _Z as AUDITED
from textweave.plans.audits import FEATURES

#: Rated rows with the label that the features partly explain.
LABELLED = f"{AUDITED}, yy AS (SELECT *, id % 5 AS fold, least(greatest(1 + se_a / 8 + ce_a * 20 + id % 7 / 5.0::DOUBLE, 1), 10)::DOUBLE AS y FROM z)"
_ALL = "whole"


def sums(name: str, source: str, inputs: Sequence[str], targets: Sequence[str], fold: str | None = "fold", weight: str = "1") -> str:
    """CTE `name`: (g, n, u_i, v_t, s_i_j, q_i_t), weighted sums of inputs, targets and their products by fold."""
    k, m = range(len(inputs)), range(len(targets))
    cells = ["sum(w) AS n", *(f"sum(w * x{i}) AS u_{i}" for i in k), *(f"sum(w * t{t}) AS v_{t}" for t in m)]
    cells += [f"sum(w * x{i} * x{j}) AS s_{i}_{j}" for i in k for j in k if i <= j] + [f"sum(w * x{i} * t{t}) AS q_{i}_{t}" for i in k for t in m]
    columns = [f"({x})::DOUBLE AS x{i}" for i, x in enumerate(inputs)] + [f"({x})::DOUBLE AS t{t}" for t, x in enumerate(targets)]
    return f"{name} AS MATERIALIZED (SELECT g, {', '.join(cells)} FROM (SELECT {fold or repr(_ALL)} AS g, ({weight})::DOUBLE AS w, {', '.join(columns)} FROM {source}) GROUP BY g)"


def others(name: str, source: str, k: int, m: int) -> str:
    """CTE `name`: for each fold the sums of all other folds."""
    cells = ["n", *(f"u_{i}" for i in range(k)), *(f"v_{t}" for t in range(m)), *(f"s_{i}_{j}" for i in range(k) for j in range(i, k)), *(f"q_{i}_{t}" for i in range(k) for t in range(m))]
    return f"{name} AS (SELECT f.g, {', '.join(f'sum({c}) AS {c}' for c in cells)} FROM {source} s JOIN (SELECT g FROM {source}) f ON f.g <> s.g GROUP BY f.g)"


def ridge(name: str, source: str, at: Sequence[int], m: int, alpha: float, scaled: bool = False) -> str:
    """CTE `name`: (g, b_t_0, b_t_1, ..., gain_t) from the sums of `source`; input i of `at` has coefficient b_t_(i + 1).

    gain is the inner product of the solution with its right side: what the inputs take off the squared error, with the penalty.
    """
    k, targets = range(len(at)), range(m)
    s = lambda i, j: f"s_{min(at[i], at[j])}_{max(at[i], at[j])}"
    centre = [f"u_{at[i]} / n AS m_{i}" for i in k] + [f"v_{t} / n AS y_{t}" for t in targets]
    centre += [f"{s(i, j)} - u_{at[i]} * u_{at[j]} / n AS a_{i}_{j}" for i in k for j in k if i <= j]
    centre += [f"q_{at[i]}_{t} - u_{at[i]} * v_{t} / n AS b_{i}_{t}" for i in k for t in targets]
    steps = [f"{name}_c AS (SELECT g, n, {', '.join(centre)} FROM {source})"]
    width = [f"sqrt(a_{i}_{i} / n)" if scaled else "1" for i in k]
    unit = [f"{w} AS d_{i}" for i, w in enumerate(width)]
    unit += [f"a_{i}_{j} / ({width[i]} * {width[j]}){f' + {alpha}::DOUBLE' if i == j else ''} AS a_{i}_{j}" for i in k for j in k if i <= j]
    unit += [f"b_{i}_{t} / {width[i]} AS b_{i}_{t}" for i in k for t in targets] + [f"b_{i}_{t} / {width[i]} AS r_{i}_{t}" for i in k for t in targets]
    keep = [f"m_{i}" for i in k] + [f"y_{t}" for t in targets]
    steps.append(f"{name}_e AS (SELECT g, {', '.join(keep + unit)} FROM {name}_c)")
    keep += [f"d_{i}" for i in k] + [f"r_{i}_{t}" for i in k for t in targets]
    last = f"{name}_e"
    for p in k:  # rows after p lose their part of pivot p
        cells = [f"a_{i}_{j} - a_{p}_{i} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" if i > p else f"a_{i}_{j}" for i in k for j in k if i <= j]
        cells += [f"b_{i}_{t} - a_{p}_{i} * b_{p}_{t} / a_{p}_{p} AS b_{i}_{t}" if i > p else f"b_{i}_{t}" for i in k for t in targets]
        steps.append(f"{name}_e{p} AS (SELECT g, {', '.join(keep + cells)} FROM {last})")
        last = f"{name}_e{p}"
    for p in reversed(k):  # back from the last input
        cells = [f"(b_{p}_{t}{''.join(f' - a_{p}_{j} * z_{j}_{t}' for j in k if j > p)}) / a_{p}_{p} AS z_{p}_{t}" for t in targets]
        steps.append(f"{name}_z{p} AS (SELECT *, {', '.join(cells)} FROM {last})")
        last = f"{name}_z{p}"
    out = [f"y_{t}{''.join(f' - m_{i} * z_{i}_{t} / d_{i}' for i in k)} AS b_{t}_0" for t in targets]
    out += [f"z_{i}_{t} / d_{i} AS b_{t}_{i + 1}" for t in targets for i in k] + [f"{' + '.join(f'r_{i}_{t} * z_{i}_{t}' for i in k)} AS gain_{t}" for t in targets]
    steps.append(f"{name} AS MATERIALIZED (SELECT g, {', '.join(out)} FROM {last})")
    return ", ".join(steps)


def predicted(inputs: Sequence[str], t: int = 0, model: str = "") -> str:
    of = f"{model}." if model else ""
    return f"{of}b_{t}_0" + "".join(f" + {of}b_{t}_{i + 1} * ({x})" for i, x in enumerate(inputs))


def held_out(inputs: Sequence[str], targets: Sequence[str], alpha: float, source: str = "yy", weight: str = "1", name: str = "h") -> str:
    """CTEs up to `name`: each fold's model of the other folds."""
    k, m = len(inputs), len(targets)
    return f"{sums(f'{name}s', source, inputs, targets, weight=weight)}, {others(f'{name}o', f'{name}s', k, m)}, {ridge(name, f'{name}o', range(k), m, alpha)}"


SUMMARY = "SELECT round(corr(p, y), 4) AS r, round(avg(abs(p - y)), 4) AS mae, count(p) AS n FROM p"


def coefficients(names: Sequence[str], model: str, first: int = 1) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, round(b_0_{i}, 4) AS coef FROM {model}" for i, n in enumerate(names, first))


def scaled_ridge() -> str:
    k = len(FEATURES)
    return f"WITH {LABELLED}, {sums('s', 'yy', FEATURES, ['y'], None)}, {ridge('b', 's', range(k), 1, 1.0, True)} {coefficients(['intercept', *FEATURES], 'b', 0)}"


def uncertainty_ridge() -> str:
    return f"WITH {LABELLED}, {held_out(FEATURES, ['y'], 0.1, weight='1 / (label_std + 0.1::DOUBLE)')}, p AS (SELECT y, {predicted(FEATURES)} AS p FROM yy JOIN h ON g = fold) {SUMMARY}"


def ordinal_regression() -> str:
    flags = [f"CASE WHEN y > {k}.5 THEN 1 ELSE 0 END" for k in range(1, 10)]
    total = " + ".join(f"least(greatest({predicted(FEATURES, t)}, 0), 1)" for t in range(len(flags)))
    return f"WITH {LABELLED}, {held_out(FEATURES, flags, 1.0)}, p AS (SELECT y, 1 + {total} AS p FROM yy JOIN h ON g = fold) {SUMMARY}"


def rank_regression(knots: int = 101) -> str:
    """Mean ranks as shares; the prediction goes back through the label's quantiles."""
    shares = ", ".join(f"{k / (knots - 1)!r}" for k in range(knots))
    return f"""WITH {LABELLED}, c AS (SELECT y, count(*) AS m FROM yy GROUP BY y), k AS (SELECT y, (sum(m) OVER (ORDER BY y) - m + (m + 1) / 2.0::DOUBLE) / sum(m) OVER () AS rank FROM c),
ranked AS (SELECT yy.*, rank FROM yy JOIN k USING (y)), {held_out(FEATURES, ['rank'], 0.1, 'ranked')}, q AS (SELECT quantile_cont(y, [{shares}]) AS q FROM yy),
v AS (SELECT y, least(greatest({predicted(FEATURES)}, 0), 1) * {knots - 1} AS x FROM yy JOIN h ON g = fold), i AS (SELECT y, x, least(floor(x), {knots - 2})::INT AS i FROM v),
p AS (SELECT y, q[i + 1] + (x - i) * (q[i + 2] - q[i + 1]) AS p FROM i, q) {SUMMARY}"""


def subset_scores(subsets: dict[str, list[str]], alpha: float = 1.0) -> str:
    """Out-of-fold correlation of each subset's model, over all rows and human rows."""
    k = len(FEATURES)
    models = ", ".join(ridge(f"m{i}", "o", [FEATURES.index(x) for x in own], 1, alpha) for i, own in enumerate(subsets.values()))
    scores = " UNION ALL ".join(
        f"SELECT '{name}' AS inputs, round(corr({predicted(own, 0, f'm{i}')}, y), 4) AS cv, round(corr({predicted(own, 0, f'm{i}')}, y) FILTER (source = 'human'), 4) AS human FROM yy JOIN m{i} ON m{i}.g = fold"
        for i, (name, own) in enumerate(subsets.items())
    )
    return f"WITH {LABELLED}, {sums('s', 'yy', FEATURES, ['y'])}, {others('o', 's', k, 1)}, {models} {scores}"


def signed_combiner(signs: dict[str, int]) -> str:
    """The bounded optimum: of all choices of bounded inputs that stand at zero, the one that keeps the signs and gains most."""
    bound = [x for x in FEATURES if signs.get(x)]
    models, tries = [], []
    for code in range(1 << len(bound)):
        own = [x for x in FEATURES if x not in bound or code >> bound.index(x) & 1]
        models.append(ridge(f"m{code}", "s", [FEATURES.index(x) for x in own], 1, 1.0, True))
        fits = " AND ".join([f"b_0_{i + 1} * {signs[x]} >= 0" for i, x in enumerate(own) if x in bound] or ["true"])
        tries.append(f"SELECT gain_0 AS gain, {', '.join(f'b_0_{own.index(x) + 1} AS {x}' if x in own else f'0 AS {x}' for x in FEATURES)} FROM m{code} WHERE {fits}")
    kept = lambda x: f"{x} * {signs[x]} >= 0" if signs.get(x) else "true"
    out = " UNION ALL ".join(f"SELECT '{x}' AS name, round({x}, 4) AS coef, {kept(x)} AS kept FROM best" for x in FEATURES)
    return f"WITH {LABELLED}, {sums('s', 'yy', FEATURES, ['y'], None)}, {', '.join(models)}, tries AS ({' UNION ALL '.join(tries)}), best AS (SELECT * FROM tries ORDER BY gain DESC LIMIT 1) {out}"


def combiner_search(candidates: dict[str, list[str]], alphas: Sequence[float]) -> str:
    """Candidates' rounded predictions, each calibrated by the isotonic fit of its own on human rows."""
    k, models, tries = len(FEATURES), [], []
    for name, own in candidates.items():
        for alpha in alphas:
            at = f"m{len(models)}"
            models.append(ridge(at, "o", [FEATURES.index(x) for x in own], 1, alpha))
            tries.append(f"SELECT '{name}' AS inputs, {alpha}::DOUBLE AS alpha, round({predicted(own, 0, at)}, 1) AS x, t FROM d JOIN {at} ON {at}.g = fold WHERE source = 'human'")
    # The fit at a place is the largest, over beginnings at or before it, of the least mean of a stretch that reaches it.
    return f"""WITH {LABELLED}, d AS (SELECT *, (y - 1) / 9 * 100 AS t FROM yy), {sums('s', 'd', FEATURES, ['t'])}, {others('o', 's', k, 1)}, {', '.join(models)},
each AS MATERIALIZED ({' UNION ALL '.join(tries)}), g AS (SELECT inputs, alpha, x, sum(t) AS s, count(*) AS n FROM each GROUP BY ALL),
c AS MATERIALIZED (SELECT inputs, alpha, x, row_number() OVER w AS i, sum(s) OVER w AS s, sum(n) OVER w AS n, s AS own_s, n AS own_n FROM g WINDOW w AS (PARTITION BY inputs, alpha ORDER BY x)),
m AS (SELECT inputs, alpha, b.x, min((b.s - a.s + a.own_s) / (b.n - a.n + a.own_n)) OVER (PARTITION BY inputs, alpha, a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b USING (inputs, alpha) WHERE b.i >= a.i),
f AS (SELECT inputs, alpha, x, max(least) AS v FROM m GROUP BY ALL), e AS (SELECT inputs, alpha, round(avg(abs(v - t)), 4) AS mae FROM each JOIN f USING (inputs, alpha, x) GROUP BY ALL)
SELECT inputs, alpha, mae, row_number() OVER (ORDER BY mae, inputs, alpha) = 1 AS best FROM e"""


def _vectors(dim: int) -> str:
    e = lambda k: f"embedding[{k + 1}]::DOUBLE"
    dims = ", ".join(f"least(greatest(3 + 3 * {e(k)} - 2 * {e(k + 1)} + vec_id * 7 % 11 / 11.0::DOUBLE, 1), 5) AS dim_{k}" for k in range(3))
    return f"v AS (SELECT vec_id % 5 AS fold, label::DOUBLE AS feat, {', '.join(f'{e(k)} AS x{k}' for k in range(dim))}, {dims} FROM embeddings), d AS MATERIALIZED (SELECT *, 10 - dim_0 - dim_1 * 0.5::DOUBLE + feat / 10 AS overall FROM v)"


def final_model(dim: int) -> str:
    places, dims = [f"x{k}" for k in range(dim)], [f"dim_{k}" for k in range(3)]
    first = ", ".join(f"{predicted(places, t)} AS p_{t}" for t in range(3))
    inputs = ["p_0", "p_1", "p_2", "feat"]
    return f"WITH {_vectors(dim)}, {sums('s', 'd', places, dims, None)}, {ridge('b', 's', range(dim), 3, 0.1)}, f AS (SELECT {first}, feat, overall FROM d, b), {sums('fs', 'f', inputs, ['overall'], None)}, {ridge('c', 'fs', range(4), 1, 10.0)} {coefficients([*dims, 'feat'], 'c')}"


def vector_subscores(dim: int) -> str:
    places, dims = [f"x{k}" for k in range(dim)], [f"dim_{k}" for k in range(3)]
    first = ", ".join(f"least(greatest({predicted(places, t)}, 1), 5) AS p_{t}" for t in range(3))
    inputs = ["p_0", "p_1", "p_2", "feat"]
    return f"""WITH {_vectors(dim)}, {held_out(places, dims, 0.1, 'd', name='b')}, f AS MATERIALIZED (SELECT fold, {first}, feat, overall, dim_0, dim_1, dim_2 FROM d JOIN b ON g = fold), {held_out(inputs, ['overall'], 10.0, 'f', name='c')},
p AS (SELECT f.*, {predicted(inputs)} AS p FROM f JOIN c ON g = fold) SELECT round(corr(p, overall), 4) AS r, {', '.join(f'round(corr(p_{k}, dim_{k}), 4) AS r_{k}' for k in range(3))}, count(p) AS n FROM p"""
