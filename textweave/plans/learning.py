"""Queries of training and out-of-fold evaluation; SQL where a closed form has few inputs.

Rows stand on `lineitem`: three inputs and a label, folds by order, sources by return flag. Vector models stand on
`embeddings` with labels from the vectors' ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweave.functions.vectors import rounded
from textweave.operators import audits, calibration, joins, training
from textweave.plans import closed_forms
from textweave.plans.audits import _Z as AUDITED
from textweave.plans.audits import FEATURES, rated
from textweave.plans.records import random_pairs_sql
from textweave.plans.tables import table
from textweave.sources.scratch import stored

INPUTS = ["l_quantity", "l_discount", "l_tax"]
DIM = 16
SIGNS = {"se_a": -1, "ce_a": 1, "ne_a": 1}
CANDIDATES, ALPHAS = {"ce": ["ce_a", "ce_b"], "se": ["se_a", "se_b"], "all": FEATURES}, (0.1, 10.0)
COMBINED = {"subscores": ["ce_a", "ce_b"], "with features": ["ce_a", "ce_b", "ne_a"], "all": FEATURES}


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_extendedprice", *INPUTS, F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"), F.when(F.col("l_returnflag") == "R", "human").otherwise("synthetic").alias("source"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows with a label that the features partly explain."""
    d = rated(spark, sf_dir).withColumn("fold", F.pmod("id", F.lit(5)).cast("int"))
    y = F.least(F.greatest(1 + F.col("se_a") / 8 + F.col("ce_a") * 20 + F.pmod("id", F.lit(7)) / 5.0, F.lit(1.0)), F.lit(10.0))
    return d.withColumn("y", y)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda k: F.get(e, F.lit(k)).cast("double")
    noise = F.pmod(F.col("vec_id") * 7, F.lit(11)) / 11.0
    dims = {f"dim_{k}": F.least(F.greatest(3 + 3 * at(k) - 2 * at(k + 1) + noise, F.lit(1.0)), F.lit(5.0)) for k in range(3)}
    d = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.pmod("vec_id", F.lit(5)).cast("int").alias("fold"), F.col("label").cast("double").alias("feat"), *[c.alias(n) for n, c in dims.items()])
    return d.withColumn("overall", 10 - F.col("dim_0") - F.col("dim_1") * 0.5 + F.col("feat") / 10)


def ridge_out_of_fold(spark, sf_dir):
    fitted = training.out_of_fold(rows(spark, sf_dir), INPUTS, "l_extendedprice", "fold", 1.0)
    return rounded(fitted.groupBy("fold").agg(F.count("*").alias("n"), F.corr("prediction", "l_extendedprice").alias("r")), 4)


def weighted_ridge(spark, sf_dir):
    """Ridge with one weight a source, from moments by source."""
    d = rows(spark, sf_dir)
    m = training.moments(d, [*INPUTS, "l_extendedprice"], ["fold", "source"])
    counts = {r[0]: r[1] for r in d.groupBy("source").count().collect()}
    w = training.source_weights(counts, "human")
    beta = training.ridge(m.reweighted(lambda g: w[g[1]]).total(), 10.0)
    return spark.createDataFrame([(n, round(float(b), 4)) for n, b in zip(["intercept", *INPUTS], beta)], "name string, coef double")


def source_weights(spark, sf_dir):
    counts = {r[0]: r[1] for r in rows(spark, sf_dir).groupBy("source").count().collect()}
    kinds = {k: training.source_weights(counts, "human", k, 2.0) for k in ("training", "equal", "multiplier")}
    return spark.createDataFrame([(s, k, round(float(x), 6)) for k, v in kinds.items() for s, x in v.items()], "source string, kind string, weight double")


def vector_subscores(spark, sf_dir):
    """Two-stage out-of-fold predictions: dimensions from vectors, then their combiner."""
    out = training.two_stage(vectors(spark, sf_dir), "embedding", DIM, [f"dim_{k}" for k in range(3)], ["feat"], "overall", "fold")
    return rounded(out.agg(F.corr("prediction", "overall").alias("r"), *[F.corr(f"dim_{k}_oof", f"dim_{k}").alias(f"r_{k}") for k in range(3)], F.count("prediction").alias("n")), 4)


def final_model(spark, sf_dir):
    a = training.final_fit(vectors(spark, sf_dir), "embedding", DIM, [f"dim_{k}" for k in range(3)], ["feat"], "overall")
    names = [*(f"dim_{k}" for k in range(3)), "feat"]
    return spark.createDataFrame([(n, round(c, 4)) for n, c in zip(names, a["combiner"]["coef"])], "name string, coef double")


def model_sweep(spark, sf_dir):
    """Penalties of three kinds of models under three weightings, from one pass."""
    m = training.moments(labelled(spark, sf_dir), [*FEATURES, "y"], ["fold", "source"])
    top = training.strongest(m, "y", 3, lambda g: g[1] == "human")
    models = {
        "ridge": [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0, 100.0)] + [{"alpha": 1.0, "inputs": top}],
        "lasso": [{"alpha": a} for a in (1e-4, 1e-2, 0.1)], "elastic_net": [{"alpha": a, "l1_ratio": r} for a in (1e-3, 0.1) for r in (0.1, 0.5)],
    }
    return rounded(training.sweep(spark, m, "y", "human", models), 4)


def best_models(spark, sf_dir):
    """The best configuration of each kind by the objective."""
    return audits.best_per_group(model_sweep(spark, sf_dir), ["kind"], "objective", "config").select("kind", "config", "weighting", "objective")


def selected_features(spark, sf_dir):
    m = training.moments(labelled(spark, sf_dir), [*FEATURES, "y"], ["fold", "source"])
    return spark.createDataFrame(list(enumerate(training.strongest(m, "y", 4, lambda g: g[1] == "human"))), "place int, feature string")


def objectives(spark, sf_dir):
    """Both objectives of the quantity as a score of the label, by line number."""
    from textweave.functions.vectors import pair_correlations

    d = labelled(spark, sf_dir).withColumn("line", F.pmod("id", F.lit(10)).cast("int"))
    kinds = {"cv": ("se_a", "y"), "human": (F.when(F.col("source") == "human", F.col("se_a")), "y"), "synth": (F.when(F.col("source") != "human", F.col("se_a")), "y")}
    by = {(r.line, r.pair): r.r for r in pair_correlations(d, kinds, ["line"]).collect()}  # a few lines
    folds: dict[int, list[float]] = {}
    for r in pair_correlations(d.where("source = 'human'"), {"own": ("se_a", "y")}, ["line", "fold"]).collect():
        folds.setdefault(r.line, []).append(r.r)
    out = []
    for line in sorted({k for k, _ in by}):
        s = {n: by.get((line, n), 0.0) for n in kinds} | {"fold_std": float(np.std(folds.get(line, [0.0])))}
        out.append((line, training.dual_objective(s), training.human_objective(s)))
    return rounded(spark.createDataFrame(out, "line int, dual double, by_human double"), 4)


def scaled_ridge(spark, sf_dir):
    m = training.moments(labelled(spark, sf_dir), [*FEATURES, "y"], ["fold"])
    return spark.createDataFrame([(n, round(float(b), 4)) for n, b in zip(["intercept", *FEATURES], training.scaled_ridge(m.total(), 1.0))], "name string, coef double")


def isotonic_calibration(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("p", F.round(F.col("se_a") * 2)).withColumn("t", (F.col("y") - 1) / 9 * 100)
    at = calibration.thresholds(calibration.isotonic_blocks(d, "p", "t"))
    return rounded(at.select(F.col("x").alias("threshold"), F.col("y").alias("value")), 4)


def combiner_search(spark, sf_dir):
    """Inputs by penalties; the least calibrated error on human rows wins. The calibration sees the rows it is scored on.

    Rows are read twice, for the moments and for cells of equal candidate, prediction and target with their number of rows;
    the calibration and the errors come from the cells.
    """
    d = labelled(spark, sf_dir).withColumn("target", (F.col("y") - 1) / 9 * 100)
    m = training.moments(d, [*FEATURES, "target"], ["fold", "source"])
    tries = [(name, alpha) for name in CANDIDATES for alpha in ALPHAS]
    predictions = []
    for name, alpha in tries:
        inputs = CANDIDATES[name]
        models = training.fold_models(m.part([*inputs, "target"]), lambda t, a=alpha: training.ridge(t, a))
        predictions.append(F.round(training.by_fold("fold", models, lambda b, i=inputs: training.line(i, b)), 1))
    # All candidates are calibrated together, each by the thresholds of its own.
    each = d.where("source = 'human'").select("target", F.posexplode(F.array(*predictions)).alias("c", "p"))
    cells = each.groupBy("c", "p", "target").agg(F.count("*").alias("n"))
    keys = ["inputs", "alpha"]
    own = [F.get(F.array(*[F.lit(t[k]) for t in tries]), F.col("c")).alias(n) for k, n in enumerate(keys)]
    cells = stored(cells.select(*own, "p", "target", "n"), "cells")
    met = calibration.calibrated(cells, "p", calibration.isotonic_blocks(cells, "p", "target", keys, times="n"), "value", keys)
    error = F.abs(F.col("value") - F.col("target"))
    out = met.groupBy(*keys).agg(F.round(F.sum(error * F.col("n")) / F.sum(F.when(error.isNotNull(), F.col("n"))), 4).alias("mae"))
    best = F.min(F.struct("mae", "inputs", "alpha")).over(Window.partitionBy(F.lit(0)))  # a row for each candidate
    return out.select(*keys, "mae", F.struct("mae", "inputs", "alpha").eqNullSafe(best).alias("best"))


def uplift_model(spark, sf_dir):
    """A non-negative correction of a base score; the corrected error must not be larger on the rows that need it."""
    d = labelled(spark, sf_dir).withColumns({"target": (F.col("y") - 1) / 9 * 100, "base": F.col("se_a")})
    beta, corrected = training.uplift(d, "base", "target", ["ce_a", "ce_b", "ne_a"], (F.col("target") >= 66) & (F.col("base") - F.col("target") <= -15))
    return rounded(d.agg(F.lit(min(beta) >= 0).alias("non_negative"), (F.min(corrected - F.col("base")) >= 0).alias("only_up"), (F.max(corrected - F.col("base")) <= 40).alias("capped"), F.count("*").alias("n")))


def signed_combiner(spark, sf_dir):
    """Coefficients under a contract of signs, standardised, with ridge rows."""
    m = training.moments(labelled(spark, sf_dir), [*FEATURES, "y"], ["fold"])
    low, high = training.signed_bounds(FEATURES, SIGNS)
    beta = training.bounded(m.total(), low, high, 1.0, scaled=True)
    return spark.createDataFrame([(n, round(float(b), 4), bool(l <= b <= h)) for n, b, l, h in zip(FEATURES, beta[1:], low, high)], "name string, coef double, kept boolean")


def _oof_summary(out: DataFrame, label: str = "y") -> DataFrame:
    return rounded(out.agg(F.corr("prediction", label).alias("r"), F.avg(F.abs(F.col("prediction") - F.col(label))).alias("mae"), F.count("prediction").alias("n")), 4)


def ordinal_regression(spark, sf_dir):
    return _oof_summary(training.ordinal(labelled(spark, sf_dir), FEATURES, "y", "fold", [k + 0.5 for k in range(1, 10)]))


def noisy_label_ridge(spark, sf_dir):
    """Models of augmented rows, evaluated on the rows as they are."""
    d = labelled(spark, sf_dir)
    m = training.moments(training.noisy_labels(d, "y", "id"), [*FEATURES, "y"], ["fold"])
    models = training.fold_models(m, lambda t: training.ridge(t, 0.1))
    return _oof_summary(d.withColumn("prediction", training.by_fold("fold", models, lambda b: training.line(FEATURES, b))))


def uncertainty_ridge(spark, sf_dir):
    return _oof_summary(training.out_of_fold(labelled(spark, sf_dir), FEATURES, "y", "fold", 0.1, training.uncertainty_weight(F.col("label_std"))))


def rank_regression(spark, sf_dir):
    return _oof_summary(training.rank_regression(labelled(spark, sf_dir), FEATURES, "y", "fold"))


def huber_regression(spark, sf_dir):
    d = labelled(spark, sf_dir)
    a, b = training.huber(d, FEATURES, "y")
    return rounded(d.agg(F.corr(training.line(FEATURES, [a, *b]), F.col("y")).alias("r"), F.count("*").alias("n")), 2)


def pairwise_ridge(spark, sf_dir):
    """Coefficients of differences of pairs, and how the score that they give goes with the label."""
    d = labelled(spark, sf_dir)
    pairs = joins.random_pairs(d, "id", "y", 1.5, 3000)
    inputs = FEATURES[:3]
    w, score = training.pairwise(pairs, d, "id", inputs, "y")
    fit = d.agg(F.corr(score, F.col("y")), F.avg(F.abs(score - F.col("y")))).first()
    return spark.createDataFrame([(n, round(float(x), 4)) for n, x in zip([*inputs, "r", "mae"], [*w, *fit])], "name string, value double")


def _subsets(spark, sf_dir, subsets: dict[str, list[str]], alpha: float = 1.0) -> DataFrame:
    m = training.moments(labelled(spark, sf_dir), [*FEATURES, "y"], ["fold", "source"])
    return rounded(spark.createDataFrame(training.subset_scores(m, "y", subsets, alpha, "human"), "inputs string, cv double, human double"), 4)


def ablation(spark, sf_dir):
    return _subsets(spark, sf_dir, training.leave_one_out(FEATURES))


def module_ablation(spark, sf_dir):
    return _subsets(spark, sf_dir, training.leave_module_out(FEATURES))


def best_subsets(spark, sf_dir):
    return _subsets(spark, sf_dir, training.best_subsets(FEATURES, 2))


def combiner_inputs(spark, sf_dir):
    return _subsets(spark, sf_dir, COMBINED)


def evaluated_weights(spark, sf_dir):
    d = labelled(spark, sf_dir)
    return rounded(training.evaluated_weights(d, F.least(F.col("se_a") + 50 * F.col("ce_a"), F.lit(100.0)), "y", "source", "fold", "human"), 4)


def weight_sensitivity(spark, sf_dir):
    """How the correlation moves as one weight of a score is changed, from one pass of moments."""
    m = training.moments(labelled(spark, sf_dir), [*FEATURES, "y"], ["fold"])
    base = {"ce_a": 50.0, "se_a": 1.0, "ne_a": 0.5, "ce_b": 0.0, "se_b": 0.0}
    out = []
    for name in ("ce_a", "se_a", "ne_a"):
        for factor in (0.5, 1.0, 1.5):
            beta = np.array([0.0, *(base[f] * (factor if f == name else 1.0) for f in FEATURES)])
            out.append((name, factor, round(training.scores_of(m, {g[0]: beta for g in m.by})["cv"], 6)))
    return spark.createDataFrame(out, "feature string, factor double, cv double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ridge_out_of_fold, weighted_ridge, source_weights, vector_subscores, final_model, model_sweep, best_models, selected_features, objectives, scaled_ridge, isotonic_calibration, combiner_search, uplift_model,
        signed_combiner, ordinal_regression, noisy_label_ridge, uncertainty_ridge, rank_regression, huber_regression, pairwise_ridge, ablation, module_ablation, best_subsets, combiner_inputs,
        evaluated_weights, weight_sensitivity,
    )
}


def _cramer(alpha: str) -> str:
    """Coefficients b1 to b3 of three inputs by Cramer's rule, from centred products s11 ... s33 and c1 to c3."""
    a = [[f"(s11 + {alpha})", "s12", "s13"], ["s12", f"(s22 + {alpha})", "s23"], ["s13", "s23", f"(s33 + {alpha})"]]

    def det(m: list[list[str]]) -> str:
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    parts = []
    for k in range(3):
        swapped = [[f"c{i + 1}" if j == k else a[i][j] for j in range(3)] for i in range(3)]
        parts.append(f"{det(swapped)} / {det(a)} AS b{k + 1}")
    return ", ".join(parts)


_XYZ = "z AS (SELECT l_orderkey % 5 AS fold, CASE WHEN l_returnflag = 'R' THEN 'human' ELSE 'synthetic' END AS source, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y FROM lineitem)"


def _moments(group: str, weight: str = "1") -> str:
    """Weighted means and centred products of x1 to x3 and y by a group, from table t."""
    cells = [f"sum(w * x{i}) / sum(w) AS m{i}" for i in range(1, 4)] + ["sum(w * y) / sum(w) AS my"]
    cells += [f"sum(w * x{i} * x{j}) - sum(w * x{i}) * sum(w * x{j}) / sum(w) AS s{i}{j}" for i in range(1, 4) for j in range(i, 4)]
    cells += [f"sum(w * x{i} * y) - sum(w * x{i}) * sum(w * y) / sum(w) AS c{i}" for i in range(1, 4)]
    return f"SELECT {group}, {', '.join(cells)} FROM (SELECT *, {weight} AS w FROM t) GROUP BY {group}"


_COUNTS = "n AS (SELECT count_if(source = 'human')::DOUBLE AS h, count_if(source <> 'human')::DOUBLE AS s FROM z)"

_Y = "yy AS (SELECT *, id % 5 AS fold, least(greatest(1 + se_a / 8 + ce_a * 20 + id % 7 / 5.0::DOUBLE, 1), 10) AS y FROM z)"
_WCORR = "(sum(w * s * y) - sum(w * s) * sum(w * y) / sum(w)) / sqrt((sum(w * s * s) - sum(w * s) * sum(w * s) / sum(w)) * (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)))"

SQL: dict[str, str] = {
    "ridge_out_of_fold": f"""WITH {_XYZ}, t AS (SELECT f.fold AS held, z.* FROM z JOIN (SELECT DISTINCT fold FROM z) f ON f.fold <> z.fold), m AS ({_moments("held")}), b AS (SELECT *, {_cramer("1.0")} FROM m),
p AS (SELECT z.fold, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3) AS p FROM z JOIN b ON held = fold) SELECT fold::INT AS fold, count(*) AS n, round(corr(p, y), 4) AS r FROM p GROUP BY fold""",
    "weighted_ridge": f"""WITH {_XYZ}, {_COUNTS}, t AS (SELECT 1 AS g, z.*, CASE WHEN source = 'human' THEN 1 ELSE 0.3::DOUBLE * h / s END AS u FROM z, n), m AS ({_moments("g", "u")}), b AS (SELECT *, {_cramer("10.0")} FROM m)
SELECT 'intercept' AS name, round(my - b1 * m1 - b2 * m2 - b3 * m3, 4) AS coef FROM b UNION ALL SELECT 'l_quantity', round(b1, 4) FROM b UNION ALL SELECT 'l_discount', round(b2, 4) FROM b UNION ALL SELECT 'l_tax', round(b3, 4) FROM b""",
    "source_weights": f"WITH {_XYZ}, {_COUNTS} SELECT 'human' AS source, 'training' AS kind, 1.0::DOUBLE AS weight FROM n UNION ALL SELECT 'synthetic', 'training', round(0.3::DOUBLE * h / s, 6) FROM n UNION ALL SELECT 'human', 'equal', round(s / h, 6) FROM n UNION ALL SELECT 'synthetic', 'equal', 1 FROM n UNION ALL SELECT 'human', 'multiplier', 2 FROM n UNION ALL SELECT 'synthetic', 'multiplier', 1 FROM n",
    "objectives": f"""WITH {AUDITED}, {_Y}, d AS (SELECT *, (id % 10)::INT AS line FROM yy), f AS (SELECT line, coalesce(stddev_pop(r), 0) AS fold_std FROM (SELECT line, fold, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(se_a, y), 0) END AS r FROM d WHERE source = 'human' GROUP BY line, fold) GROUP BY line),
c AS (SELECT line, corr(se_a, y) AS cv, corr(se_a, y) FILTER (source = 'human') AS h, corr(se_a, y) FILTER (source <> 'human') AS s FROM d GROUP BY line)
SELECT line, round(0.5::DOUBLE * least(greatest(cv, 0), 1) + 0.3::DOUBLE * least(greatest(h, 0), 1) + 0.2::DOUBLE * greatest(0, 1 - abs(h - s)), 4) AS dual,
  CASE WHEN cv < 0.5 THEN -1 ELSE round(0.6::DOUBLE * least(greatest(h, 0), 1) + 0.25::DOUBLE * least(greatest(cv, 0), 1) + 0.15::DOUBLE * greatest(0, 1 - fold_std / 0.3::DOUBLE), 4) END AS by_human FROM c JOIN f USING (line)""",
    "selected_features": f"""WITH {AUDITED}, {_Y}, r AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, y)) AS r FROM yy WHERE source = 'human'" for f in FEATURES)}), k AS (SELECT feature, (row_number() OVER (ORDER BY r.r DESC, feature) - 1)::INT AS place FROM r) SELECT place, feature FROM k WHERE place < 4""",
    "weight_sensitivity": f"WITH {AUDITED}, {_Y} " + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {f}::DOUBLE AS factor, round(corr(50.0::DOUBLE * {f if n == 'ce_a' else 1.0} * ce_a + 1.0::DOUBLE * {f if n == 'se_a' else 1.0} * se_a + 0.5::DOUBLE * {f if n == 'ne_a' else 1.0} * ne_a, y), 6) AS cv FROM yy" for n in ("ce_a", "se_a", "ne_a") for f in (0.5, 1.0, 1.5)
    ),
    "evaluated_weights": f"""WITH {AUDITED}, {_Y}, n AS (SELECT count_if(source <> 'human') / count_if(source = 'human') AS w FROM yy), s AS (SELECT yy.*, least(se_a + 50 * ce_a, 100) AS s, CASE WHEN source = 'human' THEN n.w ELSE 1 END AS w FROM yy, n),
g AS (SELECT fold, {_WCORR} AS r FROM s GROUP BY fold), f AS (SELECT avg(r) AS cv, stddev_pop(r) AS cv_std FROM g)
SELECT round({_WCORR}, 4) AS val, round(avg(pow(s - (y - 1) / 9 * 100, 2)), 4) AS mse, round(avg(s), 4) AS score_mean, round(stddev_pop(s), 4) AS score_std, round(corr(s, y) FILTER (source = 'human'), 4) AS human, round(corr(s, y) FILTER (source <> 'human'), 4) AS synth, (SELECT round(cv, 4) FROM f) AS cv, (SELECT round(cv_std, 4) FROM f) AS cv_std FROM s""",
    # The fit at a place is the largest, over beginnings at or before it, of the least mean of a stretch that reaches it.
    "isotonic_calibration": f"""WITH {AUDITED}, {_Y}, d AS (SELECT round(se_a * 2) AS x, least(greatest((y - 1) / 9 * 100, 0), 100) AS t FROM yy), g AS (SELECT x, sum(t) AS s, count(*) AS n FROM d WHERE x IS NOT NULL AND t IS NOT NULL GROUP BY x),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS s, sum(n) OVER (ORDER BY x) AS n, s AS own_s, n AS own_n FROM g),
m AS (SELECT a.i AS a, b.i AS i, min((b.s - a.s + a.own_s) / (b.n - a.n + a.own_n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b ON b.i >= a.i),
f AS (SELECT i, max(least) AS v FROM m GROUP BY i), k AS (SELECT min(x) AS lo, max(x) AS hi, min(v) AS v FROM f JOIN c USING (i) GROUP BY round(v, 7))
SELECT lo AS threshold, round(v, 4) AS value FROM k UNION ALL SELECT hi, round(v, 4) FROM k WHERE hi > lo""",
    "pairwise_ridge": f"""WITH {AUDITED}, {_Y}, r AS (SELECT id AS k, y AS s FROM yy), {random_pairs_sql(1.5, 3000)},
t AS (SELECT confidence AS w, h.ce_a - l.ce_a AS x1, h.ce_b - l.ce_b AS x2, h.se_a - l.se_a AS x3 FROM pairs JOIN yy h ON h.id = high JOIN yy l ON l.id = low),
m AS (SELECT {", ".join(f"sum(w * x{i} * x{j}) AS s{i}{j}" for i in range(1, 4) for j in range(i, 4))}, {", ".join(f"sum(w * x{i}) AS c{i}" for i in range(1, 4))} FROM t), b AS (SELECT {_cramer("1.0")} FROM m),
v AS (SELECT b1 * ce_a + b2 * ce_b + b3 * se_a AS p, y FROM yy, b), f AS (SELECT regr_slope(y, p) AS a, regr_intercept(y, p) AS c, corr(y, p) AS r FROM v)
SELECT 'ce_a' AS name, round(b1, 4) AS value FROM b UNION ALL SELECT 'ce_b', round(b2, 4) FROM b UNION ALL SELECT 'se_a', round(b3, 4) FROM b UNION ALL SELECT 'r', round(abs(r), 4) FROM f
UNION ALL SELECT 'mae', round(avg(abs(a * p + c - y)), 4) FROM v, f""",
    "scaled_ridge": closed_forms.scaled_ridge(),
    "uncertainty_ridge": closed_forms.uncertainty_ridge(),
    "ordinal_regression": closed_forms.ordinal_regression(),
    "rank_regression": closed_forms.rank_regression(),
    "ablation": closed_forms.subset_scores(training.leave_one_out(FEATURES)),
    "module_ablation": closed_forms.subset_scores(training.leave_module_out(FEATURES)),
    "best_subsets": closed_forms.subset_scores(training.best_subsets(FEATURES, 2)),
    "combiner_inputs": closed_forms.subset_scores(COMBINED),
    "signed_combiner": closed_forms.signed_combiner(SIGNS),
    "combiner_search": closed_forms.combiner_search(CANDIDATES, ALPHAS),
    "final_model": closed_forms.final_model(DIM),
    "vector_subscores": closed_forms.vector_subscores(DIM),
}
