"""Queries of boosted-tree pipelines and of scores by their artifacts, on `lineitem`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.vectors import rounded
from textweave.operators import boosting, stacking, training
from textweave.plans.audits import FEATURES
from textweave.plans.learning import labelled
from textweave.plans.serving import FEATURES as NAMED
from textweave.plans.serving import _linear_sql
from textweave.plans.tables import spread, table

DIMENSIONS = ["d_flow", "d_focus", "d_close"]
ROUNDS, RATE = 6, 0.5
FIGURES = "version string, config string, blend double, models int, trees int, cv double, human double, synth double, fold_std double, objective double, dual double"


def rated_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows with dimensions that the features explain by steps and products, and a linear score on the label's scale."""
    d = labelled(spark, sf_dir)
    noise = lambda k: F.pmod(F.col("id") * k, F.lit(13)) / 13.0
    within = lambda c: F.least(F.greatest(c, F.lit(1.0)), F.lit(5.0))
    dims = {
        "d_flow": within(1 + F.when(F.col("ce_a") > 0.05, 2.0).otherwise(0.0) + noise(5)), "d_focus": within(F.col("se_a") / 12 + F.when(F.col("ce_b") < 0.03, 1.0).otherwise(0.0) + noise(7)),
        "d_close": within(F.when((F.col("ne_a") > 3) & (F.col("ce_a") < 0.06), 4.0).otherwise(2.0) + noise(3)),
    }
    d = d.withColumns(dims)
    y = F.least(F.greatest(0.5 * (F.col("d_flow") + F.col("d_focus")) + F.col("d_close") * 0.8 + F.pmod("id", F.lit(7)) / 7.0, F.lit(1.0)), F.lit(10.0))
    linear = F.least(F.greatest(100 * (0.3 * F.col("ce_a") * 10 + 0.4 * F.col("se_a") / 50 + 0.1 * F.col("ne_a") / 7), F.lit(0.0)), F.lit(100.0))
    return d.withColumn("y", y).withColumn("linear", linear / 100 * 9 + 1)


def recipes(counts: dict[str, int], chosen: list[str]) -> list[stacking.Recipe]:
    modules, dims = stacking.by_module(FEATURES, "y"), stacking.by_dimension(FEATURES, DIMENSIONS)
    training_weights = tuple(training.source_weights(counts, "human").items())
    synth = lambda w: (("human", 1.0), ("synthetic", w))
    make = lambda *a, **k: stacking.Recipe(*a, **{"rounds": ROUNDS, "rate": RATE} | k)
    return [
        make("v1", "modules", modules, training_weights),
        make("v2", "human x 3", modules, (("human", 3.0), ("synthetic", 1.0))),
        make("v3", "dimensions", dims, training_weights, "dimension_aligned_v3"),
        make("v4", "synthetic x 0.5", dims, synth(0.5), "dimension_aligned_v3", depth=2, alpha=10.0),
        make("v5", "lasso", stacking.by_dimension(chosen or FEATURES, DIMENSIONS), synth(0.25), "dimension_aligned_v3", depth=2),
        make("v5", "human validated", dims, synth(0.25), "dimension_aligned_v3", rate=0.8, stop=2),
        make("v5", "ensemble", dims, synth(1.0), "ensemble_v5", depth=2, blends=(0.3, 0.5, 0.7)),
        make("v5", "shallow", dims, synth(0.5), "dimension_aligned_v3", depth=1),
    ]


def boosted_pipelines(spark, sf_dir):
    """Every version's out-of-fold figures on all rows, and which one the human objective promotes."""
    d = rated_dimensions(spark, sf_dir)
    counts = {r[0]: r[1] for r in d.groupBy("source").count().collect()}  # two sources
    chosen = stacking.preselected(training.moments(d, [*FEATURES, *DIMENSIONS], ["fold", "source"]), DIMENSIONS, FEATURES, "human", 0.01)
    found, _ = stacking.run(d, recipes(counts, chosen), FEATURES, [*DIMENSIONS, "y"], "y", "linear", "fold", "source")
    best = max(found, key=lambda r: (r["objective"], r["version"], r["config"], r["blend"] or 0.0))
    names = [c.split()[0] for c in FIGURES.split(", ")]
    return rounded(spark.createDataFrame([(*(r[n] for n in names), r is best) for r in found], f"{FIGURES}, promoted boolean"), 4)


def boosted_trees(spark, sf_dir):
    """Out-of-fold correlation of trees of all inputs on all rows, by fold."""
    d = labelled(spark, sf_dir)
    models = [boosting.Model(f"m{f}", tuple(FEATURES), "y", f, (("human", 1.0), ("synthetic", 1.0)), depth=3, rounds=ROUNDS, rate=RATE) for f in range(5)]
    _, state = boosting.boost(d, FEATURES, ["y"], "fold", "source", models)
    out = state.select("fold", boosting.fold_prediction(models, {f: f"m{f}" for f in range(5)}).alias("p"), F.get("y", F.lit(0)).alias("y"))
    return rounded(out.groupBy("fold").agg(F.count("*").alias("n"), F.corr("p", "y").alias("r")), 4)


def bottleneck(spark, sf_dir):
    """Trees of all inputs and of the linear model's inputs against ridge and the linear score, all out of fold: what limits."""
    d = rated_dimensions(spark, sf_dir)
    counts = {r[0]: r[1] for r in d.groupBy("source").count().collect()}  # two sources
    weights = training.source_weights(counts, "human")
    same = ["ce_a", "ne_a", "se_a"]
    kinds = {"trees of all inputs": FEATURES, "trees of the linear inputs": same}
    models = [boosting.Model(f"{n}|{f}", tuple(inputs), "y", f, tuple(weights.items()), depth=4, rounds=ROUNDS, rate=RATE) for n, inputs in kinds.items() for f in range(5)]
    _, state = boosting.boost(d, FEATURES, ["y"], "fold", "source", models)
    table_of = state.select("fold", "source", *[boosting.fold_prediction(models, {f: f"{n}|{f}" for f in range(5)}).alias(f"p{k}") for k, n in enumerate(kinds)], F.get("y", F.lit(0)).alias("y"))
    trees = training.moments(table_of, ["p0", "p1", "y"], ["fold", "source"]).reweighted(lambda g: weights[g[1]])
    plain = training.moments(d, [*FEATURES, "linear", "y"], ["fold", "source"]).reweighted(lambda g: weights[g[1]])
    ridge = training.fold_models(plain.part([*FEATURES, "y"]), lambda t: training.ridge(t, 1.0))

    def cv(m: training.Moments, name: str) -> float:
        part = m.part([name, "y"])
        each = [stacking.correlation(part.total(lambda g, f=f: g[0] == f), [0.0, 1.0]) for f in sorted({g[0] for g in m.by})]
        return sum(each) / max(1, len(each))

    part = plain.part([*FEATURES, "y"])
    each = [stacking.correlation(part.total(lambda g, f=f: g[0] == f), b) for f, b in ridge.items()]
    found = {"linear": cv(plain, "linear"), **{n: cv(trees, f"p{k}") for k, n in enumerate(kinds)}, "ridge of all inputs": sum(each) / max(1, len(each))}
    limit = training.bottleneck(found["linear"], found["trees of all inputs"])
    bent = found["trees of all inputs"] - found["ridge of all inputs"] > 0.02
    return rounded(spark.createDataFrame([(n, r, r - found["linear"], limit, bent) for n, r in found.items()], "model string, cv double, over_linear double, bottleneck string, non_linear boolean"), 4)


def sample_trees(inputs: list[str], spans: list[float], seed: int, n: int = 4) -> dict:
    """Sample trees by a rule: two levels, thresholds at shares of the inputs' spans."""
    trees = []
    for k in range(n):
        at = [(seed + k + i) % len(inputs) for i in range(3)]
        cut = [spans[f] * ((seed * 3 + k * 5 + i * 2) % 9 + 1) / 10 for i, f in enumerate(at)]
        value = [((seed * 5 + k * 7 + i * 3) % 17 - 8) / 16 for i in range(4)]
        trees.append({"feature": [at[0], at[1], at[2], -1, -1, -1, -1], "threshold": [*cut, 0.0, 0.0, 0.0, 0.0], "left": [1, 3, 5, 0, 0, 0, 0], "right": [2, 4, 6, 0, 0, 0, 0], "value": [0.0, 0.0, 0.0, *value]})
    return {"base": 2.0 + seed / 4, "inputs": inputs, "trees": trees}


#: Spans of the named features, for the samples' thresholds; `cle_unknown` is in no table and counts 0.
SPANS = {"ce_adj_p75": 1.0, "ce_n_blocks": 28.0, "se_dominant_cluster_frac": 0.8, "ne_fragment_sentence_rate": 0.64, "ne_start_end_sim": 0.7, "cle_hedge_rate": 0.08, "cle_unknown": 1.0, "bc_belief_sentence_count": 50.0}
SAMPLES: dict[str, dict] = {
    "module_aligned_v1": {m: sample_trees(own := sorted(f for f in SPANS if f.split("_")[0] == m), [SPANS[f] for f in own], k) for k, m in enumerate(stacking.MODULES)}
    | {"combiner": {"architecture": "module_aligned_v1", "coef": [9.0, 4.0, 6.0, -3.0, 5.0], "intercept": 1.5, "module_names": list(stacking.MODULES)}},
    **{
        kind: {d: sample_trees(sorted(SPANS), [SPANS[f] for f in sorted(SPANS)], k + shift, 6) for k, d in enumerate(stacking.LEGACY_DIMENSIONS)} | {"combiner": {"architecture": kind, "coef": [0.6, -0.2, 0.5, 0.4, 0.3], "intercept": 0.5} | more}
        for kind, shift, more in (("dimension_aligned_v3", 1, {"coef": [6.0, -2.0, 5.0, 4.0, 3.0]}), ("ensemble_v5", 2, {"blend_alpha": 0.35}))
    },
}


def legacy_boosted_scores(spark, sf_dir):
    """Sample artifacts of the three architectures: module trees, dimension trees, and those blended with the linear score."""
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in NAMED.items()]))
    kept = {}
    for kind, artifacts in SAMPLES.items():
        kept |= {f"{kind}_{n}": s for n, s in stacking.legacy_subscores(rows.columns, artifacts).items()}
    scored = rows.withColumns(kept)
    scores = {k: stacking.legacy_score(rows.columns, a, {n: F.col(f"{k}_{n}") for n in a if n != "combiner"}) for k, a in SAMPLES.items()}
    first = [f"module_aligned_v1_{m}" for m in stacking.MODULES]
    return rounded(scored.select("l_orderkey", "l_linenumber", *first, *[c.alias(k) for k, c in scores.items()]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (boosted_pipelines, boosted_trees, bottleneck, legacy_boosted_scores)}


def _walk_sql(tree: dict, inputs: list[str], node: int = 0) -> str:
    f = tree["feature"][node]
    if f < 0:
        return f"{tree['value'][node]!r}::DOUBLE"
    column = f"CAST({NAMED[inputs[f]]} AS DOUBLE)" if inputs[f] in NAMED else "0.0::DOUBLE"
    return f"CASE WHEN {column} <= {tree['threshold'][node]!r}::DOUBLE THEN {_walk_sql(tree, inputs, tree['left'][node])} ELSE {_walk_sql(tree, inputs, tree['right'][node])} END"


def _legacy_sql() -> str:
    parts, scores = [], []
    for kind, artifacts in SAMPLES.items():
        names = [n for n in artifacts if n != "combiner"]
        parts += [f"{artifacts[n]['base']!r}::DOUBLE + {' + '.join(_walk_sql(t, artifacts[n]['inputs']) for t in artifacts[n]['trees'])} AS {kind}_{n}" for n in names]
        c = artifacts["combiner"]
        raw = " + ".join([f"{c['intercept']!r}::DOUBLE", *(f"{x!r}::DOUBLE * {kind}_{n}" for x, n in zip(c["coef"], names, strict=True))])
        within = lambda s: f"least(greatest({s}, 0), 100)"
        share = c.get("blend_alpha")
        score = within(raw) if share is None else within(f"{share!r}::DOUBLE * linear + {1 - share!r}::DOUBLE * {within(f'({raw} - 1) / 9 * 100')}")
        scores.append(f"round({score}, 6) AS {kind}")
    first = [f"round(module_aligned_v1_{m}, 6) AS module_aligned_v1_{m}" for m in stacking.MODULES]
    return f"WITH s AS (SELECT l_orderkey, l_linenumber, least(greatest(100 * ({_linear_sql()}), 0), 100) AS linear, {', '.join(parts)} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join([*first, *scores])} FROM s"


SQL: dict[str, str] = {"legacy_boosted_scores": _legacy_sql()}
