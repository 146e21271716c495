"""Queries of audits, analyses and evaluation sets, with their SQL. Rated rows stand on `lineitem`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.vectors import pair_row, rounded
from textweave.operators import audits, quality, ratings, reports
from textweave.plans.tables import table

DIMS = ["d1", "d2", "d3", "d4", "d5"]
FEATURES = ["ce_a", "ce_b", "se_a", "se_b", "ne_a"]
#: Columns of rated rows, as expressions that both engines read alike.
RATED = {
    "id": "l_orderkey * 10 + l_linenumber", "d1": "l_partkey % 5 + 1", "d2": "l_suppkey % 5 + 1", "d3": "l_linenumber % 5 + 1", "d4": "CAST(l_quantity AS BIGINT) % 5 + 1", "d5": "l_orderkey % 5 + 1",
    "overall": "(l_partkey + l_linenumber) % 10 + 1", "source": "CASE WHEN l_returnflag = 'R' THEN 'human' ELSE 'synthetic' END", "label_std": "l_discount * 10", "text_length": "CAST(floor(l_extendedprice) AS BIGINT) % 2000",
    "ce_a": "l_discount", "ce_b": "l_tax", "se_a": "l_quantity", "se_b": "l_extendedprice", "ne_a": "l_linenumber + l_tax", "expected": "((l_partkey + l_linenumber) % 10 + 1) * 10.0", "model": "(l_suppkey % 10 + 1) * 10.0", "other": "(l_orderkey % 10 + 1) * 10.0",
}
KINDS = [*reports.SPECTRUM, reports.EMOTIONAL, reports.NEUTRAL]


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("l_linenumber").cast("int") - 1)
    doubles = {"expected", "model", "other"}
    return table(spark, sf_dir, "lineitem").select(*[F.expr(f"CAST({e} AS DOUBLE)" if c in doubles else e).alias(c) for c, e in RATED.items()], kind.alias("control_type"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over five orders' dimensions; the second misses some."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.when(F.lit(r != "b") | (F.col("l_linenumber") != 3), F.pmod(F.col("l_partkey") * (k + 2) + (7 if r == "a" else 3 if r == "b" else 1) * F.col("l_linenumber"), F.lit(5)) + 1).alias(f"{d}_{r}") for k, d in enumerate(("x", "y")) for r in "abc"])


def feature_map(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("double"))]))


def rating_statistics(spark, sf_dir):
    stats = audits.rating_stats([F.col(f"x_{r}") for r in "abc"])
    return rounded(raters(spark, sf_dir).select("id", *[c.alias(n) for n, c in stats.items()]))


def long_ratings(spark, sf_dir):
    return audits.long_ratings(raters(spark, sf_dir), ["id"], {r: [f"x_{r}", f"y_{r}"] for r in "abc"}).groupBy("rater").agg(F.count("*").alias("n"), F.sum("value_0").alias("x"), F.count("value_1").alias("n_y"))


def joined_reasons(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", audits.joined_reasons({"A": F.col("c_mktsegment"), "B": F.when(F.col("c_nationkey") % 2 == 0, F.lit("  ")).otherwise(F.col("c_name")), "C": F.when(F.col("c_nationkey") % 3 == 0, F.lit("c"))}).alias("reasons"))


def reliability(spark, sf_dir):
    return rounded(audits.reliability(raters(spark, sf_dir), {d: [f"{d}_{r}" for r in "abc"] for d in ("x", "y")}))


def composite_outliers(spark, sf_dir):
    return rounded(audits.composite_outliers(rated(spark, sf_dir), ["id"], DIMS, "overall"))


def dimension_stats(spark, sf_dir):
    return rounded(audits.dimension_stats(rated(spark, sf_dir), DIMS))


def overall_buckets(spark, sf_dir):
    return rounded(audits.overall_buckets(rated(spark, sf_dir), "overall"))


def correlation_matrix(spark, sf_dir):
    return rounded(audits.correlation_matrix(rated(spark, sf_dir), DIMS))


def label_verdict(spark, sf_dir):
    return rounded(audits.label_verdict(rated(spark, sf_dir), DIMS, "overall"))


def label_audit(spark, sf_dir):
    return rounded(audits.label_audit(rated(spark, sf_dir), DIMS, "overall", "source"))


def ranked_correlations(spark, sf_dir):
    return rounded(audits.ranked_correlations(rated(spark, sf_dir), FEATURES, "overall", F.col("source") == "human"))


def weighted_correlations(spark, sf_dir):
    w = F.when(F.col("source") == "human", 1.0).otherwise(0.3)
    return rounded(pair_row(rated(spark, sf_dir), {f: (f, "overall") for f in FEATURES}, w))


def family_audit(spark, sf_dir):
    return rounded(audits.family_audit(rated(spark, sf_dir), FEATURES, "overall", "source", "human"))


def component_audit(spark, sf_dir):
    return rounded(audits.component_audit(rated(spark, sf_dir), FEATURES))


def control_components(spark, sf_dir):
    return rounded(audits.control_components(rated(spark, sf_dir), "control_type", {"ce": ["ce_a", "ce_b"], "se": ["se_a", "se_b"], "ne": ["ne_a"]}))


COEFFICIENTS = {"ce_a": -0.5, "se_a": 0.25, "ne_a": 1.5}


def combiner_audit(spark, sf_dir):
    return rounded(audits.combiner_audit(rated(spark, sf_dir), COEFFICIENTS, "expected"))


def golden_order(spark, sf_dir):
    means = rated(spark, sf_dir).where(F.col("control_type").isin(*reports.SPECTRUM)).groupBy("control_type").agg(F.round(F.avg("model"), 6).alias("model"), F.round(F.avg("expected"), 6).alias("expected"), F.round(F.avg("ne_a"), 6).alias("ne_a"))
    return rounded(audits.golden_order(means, ["model", "expected", "ne_a"], "control_type"))


def module_grid(spark, sf_dir):
    return rounded(audits.module_grid(rated(spark, sf_dir), FEATURES, ["overall", "d1"]))


def coverage_gaps(spark, sf_dir):
    return audits.coverage_gaps(rated(spark, sf_dir), ["ce_a", "se_a", "se_b", "ne_a"], ["ne_a", "d3", "se_b"])


def source_divergence(spark, sf_dir):
    return rounded(audits.source_divergence(rated(spark, sf_dir), FEATURES, "overall", "source", "human", 0.001, 1))


def module_gaps(spark, sf_dir):
    return rounded(audits.module_gaps(audits.source_divergence(rated(spark, sf_dir), FEATURES, "overall", "source", "human")))


def error_flags(spark, sf_dir):
    rows = rated(spark, sf_dir).withColumn("error", F.abs(F.col("model") - F.col("expected")))
    return rounded(audits.error_flags(rows, [*FEATURES, "d3"], "d3", "error"))


def suspect_features(spark, sf_dir):
    """Distances by source, correlation gaps and correlation sizes as importance."""
    rows = rated(spark, sf_dir)
    ks = ratings.kolmogorov_smirnov(rows, FEATURES, (F.col("source") == "human").cast("int")).select("feature", "ks")
    gap = audits.source_divergence(rows, FEATURES, "overall", "source", "human").select("feature", "gap")
    weight = audits.ranked_correlations(rows, FEATURES, "overall").select("feature", F.abs("r").alias("importance"))
    return rounded(audits.suspect_features(weight.join(ks, "feature").join(gap, "feature"), 0.0, 0.001, 0.0005))


def damage_contrast(spark, sf_dir):
    rows = rated(spark, sf_dir).withColumn("error", F.abs(F.col("model") - F.col("expected")) + F.col("ce_a"))
    return rounded(audits.damage_contrast(rows, FEATURES, "error"))


def compared_models(spark, sf_dir):
    return rounded(audits.compared_models(rated(spark, sf_dir), "expected", "model", "other"))


def text_histogram(spark, sf_dir):
    return audits.text_histogram(rated(spark, sf_dir), "text_length", 0.0, 2000.0)


def experiment_log(spark, sf_dir):
    runs = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 3 == 0, "keep").when(F.col("s_nationkey") % 3 == 1, "discard").otherwise("crash").alias("status"), F.abs("s_acctbal").alias("loss"))
    return rounded(audits.experiment_log(runs, "s_suppkey", "status", "loss").select("s_suppkey", "status", "best", "change", "place"))


def composite_rank(spark, sf_dir):
    return rounded(audits.composite_rank(rated(spark, sf_dir), "id", ["ce_a", "ce_b", "se_a"], ["ne_a", "se_b"]))


def golden_anchors(spark, sf_dir):
    return rounded(audits.golden_anchors(rated(spark, sf_dir).withColumn("overall", F.col("overall").cast("double")), "id"))


def promotion_gates(spark, sf_dir):
    return audits.promotion_gates(rated(spark, sf_dir), "model", "other")


def false_low_groups(spark, sf_dir):
    return rounded(audits.false_low_groups(rated(spark, sf_dir)))


def false_low_deltas(spark, sf_dir):
    return rounded(audits.false_low_deltas(feature_map(rated(spark, sf_dir))))


def false_low_hypotheses(spark, sf_dir):
    return audits.false_low_hypotheses(audits.false_low_deltas(feature_map(rated(spark, sf_dir))), "ne_a", "ce_b", "ce_a")


def disorder_separation(spark, sf_dir):
    return rounded(audits.disorder_separation(feature_map(rated(spark, sf_dir))))


def entry_check(spark, sf_dir):
    return quality.checked(table(spark, sf_dir, "documents"), 2)


def entry_check_summary(spark, sf_dir):
    return quality.check_summary(table(spark, sf_dir, "documents"), 2)


def top_openings(spark, sf_dir):
    return quality.top_openings(table(spark, sf_dir, "documents"))


def best_per_group(spark, sf_dir):
    rows = rated(spark, sf_dir).select("control_type", "source", "id", "se_b")
    return rounded(audits.best_per_group(rows, ["control_type", "source"], "se_b", "id"))


def map_means(spark, sf_dir):
    rows = rated(spark, sf_dir).select(F.map_filter(F.create_map(F.lit("a"), F.col("ce_a") * 0.731, F.lit("b"), F.col("ce_b") * 0.731), lambda k, v: (k != "b") | (v > 0.02)).alias("m"))
    return rounded(audits.map_means(rows, "m"))


def ordered_dedupe(spark, sf_dir):
    return audits.ordered_dedupe(table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag"), "l_partkey", "id")


def shuffled_folds(spark, sf_dir):
    return ratings.shuffled_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rating_statistics, long_ratings, joined_reasons, reliability, composite_outliers, dimension_stats, overall_buckets, correlation_matrix, label_verdict, label_audit, ranked_correlations, weighted_correlations,
        family_audit, component_audit, control_components, combiner_audit, golden_order, module_grid, coverage_gaps, source_divergence, module_gaps, error_flags, suspect_features, damage_contrast, compared_models,
        text_histogram, experiment_log, composite_rank, golden_anchors, promotion_gates, false_low_groups, false_low_deltas, false_low_hypotheses, disorder_separation, entry_check, entry_check_summary, top_openings,
        best_per_group, map_means, ordered_dedupe, shuffled_folds,
    )
}

_Z = "z AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {c}" if c in ("expected", "model", "other") else f"{e} AS {c}" for c, e in RATED.items()) + f", {KINDS}[l_linenumber] AS control_type FROM lineitem)"
_DIMS = ", ".join(DIMS)
_FEATS = ", ".join(FEATURES)
_COMP = "(5 - (d1 + d2 + d3 + d4 + d5) / 5.0::DOUBLE) * 2 + 1"
_PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i + 1 :]]
_CORR = lambda a, b, where="": f"(SELECT corr({a}, {b}) FROM z{where})"
_OFFSET = {"a": 7, "b": 3, "c": 1}
_RATERS = "q AS (SELECT l_orderkey * 10 + l_linenumber AS id, " + ", ".join(
    (f"CASE WHEN l_linenumber <> 3 THEN (l_partkey * {k + 2} + {_OFFSET[r]} * l_linenumber) % 5 + 1 END" if r == "b" else f"(l_partkey * {k + 2} + {_OFFSET[r]} * l_linenumber) % 5 + 1") + f" AS {d}_{r}" for k, d in enumerate(("x", "y")) for r in "abc"
) + " FROM lineitem)"


def _long(columns: list[str], keep: str) -> str:
    """Unpivoted features as (keep, feature, x)."""
    return "UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c}::DOUBLE AS x FROM z " for c in columns)


def _rho(columns: list[str], label: str, by: str = "") -> str:
    """Steps that give rh(by, feature, rho): rank correlations with a label within groups."""
    keys = f"{by}feature"
    keep = f"{by}{label}::DOUBLE AS y"
    return f"""lg AS ({_long(columns, keep)}),
rk AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM lg),
rh AS (SELECT {keys}, coalesce(nullif(corr(rx, ry), 'nan'), 0) AS rho, split_part(feature, '_', 1) AS fam FROM rk GROUP BY {keys})"""


_TOP = lambda order, k: f"array_to_string(list(feature ORDER BY {order}, feature)[1:{k}], ',')"
_DELTAS = f"""dl AS (SELECT feature AS name, avg(x) FILTER (a) AS mean_a, avg(x) FILTER (b) AS mean_b, avg(x) FILTER (c) AS mean_neutral FROM (
{_long(FEATURES, "expected >= 66 AND {a} AS a, {b} AS b, control_type = 'neutral_fragmented_positive' AS c")}) GROUP BY feature HAVING avg(x) FILTER (a) IS NOT NULL AND avg(x) FILTER (b) IS NOT NULL)"""
_FALSE_LOW = _DELTAS.replace("{a}", "model - expected <= -15").replace("{b}", "expected >= 66 AND model >= 60")
_R = lambda *columns, digits=6: ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)

SQL: dict[str, str] = {
    "rating_statistics": f"""WITH {_RATERS}, v AS (SELECT id, [x_a, x_b, x_c] AS g, coalesce(x_a, 3)::DOUBLE AS a, coalesce(x_b, 3)::DOUBLE AS b, coalesce(x_c, 3)::DOUBLE AS c FROM q), s AS (SELECT *, list_sort([a, b, c]) AS s, (a + b + c) / 3 AS m FROM v)
SELECT id, concat_ws('|', a::INT, b::INT, c::INT) AS joined, round(CASE WHEN s[3] - s[1] > 2 THEN CASE WHEN s[2] - s[1] >= s[3] - s[2] THEN (s[2] + s[3]) / 2 ELSE (s[1] + s[2]) / 2 END ELSE m END, 6) AS mean, s[3] - s[1] > 2 AS trimmed,
  round(sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3), 6) AS deviation, round(s[3] - s[1], 6) AS spread, len(list_filter(g, lambda x: x IS NOT NULL))::INT AS n_ratings FROM s""",
    "long_ratings": f"WITH {_RATERS} " + " UNION ALL ".join(f"SELECT '{r}' AS rater, count(*) AS n, sum(x_{r})::BIGINT AS x, count(y_{r}) AS n_y FROM q" for r in "abc"),
    "joined_reasons": "SELECT c_custkey, concat_ws(' | ', '[A] ' || trim(c_mktsegment), CASE WHEN c_nationkey % 2 <> 0 THEN '[B] ' || trim(c_name) END, CASE WHEN c_nationkey % 3 = 0 THEN '[C] c' END) AS reasons FROM customer",
    "reliability": f"WITH {_RATERS}, l AS (SELECT 'x' AS dimension, x_a::DOUBLE AS a, x_b::DOUBLE AS b, x_c::DOUBLE AS c FROM q UNION ALL SELECT 'y', y_a, y_b, y_c FROM q), s AS (SELECT *, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) AS s FROM l) SELECT dimension, round(corr(a, b), 6) AS r_ab, round(corr(a, c), 6) AS r_ac, round(corr(b, c), 6) AS r_bc, round(avg(s), 6) AS mean_std, round(avg((s > 1.5)::INT), 6) AS wide_share FROM s GROUP BY 1",
    "composite_outliers": f"WITH {_Z}, c AS (SELECT id, {_COMP} AS composite, overall, abs({_COMP} - overall) AS gap FROM z) SELECT id, round(composite, 6) AS composite, overall, round(gap, 6) AS gap FROM c WHERE c.gap > 3 ORDER BY c.gap DESC, id LIMIT 5",
    "dimension_stats": f"WITH {_Z} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(avg({d}), 6) AS mean, round(stddev_pop({d}), 6) AS std, " + ", ".join(f"count_if({d} = {k})::BIGINT AS n_{k}" for k in range(1, 6)) + " FROM z" for d in DIMS),
    "overall_buckets": f"WITH {_Z}, b AS (SELECT ((overall - 1) // 2 * 2 + 1) AS lo FROM z) SELECT lo || '-' || (lo + 1) AS bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM z), 6) AS share FROM b GROUP BY lo",
    "correlation_matrix": f"WITH {_Z} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM z" for a, b in _PAIRS),
    "label_verdict": f"""WITH {_Z}, o AS (SELECT count(*) AS n, corr({_COMP}, overall) AS composite_r, avg((abs({_COMP} - overall) > 3)::INT) AS outlier_share, ({" + ".join(f"corr({a}, {b})" for a, b in _PAIRS)}) / {len(_PAIRS)} AS halo, avg((overall <= 4)::INT) AS low_share FROM z),
i AS (SELECT *, list_filter([CASE WHEN composite_r < 0.6 THEN 'low consistency' END, CASE WHEN outlier_share > 0.1 THEN 'outliers' END, CASE WHEN halo > 0.8 THEN 'halo' END, CASE WHEN low_share > 0.65 THEN 'skewed' END], lambda x: x IS NOT NULL) AS l FROM o)
SELECT n, {_R("composite_r", "outlier_share", "halo", "low_share")}, array_to_string(l, '; ') AS issues, CASE len(l) WHEN 0 THEN 'good' WHEN 1 THEN 'needs attention' ELSE 'poor' END AS verdict FROM i""",
    "label_audit": f"""WITH {_Z.replace("z AS", "z0 AS", 1)}, z AS (SELECT *, source AS grp FROM z0 UNION ALL SELECT *, 'all' FROM z0), {_rho(DIMS, "overall", "grp, ")},
s AS (SELECT grp, feature, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM lg GROUP BY ALL) SELECT grp, feature AS name, n, {_R("mean", "std", "min", "max", "rho")} FROM s JOIN rh USING (grp, feature)""",
    "ranked_correlations": f"""WITH {_Z}, h AS (SELECT * FROM z WHERE source = 'human'), r AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, overall) AS r, count(*) AS n FROM h" for f in FEATURES)})
SELECT feature, round(r, 6) AS r, n, row_number() OVER (ORDER BY abs(r.r) DESC, feature)::INT AS place FROM r""",
    "weighted_correlations": f"""WITH {_Z}, w AS (SELECT *, CASE WHEN source = 'human' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS w FROM z) SELECT {", ".join(f"round((sum(w * {f} * overall) - sum(w * {f}) * sum(w * overall) / sum(w)) / sqrt((sum(w * {f} * {f}) - sum(w * {f}) * sum(w * {f}) / sum(w)) * (sum(w * overall * overall) - sum(w * overall) * sum(w * overall) / sum(w))), 6) AS {f}" for f in FEATURES)} FROM w""",
    "family_audit": f"WITH {_Z.replace('z AS', 'z0 AS', 1)}, z AS (SELECT * FROM z0 WHERE source = 'human'), {_rho(FEATURES, 'overall')} SELECT fam AS family, count(*) AS n_features, round(avg(abs(rho)), 6) AS mean_abs_rho, {_TOP('abs(rho) DESC', 10)} AS strongest, {_TOP('rho DESC', 5)} AS positive, {_TOP('rho', 5)} AS negative FROM rh GROUP BY fam",
    "component_audit": f"""WITH {_Z.replace("z AS", "z0 AS", 1)}, z AS (SELECT *, 'expected' AS label, expected AS t FROM z0 UNION ALL SELECT *, 'abs_error', abs(model - expected) FROM z0), {_rho(FEATURES, "t", "label, ")},
e AS (SELECT fam, count(*) AS n_features, avg(abs(rho)) AS mean_abs, {_TOP("abs(rho) DESC", 8)} AS signals, {_TOP("rho", 5)} AS inverse FROM rh WHERE label = 'expected' GROUP BY fam), x AS (SELECT fam, {_TOP("abs(rho) DESC", 5)} AS error_signals FROM rh WHERE label = 'abs_error' GROUP BY fam)
SELECT fam AS component, n_features, round(mean_abs, 6) AS mean_abs, signals, inverse, error_signals FROM e JOIN x USING (fam)""",
    "control_components": f"WITH {_Z} SELECT control_type AS control, 'ce' AS component, round(avg((ce_a + ce_b) / 2), 6) AS value FROM z GROUP BY 1 UNION ALL SELECT control_type, 'se', round(avg((se_a + se_b) / 2), 6) FROM z GROUP BY 1 UNION ALL SELECT control_type, 'ne', round(avg(ne_a), 6) FROM z GROUP BY 1",
    "combiner_audit": f"WITH {_Z}, {_rho(list(COEFFICIENTS), 'expected')}, c(feature, coef) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in COEFFICIENTS.items())}) SELECT feature AS name, coef, round(rho, 6) AS rho, round(coef * rho, 6) AS product FROM rh JOIN c USING (feature)",
    "golden_order": f"""WITH {_Z}, m AS (SELECT control_type AS t, round(avg(model), 6) AS model, round(avg(expected), 6) AS expected, round(avg(ne_a), 6) AS ne_a FROM z WHERE control_type LIKE 'spectrum%' GROUP BY 1),
l AS (SELECT t, 'model' AS name, model AS v FROM m UNION ALL SELECT t, 'expected', expected FROM m UNION ALL SELECT t, 'ne_a', ne_a FROM m), n AS (SELECT *, lead(v) OVER (PARTITION BY name ORDER BY t) AS nx FROM l),
o AS (SELECT name, bool_and(v < nx) FILTER (nx IS NOT NULL) AS ordered FROM n GROUP BY name), p AS (SELECT a.name, avg((a.v < b.v)::INT) AS accuracy FROM l a JOIN l b ON a.name = b.name AND a.t < b.t GROUP BY 1) SELECT name, ordered, round(accuracy, 6) AS accuracy FROM o JOIN p USING (name)""",
    "module_grid": f"""WITH {_Z}, r AS ({" UNION ALL ".join(f"SELECT '{c}' AS label, '{f}' AS feature, corr({f}, {c}) AS r FROM z" for f in FEATURES for c in ("overall", "d1"))}), g AS (SELECT label, split_part(feature, '_', 1) AS module, avg(abs(r)) AS mean_abs FROM r GROUP BY ALL)
SELECT label, module, round(mean_abs, 6) AS mean_abs, arg_max(module, g.mean_abs) OVER (PARTITION BY label) AS best FROM g""",
    "coverage_gaps": f"WITH {_Z} " + " UNION ALL ".join(f"SELECT '{c}' AS label, {' + '.join(f'(abs(corr({f}, {c})) > 0.15)::INT' for f in ('ce_a', 'se_a', 'se_b', 'ne_a'))} AS n_strong, {' + '.join(f'(abs(corr({f}, {c})) > 0.15)::INT' for f in ('ce_a', 'se_a', 'se_b', 'ne_a'))} < 3 AS gap FROM z" for c in ("ne_a", "d3", "se_b")),
    "source_divergence": f"""WITH {_Z}, r AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, split_part('{f}', '_', 1) AS module, abs((corr({f}, overall) FILTER (source = 'human')) - (corr({f}, overall) FILTER (source <> 'human'))) AS gap FROM z" for f in FEATURES)})
SELECT module, feature, round(gap, 6) AS gap, r.gap <= 0.001 OR row_number() OVER (PARTITION BY module ORDER BY r.gap, feature) <= 1 AS kept FROM r""",
    "module_gaps": f"""WITH {_Z}, r AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, split_part('{f}', '_', 1) AS module, abs((corr({f}, overall) FILTER (source = 'human')) - (corr({f}, overall) FILTER (source <> 'human'))) AS gap FROM z" for f in FEATURES)})
SELECT module, count(*) AS n_features, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap, {_TOP("gap DESC", 25)} AS widest FROM r GROUP BY module""",
    "error_flags": f"""WITH {_Z}, r AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, d3) AS y, corr({f}, abs(model - expected)) AS e FROM z" for f in [*FEATURES, "d3"])})
SELECT feature, round(y, 6) AS r_label, round(e, 6) AS r_error, CASE WHEN abs(e) > 0.1 AND abs(y) <= 0.1 THEN 'misleading' WHEN abs(y) > 0.1 AND abs(e) <= 0.1 THEN 'signal' WHEN abs(y) > 0.1 THEN 'both' ELSE 'none' END AS flag FROM r""",
    "suspect_features": f"""WITH {_Z}, u AS ({_long(FEATURES, "source")}), c AS (SELECT feature, x, count_if(source <> 'human') AS a, count_if(source = 'human') AS b FROM u GROUP BY ALL),
w AS (SELECT feature, abs(sum(a) OVER o / sum(a) OVER p - sum(b) OVER o / sum(b) OVER p) AS d FROM c WINDOW o AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature)), k AS (SELECT feature, max(d) AS ks FROM w GROUP BY feature),
r AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, overall)) AS importance, abs((corr({f}, overall) FILTER (source = 'human')) - (corr({f}, overall) FILTER (source <> 'human'))) AS gap FROM z" for f in FEATURES)})
SELECT feature, {_R("importance", "ks", "gap")}, r.importance > 0 AND k.ks > 0.001 AND r.gap > 0.0005 AS suspect FROM r JOIN k USING (feature)""",
    "damage_contrast": f"""WITH {_Z}, e AS (SELECT *, abs(model - expected) + ce_a AS error FROM z), q AS (SELECT quantile_cont(error, 0.25) AS lo, quantile_cont(error, 0.9) AS hi FROM e)
{" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}) FILTER (error >= hi), 6) AS damaged, round(avg({f}) FILTER (error <= lo), 6) AS healthy, round((avg({f}) FILTER (error >= hi)) - (avg({f}) FILTER (error <= lo)), 6) AS difference FROM e, q" for f in FEATURES)}""",
    "compared_models": f"WITH {_Z}, e AS (SELECT *, abs(model - expected) AS a, abs(other - expected) AS b FROM z) SELECT round(avg((a < b)::INT), 6) AS wins, round(avg((a = b)::INT), 6) AS ties, round(avg((a > b)::INT), 6) AS losses, {', '.join(f'round(avg((a > {x})::INT), 6) AS above_{x}' for x in (5, 10, 20))}, round(quantile_cont(model, 0.9) - quantile_cont(model, 0.1), 6) AS spread FROM e",
    "text_histogram": f"WITH {_Z}, b AS (SELECT least(floor(text_length / 200.0::DOUBLE), 9)::INT AS bin, count(*) AS n FROM z GROUP BY 1) SELECT bin, n, repeat('#', (n * 40 // (SELECT max(n) FROM b))::INT) AS bar FROM b",
    "experiment_log": """WITH r AS (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'discard' ELSE 'crash' END AS status, abs(s_acctbal) AS loss FROM supplier),
w AS (SELECT *, min(loss) FILTER (status = 'keep') OVER (ORDER BY s_suppkey) AS best, CASE WHEN status = 'keep' THEN loss - last_value(CASE WHEN status = 'keep' THEN loss END IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS change FROM r)
SELECT s_suppkey, status, round(best, 6) AS best, round(change, 6) AS change, CASE WHEN w.change IS NOT NULL THEN rank() OVER (ORDER BY w.change NULLS LAST)::INT END AS place FROM w""",
    "composite_rank": f"""WITH {_Z}, l AS ({_long(["ce_a", "ce_b", "se_a", "ne_a", "se_b"], "id")}), k AS (SELECT id, feature, (row_number() OVER (PARTITION BY feature ORDER BY x, id) - 1) / ((SELECT count(*) FROM z) - 1)::DOUBLE AS r FROM l),
t AS (SELECT id, split_part(feature, '_', 1) AS fam, CASE WHEN feature IN ('ne_a', 'se_b') THEN 1 - r ELSE r END AS r FROM k) SELECT id, round(avg(r), 6) AS score, round(avg(r) FILTER (fam = 'ce'), 6) AS score_ce, round(avg(r) FILTER (fam = 'ne'), 6) AS score_ne, round(avg(r) FILTER (fam = 'se'), 6) AS score_se FROM t GROUP BY id""",
    "golden_anchors": f"""WITH {_Z}, t(target, percentile, lo, hi) AS (VALUES {", ".join(f"('{n}', {p}, {a}::DOUBLE, {b}::DOUBLE)" for n, p, a, b in audits.TARGETS)}),
c AS (SELECT t.*, z.*, overall BETWEEN lo AND hi AND text_length >= 200 AS strict FROM z JOIN t ON overall BETWEEN lo - 0.5 AND hi + 0.5 AND text_length >= 100),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY (NOT strict)::INT, (source <> 'human')::INT, label_std, abs(text_length - 800), id) AS k, count_if(strict) OVER (PARTITION BY target) AS n, count(*) OVER (PARTITION BY target) AS m FROM c)
SELECT target, percentile, id, round(overall::DOUBLE, 6) AS overall, round(label_std, 6) AS label_std, source, text_length, CASE WHEN n > 0 THEN n ELSE m END::BIGINT AS n_candidates FROM k WHERE k = 1""",
    "promotion_gates": f"""WITH {_Z}, e AS (SELECT control_type AS t, model, other, abs(model - expected) AS a, abs(other - expected) AS b FROM z),
o AS (SELECT avg(a) AS ac, avg(b) AS ab, avg(model) FILTER (t LIKE 'neutral%') AS nc, avg(other) FILTER (t LIKE 'neutral%') AS nb, avg(model) FILTER (t LIKE 'emotional%') AS mc, avg(other) FILTER (t LIKE 'emotional%') AS mb,
  avg(a) FILTER (t = 'spectrum_7_8') AS c7, avg(b) FILTER (t = 'spectrum_7_8') AS b7, avg(a) FILTER (t = 'spectrum_9_10') AS c9, avg(b) FILTER (t = 'spectrum_9_10') AS b9 FROM e),
g AS (SELECT coalesce(ac < ab, false) AS overall_mae_improved, coalesce(nc > nb, false) AS neutral_fragmented_improved, coalesce(nc >= 60, false) AS neutral_fragmented_gte_60, coalesce(mc <= greatest(40, mb + 5), false) AS emotional_coherent_not_regressed, coalesce(c7 < b7 AND c9 < b9, false) AS high_band_mae_improved FROM o)
SELECT *, overall_mae_improved AND neutral_fragmented_improved AND neutral_fragmented_gte_60 AND emotional_coherent_not_regressed AND high_band_mae_improved AS promotable FROM g""",
    "false_low_groups": f"WITH {_Z} " + " UNION ALL ".join(f"SELECT '{n}' AS grp, count(*) AS n, round(avg(expected), 6) AS mean_expected, round(avg(model), 6) AS mean_model, round(avg(model - expected), 6) AS mean_error, round(avg(abs(model - expected)), 6) AS mean_abs_error FROM z WHERE {t} HAVING count(*) > 0" for n, t in (("false_low", "expected >= 66 AND model - expected <= -15"), ("detected_high", "expected >= 66 AND model >= 60"), ("low_labeled", "expected <= 35"))),
    "false_low_deltas": f"WITH {_Z}, {_FALSE_LOW} SELECT name, {_R('mean_a', 'mean_b')}, round(mean_a - mean_b, 6) AS delta FROM dl",
    "false_low_hypotheses": f"WITH {_Z}, {_FALSE_LOW} SELECT 'coherence_masks' AS hypothesis, (SELECT mean_a >= 0.55 FROM dl WHERE name = 'ne_a') AS holds UNION ALL SELECT 'fragments_underfire', (SELECT mean_a < mean_b FROM dl WHERE name = 'ce_b') UNION ALL SELECT 'subscore_generous', (SELECT mean_a > mean_b FROM dl WHERE name = 'ce_a')",
    "disorder_separation": f"""WITH {_Z}, {_DELTAS.replace("{a}", "model < 60").replace("{b}", "control_type = 'emotional_coherent_negative'")} SELECT name, {_R("mean_a", "mean_b", "mean_neutral")}, round(dl.mean_a - dl.mean_b, 6) AS delta, row_number() OVER (ORDER BY abs(dl.mean_a - dl.mean_b) DESC, name) = 1 AS best FROM dl""",
    "entry_check": f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), s AS (SELECT count(*) AS n, {", ".join(f"count_if(contains(t, '{p.replace("'", "''")}')) AS p{k}" for k, p in enumerate(quality.OVERUSED))} FROM d),
o AS (SELECT doc_id, coalesce(array_to_string(regexp_extract_all(t, '[a-z'']+')[1:5], ' '), '') AS opening, {" OR ".join(f"(p{k} / n > 0.75 AND (length(t) - length(replace(t, '{p.replace("'", "''")}', ''))) // {len(p)} >= 2)" for k, p in enumerate(quality.OVERUSED))} AS worn FROM d, s),
c AS (SELECT *, count(*) OVER (PARTITION BY opening) AS n FROM o) SELECT doc_id, n, n > 2 OR worn AS flagged, NOT (n > 2 OR worn) AS kept FROM c""",
    "entry_check_summary": f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), o AS (SELECT *, coalesce(array_to_string(regexp_extract_all(t, '[a-z'']+')[1:5], ' '), '') AS opening FROM d), c AS (SELECT *, count(*) OVER (PARTITION BY opening) AS n FROM o)
SELECT count(*) AS total_rows, count_if(n <= 2)::BIGINT AS kept_rows, count_if(n > 2)::BIGINT AS flagged_rows, {", ".join(f"count_if(contains(t, '{p.replace("'", "''")}'))::BIGINT AS phrase_{k}" for k, p in enumerate(quality.OVERUSED))} FROM c""",
    "top_openings": "WITH o AS (SELECT doc_id, coalesce(array_to_string(regexp_extract_all(lower(text), '[a-z'']+')[1:5], ' '), '') AS opening FROM documents) SELECT opening, count(*) AS n FROM o GROUP BY opening ORDER BY count(*) DESC, min(doc_id) LIMIT 10",
    "best_per_group": f"WITH {_Z}, k AS (SELECT control_type, source, id, se_b, row_number() OVER (PARTITION BY control_type, source ORDER BY se_b DESC, id) AS k FROM z) SELECT control_type, source, id, round(se_b, 6) AS se_b FROM k WHERE k = 1",
    "map_means": f"WITH {_Z} SELECT 'a' AS name, round(avg(ce_a * 0.731::DOUBLE), 6) AS mean, count(*) AS n FROM z UNION ALL SELECT 'b', round(avg(ce_b * 0.731::DOUBLE), 6), count(*) FROM z WHERE ce_b * 0.731::DOUBLE > 0.02",
    "ordered_dedupe": "SELECT l_partkey, l_orderkey * 10 + l_linenumber AS id, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber NULLS FIRST, l_returnflag NULLS FIRST) = 1",
    "shuffled_folds": "SELECT o_orderkey, least((row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) - 1) // greatest(1, (SELECT count(*) FROM orders) // 5), 4)::INT AS fold FROM orders",
}
