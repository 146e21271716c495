"""Audits of labels, features, scores and evaluation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.functions.vectors import pair_correlations, pair_row, safe_corr
from textweave.operators.ordering import quantiles
from textweave.operators.ratings import cell_correlations, pair_cells, spearman_table, trimmed_mean

#: Missing ratings, thresholds of trimming, the composite's outlier limit, verdict limits.
MISSING_DIMENSION, MISSING_OVERALL, TRIM_DIMENSION, TRIM_OVERALL, OUTLIER = 3.0, 5.0, 2.0, 3.0, 3.0
#: Targets of golden anchors with their range of scores.
TARGETS = (("very_low", 0, 1.0, 2.0), ("low", 25, 2.5, 3.5), ("medium", 50, 4.0, 5.0), ("high", 75, 6.0, 7.5), ("very_high", 100, 8.0, 10.0))
#: What the composite rank score reads as disorder and as order.
HIGH_FEATURES = (
    "ce_break_rate", "ce_low_mass", "ce_adj_std", "ce_sharp_drop_rate", "se_cluster_entropy", "se_switch_rate", "se_switch_mean_jump", "se_n_clusters", "ne_semantic_wander", "ne_fragment_sentence_rate",
    "ne_temporal_jump_rate", "ne_punct_break_rate", "cle_fragment_rate", "cle_restart_rate", "cle_hedge_rate", "cle_punctuation_noise", "cle_adj_low_frac", "cle_zigzag_rate", "cle_semantic_break_rate", "cle_semantic_isolated_rate",
)
LOW_FEATURES = ("ce_adj_mean", "ce_longest_coherent_run", "se_dominant_cluster_frac", "se_intra_mean", "ne_arc_linearity", "ne_start_end_sim", "ne_consolidation_delta", "ne_end_to_centroid")


def plain_number(x: Column) -> Column:
    """A number as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, 2), ",", ""), r"\.?0+$", "")


def rating_stats(values: Sequence[Column], dimension: bool = True) -> dict[str, Column]:
    """joined `a|b|c`, mean (trimmed), trimmed, population deviation, spread and the number of ratings given."""
    missing = F.lit(MISSING_DIMENSION if dimension else MISSING_OVERALL)
    v = [F.coalesce(x.cast("double"), missing) for x in values]
    mean, trimmed = trimmed_mean(v, TRIM_DIMENSION if dimension else TRIM_OVERALL)
    plain = sum(v[1:], v[0]) / len(v)
    given = sum((x.isNotNull().cast("int") for x in values[1:]), values[0].isNotNull().cast("int"))
    return {
        "joined": F.concat_ws("|", *map(plain_number, v)), "mean": mean, "trimmed": trimmed, "deviation": F.sqrt(sum((x - plain) * (x - plain) for x in v) / len(v)),
        "spread": F.greatest(*v) - F.least(*v), "n_ratings": given,
    }


def long_ratings(rows: DataFrame, ids: list[str], raters: dict[str, list[str]]) -> DataFrame:
    """One row for each rater (name to its columns, in one order): ids, rater and value_0, value_1, ... ."""
    passes = [F.struct(F.lit(name).alias("rater"), *[F.col(c).alias(f"value_{k}") for k, c in enumerate(columns)]) for name, columns in raters.items()]
    return rows.select(*ids, F.inline(F.array(*passes)))


def joined_reasons(reasons: dict[str, Column]) -> Column:
    """`[A] ... | [B] ...` of the reasons that are not blank."""
    parts = [F.when(F.trim(c) != "", F.concat(F.lit(f"[{name}] "), F.trim(c))) for name, c in reasons.items()]
    return F.concat_ws(" | ", *parts)


def composite(dimensions: list[str]) -> Column:
    """The mean of the dimensions (1 to 5, high is ordered) on the overall scale."""
    mean = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0])) / len(dimensions)
    return (5 - mean) * 2 + 1


def composite_outliers(rows: DataFrame, ids: list[str], dimensions: list[str], overall: str, k: int = 5) -> DataFrame:
    """The k rows with the largest gap above OUTLIER between composite and overall; ties go to the smaller ids."""
    gap = F.abs(composite(dimensions) - F.col(overall))
    return rows.select(*ids, composite(dimensions).alias("composite"), F.col(overall).alias("overall"), gap.alias("gap")).where(F.col("gap") > OUTLIER).orderBy(F.desc("gap"), *ids).limit(k)


def dimension_stats(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, mean, std, n_1 ... n_5): all in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in dimensions])).alias("x")).select("x.*")
    return long.groupBy("dimension").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), *[F.count_if(F.col("v") == k).alias(f"n_{k}") for k in range(1, 6)])


def overall_buckets(rows: DataFrame, overall: str) -> DataFrame:
    """(bucket, n, share) of 1-2, 3-4, ... 9-10."""
    low = (F.floor((F.col(overall) - 1) / 2) * 2 + 1).cast("int")
    counts = rows.groupBy(F.format_string("%d-%d", low, low + 1).alias("bucket")).agg(F.count("*").alias("n"))
    total = rows.count()
    return counts.select("bucket", "n", (F.col("n") / F.lit(max(1, total))).alias("share"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, from one pass."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    one = pair_row(rows, {f"r{k}": p for k, p in enumerate(pairs)})
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{k}").alias("r")) for k, (x, y) in enumerate(pairs)])))


def label_verdict(rows: DataFrame, dimensions: list[str], overall: str) -> DataFrame:
    """One row: composite correlation, outlier share, halo (mean correlation of dimensions), share of low labels, issues and
    verdict: good without an issue, needs attention with one, else poor."""
    between = {f"{x}|{y}": (x, y) for i, x in enumerate(dimensions) for y in dimensions[i + 1 :]}
    with_composite = rows.withColumn("_composite", composite(dimensions))
    r = {n: F.lit(x) for n, x in pair_row(with_composite, {"composite": ("_composite", overall)} | between).first().asDict().items()}
    halo = [r[n] for n in between]
    one = with_composite.agg(
        F.count("*").alias("n"), r["composite"].alias("composite_r"), F.avg((F.abs(F.col("_composite") - F.col(overall)) > OUTLIER).cast("double")).alias("outlier_share"),
        (sum(halo[1:], halo[0]) / len(halo)).alias("halo"), F.avg((F.col(overall) <= 4).cast("double")).alias("low_share"),
    )
    tests = {"low consistency": F.col("composite_r") < 0.6, "outliers": F.col("outlier_share") > 0.10, "halo": F.col("halo") > 0.8, "skewed": F.col("low_share") > 0.65}
    issues = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    out = one.withColumn("_i", issues)
    verdict = F.when(F.size("_i") == 0, "good").when(F.size("_i") == 1, "needs attention").otherwise("poor")
    return out.select("n", "composite_r", "outlier_share", "halo", "low_share", F.array_join("_i", "; ").alias("issues"), verdict.alias("verdict"))


def distributions(rows: DataFrame, columns: list[str], source: str) -> DataFrame:
    """(grp, name, n, mean, std, min, max) of each column, over all rows and by source: one aggregation of grouping sets."""
    long = rows.select(source, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])))
    sets = long.groupingSets([[F.col("name")], [F.col("name"), F.col(source)]], "name", source)
    out = sets.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.grouping(source).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(source)).alias("grp"), "name", "n", "mean", "std", "min", "max")


def label_audit(rows: DataFrame, dimensions: list[str], overall: str, source: str) -> DataFrame:
    """distributions() of the dimensions with their rank correlation with the overall label, by group."""
    cells = pair_cells(rows, dimensions, [overall], [source])
    twice = cells.withColumn("grp", F.explode(F.array(F.lit("all"), F.col(source)))).drop(source)
    rho = cell_correlations(twice, ["grp"]).select("grp", F.col("feature").alias("name"), "rho")
    return distributions(rows, dimensions, source).join(rho, ["grp", "name"], "left")


def reliability(rows: DataFrame, dimensions: dict[str, list[str]], wide: float = 1.5) -> DataFrame:
    """(dimension, r_ab, r_ac, r_bc, mean_std, wide_share) from three raters' columns of each dimension."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, "abc", strict=True)]) for d, columns in dimensions.items()])))
    mean = (F.col("a") + F.col("b") + F.col("c")) / 3
    std = F.sqrt(sum((F.col(c) - mean) * (F.col(c) - mean) for c in "abc") / 3)
    return long.withColumn("_s", std).groupBy("dimension").agg(*[safe_corr(x, y).alias(f"r_{x}{y}") for x, y in ("ab", "ac", "bc")], F.avg("_s").alias("mean_std"), F.avg((F.col("_s") > wide).cast("double")).alias("wide_share"))


def ranked_correlations(rows: DataFrame, features: list[str], label: str, where: Column | None = None) -> DataFrame:
    """(feature, r, n, place): all features by falling size of their correlation, of the rows asked for; ties by name."""
    some = rows if where is None else rows.where(where)
    one = pair_correlations(some, {f: (f, label) for f in features}).agg(*[F.max(F.when(F.col("pair") == f, F.struct("r", "n"))).alias(f) for f in features])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f)["r"], F.lit(0.0)).alias("r"), F.coalesce(F.col(f)["n"], F.lit(0)).alias("n")) for f in features])))
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "feature")))  # a row for each feature


def family(feature: Column) -> Column:
    return F.split_part(feature, F.lit("_"), F.lit(1))


def top_text(order: Column, k: int) -> Column:
    """The names of the k first rows of a group in an order, joined."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("feature").alias("f")))), 1, k), lambda x: x["f"]), ",")


def family_audit(rows: DataFrame, features: list[str], label: str, source: str, human: str) -> DataFrame:
    """(family, n_features, mean_abs_rho, strongest ten, five most positive, five most negative) on human rows."""
    own = spearman_table(rows.where(F.col(source) == human), features, [label], []).withColumn("family", family(F.col("feature")))
    return own.groupBy("family").agg(F.count("*").alias("n_features"), F.avg(F.abs("rho")).alias("mean_abs_rho"), top_text(-F.abs("rho"), 10).alias("strongest"), top_text(-F.col("rho"), 5).alias("positive"), top_text(F.col("rho"), 5).alias("negative"))


def component_audit(rows: DataFrame, features: list[str], top: int = 8) -> DataFrame:
    """(component, n_features, mean_abs, signals, inverse, error_signals): rank correlations of features with expected,
    model and absolute error of (expected, model) rows, by the prefix of the feature's name."""
    scored = rows.withColumn("abs_error", F.abs(F.col("model") - F.col("expected")))
    rho = spearman_table(scored, features, ["expected", "abs_error"], []).withColumn("component", family(F.col("feature")))
    e = rho.where("label = 'expected'").groupBy("component").agg(F.count("*").alias("n_features"), F.avg(F.abs("rho")).alias("mean_abs"), top_text(-F.abs("rho"), top).alias("signals"), top_text(F.col("rho"), 5).alias("inverse"))
    x = rho.where("label = 'abs_error'").groupBy("component").agg(top_text(-F.abs("rho"), 5).alias("error_signals"))
    return e.join(x, "component")


def control_components(rows: DataFrame, control: str, components: dict[str, list[str]]) -> DataFrame:
    """(control, component, value): the mean over rows of each row's mean over a component's features; missing ones are 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    parts = [F.struct(F.lit(n).alias("component"), (sum((zero(c) for c in cs[1:]), zero(cs[0])) / len(cs)).alias("v")) for n, cs in components.items()]
    return rows.select(F.col(control).alias("control"), F.inline(F.array(*parts))).groupBy("control", "component").agg(F.avg("v").alias("value"))


def combiner_audit(rows: DataFrame, coefficients: dict[str, float], label: str) -> DataFrame:
    """(name, coef, rho, product): the combiner's inputs with their rank correlation with the label."""
    table = F.create_map(*[F.lit(x) for k, v in coefficients.items() for x in (k, v)])
    rho = spearman_table(rows, list(coefficients), [label], []).select(F.col("feature").alias("name"), "rho")
    return rho.select("name", F.element_at(table, F.col("name")).alias("coef"), "rho", (F.element_at(table, F.col("name")) * F.col("rho")).alias("product"))


def golden_order(rows: DataFrame, values: list[str], order: str) -> DataFrame:
    """(name, ordered, accuracy) of each value over a few golden rows: strictly rising, and the share of pairs in order.

    Golden rows are one for each target, so their pairs are few; they are sorted in one array.
    """
    parts = F.inline(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    s = rows.select(order, parts).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "v"))), lambda x: x["v"]).alias("a"))
    at = F.sequence(F.lit(0), F.size("a") - 2)
    rising = F.when(F.size("a") > 1, F.forall(at, lambda i: F.get("a", i) < F.get("a", i + 1))).otherwise(F.lit(True))
    right = F.aggregate(at, F.lit(0).cast("long"), lambda t, i: t + F.size(F.filter(F.slice("a", i + 2, F.size("a")), lambda x: x > F.get("a", i))))
    pairs = F.size("a") * (F.size("a") - 1) / 2
    return s.select("name", F.coalesce(rising, F.lit(False)).alias("ordered"), F.when(F.size("a") > 1, right / pairs).alias("accuracy"))


def module_grid(rows: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """(label, module, mean_abs, best): mean size of correlation by module and label, and the label's best module."""
    one = pair_row(rows, {f"{f}|{c}": (f, c) for f in features for c in labels})
    long = one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("label"), F.col(f"`{f}|{c}`").alias("r")) for f in features for c in labels])))
    grid = long.groupBy("label", family(F.col("feature")).alias("module")).agg(F.avg(F.abs("r")).alias("mean_abs"))
    best = grid.groupBy("label").agg(F.max_by("module", F.struct("mean_abs", "module")).alias("best"))
    return grid.join(F.broadcast(best), "label")  # a row for each label


def coverage_gaps(rows: DataFrame, features: list[str], labels: list[str], least: float = 0.15, enough: int = 3) -> DataFrame:
    """(label, n_strong, gap): how many features correlate by more than `least`, and whether that is under `enough`."""
    strong = lambda f, c: (F.abs(F.col(f"`{f}|{c}`")) > least).cast("int")
    one = pair_row(rows, {f"{f}|{c}": (f, c) for f in features for c in labels}).select(*[sum((strong(f, c) for f in features[1:]), strong(features[0], c)).alias(c) for c in labels])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n_strong"), (F.col(c) < enough).alias("gap")) for c in labels])))


def source_divergence(rows: DataFrame, features: list[str], label: str, source: str, human: str, most: float = 0.3, floor: int = 3) -> DataFrame:
    """(module, feature, gap, kept): the difference of a feature's correlation between human and other rows; kept if it is
    at most `most` or among its module's `floor` smallest."""
    h = F.col(source) == human
    both = pair_row(rows, {f"{s}_{f}": (F.when(own, F.col(f)), label) for f in features for s, own in (("h", h), ("s", ~h))})
    one = both.select(*[F.abs(F.col(f"h_{f}") - F.col(f"s_{f}")).alias(f) for f in features])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("gap")) for f in features]))).withColumn("module", family(F.col("feature")))
    k = F.row_number().over(Window.partitionBy("module").orderBy("gap", "feature"))
    return long.withColumn("k", k).select("module", "feature", "gap", ((F.col("gap") <= most) | (F.col("k") <= floor)).alias("kept"))


def module_gaps(divergence: DataFrame, k: int = 25) -> DataFrame:
    """(module, n_features, mean_gap, max_gap, widest k)."""
    return divergence.groupBy("module").agg(F.count("*").alias("n_features"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), top_text(-F.col("gap"), k).alias("widest"))


def suspect_features(table: DataFrame, importance: float = 0.01, ks: float = 0.3, gap: float = 0.2) -> DataFrame:
    """Features (feature, importance, ks, gap) that matter, differ in distribution and differ in correlation."""
    return table.withColumn("suspect", (F.col("importance") > importance) & (F.col("ks") > ks) & (F.col("gap") > gap))


def error_flags(rows: DataFrame, features: list[str], label: str, error: str, least: float = 0.1) -> DataFrame:
    """(feature, r_label, r_error, flag): misleading if the error goes with it and the label does not, signal the other way."""
    one = pair_row(rows, {f"{f}|{c}": (f, x) for f in features for c, x in (("y", label), ("e", error))})
    long = one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}|y`").alias("r_label"), F.col(f"`{f}|e`").alias("r_error")) for f in features])))
    y, e = F.abs("r_label") > least, F.abs("r_error") > least
    return long.withColumn("flag", F.when(e & ~y, "misleading").when(y & ~e, "signal").when(y & e, "both").otherwise("none"))


def damage_contrast(rows: DataFrame, features: list[str], error: str, worst: float = 0.10, best: float = 0.25) -> DataFrame:
    """(feature, damaged, healthy, difference): means over the rows of the largest and of the smallest errors."""
    low, high = quantiles(rows, error, [best, 1 - worst])
    bad, good = F.col(error) >= F.lit(high), F.col(error) <= F.lit(low)
    one = rows.agg(*[F.struct(F.avg(F.when(bad, F.col(f))).alias("d"), F.avg(F.when(good, F.col(f))).alias("h")).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)["d"].alias("damaged"), F.col(f)["h"].alias("healthy"), (F.col(f)["d"] - F.col(f)["h"]).alias("difference")) for f in features])))


def compared_models(rows: DataFrame, label: str, a: str, b: str, tie: float = 0.0, limits: Sequence[float] = (5.0, 10.0, 20.0)) -> DataFrame:
    """One row: shares of wins, ties and losses of model a against b, shares of errors of a above limits, p10 to p90 of a."""
    ea, eb = F.abs(F.col(a) - F.col(label)), F.abs(F.col(b) - F.col(label))
    p10, p90 = quantiles(rows, a, [0.1, 0.9])
    share = lambda t: F.avg(t.cast("double"))
    return rows.agg(share(ea < eb - tie).alias("wins"), share(F.abs(ea - eb) <= tie).alias("ties"), share(ea > eb + tie).alias("losses"), *[share(ea > x).alias(f"above_{int(x)}") for x in limits], F.lit(None if p10 is None else p90 - p10).cast("double").alias("spread"))


def text_histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 10, width: int = 40) -> DataFrame:
    """(bin, n, bar): fixed-width bins between low and high, the last with its upper edge, and a bar for the largest."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("m")).first().m or 1
    return counts.select("bin", "n", F.repeat(F.lit("#"), F.floor(F.col("n") * width / F.lit(most)).cast("int")).alias("bar"))


def experiment_log(log: DataFrame, order: str, status: str, loss: str, kept: str = "keep") -> DataFrame:
    """Runs in order, by ranges of the order: the running least loss of kept runs, and each kept run's change
    against the kept one before, ranked by the gain."""
    from textweave.operators.ordering import _met, arranged, value_counts

    own = F.when(F.col(status) == kept, F.col(loss))
    runs = arranged(log.withColumn("_own", own), [order])
    w = Window.partitionBy("_part").orderBy("_at")
    ends = runs.groupBy("_part").agg(F.min("_own").alias("_m"), F.max(F.when(F.col("_own").isNotNull(), F.struct("_at", "_own")))["_own"].alias("_l"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select("_part", F.min("_m").over(before).alias("_least"), F.last("_l", ignorenulls=True).over(before).alias("_last"))
    runs = _met(runs, [], ends)
    runs = runs.withColumn("best", F.least(F.min("_own").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_least"))
    last = F.coalesce(F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_last")
    runs = runs.withColumn("change", F.col("_own") - last).select(*log.columns, "best", "change")
    places = value_counts(runs.where("change IS NOT NULL"), [], "change").select(F.col("change").alias("_c"), (F.col("ahead") + 1).cast("int").alias("place"))
    return runs.join(places, F.col("change") == F.col("_c"), "left").drop("_c")


def composite_rank(rows: DataFrame, key: str, high: list[str], low: list[str]) -> DataFrame:
    """(key, score, score_<family>): the mean of the percentile ranks of features, those of order turned round.

    Ranks of ties follow the key; a single row has rank 0.5. Features are ranked together by ranges of (feature, value, key).
    """
    from textweave.operators.ordering import positions, ranges

    long = rows.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in [*high, *low]])))
    n = rows.count()
    size = n * (len(high) + len(low))
    ranked = positions(long, ["feature"], ["v", key], "_k", size)
    share = F.col("_k") / F.lit(n - 1) if n > 1 else F.lit(0.5)
    r = F.when(F.col("feature").isin(*low), 1 - share).otherwise(share) if low else share
    families = sorted({f.split("_")[0] for f in [*high, *low]})
    shares = ranked.select(key, family(F.col("feature")).alias("fam"), r.alias("r")).repartition(ranges(rows, size), key)
    return shares.groupBy(key).agg(F.avg("r").alias("score"), *[F.avg(F.when(F.col("fam") == x, F.col("r"))).alias(f"score_{x}") for x in families])


def golden_anchors(rows: DataFrame, key: str) -> DataFrame:
    """(target, percentile, key, overall, label_std, source, text_length, n_candidates) of (key, overall, label_std, source,
    text_length): per target the human row of least deviation and of a length near 800.

    Where no row of 200 characters or more is in a target's range, the range is 0.5 wider and 100 characters do.
    """
    targets = F.array(*[F.struct(F.lit(n).alias("target"), F.lit(p).alias("percentile"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, p, a, b in TARGETS])
    wide = rows.select("*", F.inline(targets)).where((F.col("overall") >= F.col("lo") - 0.5) & (F.col("overall") <= F.col("hi") + 0.5) & (F.col("text_length") >= 100))
    strict = (F.col("overall") >= F.col("lo")) & (F.col("overall") <= F.col("hi")) & (F.col("text_length") >= 200)
    # One bounded aggregation a target: the least candidate, strict ones first.
    choice = F.struct((~strict).alias("w"), (F.col("source") != "human").alias("s"), "label_std", F.abs(F.col("text_length") - 800).alias("d"), key, "overall", "source", "text_length")
    best = wide.groupBy("target", "percentile").agg(F.min(choice).alias("c"), F.count_if(strict).alias("n"), F.count("*").alias("m"))
    return best.select("target", "percentile", f"c.{key}", "c.overall", "c.label_std", "c.source", "c.text_length", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("m")).alias("n_candidates"))


def promotion_gates(rows: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """One row of the five comparisons of a candidate's scores to a baseline's, and whether all hold.

    rows: control_type, expected and the two models' scores. A gate without rows of its kind is not passed.
    """
    c = F.col
    mae = lambda m, kind=None: F.avg(F.when(F.lit(True) if kind is None else c("control_type") == kind, F.abs(c(m) - c("expected"))))
    mean = lambda m, kind: F.avg(F.when(c("control_type") == kind, c(m)))
    neutral, emotional = "neutral_fragmented_positive", "emotional_coherent_negative"
    one = rows.agg(
        *[mae(m).alias(f"mae_{k}") for k, m in (("c", candidate), ("b", baseline))], *[mean(m, neutral).alias(f"neutral_{k}") for k, m in (("c", candidate), ("b", baseline))],
        *[mean(m, emotional).alias(f"emotional_{k}") for k, m in (("c", candidate), ("b", baseline))], *[mae(m, f"spectrum_{x}").alias(f"s{x[0]}_{k}") for x in ("7_8", "9_10") for k, m in (("c", candidate), ("b", baseline))],
    )
    tests = {
        "overall_mae_improved": c("mae_c") < c("mae_b"),
        "neutral_fragmented_improved": c("neutral_c") > c("neutral_b"),
        "neutral_fragmented_gte_60": c("neutral_c") >= 60,
        "emotional_coherent_not_regressed": c("emotional_c") <= F.greatest(F.lit(40.0), c("emotional_b") + 5),
        "high_band_mae_improved": (c("s7_c") < c("s7_b")) & (c("s9_c") < c("s9_b")),
    }
    passed = one.select(*[F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()])
    names = list(tests)
    return passed.select("*", (c(names[0]) & c(names[1]) & c(names[2]) & c(names[3]) & c(names[4])).alias("promotable"))


def false_low_groups(rows: DataFrame) -> DataFrame:
    """(grp, n, mean_expected, mean_model, mean_error, mean_abs_error) of false lows, detected highs and low labels."""
    high = F.col("expected") >= 66
    error = F.col("model") - F.col("expected")
    kinds = {"false_low": high & (error <= -15), "detected_high": high & (F.col("model") >= 60), "low_labeled": F.col("expected") <= 35}
    groups = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in kinds.items()]), lambda x: x.isNotNull())
    return rows.select("expected", "model", F.explode(groups).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"), F.avg("expected").alias("mean_expected"), F.avg("model").alias("mean_model"), F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_abs_error"))


def group_deltas(rows: DataFrame, features: str, a: Column, b: Column) -> DataFrame:
    """(name, mean_a, mean_b, delta): per key of a map column the means over two groups of rows, where both have it."""
    long = rows.select(a.alias("a"), b.alias("b"), F.explode(features).alias("name", "v"))
    out = long.groupBy("name").agg(F.avg(F.when(F.col("a"), F.col("v"))).alias("mean_a"), F.avg(F.when(F.col("b"), F.col("v"))).alias("mean_b"))
    return out.where("mean_a IS NOT NULL AND mean_b IS NOT NULL").withColumn("delta", F.col("mean_a") - F.col("mean_b"))


def false_low_deltas(rows: DataFrame, features: str = "features") -> DataFrame:
    high = F.col("expected") >= 66
    return group_deltas(rows, features, high & (F.col("model") - F.col("expected") <= -15), high & (F.col("model") >= 60))


def false_low_hypotheses(deltas: DataFrame, coherence: str, fragments: str, subscore: str) -> DataFrame:
    """(hypothesis, holds): what the means of false lows suggest."""
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    one = deltas.agg((pick(coherence, "mean_a") >= 0.55).alias("coherence_masks"), (pick(fragments, "delta") < 0).alias("fragments_underfire"), (pick(subscore, "delta") > 0).alias("subscore_generous"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("hypothesis"), F.coalesce(F.col(c), F.lit(False)).alias("holds")) for c in one.columns])))


def disorder_separation(rows: DataFrame, features: str = "features") -> DataFrame:
    """group_deltas() of missed highs against emotional controls, with the neutral controls' mean and the best separator."""
    missed = (F.col("expected") >= 66) & (F.col("model") < 60)
    deltas = group_deltas(rows, features, missed, F.col("control_type") == "emotional_coherent_negative")
    neutral = rows.where(F.col("control_type") == "neutral_fragmented_positive").select(F.explode(features).alias("name", "v")).groupBy("name").agg(F.avg("v").alias("mean_neutral"))
    best = Window.orderBy(F.desc(F.abs("delta")), "name")  # a row for each feature
    return deltas.join(neutral, "name", "left").withColumn("best", F.row_number().over(best) == 1)


def best_per_group(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The row of the largest value of each group, the smaller key on a tie."""
    rest = [c for c in rows.columns if c not in by]
    best = F.min(F.struct((-F.col(value)).alias("_v"), F.col(key).alias("_k"), *rest)).alias("b")
    return rows.groupBy(*by).agg(best).select(*by, *[f"b.{c}" for c in rest])


def map_means(rows: DataFrame, column: str) -> DataFrame:
    """(name, mean, n) of each key of a map column, where it is there."""
    return rows.select(F.explode(column).alias("name", "v")).groupBy("name").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def ordered_dedupe(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order, nulls first and ties to the least other columns, in one aggregation without a window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("r")).select(key, *[f"r.{c}" for c in rest])
