"""Rater consensus and agreement, label analysis, bins, folds, samples and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.vectors import pair_row, safe_corr, weighted_r
from textweave.operators.ordering import average_ranks, positions, quantiles, running
from textweave.sources.scratch import stored


def trimmed_mean(values: list[Column], threshold: float) -> tuple[Column, Column]:
    """Mean of three ratings; beyond the threshold the one furthest from the median goes, the lowest on a tie."""
    s = F.array_sort(F.array(*values))
    low, mid, high = (F.get(s, F.lit(k)) for k in range(3))
    trimmed = high - low > threshold
    two = F.when(mid - low >= high - mid, (mid + high) / 2).otherwise((low + mid) / 2)
    return F.when(trimmed, two).otherwise((low + mid + high) / 3), trimmed


def consensus(rows: DataFrame, raters: list[str], threshold: float = 3.0) -> DataFrame:
    """Adds consensus, trimmed, spread and population deviation of three ratings; a missing one counts 5."""
    v = [F.coalesce(F.col(c).cast("double"), F.lit(5.0)) for c in raters]
    mean, trimmed = trimmed_mean(v, threshold)
    plain = (v[0] + v[1] + v[2]) / 3
    deviation = F.sqrt(sum((x - plain) * (x - plain) for x in v) / 3)
    return rows.select("*", mean.alias("consensus"), trimmed.alias("trimmed"), (F.greatest(*v) - F.least(*v)).alias("spread"), deviation.alias("deviation"))


def agreement(rated: DataFrame, raters: list[str]) -> DataFrame:
    """One row: counts, spreads, share trimmed and the three pairwise correlations."""
    a, b, c = raters
    return rated.agg(F.count("*").alias("n"), F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"), F.avg(F.col("trimmed").cast("double")).alias("trimmed_share"), safe_corr(a, b).alias("r_ab"), safe_corr(a, c).alias("r_ac"), safe_corr(b, c).alias("r_bc"))


def correlations(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, pearson, n): all features in one pass, without unpivoting the rows."""
    one = pair_row(rows, {f: (f, label) for f in features})
    n = F.lit(rows.count())
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "pearson")).select("feature", "pearson", n.alias("n"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks on ties."""
    one = cell_correlations(pair_cells(rows, [x], [y], []), [])  # no row without pairs
    return one.agg(F.coalesce(F.max("rho"), F.lit(0.0)).alias("rho"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def pair_cells(rows: DataFrame, features: list[str], labels: list[str], by: list[str]) -> DataFrame:
    """(by, label, feature, x, y, m): the distinct pairs of each feature with each label, stored, and how many rows have them.

    Rows are unpivoted once and counted inside each task first, so what is shuffled is at most the distinct pairs of a task: few
    for ratings, as many as rows for measurements. Pairs with a null take no part.
    """
    x = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    y = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in labels])
    long = rows.select(*by, F.explode(x).alias("_x"), y.alias("_y")).select(*by, "_x.*", F.explode("_y").alias("_y")).select(*by, "feature", "x", "_y.*").dropna(subset=["x", "y"])
    return stored(long.groupBy(*by, "label", "feature", "x", "y").agg(F.count("*").alias("m")), "cells")


def cell_correlations(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, feature, rho, n): rank correlations of pair_cells() rows; cells that come more than once add up."""
    keys = [*by, "label", "feature"]
    ranked = cells
    for c in "xy":
        ranked = ranked.join(average_ranks(cells, keys, c, f"r{c}", "m"), [*keys, c])
    n = F.sum("m")
    return ranked.groupBy(*keys).agg(F.when(n < 3, F.lit(0.0)).otherwise(weighted_r(F.col("rx"), F.col("ry"), F.col("m"))).alias("rho"), n.alias("n"))


def spearman_table(rows: DataFrame, features: list[str], labels: list[str], by: list[str]) -> DataFrame:
    """(by, label, feature, rho, n): rank correlations of all features with all labels, within each group.

    Ranks come from distinct values, so a group's rows never meet in one task. Pairs with a null take no part; a constant side
    or fewer than three pairs give 0.
    """
    return cell_correlations(pair_cells(rows, features, labels, by), by)


def kolmogorov_smirnov(rows: DataFrame, features: list[str], group: Column, terms: int = 100) -> DataFrame:
    """(feature, ks, p, n_a, n_b): the greatest gap between two groups' distribution functions of each feature.

    group is 0 or 1, rows of neither and nulls take no part. p is the limiting Kolmogorov distribution's.
    """
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    c = rows.select(x.alias("x"), group.alias("g")).select("x.*", "g").where("v IS NOT NULL").groupBy("feature", "v").agg(F.count_if(F.col("g") == 0).alias("a"), F.count_if(F.col("g") == 1).alias("b"))
    cum = running(c, ["feature"], ["v"], ca="a", cb="b")
    n = c.groupBy("feature").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(F.try_divide(F.col("ca") + F.col("a"), "n_a") - F.try_divide(F.col("cb") + F.col("b"), "n_b"))
    out = cum.join(n, "feature").groupBy("feature").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    square = F.col("ks") * F.col("ks") * F.coalesce(F.try_divide(F.col("n_a") * F.col("n_b"), F.col("n_a") + F.col("n_b")), F.lit(0.0))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * square))
    return out.select("feature", "ks", F.when(square < 0.02, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))).alias("p"), "n_a", "n_b")


def tertiles(rows: DataFrame, value: str) -> DataFrame:
    """Adds bin low, medium or high by the quantiles 1/3 and 2/3; a null value is high."""
    a, b = quantiles(rows, value, [1 / 3, 2 / 3])
    return rows.withColumn("bin", F.when(F.col(value) <= F.lit(a), "low").when(F.col(value) <= F.lit(b), "medium").otherwise("high"))


def balanced(rows: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each stratum as the smallest has, in the order of a hash of the key."""
    least = rows.groupBy(stratum).agg(F.count("*").alias("m")).agg(F.min("m").alias("least")).first().least or 0
    hashed = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    placed = positions(hashed, [stratum], ["_h", key], "_k", hashed.count())
    return placed.where(F.col("_k") < least).drop("_k", "_h")


def folds(rows: DataFrame, stratum: str, key: str, k: int = 5) -> DataFrame:
    """Round-robin folds within each stratum in the order of a numeric key."""
    return positions(rows, [stratum], [key], "_k", rows.count()).withColumn("fold", F.pmod("_k", F.lit(k)).cast("int")).drop("_k")


def shuffled_folds(rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of equal size in the order of a hash of the key; the last takes the remainder."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    size = max(1, rows.count() // k)
    placed = positions(hashed, [], ["_h", key], "_k", hashed.count())
    return placed.withColumn("fold", F.least(F.floor(F.col("_k") / size), F.lit(k - 1)).cast("int")).drop("_k", "_h")


def buckets(rows: DataFrame, value: str, width: int = 20, top: int = 80) -> DataFrame:
    """n, MAE and RMSE by bucket of the expected value; the last bucket takes its upper edge."""
    low = F.least(F.floor(F.col(value) / width) * width, F.lit(top)).cast("int")
    err = F.col("model") - F.col(value)
    return rows.groupBy(F.format_string("%02d-%03d", low, low + width).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(value).alias("mean_expected"), F.avg("model").alias("mean_model"))
