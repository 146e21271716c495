"""Vector and statistics expressions that stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))


def weighted_r(a: Column, b: Column, w: Column) -> Column:
    """Pearson's r of weighted rows as an aggregate; 0 where a side is constant. Nulls must be gone, or be null in all three."""
    total, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - F.try_divide(sa * sb, total)
    va, vb = F.sum(w * a * a) - F.try_divide(sa * sa, total), F.sum(w * b * b) - F.try_divide(sb * sb, total)
    return F.coalesce(F.when((va > 1e-12) & (vb > 1e-12), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))), F.lit(0.0))


def safe_corr(x: str, y: str, weight: Column | None = None) -> Column:
    """Pearson's r as an aggregate, weighted if asked: 0 for fewer than three pairs or a constant side.

    A row with a null or NaN on one side takes no part on either.
    """
    a, b = (F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    if weight is None:
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    else:
        r = weighted_r(a, b, F.when(both, weight.cast("double")))
    return F.when(F.count(a) < 3, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def pair_correlations(rows: DataFrame, pairs: dict[str, tuple[str | Column, str | Column]], by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, pair, r, n): safe_corr() of many pairs, weighted if asked. A pair of a group without a row has no row here.

    The pairs are unpivoted and summed up inside each task: aggregates of many pairs side by side would be one function too
    long for the JVM to compile.
    """
    clean = lambda c: F.nullif((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(float("nan")))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), clean(a).alias("a"), clean(b).alias("b")) for k, (a, b) in enumerate(pairs.values())])
    names = F.array(*map(F.lit, pairs))
    w = [] if weight is None else [weight.cast("double").alias("w")]
    long = rows.select(*(by or []), *w, F.inline(cells)).where("a IS NOT NULL AND b IS NOT NULL")
    if w:
        r = F.when(F.count("*") < 3, F.lit(0.0)).otherwise(weighted_r(F.col("a"), F.col("b"), F.col("w")))
        return long.groupBy(*(by or []), "k").agg(r.alias("r"), F.count("*").alias("n")).select(*(by or []), F.get(names, F.col("k")).alias("pair"), "r", "n")
    sums = long.groupBy(*(by or []), "k").agg(F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.count("*").alias("n"))
    r = F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("c"), F.col("sa") * F.col("sb")), F.lit(0.0)))
    return sums.select(*(by or []), F.get(names, F.col("k")).alias("pair"), r.alias("r"), "n")


def pair_row(rows: DataFrame, pairs: dict[str, tuple[str | Column, str | Column]], weight: Column | None = None) -> DataFrame:
    """One row of all pairs' correlations, a column each."""
    return pair_correlations(rows, pairs, weight=weight).agg(*[F.coalesce(F.max(F.when(F.col("pair") == n, F.col("r"))), F.lit(0.0)).alias(n) for n in pairs])


def share(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def rounded(df, digits: int = 6):
    """Doubles of a result rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
