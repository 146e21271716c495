"""Running sums, positions and quantiles over whole tables without one task that holds them all.

Rows are dealt into ranges of (keys, order) by Spark's range partitioning, sorted inside each, and stored with the number of
their range and their place in it, so that ranges stay what they are. A row's position is its place plus the rows of the
ranges before; only one row a range is ever gathered. Give an order that ends in a unique key: equal values, even one value
alone, are then spread over ranges like others.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.sources.scratch import stored

#: Rows of a range at most, about: a task sorts that many, however large the table.
RANGE_ROWS = 1 << 20
#: Groups whose starts are broadcast at most; more meet their rows by (group, range).
BROADCAST_GROUPS = 100_000


def _same(left: DataFrame, right: DataFrame, names: list[str], others: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in zip(names, others, strict=True)])


def ranges(rows: DataFrame, size: int) -> int:
    """The number of partitions for that many rows: the session's, or more so that none has more than RANGE_ROWS."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_ROWS))


def arranged(rows: DataFrame, order: list[Column | str], size: int | None = None) -> DataFrame:
    """The rows, stored, with `_part` and `_at`: the range of the order that holds a row, and its place there from 0.

    size: the number of rows, if it is known; there are then as many ranges as keep each at RANGE_ROWS.
    """
    dealt = rows.repartitionByRange(*order) if size is None or size <= RANGE_ROWS else rows.repartitionByRange(ranges(rows, size), *order)
    dealt = dealt.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return stored(dealt.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "arranged")


def _met(rows: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
    """Joins arranged rows to a side of one row for each (keys, _part): at most one range of rows meets a row of the side."""
    names = [f"_of_{k}" for k in (*keys, "_part")]
    side = side.withColumnsRenamed(dict(zip((*keys, "_part"), names, strict=True)))
    if side.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        side = F.broadcast(side)
    return rows.join(side, _same(rows, side, [*keys, "_part"], names)).drop(*names)


def running(rows: DataFrame, keys: list[str], order: list[Column | str], **sums: str) -> DataFrame:
    """Adds, for each name=column, the sum of the column over the rows of the same keys before a row."""
    a = arranged(rows, [*keys, *order])
    w = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = a.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select(*keys, "_part", *[zero(F.sum(f"_{n}").over(before)).alias(f"_{n}") for n in sums])
    return _met(a, keys, totals).select(*rows.columns, *[(F.col(f"_{n}") + zero(F.sum(c).over(w))).alias(n) for n, c in sums.items()])


def positions(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "position", size: int | None = None) -> DataFrame:
    """Adds the place of a row within its keys from 0, in an order that ends in a unique key. size: the number of rows."""
    a = arranged(rows, [*keys, *order], size)
    parts = a.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return _met(a, keys, starts).select(*rows.columns, (F.col("_start") + F.col("_at")).alias(name))


def value_counts(rows: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    """(keys, value, m, ahead): distinct values with their number of rows, and how many rows have a smaller value.

    times: a column that says how often a row counts.
    """
    counts = rows.groupBy(*keys, value).agg((F.count("*") if times is None else F.sum(times)).alias("m"))
    return running(counts, keys, [value], ahead="m")


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str, times: str | None = None) -> DataFrame:
    """(keys, value, name): the mean rank of each distinct value within its keys; see value_counts()."""
    return value_counts(rows, keys, value, times).select(*keys, value, (F.col("ahead") + (F.col("m") + 1) / 2.0).alias(name))


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between ranks; null values take no part. A few numbers reach the driver."""
    return all_quantiles(rows, {value: shares})[value]


def all_quantiles(rows: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, ranked together in one pass."""
    names = list(shares)
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.col(n).cast("double").alias("v")) for k, n in enumerate(names)]))).where("v IS NOT NULL")
    cum = stored(value_counts(long, ["c"], "v"), "ranked")
    n = {r.c: r.n for r in cum.groupBy("c").agg(F.sum("m").alias("n")).collect()}
    at = {(k, i): s * (n.get(k, 0) - 1) for k, name in enumerate(names) for i, s in enumerate(shares[name]) if k in n}
    wanted: dict[int, set[int]] = {}
    for (k, _), p in at.items():
        wanted.setdefault(k, set()).update(x for x in (int(p), int(p) + 1) if x < n[k])
    places = F.array(*[F.array(*[F.lit(x).cast("long") for x in sorted(wanted.get(k, ()))]).cast("array<bigint>") for k in range(len(names))])
    own = F.filter(F.get(places, F.col("c")), lambda x: (x >= F.col("ahead")) & (x < F.col("ahead") + F.col("m")))
    value = {(r.c, r.x): r.v for r in cum.select("c", "v", F.explode(own).alias("x")).collect()}  # two rows a share
    out: dict[str, list[float | None]] = {}
    for k, name in enumerate(names):
        for i in range(len(shares[name])):
            if (p := at.get((k, i))) is None:
                out.setdefault(name, []).append(None)
                continue
            low, high = value[k, int(p)], value.get((k, int(p) + 1))
            out.setdefault(name, []).append(low if high is None else low + (high - low) * (p - int(p)))
    return out


def spread_join(rows: DataFrame, side: DataFrame, on: str, times: str, most: int = 10_000) -> DataFrame:
    """Left join of rows to one row a key, `times` being its number of rows: the few very common keys are broadcast.

    There are `most` of those at the utmost, as each has more than a `most`-th of all rows. Null keys meet null keys.
    """
    least = max(1, rows.count() // most)
    hot = F.broadcast(side.where(F.col(times) > least).withColumnRenamed(on, "_key"))
    cold = side.where(F.col(times) <= least).withColumnRenamed(on, "_key")
    common = rows.join(hot, rows[on].eqNullSafe(hot["_key"])).drop("_key")
    rare = rows.join(hot, rows[on].eqNullSafe(hot["_key"]), "left_anti")
    return common.unionByName(rare.join(cold, rare[on].eqNullSafe(cold["_key"]), "left").drop("_key"))


def carried(rows: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the last value that is not null at or before a row in the order of the whole table."""
    a = arranged(rows, order)
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    ends = a.groupBy("_part").agg(F.max(F.when(F.col(value).isNotNull(), F.struct("_at", F.col(value).alias("v"))))["v"].alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_ahead"))
    return _met(a, [], ahead).select(*rows.columns, F.coalesce(inside, F.col("_ahead")).alias(name))
