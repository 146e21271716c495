"""Seeded choices and draws: uniforms are hashes of keys, so a table gives the same rows on every run and in any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators.ordering import carried, positions, running

#: Uniforms are 12 hexadecimal digits of a hash, as whole numbers below this.
SPAN = 1 << 48
#: Weights of draws count in units of 1 / UNIT.
UNIT = 1_000_000


def uniform(seed: int, *key: Column) -> Column:
    """A whole number below SPAN that the seed and the key fix."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def weighted_choice(u: Column, items: Sequence[tuple[object, float]]) -> Column:
    """The first item whose weights so far reach the share u / SPAN of all weights; weights that do not sum to more than 0 raise."""
    total = float(sum(w for _, w in items))
    if total <= 0:
        raise ValueError("weights must sum to a positive number")
    pick, so_far, out = u.cast("double") / float(SPAN) * total, 0.0, None
    for value, w in items[:-1]:
        so_far += w
        out = F.when(pick <= so_far, F.lit(value)) if out is None else out.when(pick <= so_far, F.lit(value))
    return F.lit(items[-1][0]) if out is None else out.otherwise(F.lit(items[-1][0]))


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key): n draws with replacement, each row with probability proportional to its weight.

    Inverse distribution function: rows lie one after the other in the order of the key, each as long as its weight; a draw
    is a place on that line and takes the row that lies there. Rows and draws are sorted together by ranges of the line, so
    neither a heavy row nor a popular place meets all draws in one task. Null, negative and zero weights are never drawn;
    repeated keys are rows of their own; without a weight above zero there are no draws.
    """
    units = F.round(F.col(weight).cast("double") * UNIT).cast("long")
    heavy = rows.select(F.col(key).alias("_key"), units.alias("_w")).where("_w > 0")
    line = running(heavy, [], ["_key", "_w"], _from="_w")
    total = line.agg(F.sum("_w").alias("t")).first().t or 0
    if not total:
        return rows.select(F.lit(0).cast("long").alias("draw"), F.col(key)).limit(0)
    place = F.call_function("div", F.col("_u").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)"), F.lit(SPAN).cast("decimal(19,0)"))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("_u")).select("draw", place.alias("_from"))
    spots = line.select("_from", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("draw"), F.struct("_key").alias("_row"))
    spots = spots.unionByName(draws.select("_from", F.lit(1).alias("_kind"), "draw", F.lit(None).cast(spots.schema["_row"].dataType).alias("_row")))
    met = carried(spots, ["_from", "_kind", "draw"], "_row", "_met").where("_kind = 1")
    return met.select("draw", F.col("_met._key").alias(key))


def class_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: shuffled folds that each have their part of every class, to within one row.

    Rows are dealt in turn in the order of (class, hash of the key): where a class does not come out even, the next class goes
    on at the following fold, so folds differ by one row in all too. Null labels are a class, after all others.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))))
    placed = positions(hashed, [], [F.col(label).asc_nulls_last(), "_h", key], "_k", hashed.count())
    return placed.withColumn("fold", F.pmod("_k", F.lit(k)).cast("int")).drop("_h", "_k")


def quantized(value: Column, edges: Sequence[float]) -> Column:
    """The class of a number: how many of the rising edges it reaches; null stays null."""
    return F.when(value.isNotNull(), sum(((value >= e).cast("int") for e in edges), F.lit(0)))
