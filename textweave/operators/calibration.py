"""Isotonic calibration as tables: no threshold goes to the driver, and no task holds more than a bounded run of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.operators.ordering import BROADCAST_GROUPS, carried, positions, spread_join
from textweave.sources.scratch import stored

#: Blocks that one task pools at once.
RUN = 65_536


def pooled(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first index of each block of the non-decreasing fit: neighbours whose means do not rise are pooled."""
    first: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for k, (s, w) in enumerate(zip(total.tolist(), weight.tolist(), strict=True)):
        at = k
        while sums and sums[-1] * w >= s * weights[-1]:
            s, w, at = s + sums.pop(), w + weights.pop(), first.pop()
        first.append(at)
        sums.append(s)
        weights.append(w)
    return np.asarray(first, np.int64)


def _pool_runs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pools each run (keys, _run) of adjacent blocks (lo, hi, total, weight)."""
    names = [*keys, "lo", "hi", "total", "weight"]
    schema = T.StructType([*(blocks.schema[n] for n in names), T.StructField("_run", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo").combine_chunks()
        of = {n: table.column(n).to_numpy() for n in ("hi", "total", "weight")}
        first = pooled(of["total"], of["weight"])
        last = np.append(first[1:], len(table)) - 1
        heads = table.take(pa.array(first))
        sums = {n: pa.array(np.add.reduceat(of[n], first)) for n in ("total", "weight")}
        cells = {n: heads.column(n) for n in (*keys, "lo", "_run")} | {"hi": pa.array(of["hi"][last])} | sums
        return pa.table([cells[n] for n in schema.names], names=schema.names)

    return blocks.groupBy(*keys, "_run").applyInArrow(run, schema)


def isotonic_blocks(rows: DataFrame, prediction: str, label: str, keys: list[str] | tuple[str, ...] = (), most: int = RUN, times: str | None = None) -> DataFrame:
    """(keys, lo, hi, value, weight): blocks of the non-decreasing least-squares fit of labels, cut to 0 and 100, for each key.

    Labels of equal predictions are averaged first. Blocks then lie in runs of `most` neighbours and each run is pooled by a
    task of its own; runs shift by half their length from round to round until no two neighbours fall, so a pool may grow
    over any number of runs. In whatever order neighbours are pooled, the fit is the same. Rows with a null or NaN
    prediction or label take no part; no rows give no blocks. times: a column that says how often a row counts.
    """
    keys = list(keys)
    p, y = F.col(prediction).cast("double"), F.col(label).cast("double")
    some = rows.where(p.isNotNull() & y.isNotNull() & ~F.isnan(p) & ~F.isnan(y))
    n = F.lit(1.0) if times is None else F.col(times).cast("double")
    clipped = some.select(*keys, p.alias("lo"), F.least(F.greatest(y, F.lit(0.0)), F.lit(100.0)).alias("_y"), n.alias("_n"))
    blocks = clipped.groupBy(*keys, "lo").agg(F.sum(F.col("_y") * F.col("_n")).alias("total"), F.sum("_n").alias("weight")).withColumn("hi", F.col("lo"))
    shift = 0
    while True:
        placed = positions(blocks, keys, ["lo"], "_place")
        runs = placed.withColumn("_run", F.expr(f"(_place + {shift}) div {most}")).drop("_place")
        blocks = stored(_pool_runs(runs, keys), "isotonic")
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy(*keys, "_run").agg(F.min_by(mean, "lo").alias("_first"), F.max_by(mean, "lo").alias("_last"))
        ahead = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_run"))  # a row for each run
        falls = not ends.select((F.col("_last") >= ahead).alias("f")).where("f").isEmpty()
        blocks = blocks.drop("_run")
        if not falls:
            return blocks.select(*keys, "lo", "hi", mean.alias("value"), "weight")
        shift = most // 2 - shift


def thresholds(blocks: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(keys, x, y): both ends of each block with its value, one row where they are the same."""
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select(*keys, F.explode(ends).alias("x"), F.col("value").alias("y"))


def _between(p: Column, low: Column, high: Column) -> Column:
    """The value of a block that holds p, else the line between the blocks around it, else the nearest block's."""
    line = low["value"] + (p - low["hi"]) * (high["value"] - low["value"]) / (high["lo"] - low["hi"])
    return F.when(low["hi"] >= p, low["value"]).when(low["value"].isNotNull() & high["value"].isNotNull(), line).otherwise(F.coalesce(low["value"], high["value"]))


def calibrated(rows: DataFrame, prediction: str, blocks: DataFrame, name: str = "calibrated", keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The rows with `name`: their prediction through the blocks of their key, straight lines between, held beyond the ends.

    A sorted merge: distinct predictions and blocks stand in one order dealt over ranges, and the block before and the one
    after are carried to each prediction. At most BROADCAST_GROUPS distinct predictions then meet their rows by a broadcast,
    so the rows are not shuffled. Null or NaN predictions, and keys without blocks, give null.
    """
    keys = list(keys)
    p = F.col(prediction).cast("double")
    of = F.struct(*[F.col(k) for k in keys], p.alias("_p"))
    each = rows.where(p.isNotNull() & ~F.isnan(p)).groupBy(of.alias("_of")).agg(F.count("*").alias("_n"))
    asks = each.select(*[F.col(f"_of.{k}").alias(k) for k in keys], F.col("_of._p").alias("_x"), "_n", F.lit(None).cast("struct<lo:double,hi:double,value:double>").alias("_b"))
    marks = blocks.select(*keys, F.col("lo").alias("_x"), F.lit(None).cast("long").alias("_n"), F.struct("lo", "hi", "value").alias("_b"))
    line = asks.unionByName(marks).withColumn("_b", F.when(F.col("_b").isNotNull(), F.struct(F.struct(*(keys or [F.lit(0).alias("_")])).alias("k"), F.col("_b").alias("b"))))
    # Of a block and a prediction at its beginning the block comes first both ways, so it is the one before and after.
    up = carried(line, [*keys, "_x", F.col("_b").isNull()], "_b", "_low")
    both = carried(up, [*[F.col(k).desc() for k in keys], F.col("_x").desc(), F.col("_b").isNull()], "_b", "_high").where("_n IS NOT NULL")
    own = F.struct(*(keys or [F.lit(0).alias("_")]))
    block = lambda c: F.when(F.col(f"{c}.k").eqNullSafe(own), F.col(f"{c}.b"))
    found = both.select(F.struct(*keys, F.col("_x").alias("_p")).alias("_of"), "_n", _between(F.col("_x"), block("_low"), block("_high")).alias(name))
    found, rows = stored(found, "calibrated"), rows.withColumn("_of", of)
    if found.limit(BROADCAST_GROUPS + 1).count() > BROADCAST_GROUPS:
        return spread_join(rows, found, "_of", "_n").drop("_of", "_n")
    few = F.broadcast(found.drop("_n").withColumnRenamed("_of", "_key"))
    return rows.join(few, rows["_of"].eqNullSafe(few["_key"]), "left").drop("_of", "_key")
