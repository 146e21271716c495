"""Point-in-time feature join by skyline staircase sweeps over blocks of time.

Each ask (key, t) wants the usable version of its key of the highest priority: event, then arrival, then a tie column. A
version is usable from max(event, arrival) until before its expiry. Time is cut into blocks of 2 ** bits units, and each
(key, block) is swept on its own, so one key of a third of all rows is as many cells as there are blocks.

- Versions of one key, start and expiry are one: the best of them. It is found before the shuffle.
- A version goes as a row to the block of its start and to the block of its end. What it covers in between is written as
  the few dyadic nodes over blocks that cover it exactly; a block takes the best version over its nodes. So rows do not
  grow with the length of a version.
- A sweep holds the staircase alone: versions by priority whose expiry rises as the priority falls. A new version is placed by
  bisection and goes at once if a better one outlives it; those it outlives go; an ask drops the expired front and reads it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import stored

#: Seconds of a block are 2 ** BITS.
BITS = 6
#: Rows that a sweep hands on at once.
ROWS = 10_000


class Staircase:
    """Active versions by rising priority; expiry falls along the list, so the last is the best and the first to expire."""

    def __init__(self):
        self.priority: list[tuple] = []
        self.expiry: list[int] = []
        self.payload: list = []

    def add(self, priority: tuple, expiry: int, payload) -> None:
        """A version enters unless one of its priority or above lives as long; it removes those below that do not outlive it."""
        at = bisect_left(self.priority, priority)
        if at < len(self.expiry) and self.expiry[at] >= expiry:
            return
        to = at + (at < len(self.priority) and self.priority[at] == priority)
        while at and self.expiry[at - 1] <= expiry:
            at -= 1
        self.priority[at:to], self.expiry[at:to], self.payload[at:to] = [priority], [expiry], [payload]

    def best(self, t: int):
        """(priority, payload) of the best version at a time that never falls, or None."""
        while self.expiry and self.expiry[-1] <= t:
            self.priority.pop()
            self.expiry.pop()
            self.payload.pop()
        return (self.priority[-1], self.payload[-1]) if self.expiry else None


def sweep(schema: pa.Schema):
    """Rows (key, block, time, asks, expiry, event, arrival, tie, payload) in order of time within cells to answers of asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, stairs, out = None, Staircase(), []

        def answers() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, block, time, asks, expiry, event, arrival, tie, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != (key, block):
                    cell, stairs = (key, block), Staircase()
                if not asks:
                    stairs.add((event, arrival, tie), expiry, payload)
                elif (found := stairs.best(time)) is not None:
                    out.append((key, time, *found[0], found[1]))
                    if len(out) >= ROWS:
                        yield answers()
        if out:
            yield answers()

    return run


def nodes(first: Column, last: Column, levels: int) -> Column:
    """(level, node) of the dyadic nodes that cover blocks first to last: at each level at most one at either end."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.expr("0L").alias("x")))

    def of(e: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), e["level"])
        low = F.call_function("shiftright", first + size - 1, e["level"])
        high = F.call_function("shiftright", last + 1, e["level"])  # nodes low to high - 1 lie inside
        left = F.when((low < high) & (low.bitwiseAND(1) == 1), F.struct(e["level"].alias("level"), low.alias("node")))
        right = F.when((low < high) & (high.bitwiseAND(1) == 1), F.struct(e["level"].alias("level"), (high - 1).alias("node")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(ends, of)), lambda n: n.isNotNull())


def as_of(asks: DataFrame, versions: DataFrame, key: str, time: str, event: str, arrival: str, expiry: str, tie: str, payload: list[str], bits: int = BITS) -> DataFrame:
    """The asks with `event`, `arrival`, `tie` and `payload` (a struct) of their version, null where there is none.

    Times are whole numbers of one unit. Null keys and times match nothing; versions with a null in event, arrival, expiry or
    tie, or that expire before they can be used, take no part. Repeated asks get the same answer each. Of versions of equal
    event, arrival and tie the one that expires last counts, of those that start and end alike the larger payload. Either
    side may be empty. Answers come back under names of their own, so columns of the asks called `event` and so on are kept
    and the answers' are nested in the struct `found`.
    """
    start = F.greatest(event, arrival)
    usable = versions.select(F.col(key).alias("k"), start.alias("start"), F.col(expiry).alias("expiry"), F.struct(F.col(event).alias("event"), F.col(arrival).alias("arrival"), F.col(tie).alias("tie"), F.struct(*payload).alias("payload")).alias("p"))
    usable = usable.where((F.col("start") < F.col("expiry")) & F.col("k").isNotNull() & F.col("p.tie").isNotNull() & F.col("p.event").isNotNull() & F.col("p.arrival").isNotNull())
    block = lambda c: F.shiftright(c, bits)
    best = usable.groupBy("k", "start", "expiry").agg(F.max("p").alias("p")).withColumns({"first": block("start"), "last": block(F.col("expiry") - 1)})
    best = stored(best, "versions")
    asked = stored(asks.select(F.col(key).alias("k"), F.col(time).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct().withColumn("block", block("t")), "asks")

    width = 1 << bits
    row = lambda b, t, e: F.struct(b.alias("block"), t.alias("time"), e.alias("expiry"))
    one = row(F.col("first"), F.col("start"), F.col("expiry"))
    two = row(F.col("last"), F.col("last") * width, F.col("expiry"))
    edges = best.select("k", "p", F.explode(F.when(F.col("first") == F.col("last"), F.array(one)).otherwise(F.array(one, two))).alias("r")).select("k", "r.*", "p")
    rows = edges.select("k", "block", "time", F.lit(False).alias("asks"), "expiry", "p.*")
    longest = best.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0
    if longest > 1:
        levels = max(0, (longest - 1).bit_length() - 1)
        covers = best.where("last - first > 1").select("k", "p", F.explode(nodes(F.col("first") + 1, F.col("last") - 1, levels)).alias("n")).groupBy("k", "n.level", "n.node").agg(F.max("p").alias("p"))
        cells = asked.select("k", "block").distinct().select("k", "block", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
        cells = cells.withColumn("node", F.call_function("shiftright", "block", "level"))
        floors = cells.hint("merge").join(covers, ["k", "level", "node"]).groupBy("k", "block").agg(F.max("p").alias("p"))
        rows = rows.unionByName(floors.select("k", "block", (F.col("block") * width).alias("time"), F.lit(False).alias("asks"), ((F.col("block") + 1) * width).alias("expiry"), "p.*"))
    none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name in ("expiry", "event", "arrival", "tie", "payload")}
    rows = rows.unionByName(asked.select("k", "block", F.col("t").alias("time"), F.lit(True).alias("asks"), *[c.alias(n) for n, c in none.items()]))
    laid = rows.repartition("k", "block").sortWithinPartitions("k", "block", "time", "asks", "event", "arrival", "tie", "expiry")
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField("k", kinds["k"]), T.StructField("t", T.LongType()), *(T.StructField(c, kinds[c]) for c in ("event", "arrival", "tie", "payload"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    order = ["k", "block", "time", "asks", "expiry", "event", "arrival", "tie", "payload"]
    answers = laid.select(*order).mapInArrow(sweep(to_arrow_schema(out)), out)
    answers = answers.select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.struct("event", "arrival", "tie", "payload").alias("found"))
    return asks.join(answers.hint("merge"), (asks[key] == F.col("_k")) & (asks[time] == F.col("_t")), "left").drop("_k", "_t")
