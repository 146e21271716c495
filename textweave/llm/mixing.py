"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Targets: sources in code-point order, null last, weigh `WEIGHTS` in turn and share a multiple of all words; a target stops at
CAP times its source's size and the excess goes to the others by weight (water filling, in whole numbers). Words are dealt
as blocks of equal size: sources get blocks by the highest quotients target / (2 k + 1), and so do the shards of a source by
quotients of their size. Inside a shard, documents lie in the order of a seeded hash; its blocks are taken in whole passes,
and those of the last, broken pass are a run that starts at a seeded block and goes round.

A shard has about SHARD_WORDS words and SHARD_DOCS documents, whatever its source has, so a source of a third of all rows is
many shards. Of the quotients, only those that can lie near the last awarded one are listed: two or three for each party.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.llm.common import small_side, stored
from textweave.operators.ordering import positions, running

WEIGHTS = (5, 2, 1)
#: The mix has SHARE[0] / SHARE[1] times the words of all sources; a document is taken CAP times at most.
SHARE, CAP = (3, 2), 2
#: Words of a block; a source's taken words are off its target by less than about one block a shard.
BLOCK = 8
SHARD_WORDS, SHARD_DOCS = 1 << 18, 1024


def exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def seeded(seed: int, *parts: Column) -> Column:
    """Hexadecimal digits that the seed and the parts fix."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed))))


def number(digits: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, place, weight, target) of (source, source_size, n_docs).

    In rising order of size / weight, a source is at its limit if its limit is at most its part of what the sources before
    leave; each row decides this from sums over the rows before it.
    """
    placed = positions(sources, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int")).cast("long")
    placed = placed.withColumn("weight", weight).withColumn("_cap", cap * F.col("source_size"))
    many = math.lcm(*weights)
    ordered = placed.withColumn("_ratio", exact(F.col("source_size")) * F.expr(f"{many} div weight"))
    before = stored(running(ordered, [], ["_ratio", "place"], _caps="_cap", _weights="weight"), "filled")
    total = before.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    size, every = total.s or 0, total.w or 0
    up, down = share
    at_limit = exact(F.col("_cap")) * exact(down * (F.lit(every) - F.col("_weights"))) <= exact(F.col("weight")) * exact(F.lit(up * size) - down * F.col("_caps"))
    full = before.where(at_limit).agg(F.sum("_cap").alias("c"), F.sum("weight").alias("w")).first()
    left, free = up * size - down * (full.c or 0), down * (every - (full.w or 0))
    part = F.lit(float(left)) * F.col("weight") / F.lit(float(free)) if free else F.col("_cap").cast("double")
    return before.withColumn("target", F.when(at_limit, F.col("_cap").cast("double")).otherwise(part)).drop("_cap", "_ratio", "_caps", "_weights")


def apportion(parties: DataFrame, key: str, party: str, votes: str, seats: str) -> DataFrame:
    """The parties with `quota`: `seats` of their key dealt by the highest quotients votes / (2 k + 1), ties to the lesser party.

    With n parties and v votes the last of s quotients lies between v / (2 s + n) and v / (2 s - n): what is above is
    awarded, what is below is not, and the quotients between, about two a party, are ranked by ranges.
    """
    v = F.col(votes).cast("double")
    sums = parties.where(v > 0).groupBy(key).agg(F.sum(v).alias("_v"), F.count("*").alias("_n"))
    sums = stored(sums, "votes")
    known = parties.where(v > 0).join(small_side(sums, sums.count()), key)
    count = lambda q: F.floor((v / q + 1) / 2).cast("long")
    high = F.when(2 * F.col(seats) > F.col("_n"), F.greatest(F.lit(0), count(F.col("_v") / (2 * F.col(seats) - F.col("_n"))) - 1)).otherwise(F.lit(0).cast("long"))
    low = count(F.col("_v") / (2 * F.col(seats) + F.col("_n"))) + 1
    known = stored(known.select(*parties.columns, high.alias("_sure"), low.alias("_most")), "parties")
    sure = stored(known.groupBy(key).agg(F.sum("_sure").alias("_given")), "given")
    near = known.select(key, party, F.col(seats).alias("_s"), v.alias("_p"), F.explode(F.sequence(F.col("_sure"), F.col("_most"))).alias("_k"))
    ranked = positions(near.withColumn("_q", F.col("_p") / (2 * F.col("_k") + 1)), [key], [F.desc("_q"), party, "_k"], "_rank")
    won = ranked.join(small_side(sure, sure.count()), key).where(F.col("_rank") < F.col("_s") - F.col("_given")).groupBy(key, party).agg(F.count("*").alias("_won"))
    both = known.join(won, [key, party], "left").select(*parties.columns, (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).alias("quota"))
    return both.unionByName(parties.where(~F.coalesce(v > 0, F.lit(False))).withColumn("quota", F.lit(0).cast("long")))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length of the common part of [a, b) and [c, d)."""
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0).cast("long"))


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, shard, start, taken): a row for each row of docs.

    A word is [^\\x20\\x09-\\x0D]+; a null text has none. A null source is a source of its own, a null id is an id like
    others. Repeated rows are documents of their own: rows alike in id, source and size may swap their places. An empty table
    gives no rows; sources without words have target 0. Other columns take no part.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size")), "sized")
    # stored
    sources = targets(stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources"))
    total = sources.agg(F.sum("source_size").alias("s")).first().s or 0
    seats = (2 * SHARE[0] * total + SHARE[1] * block) // (2 * SHARE[1] * block)
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / shard_docs)).cast("long")
    dealt = stored(apportion(sources.withColumns({"_g": F.lit(0), "_seats": F.lit(seats)}), "_g", "place", "target", "_seats").select("source", "source_size", "n_docs", "place", "target", F.col("quota").alias("blocks"), n_shards.alias("n_shards")), "quotas")
    side = small_side(dealt.withColumnRenamed("source", "_source"), dealt.count())
    placed = sized.join(side, sized.source.eqNullSafe(side["_source"])).drop("_source").withColumn("h", seeded(seed, F.col("doc_id")))
    placed = placed.withColumn("shard", F.pmod(number(F.col("h")), F.col("n_shards")))
    shards = stored(placed.groupBy("place", "shard", "blocks").agg(F.sum("size").alias("words")), "shards")
    quotas = apportion(shards, "place", "shard", "words", "blocks").select("place", "shard", "words", "quota")
    # A shard's blocks: whole passes, then a run of `run` blocks from a seeded one, out of `full` whole blocks.
    words = F.col("words")
    want = F.least(F.col("quota") * block, CAP * words)
    passes = F.coalesce(F.expr(f"least(quota * {block}, {CAP} * words) div nullif(words, 0)"), F.lit(0).cast("long"))
    full = F.expr(f"words div {block}")
    run = F.least(full, F.expr(f"(want - passes * words + {block // 2}) div {block}"))
    first = F.when(F.col("full") > 0, F.pmod(number(seeded(seed, F.col("place"), F.col("shard"))), F.col("full"))).otherwise(F.lit(0).cast("long"))
    quotas = quotas.withColumn("want", want).withColumn("passes", passes).withColumns({"full": full, "run": run}).withColumn("first", first)
    w = Window.partitionBy("place", "shard").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.join(quotas.hint("merge"), ["place", "shard"]).withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    a, b = F.col("start"), F.col("start") + F.col("size")
    left, right = F.col("first") * block, (F.col("first") + F.col("run")) * block
    end = F.col("full") * block
    chosen = overlap(a, b, left, F.least(right, end)) + overlap(a, b, F.lit(0).cast("long"), right - end)
    return laid.select("doc_id", "size", "source", "source_size", "target", "shard", "start", (F.col("passes") * F.col("size") + chosen).alias("taken"))
