"""Removal of repeated word windows by level-wise doubling.

Level 1 compares windows of a quarter of the width, one for each anchor (see windows.py); only what is repeated there is
extended to half the width, and only what is repeated there to the full width. Levels are equi-aggregations on hashes, so
one very common passage is pre-aggregated and never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import list_array_of, list_parts, segment_sum, stored, sub_batches, texts_of, words_of
from textweave.llm.windows import HASHED_BYTES, Hashes, covered, keyed, shared_anchors, spread_join, with_rows, word_units

WIDTH = 50
RANGES = "array<struct<first:int,n:int>>"


def halves(docs: DataFrame, wanted: DataFrame, width: int, half: int) -> DataFrame:
    """(key, ctx, low, h, first, windows): each wanted stretch as two or more nodes.

    A node is a run of windows that all hold one stretch of `half` words, at a fixed place from the anchor; h is its hash.
    """
    lists = stored(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "ctx", "first", "n", "low", "back")).alias("want")), "wanted")
    joined = with_rows(docs, lists, "inner").dropDuplicates(["doc_id", "th"]).select("text", "want")
    step = width - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, limit=HASHED_BYTES):
                values, offsets = word_units(texts_of(batch))
                hashes = Hashes(values)
                want, at = list_parts(batch.column(1))
                key, ctx, first, n, low, back = (want.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                begin = offsets[np.repeat(np.arange(batch.num_rows), np.diff(at))] + first
                # Nodes are counted back from the anchor, so equal windows of different stretches fall into equal nodes.
                ahead = np.repeat(back, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                stretch = np.repeat(np.arange(len(n)), n)
                node = ahead // step
                head = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (stretch[1:] != stretch[:-1])) if len(node) else np.zeros(0, bool))
                row, size = stretch[head], np.diff(np.append(head, len(node)))
                start = back[row] - ahead[head]
                h = hashes.of(begin[row] + back[row] - node[head] * step, half)
                place = begin[stretch] + np.repeat(back, n) - ahead
                windows = list_array_of(pa.array(hashes.of(place, width).view(np.int64)), np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(ctx[row]), pa.array(low[row].astype(np.int64)), pa.array(h.view(np.int64)), pa.array(start.astype(np.int32)), windows], ["key", "ctx", "low", "h", "first", "windows"])

    return joined.mapInArrow(run, "key long, ctx long, low long, h long, first int, windows array<long>")


def repeated_runs(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, runs): for each text, its runs of windows that also start in a document of smaller id."""
    quarter, half = -(-width // 4), -(-width // 2)
    rank = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    # Level 1: quarter windows that more than one document holds, in more than one surrounding.
    anchors = shared_anchors(docs, word_units, width, quarter, F.col("a") < F.col("b"), F.min(rank).alias("a"), F.max(rank).alias("b"))
    stretches = stored(anchors.groupBy("key", "ctx").agg(F.count("*").alias("times"), F.min(rank).alias("low"), F.max(rank).alias("high"), F.min(F.struct(rank.alias("r"), "doc_id", "th", "first", "n", "back")).alias("one")), "stretches")
    groups = stored(stretches.groupBy("key").agg(F.count("*").alias("m"), F.min("low").alias("a"), F.max("low").alias("b")).where("m > 1 AND a < b").select("key", "m"), "groups")
    wanted = spread_join(stretches, groups, ["key"], "m").select("one.doc_id", "one.th", "one.first", "one.n", "one.back", "key", "ctx", "low")
    # Level 2: half windows; level 3: whole windows of the nodes that survive.
    nodes = stored(halves(docs, wanted, width, half), "nodes")
    alike = nodes.groupBy("key", "h").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("key", "h")
    windows = nodes.join(alike, ["key", "h"]).select("key", "ctx", "low", "first", F.posexplode("windows").alias("k", "w"))
    least = windows.groupBy("key", "w").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("key", "w", "a")
    place = F.struct((F.col("first") + F.col("k")).cast("int").alias("first"), F.lit(1).alias("n"))
    parts = windows.join(least, ["key", "w"]).where("low > a").groupBy("key", "ctx").agg(F.collect_list(place).alias("ranges"))
    # Documents other than the least that holds a stretch lose all its windows; the least loses those found at level 3.
    marks = stretches.join(parts, ["key", "ctx"], "left").where("low < high OR ranges IS NOT NULL").select("key", "ctx", "low", "times", F.col("ranges").cast(RANGES).alias("ranges"))
    own = F.when(rank > F.col("low"), F.array(F.struct("first", "n"))).otherwise(F.transform("ranges", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), r["n"].alias("n"))))
    hits = spread_join(anchors, stored(marks, "marks"), ["key", "ctx"], "times").select("doc_id", "th", own.cast(RANGES).alias("r")).where("r IS NOT NULL")
    return hits.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("r")).alias("runs"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) for every row; other columns are ignored. Ids are whole numbers.

    Null is the empty text; texts of fewer than `width` words lose nothing. Rows of one id do not remove each other's
    words. A null id counts as below all others. Repeated rows get the same result each; no rows give none.
    """
    docs = keyed(docs, id_col, text_col)
    runs = stored(repeated_runs(docs, width), "runs")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for whole in batches:
            for batch in sub_batches(whole):
                codes, offsets, words = words_of(texts_of(batch))
                gone = np.zeros(len(codes), bool)
                for i, pairs in enumerate(batch.column(2)):
                    if pairs.is_valid:
                        gone[offsets[i] : offsets[i + 1]] = covered(int(offsets[i + 1] - offsets[i]), pairs.values.field(0).to_numpy().astype(np.int64), pairs.values.field(1).to_numpy().astype(np.int64), width)
                at = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept = pc.binary_join(list_array_of(words.take(pa.array(codes[~gone])), at), " ")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(segment_sum(gone, offsets)), kept], schema.names)

    return with_rows(docs, runs, "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
