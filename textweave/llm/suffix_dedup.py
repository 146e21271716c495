"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Anchors bring together the stretches that can share a window of `width` bytes (see windows.py). Each block of such
stretches gets a suffix array and its transform; starting from the boundaries between first bytes, a breadth-first
backward extension finds the boundaries of common prefix 1, 2, 3, ... and stops at `width`: suffixes that no boundary
has parted by then share `width` bytes or more.

A group of one anchor that is larger than a block is dealt over several blocks by its stretches' contexts. Each of them
is transformed like any other; then the first window of every class of equal windows in a block is compared, by hash,
with those of the group's other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.apart import columns_apart
from textweave.llm.common import column, list_parts, mix64, stored, string_bytes, sub_batches, texts_of
from textweave.llm.windows import HASHED_BYTES, Hashes, byte_units, covered, keyed, shared_anchors, spread_join, with_rows

WIDTH, GRAM = 400, 160
#: Bytes of stretches in one transform: its arrays stay within a processor's cache.
BLOCK_BYTES = 1 << 18
#: Distinct stretches of one anchor in a block; larger groups are dealt over several.
GROUP_STRETCHES = 1024
#: Distinct stretches that one task transforms.
TASK_STRETCHES = 20_000


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 ends a stretch; suffixes that equal to their end are in any order.

    ends: for each position, that of the 0 after it. Only suffixes that are not yet alone in their class are sorted again.
    """
    n = len(symbols)
    places = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 8) | np.where(places + k <= ends, symbols[np.minimum(places + k, n - 1)], 0)
    # UTF-8 has no byte above 0xF7, so symbols (bytes plus one) fit eight bits.
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    depth, longest = 7, int((ends - places).max()) + 1
    while depth < longest:
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        at = order[rows]
        after = np.where(at + depth <= ends[at], rank[np.minimum(at + depth, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + after
        again = np.argsort(both)
        at, both = at[again], both[again]
        order[rows] = at
        fresh = np.append(True, both[1:] != both[:-1])
        new[rows] |= fresh
        rank[order] = np.maximum.accumulate(np.where(new, places, 0))
        depth *= 2
    return order


def repeated_suffixes(symbols: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in order, whose next `width` symbols also start elsewhere in the block, and a number for each class of equals."""
    n = len(symbols)
    order = suffix_order(symbols, ends)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Backward step of each suffix in order; a stretch's first position has none.
    step = np.where((order > 0) & (symbols[order - 1] != 0), place[order - 1], -1)
    ahead = np.where(symbols[order] != 0, place[np.minimum(order + 1, n - 1)], -1)
    first = symbols[order]
    unset = np.ones(n + 1, bool)
    fresh = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    unset[fresh] = unset[n] = False
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for length in range(width):
        # Intervals of common prefix `length`, each cut by the fresh boundaries into pieces.
        cuts = fresh[fresh > 0]
        if not len(cuts):
            break
        parent = np.searchsorted(low, cuts, "right") - 1
        split = parent[np.append(True, parent[1:] != parent[:-1])]
        starts = np.sort(np.concatenate([cuts, low[split]]))
        owner = np.searchsorted(low[split], starts, "right") - 1
        stops = np.where(np.append(owner[1:] == owner[:-1], False), np.append(starts[1:], 0), high[split][owner])
        size = stops - starts
        # All pieces but the largest of each interval are walked: n log n steps over all lengths.
        by_size = np.lexsort((-size, owner))
        largest = by_size[np.append(True, owner[by_size[1:]] != owner[by_size[:-1]])]
        walk = np.ones(len(starts), bool)
        walk[largest] = False
        a, b = starts[walk], stops[walk]
        piece = np.repeat(np.arange(len(a)), b - a)
        element = np.arange(len(piece)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[piece]
        target = step[element]
        piece, target = piece[target >= 0], target[target >= 0]
        before, behind = target - 1, np.minimum(target + 1, n - 1)
        left = (target > 0) & (first[before] == first[target]) & (ahead[before] < a[piece])
        right = (target + 1 < n) & (first[behind] == first[target]) & (ahead[behind] >= b[piece])
        found = np.concatenate([target[left], target[right] + 1])
        found = np.sort(found[unset[found]])
        fresh = found[np.append(True, found[1:] != found[:-1])[: len(found)]]
        unset[fresh] = False
        more = size > 1
        keep = np.ones(len(low), bool)
        keep[split] = False
        low, high = np.concatenate([low[keep], starts[more]]), np.concatenate([high[keep], stops[more]])
        by = np.argsort(low, kind="stable")
        low, high = low[by], high[by]
        inside = np.searchsorted(low, fresh, "right") - 1
        fresh = fresh[(inside >= 0) & (fresh < high[np.maximum(inside, 0)])] if len(low) else fresh[:0]
    count = high - low
    together = order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    kind = np.repeat(low, count)
    whole = np.flatnonzero(ends[together] - together >= width)
    whole = whole[np.argsort(together[whole])]
    return together[whole], kind[whole]


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and sizes of the maximal runs in sorted places."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.append(True, places[1:] != places[:-1] + 1))
    return places[cut], np.diff(np.append(cut, len(places)))


RANGES = "array<struct<first:int,n:int>>"
FOUND = f"key long, ctx long, ranges {RANGES}, windows array<struct<at:int,w:bigint>>"


def struct_lists(offsets: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


def block_ranges(width: int):
    """Takes (key, part, many, ctx, bytes) sorted by key and part; yields FOUND, whole parts to a block.

    ranges are the windows repeated in the block; windows, for groups of many parts, the first of each class of equals.
    """

    def solve(manys: np.ndarray, keys: np.ndarray, ctxs: np.ndarray, stretches: list[bytes]) -> pa.RecordBatch:
        size = np.array([len(s) for s in stretches])
        starts = np.concatenate([[0], np.cumsum(size + 1)])
        symbols = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[starts[1:] - 1] = 0
        ends = np.repeat(starts[1:] - 1, size + 1)
        places, kind = repeated_suffixes(symbols, ends, width)
        first, n = runs_of(places)
        owner = np.searchsorted(starts, first, "right") - 1
        at = np.searchsorted(owner, np.arange(len(keys) + 1))
        ranges = struct_lists(at, first=(first - starts[owner]).astype(np.int32), n=n.astype(np.int32))
        later = np.ones(len(places), bool)
        later[np.unique(kind, return_index=True)[1]] = False  # places are in order, so these are the first of each class
        alone = ends - np.arange(len(symbols)) >= width
        alone[places[later]] = False
        alone &= np.repeat(manys, size + 1)
        some = np.flatnonzero(alone)
        owner = np.searchsorted(starts, some, "right") - 1
        w = Hashes(mix64(np.arange(257, dtype=np.uint64))[symbols]).of(some, width).view(np.int64) if len(some) else np.zeros(0, np.int64)
        windows = struct_lists(np.searchsorted(owner, np.arange(len(keys) + 1)), at=(some - starts[owner]).astype(np.int32), w=w)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ctxs), ranges, windows], ["key", "ctx", "ranges", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None

        def done() -> pa.RecordBatch:
            keys, manys, ctxs, stretches = zip(*rows, strict=True)
            return solve(np.array(manys), np.array(keys), np.array(ctxs), list(stretches))

        for batch in batches:
            for key, part, many, ctx, stretch in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held > BLOCK_BYTES and (key, part) != last:
                    yield done()
                    rows, held = [], 0
                rows.append((key, many, ctx, stretch))
                held += len(stretch)
                last = (key, part)
        if rows:
            yield done()

    return run


def stretches_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, part, many, ctx, bytes): the bytes of wanted stretches."""
    lists = stored(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "part", "many", "ctx", "first", "n")).alias("want")), "wanted")
    joined = with_rows(docs, lists, "inner").dropDuplicates(["doc_id", "th"]).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, limit=HASHED_BYTES):
                raw, offsets = string_bytes(texts_of(batch))
                want, at = list_parts(batch.column(1))
                first, n = (want.field(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                begin = offsets[np.repeat(np.arange(batch.num_rows), np.diff(at))] + first
                parts = pa.array([raw[a : a + m + width - 1].tobytes() for a, m in zip(begin.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(want.field(i) for i in range(4)), parts], ["key", "part", "many", "ctx", "bytes"])

    return joined.mapInArrow(run, "key long, part int, many boolean, ctx long, bytes binary")


def repeated_runs(docs: DataFrame, width: int, gram: int, group_stretches: int) -> DataFrame:
    """(doc_id, th, runs): for each text with repeats, its runs of windows that also start elsewhere."""
    anchors = shared_anchors(docs, byte_units, width, gram, F.col("rows") > 1)
    stretches = stored(anchors.groupBy("key", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "first", "n")).alias("one")), "stretches")
    groups = stored(stretches.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    # A stretch that occurs twice is repeated as a whole, but others may share some of its windows.
    parts = F.ceil(F.col("m") / group_stretches).cast("int")
    part = F.pmod(F.xxhash64("ctx"), parts).cast("int")
    wanted = spread_join(stretches, groups, ["key"], "m").select("one.*", "key", "ctx", part.alias("part"), (parts > 1).alias("many"))
    found = stored(stretches_of(docs, wanted, width), "stretch_bytes")
    dealt = found.repartition(max(1, -(-found.count() // TASK_STRETCHES)), "key", "part").sortWithinPartitions("key", "part", "ctx")
    blocks = stored(dealt.mapInArrow(block_ranges(width), FOUND), "blocks")
    # Windows that the parts of a large group have in common: the parts were transformed, their classes meet by hash.
    windows = blocks.where(F.size("windows") > 0).select("key", "ctx", F.inline("windows"))
    twice = windows.groupBy("key", "w").agg(F.count("*").alias("c")).where("c > 1").select("key", "w")
    across = windows.join(twice, ["key", "w"]).groupBy("key", "ctx").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.lit(1).alias("n"))).cast(RANGES).alias("ranges"))
    inside = blocks.where(F.size("ranges") > 0).select("key", "ctx", "ranges")
    none = F.expr(f"cast(array() as {RANGES})").alias("ranges")
    full = stretches.where("times > 1").select("key", "ctx", none, "times")
    rows = inside.unionByName(across).withColumn("times", F.lit(1).cast("long")).unionByName(full)
    marks = stored(rows.groupBy("key", "ctx").agg(F.max("times").alias("times"), F.flatten(F.collect_list("ranges")).alias("ranges")), "marks")
    hits = spread_join(anchors, marks, ["key", "ctx"], "times")
    own = F.when(F.col("times") > 1, F.array(F.struct("first", "n"))).otherwise(F.transform("ranges", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), r["n"].alias("n"))))
    return hits.select("doc_id", "th", own.cast(RANGES).alias("r")).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("r")).alias("runs"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_stretches: int = GROUP_STRETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row; other columns are ignored.

    Null is the empty text; texts shorter than `width` lose nothing. Repeated rows and rows of one id are documents of
    their own, so exact copies of `width` bytes or more lose all of them. Null ids are kept; no rows give none.
    """
    docs = keyed(docs, id_col, text_col)
    runs = stored(repeated_runs(docs, width, gram, group_stretches), "runs")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                texts = texts_of(batch)
                raw, offsets = string_bytes(texts)
                out = []
                for i, pairs in enumerate(batch.column(2)):
                    own = raw[offsets[i] : offsets[i + 1]]
                    if not pairs.is_valid:
                        out.append((len(own), 0, 0, own.tobytes()))
                        continue
                    gone = covered(len(own), pairs.values.field(0).to_numpy().astype(np.int64), pairs.values.field(1).to_numpy().astype(np.int64), width)
                    out.append((len(own), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), own[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:3]), pa.array([o[3] for o in out], pa.binary())], schema.names)

    return with_rows(docs, runs, "left").select("doc_id", "text", "runs").mapInArrow(run, schema)


@columns_apart
def cleaned(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_stretches: int = GROUP_STRETCHES) -> DataFrame:
    """The documents with all their columns, repeated bytes taken out of `text` and `n_chars` brought up to date.

    What a cut leaves of a character goes too. Null texts stay null; other rules as in remove_repeats().
    """
    runs = stored(repeated_runs(keyed(docs), width, gram, group_stretches), "runs").withColumnRenamed("runs", "_runs")
    joined = with_rows(docs, runs, "left", docs.columns).select(*docs.columns, "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                names = batch.schema.names
                texts = column(batch, "text").to_pylist()
                for i, pairs in enumerate(column(batch, "_runs")):
                    if pairs.is_valid and texts[i] is not None:
                        raw = np.frombuffer(texts[i].encode(), np.uint8)
                        gone = covered(len(raw), pairs.values.field(0).to_numpy().astype(np.int64), pairs.values.field(1).to_numpy().astype(np.int64), width)
                        texts[i] = raw[~gone].tobytes().decode(errors="ignore")
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names[:-1])], names[:-1])

    return joined.mapInArrow(run, docs.schema)
