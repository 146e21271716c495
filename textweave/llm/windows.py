"""Anchored windows: the part that exact repeat removal over bytes and over words have in common.

Every window of `width` units designates one anchor, the k-gram of least hash inside it. The choice depends on the
window's content alone, so equal windows designate equal anchors at equal places. Windows are thus compared only within
the group of one anchor, and the runs of windows that share an anchor are described by one row instead of one for each
window: its context is the stretch of units that those windows cover.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import BROADCAST_ROWS, mix64, stored, string_bytes, sub_batches, texts_of, word_hashes, words_of

BASE = np.uint64(0x9FB21C651E98DF25)
#: Low bits of a packed minimum that hold its place, and the gram starts that are packed at once.
PLACE_BITS, PACKED = 28, 1 << 20


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)]) for b in (BASE, inverse))


class Hashes:
    """Hashes of any stretch of a unit sequence in constant time each."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(1 << max(16, int(len(values)).bit_length()))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.down[start])


def byte_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash value for each byte, and the texts' offsets."""
    raw, offsets = string_bytes(texts)
    return mix64(np.arange(1, 257, dtype=np.uint64))[raw], offsets


def word_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, words = words_of(texts)
    return (word_hashes(words) if len(words) else np.zeros(0, np.uint64))[codes], offsets


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of `span` values: prefix and suffix minima of blocks of that size."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def anchored(values: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, and for each run of windows with one anchor: text, first window, number of windows, the anchor's hash and place."""
    none = np.zeros(0, np.int64)
    hashes = Hashes(values)
    n, span = len(values), width - gram + 1
    if n < width:
        return hashes, none, none, none, none.astype(np.uint64), none
    grams = hashes.of(np.arange(n - gram + 1), gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = np.empty(n - width + 1, np.int64)
    for at in range(0, len(anchor), PACKED):
        # The first least gram of each window, whatever the slice it is in.
        own = grams[at : at + PACKED + span - 1]
        anchor[at : at + PACKED] = (sliding_min((own & ~low) | np.arange(len(own), dtype=np.uint64), span) & low).astype(np.int64) + at
    size = np.diff(offsets)
    long = np.flatnonzero(size >= width)
    if not len(long):
        return hashes, none, none, none, none.astype(np.uint64), none
    count = size[long] - width + 1
    text = np.repeat(long, count)
    window = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[text]
    chosen = anchor[window]
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    return hashes, text[first], window[first], np.diff(np.append(first, len(text))), grams[chosen[first]], chosen[first]


#: Bytes of text whose arrays of hashes are in memory at once.
HASHED_BYTES = 1 << 19


def anchor_rows(docs: DataFrame, units: Callable, width: int, gram: int) -> DataFrame:
    """(doc_id, th, key, ctx, first, n, back): one row for each run of windows, its anchor `back` units after its first.

    th tells texts of one id apart.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("th", "key", "ctx")), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("back", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, limit=HASHED_BYTES):
                values, offsets = units(texts_of(batch))
                hashes, text, first, n, key, place = anchored(values, offsets, width, gram)
                size = n + (width - 1)
                ctx = mix64(hashes.of(first, size) ^ mix64(size.astype(np.uint64)))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array((first - offsets[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((place - first).astype(np.int32))],
                    schema.names,
                )

    return docs.select("doc_id", "text", text_hash().alias("th")).mapInArrow(run, schema)


def text_hash() -> Column:
    return F.xxhash64("text")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null id is kept as null, and compares as below all others."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


#: Keys of more rows than HOT_ROWS, and than a HOT_KEYS-th of all rows, so that they are HOT_KEYS at most, are broadcast.
HOT_ROWS, HOT_KEYS = 10_000, 10_000


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], times: str) -> DataFrame:
    """Inner join of stored rows to a stored side of one row a key; `times` is the key's number of rows, or a bound above it.

    Rows of very common keys stay where they are and meet their key by a broadcast, so no task gets all of them. A row of
    the side holds a stretch's runs at most (2 KB), so 20 MB are broadcast at most.
    """
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = side.where(F.col(times) > least)
    if not hot.limit(1).count():
        return rows.join(side, on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(side.where(F.col(times) <= least), on)
    return rows.join(F.broadcast(hot), on).unionByName(others)


def shared_anchors(docs: DataFrame, units: Callable, width: int, gram: int, test: Column, *aggregates: Column) -> DataFrame:
    """The anchor rows of those keys whose aggregates, or `rows`, pass a test; the others cannot hold a repeat.

    Keys are pre-aggregated by each task before they are shuffled, so a very common one costs a row for each task.
    """
    anchors = stored(anchor_rows(docs, units, width, gram), "anchors")
    keys = stored(anchors.groupBy("key").agg(F.count("*").alias("rows"), *aggregates).where(test).select("key", "rows"), "keys")
    return stored(spread_join(anchors, keys, ["key"], "rows").drop("rows"), "shared_anchors")


def with_rows(docs: DataFrame, rows: DataFrame, how: str, columns: list[str] | None = None) -> DataFrame:
    """Joins a stored table of rows for (doc_id, th) to the documents; null ids meet null ids.

    While the ids are few enough to broadcast, only texts that have rows are shuffled.
    """
    columns = columns or ["doc_id", "text"]
    left = docs.select(*columns, text_hash().alias("th"))
    right = rows.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    on = left.doc_id.eqNullSafe(right["_d"]) & (left.th == right["_t"])
    if rows.count() > BROADCAST_ROWS:
        return left.join(right, on, how).drop("_d", "_t")
    ids = F.broadcast(rows.select(F.col("doc_id").alias("_i"), F.col("th").alias("_h")))
    match = left.doc_id.eqNullSafe(ids["_i"]) & (left.th == ids["_h"])
    some = left.join(ids, match, "left_semi").join(right, on, how).drop("_d", "_t")
    if how != "left":
        return some
    rest = left.join(ids, match, "left_anti")
    return some.unionByName(rest, allowMissingColumns=True)


def covered(n_units: int, firsts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Which units lie in a window of the given runs (first window, number of windows)."""
    edge = np.zeros(n_units + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, firsts + counts + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0
