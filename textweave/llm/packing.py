"""Best-fit packing of token pieces by bound-certified repacking.

Every partition packs its pieces by best-fit decreasing and certifies its bin count with dual-feasible-function lower
bounds. Partitions above their bound, and the emptiest bin of the others, give documents up; those are dealt anew over
fewer partitions and packed again, as long as that saves bins. Memory stays that of one partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.bpe import tokenizer
from textweave.llm.common import stored, sub_batches, texts_of

#: Pieces that one task packs, half a million at most (sequence ids have 20 bits for a task's own); partitions are as many
#: as that needs, whatever the input's size.
PIECES_PER_TASK = 200_000


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids, the separator, cut every `capacity` ids.

    A null or empty text is the separator alone. Null ids and repeated rows keep their own pieces; no rows give none.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for batch in sub_batches(whole, limit=12 << 20):
                ids, offsets = bpe.encode(texts_of(batch))
                n = batch.num_rows
                ends = offsets[1:] + np.arange(1, n + 1)
                flat = np.full(ends[-1], separator, "<u4")
                flat[np.delete(np.arange(ends[-1]), ends - 1)] = ids
                begins = np.concatenate([[0], ends[:-1]])
                count = -(-(ends - begins) // capacity)
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begins)[row] - start)
                data, at = flat.tobytes(), (begins[row] + start) * 4
                crc = [zlib.crc32(memoryview(data)[a : a + 4 * m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions over the histogram of sizes."""
    x = np.arange(capacity + 1)
    count = np.bincount(sizes, minlength=capacity + 1)
    used = x[count > 0]
    count = count[used]
    best = -(-int(used @ count) // capacity)
    half = capacity // 2
    # Large items count as a whole bin, small ones not at all (thresholds e), the others by their size.
    n_at = lambda lo, hi: count[(used > lo) & (used <= hi)]
    for e in np.unique(np.minimum(used[used <= half], half)).tolist():
        large = int(n_at(capacity - e, capacity).sum())
        middle = (used >= e) & (used <= capacity - e)
        best = max(best, large + -(-int(used[middle] @ count[middle]) // capacity))
    for k in range(1, 41):
        whole = (used * (k + 1)) % capacity == 0
        # In units of 1 / (k * capacity): exact integers.
        value = np.where(whole, used * k, used * (k + 1) // capacity * capacity)
        best = max(best, -(-int(value @ count) // (k * capacity)))
    for e in np.unique(used[used <= half]).tolist():
        parts = capacity // e
        value = np.where(2 * used > capacity, 2 * (parts - (capacity - used) // e), np.where(2 * used == capacity, parts, 2 * (used // e)))
        best = max(best, -(-int(value @ count) // (2 * parts)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Bins lie in stacks by free space; a bit set finds the tightest that fits."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            stacks[left].append(b)
            free |= 1 << left
    return bins, offsets


def packer(capacity: int, step: int) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition, with its bins and the bound that certifies them; `again` marks pieces of bins to give up."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        table = table.drop_columns(["_part"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_row", "ascending")])
        sizes = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(sizes, capacity)
        again = fill < capacity if len(fill) > bound else np.zeros(len(fill), bool)
        again[np.argmin(fill)] = fill.min() < capacity
        of = lambda n: pa.array(np.full(len(sizes), n, np.int64))
        more = {"sequence_id": pa.array((step << 48) | (part << 20) | bins), "offset": pa.array(offsets), "again": pa.array(again[bins]), "bins": of(len(fill)), "bound": of(bound)}
        for name, values in more.items():
            table = table.append_column(name, values)
        return table

    return run


def pack(pieces: DataFrame, capacity: int = 2048, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to `pieces`, packed_in (the exchange that fixed the place), and bins and bound: the
    sequences of the partition that packed the piece, and the fewest that any packing of it can have.

    Ties in length go by doc_id, then piece. Full pieces take a sequence of their own without packing. Exchanges go on
    while one saves a sequence; every piece keeps the last place it got.
    """
    names = pieces.columns
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    one = F.lit(1).cast("long")
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("packed_in"), one.alias("bins"), one.alias("bound"))
    pool = pieces.where(F.col("length") < capacity)
    n = pool.count()
    out = [full]
    schema = T.StructType([*pool.schema.fields, *(T.StructField(c, T.BooleanType() if c == "again" else T.LongType()) for c in ("sequence_id", "offset", "again", "bins", "bound"))])
    step, given_up = 0, None
    while True:
        parts = max(1, -(-n // pieces_per_task))
        keyed = pool.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(step)), F.lit(parts)))
        if n:
            keyed = keyed.repartition(min(parts, 100_000), "_part")
        done = stored(keyed.groupBy("_part").applyInArrow(packer(capacity, step), schema), f"packed{step}")
        first = F.col("offset") == 0  # one piece of each sequence
        count = done.agg(F.count_if(first).alias("bins"), F.count_if(first & F.col("again")).alias("again"), F.count_if("again").alias("n")).first()
        # One partition has nobody to exchange with; a round that saved nothing is the last.
        last = parts == 1 or not count.n or (given_up is not None and count.bins >= given_up)
        out.append((done if last else done.where(~F.col("again"))).select(*names, "sequence_id", "offset", F.lit(step).alias("packed_in"), "bins", "bound"))
        if last:
            break
        pool, n, given_up, step = done.where("again").drop("sequence_id", "offset", "again", "bins", "bound"), count.n, count.again, step + 1
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; see token_pieces() and pack()."""
    return pack(token_pieces(docs, path, capacity), capacity)
