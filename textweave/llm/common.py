"""Helpers shared by the training-data operators: shared storage, word splitting, ragged arrays."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; bounds its working memory.
CHUNK_BYTES = 6 << 20
#: Rows up to which an id list may be broadcast (16 bytes a row: 16 MB at most).
BROADCAST_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine (as in tests) gets a folder of its own; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark's own clean-up of a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts lineage and survives lost executors.

    The shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Marks a side for broadcast only if its counted rows are within BROADCAST_ROWS; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sub_batches(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most `limit` bytes of text each (one row may exceed it)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < n:
        before = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    let_go()


@functools.lru_cache(maxsize=1)
def c_library() -> ctypes.CDLL | None:
    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") else None


def let_go() -> None:
    """Gives memory that is free inside this Python worker back to the machine: workers outlive a task and add up."""
    pa.default_memory_pool().release_unused()
    if c_library() is not None:
        c_library().malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with null as the empty text, as one plain string array."""
    return pc.fill_null(column(batch, name).cast(pa.string()), "")


def list_parts(values: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Flat values and offsets from 0 of a list array that may be a slice."""
    offsets = values.offsets.to_numpy()
    return values.values.slice(offsets[0], offsets[-1] - offsets[0]), (offsets - offsets[0]).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: dictionary codes, offsets of texts, the distinct words."""
    flat, offsets = list_parts(pc.ascii_split_whitespace(texts))
    full = pc.greater(pc.binary_length(flat), 0)
    if (kept := full.to_numpy(zero_copy_only=False)).all():
        kept_offsets = offsets
    else:
        flat = flat.filter(full)
        kept_offsets = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int64)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept_offsets, coded.dictionary


def string_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes and offsets from 0 of a string or binary array without nulls."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    o = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return flat, o - o[0]


def ragged_take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the given rows of a ragged array; returns values and offsets."""
    size = offsets[rows + 1] - offsets[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return flat[np.arange(out[-1]) + np.repeat(offsets[rows] - out[:-1], size)], out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets; empty runs give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def list_array_of(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return list_array_of(pa.array(flat), offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, for hashing arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter(map(one, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
