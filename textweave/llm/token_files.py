"""Token counts of documents in flat, unindexed token files.

A file is nothing but little-endian token ids, each document ended by one end-of-document id. It is cut into blocks at
fixed offsets; each block is searched for the id on arrays, and a prefix scan over the blocks' summaries stitches the
documents that cross block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.bpe import tokenizer
from textweave.llm.common import shared_root, small_side, stored, sub_batches, texts_of

BLOCK_TOKENS = 1 << 18
#: Documents in a file that is written here: a partition with more is written as several files, none read as one large row.
FILE_DOCUMENTS = 1 << 13
#: Bytes of a file that is read as one row at most, and of a larger one's blocks that one task reads.
WHOLE_BYTES, TASK_BYTES = 1 << 28, 1 << 27
#: Bytes of text encoded at once.
ENCODED_BYTES = 3 << 20


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text", file_documents: int = FILE_DOCUMENTS) -> DataFrame:
    """Writes flat files; returns (file, ordinal, doc_id), the order of the documents in them.

    Spark's text writer puts down raw bytes and ends each row with the separator, here the end id: files of any store
    that Spark can write to, committed as a whole by each task. Texts that spell a special token are ordinary text, so
    the end id occurs nowhere else. The order is stored by a scan of its own; both scans observe a digest of all places,
    ids and texts, and an input that does not come out the same twice is an error.
    """
    if width not in (2, 4):
        raise ValueError("ids are 2 or 4 bytes wide")
    kind, end = "<u2" if width == 2 else "<u4", int(end_id).to_bytes(width, "little")
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("at", F.monotonically_increasing_id())
    seen = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("at", "doc_id", "text")).alias("digest"))
    first, second = Observation(), Observation()
    order = stored(source.observe(first, seen.alias("seen")).select("at", "doc_id"), "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for batch in sub_batches(whole, limit=ENCODED_BYTES):
                ids, offsets = bpe.encode(texts_of(batch), specials=False)
                data = pa.py_buffer(ids.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), data])], ["tokens"])

    tokens = source.observe(second, seen.alias("seen")).select("text").mapInArrow(run, "tokens binary").select(F.expr("cast(tokens as string)").alias("value"))
    # The encoding option is for the separator alone; the rows' bytes go out as they are.
    tokens.write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("maxRecordsPerFile", file_documents).text(folder)
    if first.get != second.get:
        raise RuntimeError("two scans of the documents differ; store them first")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return order.select(file_number(F.shiftright("at", 33), F.floor(place / file_documents)).alias("file"), (place % file_documents).alias("ordinal"), "doc_id")


def file_number(partition: Column, chunk: Column) -> Column:
    """One number for a file name's two: partitions are under 2 ** 31, files of one under 2 ** 32."""
    return F.shiftleft(partition.cast("long"), 32).bitwiseOR(chunk.cast("long"))


def token_blocks(spark: SparkSession, folder: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file, block, first, tokens binary): the files of a folder cut at fixed offsets; bytes after a file's last whole token
    are an error.

    Files of up to `whole_bytes` are read as a row by Spark, from any store. Larger ones are never held: their blocks are dealt over
    tasks in runs of TASK_BYTES, and each task reads its own ranges, so one file is read by many tasks. Those need a store that
    Arrow can open (shared folders, HDFS, the usual object stores).
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    number = file_number(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1), F.coalesce(F.regexp_extract("path", r"-c(\d+)(?:\.[^/]*)?$", 1).try_cast("long"), F.lit(0)))
    size = block_tokens * width
    odd = F.raise_error(F.concat(F.col("path"), F.lit(f": no whole number of tokens of {width} bytes"))).cast("long")
    files = listed.withColumns({"file": number, "length": F.when(F.col("length") % width == 0, F.col("length")).otherwise(odd)})
    at = F.explode(F.expr(f"sequence(0L, (length - 1) div {size})"))
    cut = files.where(listed["length"] <= whole_bytes).select("file", "content", at.alias("block"))
    small = cut.select("file", "block", (F.col("block") * block_tokens).alias("first"), F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("tokens"))
    big = files.where(listed["length"] > whole_bytes).select("file", "path", "length")  # without their content
    total = big.agg(F.sum("length")).first()[0]
    if total is None:
        return small
    run_blocks = max(1, TASK_BYTES // size)
    ranges = big.select("file", "path", "length", at.alias("block")).repartition(int(total) // TASK_BYTES + 1, "file", F.floor(F.col("block") / run_blocks)).sortWithinPartitions("file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from contextlib import ExitStack

        with ExitStack() as stack:
            name, source = None, None
            for batch in batches:
                for i, r in enumerate(batch.to_pylist()):
                    if r["path"] != name:
                        stack.close()
                        name, source = r["path"], stack.enter_context(opened(r["path"]))
                    start = r["block"] * size
                    source.seek(start)
                    tokens = source.read(min(size, r["length"] - start))
                    if len(tokens) != min(size, r["length"] - start):
                        raise ValueError(f"{name} ends early")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([r["block"]], pa.int64()), pa.array([r["block"] * block_tokens], pa.int64()), pa.array([tokens], pa.binary())], ["file", "block", "first", "tokens"])

    return small.unionByName(ranges.mapInArrow(read, "file long, block long, first long, tokens binary"))


def opened(path: str) -> pa.NativeFile:
    """A file of Spark's listing for reading at any place; the listing gives names without escapes."""
    from urllib.parse import quote

    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(name)


def document_lengths(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document, the end id not counted.

    Tokens after a file's last end id are a document of their own. Empty files and empty tables give no rows; documents
    of no tokens count 0. Other columns of `blocks` are ignored; a null block of tokens is an empty one.
    """
    kind = "<u2" if width == 2 else "<u4"
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("first", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column(2)[i].as_py()
                ids = np.frombuffer(batch.column(3)[i].as_buffer() if batch.column(3)[i].is_valid else b"", kind)
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "first", "size", "ends"])

    found = blocks.select(F.col("file").cast("long"), F.col("block").cast("long"), F.col("first").cast("long"), "tokens").mapInArrow(run, schema)
    found = stored(found, "ends")
    # The scan: documents ended before a block, and the last end before it, from sums and maxima over the summaries of the blocks
    # ahead. The ends themselves stay where they are.
    last = F.try_element_at("ends", F.lit(-1))
    blocks = found.select("file", "block", F.size("ends").alias("m"), last.alias("last"), (F.col("first") + F.col("size")).alias("stop"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    ended, last_end = F.coalesce(F.sum("m").over(ahead), F.lit(0)), F.coalesce(F.max("last").over(ahead), F.lit(-1))
    scanned = blocks.select("file", "block", "last", "stop", ended.alias("ended"), last_end.alias("last_end"), (F.max("block").over(whole) == F.col("block")).alias("final"))
    tail = F.when(F.col("final") & (F.col("stop") > F.coalesce("last", "last_end") + 1), F.col("stop"))
    scanned = stored(scanned.select("file", "block", "ended", "last_end", tail.alias("tail")), "scanned")
    met = found.select("file", "block", "ends").join(small_side(scanned, scanned.count()), ["file", "block"])
    stitched = met.select("file", "ended", "last_end", F.when(F.col("tail").isNull(), F.col("ends")).otherwise(F.concat("ends", F.array("tail"))).alias("ends"))
    each = stitched.select("file", "ended", F.posexplode(F.arrays_zip(F.concat(F.array("last_end"), F.expr("slice(ends, 1, greatest(size(ends) - 1, 0))")).alias("a"), F.col("ends").alias("b"))).alias("k", "d"), F.size("ends").alias("m"))
    return each.where("k < m").select("file", (F.col("ended") + F.col("k")).cast("long").alias("ordinal"), (F.col("d.a") + 1).alias("start"), (F.col("d.b") - F.col("d.a") - 1).alias("n_tokens"))


def count_document_tokens(docs: DataFrame, path: str, end_id: int, width: int = 2) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) of every document: writes flat files, scans them, joins the order.

    Null and empty texts count 0. Null ids and repeated rows are documents like others; no rows give none.
    """
    folder = f"{shared_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    order = write_token_files(docs, path, folder, end_id, width)
    if order.limit(1).count() == 0:
        return order.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    found = document_lengths(token_blocks(docs.sparkSession, folder, width), end_id, width)
    return order.join(found, ["file", "ordinal"], "full").select("doc_id", "file", "ordinal", "start", F.coalesce("n_tokens", F.raise_error(F.lit("the files and their order differ")).cast("long")).alias("n_tokens"))
