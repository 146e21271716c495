"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle of five words weighs its count in the text times its inverse document frequency, the mean of its words'. The
word frequencies are over all documents, in a hashed table of fixed size. Consistent samples agree between two texts with
a probability equal to their weighted Jaccard similarity; texts that agree on a whole band meet in a bucket. Each text is
first tried with leading members of its buckets, which settles most of them. A bucket that still holds two classes goes,
with its texts, to cells that compare every pair of different classes by sketches and verify what those leave possible on
whole texts, until no unverified pair is left; a cell gives the links that join classes, not all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import column, list_array, list_parts, mix64, small_side, stored, sub_batches, texts_of, word_hashes, words_of
from textweave.llm.components import connected_components
from textweave.llm.windows import Hashes, keyed, text_hash

SHINGLE = 5
ODD = np.uint64(0xD6E8FEB86659FD93)
SIMILARITY = 0.8
#: Two texts of similarity 0.8 share no band with probability (1 - 0.8 ** ROWS) ** BANDS = 2e-4, of 0.85 with 8e-6.
BANDS, ROWS = 16, 4
#: Samples that may differ of two texts that are compared: 0.8 goes beyond it with probability 1e-5.
MOST_APART = 27
PLANES = 4
#: Texts in cells of more than CROWD others get LONG further samples; of those, 0.8 goes beyond LONG_APART with probability
#: 1e-5 too, 0.72 in most cases.
CROWD, LONG, LONG_APART = 256, 1024, 245
#: Members and bytes of text in a block of a bucket, and what is verified at once: a cell holds two blocks at most.
CELL_ROWS, CELL_BYTES, VERIFIED = 1024, 4 << 20, 1 << 18
#: Pairs of a cell that are held at once.
HELD_PAIRS = 1 << 16
#: Limits of samples apart, of 64 and of LONG, that a cell's pairs pass in turn: the likeliest links first, so that texts
#: around one original are one class before the others are looked at; then all that can reach the similarity.
PASSES = ((14, 150), (MOST_APART, LONG_APART))
#: Bytes of text whose shingles are in memory at once.
SHINGLED_BYTES = 1 << 20
#: Slots of the hashed word-frequency table: the bound of what reaches the driver and is broadcast.
SLOTS = 1 << 18
LEVELS = 1 << 16


SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
LONG_SEEDS = mix64(np.arange(BANDS * ROWS + 1, BANDS * ROWS + LONG + 1, dtype=np.uint64))


def gamma_levels() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at LEVELS equal steps."""
    x = np.concatenate([np.geomspace(1e-6, 1, 20_000), np.linspace(1, 40, 80_000)[1:]])
    return np.interp((np.arange(LEVELS) + 0.5) / LEVELS, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each word slot, ln((1 + N) / (1 + df)) + 1 over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for whole in batches:
            for batch in sub_batches(whole, limit=SHINGLED_BYTES):
                codes, offsets, words = words_of(texts_of(batch))
                total[SLOTS] += batch.num_rows
                if len(words):
                    slot = (word_hashes(words) % np.uint64(SLOTS)).astype(np.int64)
                    of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                    total[:SLOTS] += np.bincount(np.unique((of << 18) | slot[codes]) & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    table = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS + 1)
    total[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return (np.log((1 + total[SLOTS]) / (1 + total[:SLOTS])) + 1).astype(np.float32)


def shingles(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each text's distinct shingles, ordered by text and hash; word hashes and their offsets.

    A text of one to four words has one shingle, all of them.
    """
    codes, offsets, words = words_of(texts)
    by_word = word_hashes(words) if len(words) else np.zeros(0, np.uint64)
    value = by_word[codes]
    share = idf[(by_word % np.uint64(SLOTS)).astype(np.int64)].astype(np.float64)[codes] / SHINGLE
    hashes = Hashes(value)
    size = np.diff(offsets)
    count = np.maximum(size - SHINGLE + 1, 0)
    of = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + offsets[of]
    weight = np.zeros(len(at))
    for k in range(SHINGLE):
        weight += share[at + k]
    h = hashes.of(at, SHINGLE)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        h = np.concatenate([h, hashes.of(offsets[short], size[short])])
        of = np.concatenate([of, short])
        weight = np.concatenate([weight, [share[offsets[i] : offsets[i + 1]].sum() * SHINGLE / size[i] for i in short]])
    order = np.argsort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    h, of, weight = h[order], of[order], weight[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    return of[first], h[first], weight[first] * times, value, offsets


def samples(of: np.ndarray, h: np.ndarray, weight: np.ndarray, levels: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number and consistent samples of each seed: one for each text that has shingles, in order."""
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    size = np.diff(np.append(begin, len(of)))
    log_w = np.log(weight).astype(np.float32)
    log_levels = np.log(levels)
    inverse = 1 / levels
    for k, seed in enumerate(seeds):
        # The four 16-bit fields of a mixed product: r, c and beta of this sample for each shingle.
        x = (h ^ seed) * ODD
        x ^= x >> np.uint64(29)
        x *= ODD
        field = x.view(np.uint16).reshape(-1, 4)
        level = field[:, 3].astype(np.intp)
        r = levels[level]
        beta = field[:, 1].astype(np.float32)
        beta *= np.float32(1 / LEVELS)
        t = log_w * inverse[level]
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= 1
        r *= beta
        r += log_levels[field[:, 2].astype(np.intp)]
        least = np.minimum.reduceat(r, begin)
        hits = np.flatnonzero(r == np.repeat(least, size))
        at = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]
        yield k, mix64(h[at] ^ mix64(t[at].astype(np.int64).view(np.uint64) + np.uint64(k)))


def signatures(texts: pa.Array, idf: np.ndarray, levels: np.ndarray) -> tuple[list[bytes | None], pa.Array, pa.Array, np.ndarray]:
    """For each text: a 128-bit hash of its words (None: no words), band hashes, a few bits of each sample, total weight.

    Bit k of plane p is bit p of sample k, so the samples that differ are the set bits of the planes' differences.
    """
    import xxhash

    of, h, weight, value, offsets = shingles(texts, idf)
    n = len(texts)
    keys = [xxhash.xxh3_128_digest(value[a:b].tobytes()) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    bands, planes = np.zeros((n, BANDS), np.uint64), np.zeros((n, PLANES), np.uint64)
    if len(h):
        rows = np.unique(of)
        for k, sample in samples(of, h, weight, levels, SEEDS):
            bands[rows, k // ROWS] = mix64(bands[rows, k // ROWS] ^ sample)
            for plane in range(PLANES):
                planes[rows, plane] |= ((sample >> np.uint64(plane)) & np.uint64(1)) << np.uint64(k)
    total = np.bincount(of, weights=weight, minlength=n)
    some = np.array([key is not None for key in keys])
    lists = list_array(bands[some].view(np.int64).ravel(), BANDS * np.concatenate([[0], np.cumsum(some)]))
    return keys, lists, list_array(planes.view(np.int64).ravel(), PLANES * np.arange(n + 1)), total


def long_sketches(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(key, sketch): PLANES bits of each of LONG further samples, plane by plane in words of 64 samples."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)  # SLOTS floats
    width = LONG // 64 * PLANES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = gamma_levels()
        for whole in batches:
            for batch in sub_batches(whole, limit=SHINGLED_BYTES):
                of, h, weight, _, _ = shingles(texts_of(batch), shared.value)
                planes = np.zeros((batch.num_rows, width), np.uint64)
                if len(h):
                    rows = np.unique(of)
                    for k, sample in samples(of, h, weight, levels, LONG_SEEDS):
                        for plane in range(PLANES):
                            planes[rows, k // 64 * PLANES + plane] |= ((sample >> np.uint64(plane)) & np.uint64(1)) << np.uint64(k % 64)
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(planes.view(np.int64).ravel(), width * np.arange(batch.num_rows + 1))], ["key", "sketch"])

    return texts.select("key", "text").mapInArrow(run, "key binary, sketch array<long>")


def samples_apart(left: Column, right: Column, words: int) -> Column:
    """How many samples differ between two sketches of so many words of 64 samples, PLANES bits each."""
    differ = [functools.reduce(lambda x, y: x.bitwiseOR(y), [left[p].bitwiseXOR(right[p]) for p in range(PLANES * w, PLANES * (w + 1))]) for w in range(words)]
    return functools.reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ])


def signature_rows(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("th", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("planes", T.ArrayType(T.LongType())), T.StructField("weight", T.DoubleType()), T.StructField("size", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # SLOTS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = gamma_levels()
        for whole in batches:
            for batch in sub_batches(whole, limit=SHINGLED_BYTES):
                texts = texts_of(batch)
                keys, bands, planes, total = signatures(texts, shared.value, levels)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), bands, planes, pa.array(total), pc.binary_length(texts).cast(pa.int64())], schema.names)

    return docs.select("doc_id", "text", text_hash().alias("th")).mapInArrow(run, schema)


def overlap(of: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of n pairs, from the shingles of both sides of each."""
    order = np.argsort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    of, h, w = of[order], h[order], w[order]
    same = np.flatnonzero((of[1:] == of[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(of[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
    union = np.bincount(of, weights=w, minlength=n) - shared
    return np.divide(shared, union, out=np.zeros(n), where=union > 0)


def similarities(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of texts row by row; two texts without words have 0."""
    n = len(left)
    of, h, w, _, _ = shingles(pa.concat_arrays([left, right]), idf)
    return overlap(of % n, h, w, n)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Pairs (a, b) of keys with whether they reach the similarity, on whole texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "ta", SHINGLED_BYTES):
                for part in sub_batches(batch, "tb", SHINGLED_BYTES):
                    s = similarities(texts_of(part, "ta"), texts_of(part, "tb"), shared.value)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s >= similarity)], ["a", "b", "alike"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, alike boolean")


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with their class: their own key as long as they have no link."""
    found = buckets.join(labels.withColumnRenamed("node", "key"), "key", "left")
    return found.withColumn("label", F.coalesce("label", "key"))


def of_two_classes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes differ."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def joined_classes(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) of all keys that have a link: classes joined by further links are components of classes."""
    links = stored(links, "links")
    if labels is None:
        return stored(connected_components(links), "labels")
    if not links.limit(1).count():
        return labels
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    both = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = stored(connected_components(both), "merged")
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stored(moved.unionByName(merged.join(labels, "node", "left_anti")), "labels")


def open_cells(buckets: DataFrame, labels: DataFrame, texts: DataFrame, idf: np.ndarray) -> tuple[DataFrame, int]:
    """(bucket, i, j, block, key, label, weight, planes, sketch, text) of buckets that hold two classes.

    The members of a bucket's largest class and the others are cut into blocks; the cells (i, j) are the pairs of blocks
    of which one at least is of others. So a member of the largest class is repeated once for each block of others: the
    work grows with the square of texts that are alike and yet in different classes only. Of buckets with the same members
    one is kept. Also returns the number of rows without repeats.
    """
    marked = labelled(buckets, labels)
    classes = marked.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("size").alias("s"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    info = classes.groupBy("bucket").agg(F.max_by(F.struct("label", "c", "s"), F.struct("c", "label")).alias("most"), F.count("*").alias("classes"), F.sum("c").alias("m"), F.sum("s").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    info = info.where("classes > 1").groupBy("m", "x", "y").agg(F.min(F.struct("bucket", "most", "m", "size")).alias("o")).select("o.bucket", "o.most", "o.m", "o.size")
    parts = lambda rows, size: F.greatest(F.ceil(rows / CELL_ROWS), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    info = info.select("bucket", F.col("most.label").alias("top"), parts(F.col("m") - F.col("most.c"), F.col("size") - F.col("most.s")).alias("others"), parts(F.col("most.c"), F.col("most.s")).alias("tops"), (F.col("m") > CROWD).alias("crowded"))
    info = stored(info, "open")
    rows = marked.join(small_side(info, info.count()), "bucket")
    large = F.col("label") == F.col("top")
    block = F.when(large, F.col("others") + F.pmod(F.xxhash64("key"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("key"), F.col("others"))).cast("int")
    last = F.when(large, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    rows = rows.select("bucket", "key", "label", "weight", "planes", "crowded", block.alias("block"), last.alias("last"))
    rows = stored(rows, "members")
    members = rows.count()
    long = long_sketches(texts.join(rows.where("crowded").select("key").distinct(), "key", "left_semi"), idf)
    rows = rows.join(texts, "key").join(stored(long, "sketches"), "key", "left").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return rows.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "key", "label", "weight", "planes", "sketch", "text"), members


class Cells:
    """A table of whole cells: pairs that sketches leave possible are verified, and classes joined, as they come."""

    def __init__(self, table: pa.Table, idf: np.ndarray, similarity: float):
        words = lambda values, n: list_parts(values)[0].to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
        one = lambda c: table.column(c).combine_chunks()
        bucket, i, j = (one(c).to_numpy() for c in ("bucket", "i", "j"))
        self.idf, self.similarity = idf, similarity
        self.cell = np.cumsum(np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        self.within, self.block = i == j, one("block").to_numpy()
        self.label = one("label").dictionary_encode().indices.to_numpy().astype(np.int64)
        self.weight, self.planes = one("weight").to_numpy(), words(one("planes"), len(self.cell))
        sketches = one("sketch")
        self.known = sketches.is_valid().to_numpy(zero_copy_only=False)
        self.at = np.cumsum(self.known) - 1
        self.sketch = words(sketches.drop_null(), int(self.known.sum())) if self.known.any() else np.zeros((0, 1), np.uint64)
        key = one("key").dictionary_encode()
        self.text, self.node = one("text"), key.indices.to_numpy().astype(np.int64)
        # Shingles of the keys that have taken part so far.
        self.h, self.w = np.zeros(0, np.uint64), np.zeros(0)
        self.begin, self.size = (np.full(len(key.dictionary), -1) for _ in range(2))
        self.links: list[tuple[int, int]] = []

    def pairs(self, most: int, most_long: int) -> Iterator[np.ndarray]:
        """(rows u, v, samples apart) of pairs of a cell and of different classes that weights and sketches leave possible."""
        held, count = [], 0
        rows, d, n = np.arange(len(self.cell)), 1, len(self.cell)
        while True:
            rows = rows[rows + d < n]
            rows = rows[self.cell[rows] == self.cell[rows + d]]  # cells are runs of rows: a row without a partner has none further on
            if not len(rows):
                break
            v = rows + d
            fits = (self.label[rows] != self.label[v]) & (self.within[rows] | (self.block[rows] != self.block[v]))
            fits &= np.minimum(self.weight[rows], self.weight[v]) >= (self.similarity - 1e-9) * np.maximum(self.weight[rows], self.weight[v])
            u = rows[fits]
            v = u + d
            differ = np.zeros(len(u), np.uint64)
            for p in range(PLANES):
                differ |= self.planes[u, p] ^ self.planes[v, p]
            apart = np.bitwise_count(differ).astype(np.int64)
            some = apart <= most
            u, v, apart = u[some], v[some], apart[some] * (LONG // 64)
            both = np.flatnonzero(self.known[u] & self.known[v])
            if len(both):
                differ = np.bitwise_or.reduce((self.sketch[self.at[u[both]]] ^ self.sketch[self.at[v[both]]]).reshape(len(both), -1, PLANES), 2)
                apart[both] = np.bitwise_count(differ).sum(1)
                keep = np.ones(len(u), bool)
                keep[both] = apart[both] <= most_long
                u, v, apart = u[keep], v[keep], apart[keep]
            if len(u):
                held.append(np.stack([u, v, apart]))
                count += len(u)
            if count >= HELD_PAIRS:
                yield np.concatenate(held, 1)
                held, count = [], 0
            d += 1
        if held:
            yield np.concatenate(held, 1)

    def shingle(self, rows: np.ndarray) -> None:
        """Brings the shingles of these rows' texts, once for each key."""
        node, first = np.unique(self.node[rows], return_index=True)
        new = self.size[node] < 0
        node, first = node[new], rows[first[new]]
        if not len(node):
            return
        h, w, sizes = [self.h], [self.w], []
        for part in sub_batches(pa.RecordBatch.from_arrays([self.text.take(pa.array(first))], ["text"]), limit=SHINGLED_BYTES):
            of, ph, pw, _, _ = shingles(texts_of(part), self.idf)
            h.append(ph)
            w.append(pw)
            sizes.append(np.bincount(of, minlength=part.num_rows))
        size = np.concatenate(sizes)
        self.begin[node] = len(self.h) + np.cumsum(size) - size
        self.size[node] = size
        self.h, self.w = np.concatenate(h), np.concatenate(w)

    def verify(self, u: np.ndarray, v: np.ndarray) -> None:
        """Joins the classes of the pairs that reach the similarity; as many at once as VERIFIED shingles."""
        self.shingle(np.concatenate([u, v]))
        a, b = self.node[u], self.node[v]
        ahead = np.cumsum(self.size[a] + self.size[b])
        begin = 0
        while begin < len(u):
            end = max(begin + 1, int(np.searchsorted(ahead, (ahead[begin - 1] if begin else 0) + VERIFIED, "right")))
            pairs = np.flatnonzero(self.label[u[begin:end]] != self.label[v[begin:end]]) + begin  # others are settled by now
            if len(pairs):
                nodes = np.concatenate([a[pairs], b[pairs]])
                size = self.size[nodes]
                flat = np.repeat(self.begin[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
                of = np.repeat(np.arange(len(nodes)) % len(pairs), size)
                for p in pairs[overlap(of, self.h[flat], self.w[flat], len(pairs)) >= self.similarity]:
                    x, y = self.label[u[p]], self.label[v[p]]
                    if x != y:
                        self.label[self.label == y] = x
                        self.links.append((int(u[p]), int(v[p])))
            begin = end

    def joined(self) -> np.ndarray:
        """Rows (u, v) of the links that joined classes."""
        for most, most_long in PASSES:
            for u, v, apart in self.pairs(most, most_long):
                order = np.argsort(apart, kind="stable")
                self.verify(u[order], v[order])
        return np.array(self.links, np.int64).reshape(-1, 2).T


def cell_links(cells: DataFrame, members: int, idf: np.ndarray, similarity: float) -> DataFrame:
    """(a, b): the links that join classes, of all cells; a worker holds some cells at once, or one."""
    shared = cells.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, last = [], 0, 0, None

        def links() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            u, v = Cells(table, shared.value, similarity).joined()
            key = table.column("key").combine_chunks()
            return pa.RecordBatch.from_arrays([key.take(pa.array(u)), key.take(pa.array(v))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j"))
            cut = np.append(np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, batch.num_rows)
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column(batch, "text")).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            for to in cut.tolist():
                this = (bucket[at], i[at], j[at])
                if held and this != last and (rows > CELL_ROWS or size > CELL_BYTES):
                    yield links()
                    held, rows, size = [], 0, 0
                held.append(batch.slice(at, to - at))
                rows, size, last, at = rows + to - at, size + int(sizes[to] - sizes[at]), this, to
        if held:
            yield links()

    where = ["bucket", "i", "j"]
    return cells.repartition(max(1, -(-members // CELL_ROWS)), *where).sortWithinPartitions(*where, "key").mapInArrow(run, "a binary, b binary")


def row_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, label) for every row: its text hash and its class, null for null texts and texts without words.

    Classes are the components of verified links; texts of equal words are in one class, repeated rows too.
    """
    docs = keyed(docs, id_col, text_col)
    idf = document_frequencies(docs)
    rows = stored(signature_rows(docs, idf), "signatures")
    some = rows.where("key IS NOT NULL").groupBy("key")
    nodes = stored(some.agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("bands").alias("bands"), F.min("planes").alias("planes"), F.max("weight").alias("weight"), F.max("size").alias("size")), "nodes")
    each = nodes.select("key", "weight", "planes", "size", F.posexplode("bands").alias("band", "h")).select("key", "weight", "planes", "size", F.xxhash64("band", "h").alias("bucket"))
    heads = each.groupBy("bucket").agg(F.min(F.struct("key", "weight", "planes")).alias("head"), F.count("*").alias("m")).where("m > 1")
    buckets = stored(each.join(heads, "bucket").select("bucket", "key", "weight", "planes", "size", "head"), "buckets")
    involved = stored(buckets.select("key").distinct().join(nodes, "key").select("key", F.col("one.doc_id").alias("_d"), F.col("one.th").alias("_t")), "involved")
    side = small_side(involved, involved.count())
    named = docs.withColumn("th", text_hash())
    texts = stored(named.join(side, named.doc_id.eqNullSafe(side["_d"]) & (named.th == side["_t"])).select("key", "text").dropDuplicates(["key"]), "texts")
    # Each text with the leads of its buckets that weights and sketches leave possible: the least one first, then those of
    # other classes.
    fits = F.least("weight", "head.weight") >= (similarity - 1e-9) * F.greatest("weight", "head.weight")
    fits &= samples_apart(F.col("planes"), F.col("head.planes"), 1) <= MOST_APART
    leads = stored(buckets.where(F.col("key") != F.col("head.key")).where(fits).select(F.col("key").alias("a"), F.col("head.key").alias("b")).distinct(), "leads")
    first = leads.groupBy("a").agg(F.min("b").alias("b"))
    labels = joined_classes(None, verified(first, texts, idf, similarity).where("alike").select("a", "b"))
    others = leads.join(first, ["a", "b"], "left_anti")
    labels = joined_classes(labels, verified(of_two_classes(others, labels), texts, idf, similarity).where("alike").select("a", "b"))
    cells, members = open_cells(buckets.drop("head"), labels, texts, idf)
    labels = joined_classes(labels, cell_links(cells, members, idf, similarity))
    classes = rows.select("doc_id", "th", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    return classes.select("doc_id", "th", F.coalesce("label", "key").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) for every row: its class's least id and number of rows; other columns are ignored.

    See row_classes(). Null texts and texts without words are classes of their own. A class of null ids alone has a null
    class_id.
    """
    classes = row_classes(docs, similarity, id_col, text_col)
    sizes = classes.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    some = classes.where("label IS NOT NULL").join(sizes, "label").select("doc_id", "class_id", "class_size")
    none = classes.where("label IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return some.unionByName(none)
