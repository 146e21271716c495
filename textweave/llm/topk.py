"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Candidates come by descending length, in bands: all shards of the longest band are searched first, and each query takes
its k-th score so far on to the next, where it is left out once the band's greatest length cannot reach that score. Within
a shard, too, blocks come by descending length. After a rotation onto the principal axes of all vectors, the first axes
hold most of a product; what the other axes can add is at most the product of the residual lengths. A block whose length
bound is under a query's k-th score is skipped, candidates whose partial sum plus residual bound is under it are dropped,
and the rest are scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.llm.common import stored

#: Rows of one candidate block and of one query block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Bytes of vectors, as 64-bit numbers, in one task's candidates and queries; a task's arrays take about five times that.
SHARD_BYTES, QUERY_BYTES = 32 << 20, 16 << 20
#: A band of lengths has so many times the vectors of the band of longer ones before it.
BAND_GROWTH = 8
#: Share of the axes that the partial sums use.
LEADING = 0.5
#: Above this share of survivors the exact products of a block come from one matrix product.
DENSE = 0.05


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for vectors that hold null or non-finite components."""
    whole = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of all vectors: eigenvectors of the dim x dim sum of outer products, by falling eigenvalue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = matrix(batch.column(0), dim).astype(np.float64)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "v"])

    cells = vectors.select("v").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").toArrow()
    if not cells.num_rows:
        return np.eye(dim)
    _, axes = np.linalg.eigh(cells.column("v").to_numpy().reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1])


def matrix(values: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(values).to_numpy(zero_copy_only=False).reshape(-1, dim)


def searcher(k: int, dim: int, axes: np.ndarray) -> Callable:
    lead = max(1, int(dim * LEADING))

    def prepared(table: pa.Table) -> tuple:
        ids = table.column("vec_id").to_numpy()
        v = matrix(table.column("v").combine_chunks(), dim)
        length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        turned = v.astype(np.float64) @ axes
        return ids, v, length, turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.sort_by([("norm", "descending"), ("vec_id", "ascending")])
            q_ids, q_all, q_length, q_lead, q_rest = prepared(left)
            given = left.column("floor").to_numpy()
            c_ids, c_all, c_length, c_lead, c_rest = prepared(right.sort_by([("norm", "descending"), ("vec_id", "ascending")]))
            several = len(np.unique(c_ids)) < len(c_ids)
            # Whole numbers: doubles are exact up to 2 ** 53, beyond that products are taken in Python integers.
            exact = q_length.max() * c_length.max() < 2**52
            slack = 1e-6 * (1 + q_length.max() * c_length.max())
            for at in range(0, len(q_ids), QUERY_BLOCK):
                rows = slice(at, at + QUERY_BLOCK)
                n = len(q_ids[rows])
                best = np.full((n, k), -np.inf if exact else 0, np.float64 if exact else object)
                if not exact:
                    best[:] = -(10**100)
                who = np.full((n, k), np.iinfo(np.int64).max)
                for c in range(0, len(c_ids), BLOCK):
                    cols = slice(c, c + BLOCK)
                    floor = np.maximum(best[:, -1].astype(np.float64), given[rows])
                    alive = np.flatnonzero(q_length[rows] * c_length[c] + slack >= floor)
                    if not len(alive):
                        break  # no later block has longer vectors
                    bound = q_lead[rows][alive] @ c_lead[cols].T + np.outer(q_rest[rows][alive], c_rest[cols]) + slack
                    qi, ci = np.nonzero(bound >= floor[alive, None])
                    if not len(qi):
                        continue
                    if exact and len(qi) > DENSE * bound.size:
                        score = (q_all[rows][alive].astype(np.float64) @ c_all[cols].astype(np.float64).T)[qi, ci]
                    elif exact:
                        score = np.einsum("ij,ij->i", q_all[rows][alive[qi]].astype(np.float64), c_all[cols][ci].astype(np.float64))
                    else:
                        score = np.array([sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q_all[rows][alive[qi]], c_all[cols][ci], strict=True)], object)
                    qi, ids = alive[qi], c_ids[cols][ci]
                    good = (score >= best[qi, -1]) & (score >= given[rows][qi] - slack) & (ids != q_ids[rows][qi])
                    qi, ids, score = qi[good], ids[good], score[good]
                    if not len(qi):
                        continue
                    touched = np.unique(qi)
                    qi = np.concatenate([qi, np.repeat(touched, k)])
                    ids = np.concatenate([ids, who[touched].ravel()])
                    score = np.concatenate([score, best[touched].ravel()])
                    order = np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], ids[i]))) if score.dtype == object else np.lexsort((ids, -score, qi))
                    # An id counts once, with its best score: later rows of a query and id go; places without an id stay.
                    if several:
                        by_id = np.lexsort((np.arange(len(order)), ids[order], qi[order]))
                        x, y = qi[order][by_id], ids[order][by_id]
                        repeat = np.append(False, (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (y[1:] < np.iinfo(np.int64).max))
                        order = order[np.sort(by_id[~repeat])]
                    qi, ids, score = qi[order], ids[order], score[order]
                    first = np.searchsorted(qi, touched)
                    take = first[:, None] + np.arange(k)
                    best[touched], who[touched] = score[take], ids[take]
                found = who < np.iinfo(np.int64).max
                out["query_id"].append(np.repeat(q_ids[rows], k)[found.ravel()])
                out["vec_id"].append(who[found])
                out["score"].append(best[found].astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for c, v in out.items()})

    return run


def bands(source: DataFrame, n: int, first: int) -> list[float]:
    """Falling least lengths of the bands: the first has about `first` vectors, each other BAND_GROWTH times as many."""
    shares, done, size = [], 0, first
    while done + size < n:
        done += size
        shares.append(1 - done / n)
        size *= BAND_GROWTH
    edges = source.agg(F.percentile_approx("norm", F.array(*map(F.lit, shares)), F.lit(10_000)).alias("e")).first().e if shares else []
    return [*sorted(set(edges), reverse=True), -1.0]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id is divisible by `every`.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do null ids, nor vectors of another length than most (the longer of two equally common
    ones): they have no product with the others. A query does not match itself, that is rows of its own id. Rows repeated
    under one id count once, different vectors of one id with their best product. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    source = vectors.select(vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vector_col], scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    source = stored(source.dropDuplicates(["vec_id", "v"]).withColumn("norm", norm), "vectors")
    sizes = source.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    most = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).first()
    if most is None or not most.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, source = most.dim, source.where(F.size("v") == most.dim)
    axes = rotation(source, dim)
    room = lambda size: max(1, size // (8 * dim))
    # Enough shards for all cores, none larger than SHARD_BYTES.
    shard_rows = min(room(SHARD_BYTES), max(BLOCK, -(-most.n // spark.sparkContext.defaultParallelism)))
    blocks = -(-most.q // room(QUERY_BYTES))
    asked = source.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, above = None, None
    for least in bands(source, most.n, shard_rows):
        band = source.where(F.col("norm") >= least) if above is None else source.where((F.col("norm") >= least) & (F.col("norm") < above))
        size = band.agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
        above = least
        if not size.n:
            continue
        shards = -(-size.n // shard_rows)
        queries = asked.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            floors = best.groupBy("query_id").agg(F.min("score").cast("double").alias("f"), F.count("*").alias("m")).where(F.col("m") == k)
            queries = asked.join(floors, asked.vec_id == floors.query_id, "left").select(*asked.columns, F.coalesce("f", F.lit(float("-inf"))).alias("floor"))
            # A millionth more than the bound, for its rounding.
            queries = queries.where(F.col("norm") * size.top * (1 + 1e-6) + 1e-6 >= F.col("floor"))
        left = queries.toDF(*queries.columns).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = band.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(searcher(k, dim, axes), schema)
        merged = (found if best is None else found.unionByName(best)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = stored(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
