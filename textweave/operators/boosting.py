"""Gradient-boosted trees over binned inputs: many models fitted side by side, one pass over the rows for each tree level.

Inputs are cut at exact quantiles into at most BINS bins of a byte each. Rows alike in bins, fold and source are one cell with
their number and the sums of their targets, which is all that squared errors need; cells of the same bins lie together, so a
tree is walked once for each combination of bins. A pass sums, inside its tasks, residuals and weights by
(model, node, input, bin); tasks' sums are added up in a tree and are as large as the models' trees, whatever the number of rows, and all models
(folds, targets, source weights, depths) share the pass. Predictions so far are stored with the cells every KEEP trees and
worked out from the trees in between, so a lost task only reads its cells again.

A fitted model is a plain dictionary: base, inputs, and trees as arrays of feature, threshold, left, right and value, walked by
tree_score() as one expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators.ordering import all_quantiles
from textweave.sources.scratch import stored

BINS, KEEP = 64, 16
#: Tasks whose sums are added at once.
FAN = 64
#: A split must leave this weight on either side and gain more than this.
LEAST_WEIGHT, LEAST_GAIN = 1.0, 1e-9


@dataclass(frozen=True)
class Model:
    """What to fit: `held` is the fold left out, `weights` those of sources (others weigh 0), `stop` ends a model after that many
    trees without a smaller error on the human rows of its held fold, of which it then keeps the best number of trees."""

    name: str
    inputs: tuple[str, ...]
    target: str
    held: int | None
    weights: tuple[tuple[str, float], ...]
    depth: int = 3
    rounds: int = 20
    rate: float = 0.1
    l2: float = 1.0
    stop: int | None = None


@dataclass
class Tree:
    """Nodes in order of making; a leaf has feature -1. Rows go left where their bin is at most the cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaf(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = self.leaf(left), self.leaf(right)
        return self.left[node], self.right[node]

    def nodes(self, x: Sequence[np.ndarray]) -> np.ndarray:
        """The leaf of each row of bins, given as columns."""
        kind = np.uint8 if len(self.value) < 256 else np.int32

        def walk(k: int):
            if self.feature[k] < 0:
                return kind(k)
            return np.where(x[self.feature[k]] <= self.cut[k], walk(self.left[k]), walk(self.right[k]))

        return np.broadcast_to(walk(0), len(x[0]) if x else 0)

    def of(self, x: Sequence[np.ndarray]) -> np.ndarray:
        return np.array(self.value).take(self.nodes(x))


def edges_of(rows: DataFrame, inputs: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Upper ends of bins but the last: distinct exact quantiles, a few numbers for each input."""
    found = all_quantiles(rows, {n: [k / bins for k in range(1, bins)] for n in inputs})
    return {n: sorted({v for v in found[n] if v is not None}) for n in inputs}


def binned(rows: DataFrame, inputs: Sequence[str], edges: dict[str, list[float]], targets: Sequence[str], fold: str, source: str) -> DataFrame:
    """(x, y, fold, source): a byte for each input and an array of targets. A missing input counts 0; rows without a target, fold
    or source take no part."""
    cuts = [np.array(edges[n]) for n in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.empty((n, len(cuts)), np.uint8)
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
            for k, c in enumerate(cuts):
                x[:, k] = np.searchsorted(c, values[:, k], "left")
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * len(cuts)).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([raw, *batch.columns[1:]], ["x", "y", "fold", "source"])

    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    whole = rows.select(F.array(*[F.coalesce(number(n), F.lit(0.0)) for n in inputs]).alias("x"), F.array(*[number(t) for t in targets]).alias("y"), F.col(fold).cast("int").alias("fold"), F.col(source).cast("string").alias("source"))
    whole = whole.where(F.col("fold").isNotNull() & F.col("source").isNotNull() & ~F.exists("y", lambda v: v.isNull()))
    return whole.mapInArrow(run, "x binary, y array<double>, fold int, source string")


def cells(rows: DataFrame, targets: int, parts: int) -> DataFrame:
    """(x, n, s, q, fold, source, p): binned rows alike in bins, fold and source, with their number and their targets' sums and sums
    of squares; those of the same bins lie one after the other."""
    y = [F.get("y", F.lit(t)) for t in range(targets)]
    sums = rows.groupBy("x", "fold", "source").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(v) for v in y]).alias("s"), F.array(*[F.sum(v * v) for v in y]).alias("q"))
    together = sums.repartition(parts, "x").sortWithinPartitions("x")
    return together.select("x", "n", "s", "q", "fold", "source", F.array().cast("array<double>").alias("p"))


class Cells:
    """A batch of cells as arrays; x holds the bins of each run of cells of the same bins, by column."""

    def __init__(self, batch: pa.RecordBatch, width: int, targets: int):
        x = matrix(batch.column(0), width)
        self.starts = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]).any(1)) + 1]) if len(x) else np.zeros(0, np.int64)
        self.runs = np.diff(np.append(self.starts, len(x)))
        self.x = [np.ascontiguousarray(x[self.starts, k]) for k in range(width)]
        self.wide = [c.astype(np.int64) for c in self.x]
        self.n, self.s, self.q = batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(2), targets), matrix(batch.column(3), targets)
        self.folds = batch.column(4).to_numpy(zero_copy_only=False)
        coded = batch.column(5).dictionary_encode()
        self.code, self.names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        self.stored = batch.column(6)
        self.known: dict = {}

    def weight(self, model: Model) -> np.ndarray:
        """The weight of a row of each cell."""
        key = model.weights, model.held
        if key not in self.known:
            by = dict(model.weights)
            w = np.array([by.get(n, 0.0) for n in self.names])[self.code]
            self.known[key] = w if model.held is None else np.where(self.folds == model.held, 0.0, w)
        return self.known[key]

    def total(self, model: Model, target: int) -> np.ndarray:
        """The weighted sum of a target, or of rows (target -1), by run."""
        key = model.weights, model.held, target
        if key not in self.known:
            self.known[key] = np.add.reduceat(self.weight(model) * (self.n if target < 0 else self.s[:, target]), self.starts)
        return self.known[key]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length, or of bytes, as a matrix."""
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists_of(p: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


class Fit:
    """Models, their trees so far, and how many of these are in the stored predictions."""

    def __init__(self, models: Sequence[Model], inputs: Sequence[str], targets: Sequence[str], human: str, bins: int):
        self.bins = bins
        self.models, self.human, self.width, self.n_targets = list(models), human, len(inputs), len(targets)
        self.columns = [[inputs.index(n) for n in m.inputs] for m in models]
        self.target = [targets.index(m.target) for m in models]
        self.base = [0.0] * len(models)
        self.trees: list[list[Tree]] = [[] for _ in models]
        self.kept = [0] * len(models)
        self.best: list[tuple[float, int]] = [(np.inf, 0)] * len(models)
        self.open = [True] * len(models)

    def predictions(self, c: Cells, m: int) -> np.ndarray:
        """Of each run, from the stored ones and the trees since."""
        p = matrix(c.stored, len(self.models))[c.starts, m] if self.kept[m] else np.full(len(c.starts), self.base[m])
        for tree in self.trees[m][self.kept[m] :]:
            p = p + tree.of(c.x)
        return p

    def cells(self, batch: pa.RecordBatch) -> Cells:
        return Cells(batch, self.width, self.n_targets)

    def sums(self, task, state: DataFrame) -> dict[int, np.ndarray]:
        """Runs a task's (model, vector) sums over all rows and adds the vectors up, FAN tasks at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    for m, values in task(batch):
                        total[m] = total[m] + values if m in total else values
            if total:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["m", "part", "v"])

        def add(table: pa.Table) -> pa.Table:
            values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(0)
            return pa.table({"m": table.column("m").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "v": pa.array([values], pa.list_(pa.float64()))})

        kinds = "m int, part int, v array<double>"
        out, parts = state.mapInArrow(run, kinds), max(1, state.rdd.getNumPartitions())
        while parts > 1:
            out, parts = out.groupBy("m", F.expr(f"part div {FAN}")).applyInArrow(add, kinds), -(-parts // FAN)
        found = out.toArrow()
        return {m: np.array(v) for m, v in zip(found.column("m").to_pylist(), found.column("v").to_pylist(), strict=True)}

    def start(self, state: DataFrame) -> None:
        def task(batch):
            c = self.cells(batch)
            for m, model in enumerate(self.models):
                yield m, np.array([c.total(model, self.target[m]).sum(), c.total(model, -1).sum()])

        for m, (total, weight) in self.sums(task, state).items():
            self.base[m] = total / weight if weight > 0 else 0.0

    def level(self, state: DataFrame, growing: list[Tree | None], leaves: list[list[int]], measure: bool) -> dict:
        """By model: the squared error and number of human rows of the held fold (if measured), then the (bins, 2) sums of residuals
        and weights of each leaf that may still be split and each of the model's inputs."""

        def task(batch):
            c = self.cells(batch)
            for m, model in enumerate(self.models):
                measured = measure and model.stop is not None
                if growing[m] is None or not (leaves[m] or measured):
                    continue
                p = self.predictions(c, m)
                error = np.zeros(2)
                if measured and self.human in c.names:
                    own = np.flatnonzero((c.folds == model.held) & (c.code == c.names.index(self.human)))
                    at, t = np.repeat(p, c.runs)[own], self.target[m]
                    error = np.array([(c.q[own, t] - 2 * at * c.s[own, t] + at * at * c.n[own]).sum(), c.n[own].sum()])
                out = [error]
                if leaves[m]:
                    h = c.total(model, -1)
                    g = c.total(model, self.target[m]) - h * p
                    slot = np.full(len(growing[m].value), len(leaves[m]))  # rows of other nodes go to a place that is left out
                    slot[leaves[m]] = np.arange(len(leaves[m]))
                    at, size = (slot * self.bins).take(growing[m].nodes(c.x)), len(leaves[m]) * self.bins
                    for f in self.columns[m]:
                        cell = at + c.wide[f]
                        out.append(np.stack([np.bincount(cell, g, size)[:size], np.bincount(cell, h, size)[:size]], 1).ravel())
                yield m, np.concatenate(out)

        found = {}
        for m, v in self.sums(task, state).items():
            found[m, -1, 0] = v[:2]
            tables = v[2:].reshape(len(self.columns[m]), len(leaves[m]), self.bins, 2)
            found |= {(m, node, f): tables[i, k] for i, f in enumerate(self.columns[m]) for k, node in enumerate(leaves[m])}
        return found

    def kept_with(self, state: DataFrame) -> DataFrame:
        """The cells, stored, with the predictions of all trees so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = self.cells(batch)
                p = np.stack([np.repeat(self.predictions(c, m), c.runs) for m in range(len(self.models))], 1) if batch.num_rows else np.zeros((0, len(self.models)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], lists_of(p)], ["x", "n", "s", "q", "fold", "source", "p"])

        return stored(state.mapInArrow(run, "x binary, n double, s array<double>, q array<double>, fold int, source string, p array<double>"), "boosted")

    def finished(self, rows: DataFrame) -> DataFrame:
        """Binned rows with predictions `p` of all models, of the trees that count; worked out as they are read."""
        trees = [self.trees[m][: self.size(m)] for m in range(len(self.models))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [np.ascontiguousarray(c) for c in matrix(batch.column(0), self.width).T]
                p = np.empty((batch.num_rows, len(trees)))
                for m, own in enumerate(trees):
                    p[:, m] = self.base[m]
                    for tree in own:
                        p[:, m] += tree.of(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists_of(p)], ["x", "y", "fold", "source", "p"])

        return rows.mapInArrow(run, "x binary, y array<double>, fold int, source string, p array<double>")

    def size(self, m: int) -> int:
        return self.best[m][1] if self.models[m].stop is not None and np.isfinite(self.best[m][0]) else len(self.trees[m])

    def judge(self, found: dict) -> None:
        """Notes the error of each model as it is, and ends those that have not become better for long enough."""
        for m, model in enumerate(self.models):
            if model.stop is None or (m, -1, 0) not in found:
                continue
            total, n = found[m, -1, 0]
            if n and total / n < self.best[m][0] - 1e-12:
                self.best[m] = (total / n, len(self.trees[m]))
            elif len(self.trees[m]) - self.best[m][1] >= model.stop:
                self.open[m] = False


def best_split(sums: dict[int, np.ndarray], l2: float) -> tuple[int, int, tuple[float, float], tuple[float, float]] | None:
    """(input, cut, (residuals, weight) of the left, of the right) of the largest gain; ties to the first input and bin."""
    best, out = LEAST_GAIN, None
    for f in sorted(sums):
        left = np.cumsum(sums[f], 0)
        total = left[-1]
        right = total - left
        ok = (left[:, 1] >= LEAST_WEIGHT) & (right[:, 1] >= LEAST_WEIGHT)
        gain = np.where(ok, left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (np.maximum(right[:, 1], 0) + l2) - total[0] ** 2 / (total[1] + l2), -np.inf)
        cut = int(np.argmax(gain))
        if gain[cut] > best * (1 + 1e-9):
            best, out = float(gain[cut]), (f, cut, tuple(left[cut]), tuple(right[cut]))
    return out


def boost(rows: DataFrame, inputs: Sequence[str], targets: Sequence[str], fold: str, source: str, models: Sequence[Model], human: str = "human", bins: int = BINS) -> tuple[dict[str, dict], DataFrame]:
    """The fitted models by name, and (x, y, fold, source, p): p holds each model's predictions, in the order of the models.

    Models of different depth, rounds and weights grow their trees in step. A model without rows of weight predicts 0.
    """
    edges = edges_of(rows, inputs, bins)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = binned(rows, inputs, edges, targets, fold, source)
    rows = stored(rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows, "binned")
    state = stored(cells(rows, len(targets), 4 * cores), "cells")
    fit = Fit(models, list(inputs), list(targets), human, bins)
    fit.start(state)
    for t in range(max((m.rounds for m in models), default=0)):
        growing = [Tree() if fit.open[k] and t < m.rounds else None for k, m in enumerate(models)]
        leaves = [[0] if tree is not None else [] for tree in growing]
        for depth in range(max(m.depth for m in models)):
            leaves = [own if depth < models[k].depth else [] for k, own in enumerate(leaves)]
            if not any(leaves):
                break
            found = fit.level(state, growing, leaves, depth == 0)
            if depth == 0:
                fit.judge(found)
            for k, model in enumerate(models):
                if not fit.open[k]:
                    growing[k], leaves[k] = None, []
                    continue
                more = []
                for node in leaves[k]:
                    split = best_split({f: found[k, node, f] for f in fit.columns[k] if (k, node, f) in found}, model.l2)
                    if split:
                        f, cut, *sides = split
                        more += growing[k].split(node, f, cut, *(model.rate * g / (h + model.l2) for g, h in sides))
                leaves[k] = more
        for k, tree in enumerate(growing):
            if tree is not None:
                fit.trees[k].append(tree)
        if t % KEEP == KEEP - 1:
            state = fit.kept_with(state)
            fit.kept = [len(trees) for trees in fit.trees]
    if any(m.stop is not None for m in models):
        fit.judge(fit.level(state, [Tree() for _ in models], [[] for _ in models], True))
    return {m.name: artifact(m, fit.base[k], fit.trees[k][: fit.size(k)], list(inputs), edges) for k, m in enumerate(models)}, fit.finished(rows)


def artifact(model: Model, base: float, trees: Sequence[Tree], inputs: list[str], edges: dict[str, list[float]]) -> dict:
    """A model of values in place of bins: rows go left where the input is at most the threshold."""
    place = {inputs.index(n): k for k, n in enumerate(model.inputs)}
    out = []
    for tree in trees:
        threshold = [(edges[inputs[f]] + [np.inf])[min(c, len(edges[inputs[f]]))] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)]
        out.append({"feature": [place.get(f, -1) for f in tree.feature], "threshold": [float(x) for x in threshold], "left": list(tree.left), "right": list(tree.right), "value": [float(v) for v in tree.value]})
    return {"base": float(base), "inputs": list(model.inputs), "trees": out}


def depth_of(tree: dict) -> int:
    deep = [0] * len(tree["value"])
    for k, f in enumerate(tree["feature"]):
        if f >= 0:
            deep[tree["left"][k]] = deep[tree["right"][k]] = deep[k] + 1
    return max(deep)


def complete(tree: dict, depth: int) -> tuple[list[int], list[float], list[float]]:
    """Features and thresholds of the inner nodes of a complete tree (children of k at 2 k + 1 and 2 k + 2), and its leaves."""
    feature, threshold, at = [0] * (2**depth - 1), [float("inf")] * (2**depth - 1), [0]
    for k in range(2**depth - 1):
        node = at[k]
        if tree["feature"][node] >= 0:
            feature[k], threshold[k] = tree["feature"][node], tree["threshold"][node]
            at += [tree["left"][node], tree["right"][node]]
        else:
            at += [node, node]
    return feature, threshold, [tree["value"][n] for n in at[2**depth - 1 :]]


#: Inner nodes of a model that are written out as an expression of their own at most; more are walked in arrays.
WRITTEN_NODES = 4096


def tree_score(features: list[Column], model: dict) -> Column:
    """The prediction of a fitted model as an expression; a missing input counts 0.

    The inputs are an array, so they are worked out once for each row and not at each node. Small models are nested conditions on
    whole Arrow batches; those of more nodes are walked in literal arrays of features, thresholds and leaves.
    """
    x = F.array(*[F.coalesce(F.nullif(f.cast("double"), F.lit(float("nan"))), F.lit(0.0)) for f in features])
    base, trees = F.lit(float(model["base"])), model["trees"]
    if not trees:
        return base
    if sum(len(t["feature"]) // 2 for t in trees) > WRITTEN_NODES:
        return F.get(F.transform(F.array(x), lambda own: base + walked(own, trees)), F.lit(0))

    width = len(features)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        own = rows.flatten().to_numpy().reshape(-1, width).T

        def nested(t: dict, k: int) -> np.ndarray | float:
            if t["feature"][k] < 0:
                return float(t["value"][k])
            return np.where(own[t["feature"][k]] <= float(t["threshold"][k]), nested(t, t["left"][k]), nested(t, t["right"][k]))

        total = np.full(own.shape[1], float(model["base"]))
        for t in trees:
            total = total + nested(t, 0)
        return pa.array(total)

    return score(x)


def walked(x: Column, trees: Sequence[dict]) -> Column:
    """The sum of trees, walked in arrays: trees of one depth lie as complete trees one after the other, and a step down doubles
    the place and looks up one feature and one threshold."""
    total = F.lit(0.0)
    groups: dict[int, list[dict]] = {}
    for t in trees:
        groups.setdefault(depth_of(t), []).append(t)
    for depth, own in sorted(groups.items()):
        parts = [complete(t, depth) for t in own]
        if not depth:
            total = total + sum(p[2][0] for p in parts)
            continue
        feature = F.expr(f"array({', '.join(str(f) for p in parts for f in p[0])})")
        threshold, value = (F.expr(f"array({', '.join(number(v) for p in parts for v in p[k])})") for k in (1, 2))
        total = total + _walked(x, feature, threshold, value, len(own), depth)
    return total


def _walked(x: Column, feature: Column, threshold: Column, value: Column, trees: int, depth: int) -> Column:
    inner = 2**depth - 1

    def add(total: Column, t: Column) -> Column:
        step = lambda at, _: 2 * at + F.when(F.get(x, F.get(feature, t * inner + at)) <= F.get(threshold, t * inner + at), 1).otherwise(2)
        return total + F.get(value, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) + t * (inner + 1) - inner)

    return F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.lit(0.0), add)


def number(x: float) -> str:
    return "double('Infinity')" if np.isinf(x) else f"double('{float(x)!r}')"


def fold_prediction(models: Sequence[Model], names: dict[int, str]) -> Column:
    """From the rows of boost(): the prediction of the model whose held fold is the row's; names: fold to model."""
    at = {m.name: k for k, m in enumerate(models)}
    out = F.lit(None).cast("double")
    for held, name in names.items():
        out = F.when(F.col("fold") == held, F.get("p", F.lit(at[name]))).otherwise(out)
    return out
