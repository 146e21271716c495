"""Linear models from weighted moments: one pass over the rows, then everything on matrices of the number of inputs squared.

Each fold's products of (1, inputs, labels) with each other are summed once, in Arrow batches inside the tasks; a training
set is all folds but one. Since a linear model's predictions are linear in the inputs, correlations and errors of
out-of-fold predictions come from the same moments: sweeps over penalties, inputs and weights read the rows once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """For each group (a fold, or a fold and a source) the matrix of weighted products of (1, *names)."""

    names: list[str]
    by: dict[tuple, np.ndarray] = field(default_factory=dict)

    def total(self, keep=lambda group: True) -> np.ndarray:
        m = len(self.names) + 1
        return sum((x for g, x in self.by.items() if keep(g)), np.zeros((m, m)))

    def part(self, names: Sequence[str]) -> Moments:
        at = [0, *(self.names.index(n) + 1 for n in names)]
        return Moments(list(names), {g: x[np.ix_(at, at)] for g, x in self.by.items()})

    def reweighted(self, weight) -> Moments:
        """Groups times a weight each: source weights need no second pass."""
        return Moments(self.names, {g: x * weight(g) for g, x in self.by.items()})


def moments(rows: DataFrame, names: list[str], groups: list[str], weight: Column | None = None, vector: str | None = None, dim: int = 0) -> Moments:
    """Moments of columns, and of the first `dim` places of a vector column as v0, v1, ..., by groups.

    Rows with a null in a name or group, or a shorter vector, take no part. A task keeps one matrix a group; a matrix's rows
    are summed by (group, row) in the shuffle, so the driver gets one matrix for each group.
    """
    numbers = F.array(*[F.col(c).cast("double") for c in names]) if names else F.array().cast("array<double>")
    inputs = numbers if vector is None else F.concat(numbers, F.slice(F.col(vector).cast("array<double>"), 1, dim))
    every = [*names, *(f"v{k}" for k in range(dim if vector else 0))]
    m = len(every) + 1
    w = F.lit(1.0) if weight is None else weight.cast("double")
    source = rows.select(F.to_json(F.struct(*[F.col(g).alias(f"g{k}") for k, g in enumerate(groups)])).alias("g"), w.alias("w"), inputs.alias("x"), *[F.col(g) for g in groups])
    source = source.dropna().where((F.size("x") == m - 1) & ~F.exists("x", lambda v: v.isNull())).select("g", "w", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([np.ones((batch.num_rows, 1)), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, m - 1)], 1)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            for k, g in enumerate(coded.dictionary.to_pylist()):
                own = x[code == k]
                total[g] = total.get(g, 0) + (own * w[code == k, None]).T @ own
        for g, matrix in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * m, pa.string()), pa.array(np.arange(m, dtype=np.int32)), pa.array(list(matrix), pa.list_(pa.float64()))], ["g", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, m).sum(0)
        return pa.table({"g": table.column("g").slice(0, 1), "i": table.column("i").slice(0, 1), "row": pa.array([rows], pa.list_(pa.float64()))})

    schema = "g string, i int, row array<double>"
    summed = source.mapInArrow(run, schema).groupBy("g", "i").applyInArrow(add, schema).toArrow()
    out = Moments(every)
    import json

    for g, i, row in zip(summed.column("g").to_pylist(), summed.column("i").to_pylist(), summed.column("row").to_pylist(), strict=True):
        key = tuple(json.loads(g).values())
        out.by.setdefault(key, np.zeros((m, m)))[i] = row
    return out


def centred(total: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, means and centred products."""
    weight = total[0, 0]
    mean = total[0, 1:] / weight if weight > 0 else np.zeros(len(total) - 1)
    return weight, mean, total[1:, 1:] - weight * np.outer(mean, mean)


def ridge(total: np.ndarray, alpha: float, targets: int = 1) -> np.ndarray:
    """Intercept and coefficients of the last `targets` names on those before; the intercept is not penalised.

    Without weight all are 0. A column for each target; one target gives a vector.
    """
    weight, mean, c = centred(total)
    k = len(mean) - targets
    if weight <= 0:
        beta = np.zeros((k + 1, targets))
    else:
        coef = np.linalg.lstsq(c[:k, :k] + alpha * np.eye(k), c[:k, k:], rcond=None)[0]
        beta = np.concatenate([(mean[k:] - mean[:k] @ coef)[None], coef])
    return beta[:, 0] if targets == 1 else beta


def bounded(total: np.ndarray, lower: np.ndarray, upper: np.ndarray, alpha: float = 0.0, l1: float = 0.0, intercept: bool = True, scaled: bool = False, steps: int = 2000) -> np.ndarray:
    """Least squares within bounds by coordinate descent, with an l2 penalty alpha and an l1 penalty on each coefficient.

    scaled: inputs are standardised first and the scaler is folded back into the coefficients.
    """
    weight, mean, c = centred(total)
    if not intercept:
        mean, c = np.zeros_like(mean), total[1:, 1:].copy()
    k = len(mean) - 1
    beta = np.zeros(k)
    if weight <= 0:
        return np.zeros(k + 1)
    scale = np.sqrt(np.maximum(np.diag(c)[:k] / weight, 0)) if scaled else np.ones(k)
    scale[scale == 0] = 1
    a, b = c[:k, :k] / np.outer(scale, scale), c[:k, k] / scale
    low, high = lower * scale, upper * scale
    for _ in range(steps):
        change = 0.0
        for j in range(k):
            size = a[j, j] + alpha
            if size <= 1e-12:
                continue
            r = b[j] - a[j] @ beta + a[j, j] * beta[j]
            new = min(max(np.sign(r) * max(abs(r) - l1, 0.0) / size, low[j]), high[j])
            change = max(change, abs(new - beta[j]) * size)
            beta[j] = new
        if change < 1e-10 * max(1.0, abs(b).max(initial=0)):
            break
    beta = beta / scale
    return np.concatenate([[mean[k] - beta @ mean[:k] if intercept else 0.0], beta])


def elastic_net(total: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """1 / (2n) squared error + alpha * (l1_ratio |b| + (1 - l1_ratio) / 2 b^2)."""
    n, k = total[0, 0], len(total) - 2
    free = np.full(k, np.inf)
    return bounded(total, -free, free, alpha * (1 - l1_ratio) * n, alpha * l1_ratio * n)


def line(names: Sequence[str], beta: Sequence[float], vector: str | None = None) -> Column:
    """A model's prediction as an expression; v0, v1, ... are places of the vector column."""
    plain = [(n, b) for n, b in zip(names, beta[1:], strict=True) if vector is None or n not in _places(names)]
    out = F.lit(float(beta[0]))
    for n, b in plain:
        out = out + F.col(n).cast("double") * float(b)
    if vector is not None:
        coef = [float(b) for n, b in zip(names, beta[1:], strict=True) if n in _places(names)]
        if coef:
            out = out + F.aggregate(F.zip_with(F.slice(F.col(vector), 1, len(coef)), F.array(*map(F.lit, coef)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return out


def _places(names: Sequence[str]) -> set[str]:
    return {n for n in names if n[0] == "v" and n[1:].isdigit()}


def by_fold(fold: str, models: dict, of) -> Column:
    """The model of a row's fold, as an expression; null for other folds."""
    out = F.lit(None).cast("double")
    for value, model in models.items():
        out = F.when(F.col(fold) == value, of(model)).otherwise(out)
    return out


def fold_models(m: Moments, fit) -> dict:
    """For each fold (the first of a group's keys) the model of all other folds."""
    return {fold: fit(m.total(lambda g, f=fold: g[0] != f)) for fold in sorted({g[0] for g in m.by}, key=str)}


def out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str, alpha: float = 1.0, weight: Column | None = None) -> DataFrame:
    """The rows with `prediction` by a ridge model of the other folds; null where a feature or the fold is null."""
    models = fold_models(moments(rows, [*features, label], [fold], weight), lambda t: ridge(t, alpha))
    return rows.withColumn("prediction", by_fold(fold, models, lambda b: line(features, b)))


def scores_of(m: Moments, models: dict, human=None) -> dict[str, float]:
    """Correlations and error of out-of-fold predictions from moments: cv, human, synth, their fold deviation, mse.

    m's names are the inputs and one label; its groups (fold,) or (fold, source). Weights of m are left out of the scores by
    giving unweighted moments here.
    """

    def sums(keep) -> np.ndarray:
        out = np.zeros((3, 3))  # of (1, prediction, label)
        for g, x in m.by.items():
            if keep(g):
                lift = np.zeros((3, len(x)))
                lift[0, 0] = 1
                lift[1, :-1] = models[g[0]]
                lift[2, -1] = 1
                out += lift @ x @ lift.T
        return out

    def corr(s: np.ndarray) -> float:
        n = s[0, 0]
        if n < 3:
            return 0.0
        c = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / n
        return float(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1])) if c[0, 0] > 1e-12 and c[1, 1] > 1e-12 else 0.0

    every = sums(lambda g: True)
    out = {"cv": corr(every), "mse": float((every[1, 1] - 2 * every[1, 2] + every[2, 2]) / every[0, 0]) if every[0, 0] else 0.0}
    folds = sorted({g[0] for g in m.by}, key=str)
    if human is not None:
        out["human"], out["synth"] = corr(sums(lambda g: g[1] == human)), corr(sums(lambda g: g[1] != human))
        own = [corr(sums(lambda g, f=f: g[0] == f and g[1] == human)) for f in folds]
        out["fold_std"] = float(np.std(own)) if own else 0.0
    return out


def source_weights(counts: dict[str, int], human: str, kind: str = "training", multiplier: float = 1.0) -> dict[str, float]:
    """A weight for each source: training (others 0.3 * n_h / n_s), equal (human n_s / n_h) or multiplier (human)."""
    n_h, n_s = counts.get(human, 0), sum(n for s, n in counts.items() if s != human)
    if kind == "training":
        return {s: 1.0 if s == human else (0.3 * n_h / n_s if n_s else 1.0) for s in counts}
    if kind == "equal":
        return {s: (n_s / n_h if n_h and n_s else 1.0) if s == human else 1.0 for s in counts}
    if kind == "multiplier":
        return {s: multiplier if s == human else 1.0 for s in counts}
    raise ValueError(f"unknown weighting {kind}")


def strongest(m: Moments, label: str, k: int, keep=lambda g: True) -> list[str]:
    """The k inputs of the largest correlation with the label, ties by name.

    Chosen before folds: the choice has seen the validation labels.
    """
    _, _, c = centred(m.total(keep))
    at = m.names.index(label)
    size = np.sqrt(np.maximum(np.diag(c), 0))
    r = {n: abs(c[i, at] / (size[i] * size[at])) if size[i] > 1e-9 and size[at] > 1e-9 else 0.0 for i, n in enumerate(m.names) if i != at}
    return sorted(r, key=lambda n: (-r[n], n))[:k]


def dual_objective(s: dict[str, float], most_gap: float = 1.0) -> float:
    unit = lambda x: max(0.0, min(1.0, x))
    return 0.5 * unit(s["cv"]) + 0.3 * unit(s["human"]) + 0.2 * max(0.0, 1 - abs(s["human"] - s["synth"]) / most_gap)


def human_objective(s: dict[str, float], floor: float = 0.5) -> float:
    """-1 below the floor of the overall correlation; else mostly the human one, with a bonus for even folds."""
    if s["cv"] < floor:
        return -1.0
    unit = lambda x: max(0.0, min(1.0, x))
    return 0.60 * unit(s["human"]) + 0.25 * unit(s["cv"]) + 0.15 * max(0.0, 1 - s["fold_std"] / 0.3)


def sweep(spark, plain: Moments, label: str, human: str, models: dict[str, list[dict]], weightings: Sequence[str] = ("none", "training", "equal")) -> DataFrame:
    """(kind, config, weighting, cv, human, synth, fold_std, mse, non_zero, objective): every configuration of every kind.

    plain: moments by (fold, source) of all inputs and the label. models: kind (ridge, lasso, elastic_net) to its settings;
    a setting may name its `inputs`. All of it runs on the driver on matrices; the rows were read once.
    """
    counts: dict[str, int] = {}
    for g, x in plain.by.items():
        counts[g[1]] = counts.get(g[1], 0) + int(round(x[0, 0]))
    out = []
    for kind, settings in models.items():
        for setting, weighting in itertools.product(settings, weightings):
            inputs = setting.get("inputs", [n for n in plain.names if n != label])
            m = plain.part([*inputs, label])
            w = source_weights(counts, human, weighting) if weighting != "none" else dict.fromkeys(counts, 1.0)
            fit = (lambda t, a=setting["alpha"]: ridge(t, a)) if kind == "ridge" else (lambda t, a=setting["alpha"], r=setting.get("l1_ratio", 1.0): elastic_net(t, a, r))
            s = scores_of(m, fold_models(m.reweighted(lambda g, w=w: w[g[1]]), fit), human)
            non_zero = int((np.abs(fit(m.total())[1:]) > 1e-9).sum())
            config = ",".join(f"{k}={len(v) if k == 'inputs' else v}" for k, v in sorted(setting.items()))
            out.append((kind, config, weighting, *(float(s[c]) for c in ("cv", "human", "synth", "fold_std", "mse")), non_zero, float(dual_objective(s))))
    return spark.createDataFrame(out, "kind string, config string, weighting string, cv double, human double, synth double, fold_std double, mse double, non_zero int, objective double")


class Spectrum:
    """Ridge of any penalty from one eigendecomposition of a training set's centred products."""

    def __init__(self, total: np.ndarray, targets: int = 1):
        self.weight, self.mean, c = centred(total)
        self.k = len(self.mean) - targets
        self.values, self.vectors = np.linalg.eigh(c[: self.k, : self.k])
        self.on = self.vectors.T @ c[: self.k, self.k :]

    def ridge(self, alpha: float) -> np.ndarray:
        """As ridge(): intercept and coefficients, a column for each target; directions without spread get no coefficient."""
        if self.weight <= 0:
            return np.zeros((self.k + 1, self.on.shape[1]))
        least = max(self.values.max(initial=0.0), 0.0) * self.k * np.finfo(float).eps
        size = np.maximum(self.values, 0) + alpha
        inverse = np.where(size > least, 1 / np.where(size > least, size, 1.0), 0.0)
        coef = self.vectors @ (self.on * inverse[:, None])
        return np.concatenate([(self.mean[self.k :] - self.mean[: self.k] @ coef)[None], coef])


def path(total: np.ndarray, penalties: Sequence[tuple[float, float]], steps: int = 2000) -> list[np.ndarray]:
    """Elastic nets of (alpha, l1_ratio) on one training set, each started from the one before; give them from strong to weak.

    Coordinate descent with running residual products: a step that changes nothing costs one look.
    """
    weight, mean, c = centred(total)
    k = len(mean) - 1
    if weight <= 0:
        return [np.zeros(k + 1) for _ in penalties]
    a, b = c[:k, :k] / weight, c[:k, k] / weight
    diagonal, beta, rest = np.diag(a).copy(), np.zeros(k), b.copy()  # rest = b - a @ beta
    out = []
    for alpha, ratio in penalties:
        l1, l2 = alpha * ratio, alpha * (1 - ratio)
        active = range(k)
        for _ in range(steps):
            change = 0.0
            for j in active:
                if diagonal[j] + l2 <= 1e-12:
                    continue
                r = rest[j] + diagonal[j] * beta[j]
                new = (r - l1 if r > l1 else r + l1 if r < -l1 else 0.0) / (diagonal[j] + l2)
                if new != beta[j]:
                    change = max(change, abs(new - beta[j]) * diagonal[j])
                    rest -= a[:, j] * (new - beta[j])
                    beta[j] = new
            small = change < 1e-9 * max(1e-12, abs(b).max(initial=0))
            if small and len(active) == k:
                break
            # Passes over the inputs in use, until they stand; then one over all.
            active = range(k) if small or len(active) != k and change == 0 else np.flatnonzero(beta)
            if not len(active):
                active = range(k)
        out.append(np.concatenate([[mean[k] - beta @ mean[:k]], beta]))
    return out


def vector_sweep(spark, plain: Moments, places: Sequence[str], dimensions: Sequence[str], features: Sequence[str], label: str, human: str, settings: dict[str, list], weightings: dict[str, dict[str, float]]) -> DataFrame:
    """(arch, config, weighting, cv, human, synth, fold_std, mse, non_zero, objective) of direct, dimension and hybrid models.

    plain: moments by (fold, source) of vector places, features, dimensions and the label: the rows were read once. settings:
    ridge and lasso (alphas), elastic_net ((alpha, l1_ratio)), dimension ((alpha, combiner alpha)), hybrid ((number of the features
    that go best with human labels, alpha)). Every
    training set is decomposed once for all its ridge penalties, and lasso and elastic net go down a path. A dimension
    model's combiner is fitted on out-of-fold predictions, which are linear in the vector, so its moments follow from these.
    """
    folds = sorted({g[0] for g in plain.by})
    out = []

    def note(arch: str, config: str, weighting: str, m: Moments, models: dict, non_zero: int) -> None:
        s = scores_of(m, models, human)
        out.append((arch, config, weighting, *(float(s[c]) for c in ("cv", "human", "synth", "fold_std", "mse")), non_zero, human_objective(s)))

    direct = plain.part([*places, label])
    widths = {k: strongest(plain.part([*features, label]), label, k, lambda g: g[1] == human) for k in sorted({k for k, _ in settings.get("hybrid", ())})}
    dims = plain.part([*places, *dimensions])
    for name, weight in weightings.items():
        of = lambda m, w=weight: m.reweighted(lambda g: w.get(g[1], 0.0))
        held = lambda m, f: m.total(lambda g: g[0] != f)
        with_features = [(f"k={k},", plain.part([*places, *own, label]), [a for j, a in settings["hybrid"] if j == k]) for k, own in widths.items()]
        for arch, prefix, m, alphas in (("ridge", "", direct, settings.get("ridge", ())), *(("hybrid", *h) for h in with_features)):
            spectra = {f: Spectrum(held(of(m), f)) for f in folds}
            for alpha in alphas:
                note(arch, f"{prefix}alpha={alpha:g}", name, m, {f: s.ridge(alpha)[:, 0] for f, s in spectra.items()}, len(m.names) - 1)
        for arch, penalties in (("lasso", [(a, 1.0) for a in settings.get("lasso", ())]), ("elastic_net", list(settings.get("elastic_net", ())))):
            ratios = sorted({r for _, r in penalties})
            for ratio in ratios:
                own = sorted((p for p in penalties if p[1] == ratio), reverse=True)
                paths = {f: path(held(of(direct), f), own) for f in folds}
                whole = path(direct.total(), own)
                for i, (alpha, _) in enumerate(own):
                    config = f"alpha={alpha:g}" + (f",l1_ratio={ratio:g}" if arch == "elastic_net" else "")
                    note(arch, config, name, direct, {f: p[i] for f, p in paths.items()}, int((np.abs(whole[i][1:]) > 1e-10).sum()))
        spectra = {f: Spectrum(held(of(dims), f), len(dimensions)) for f in folds} if settings.get("dimension") else {}
        for alpha in sorted({a for a, _ in settings.get("dimension", ())}):
            first = {f: s.ridge(alpha) for f, s in spectra.items()}
            lifted = Moments([*dimensions, label])
            for g, x in direct.by.items():
                lift = np.zeros((len(dimensions) + 2, len(x)))
                lift[0, 0] = lift[-1, -1] = 1
                lift[1:-1, :-1] = first[g[0]].T
                lifted.by[g] = lift @ x @ lift.T
            for c in [c for a, c in settings["dimension"] if a == alpha]:
                second = fold_models(of(lifted), lambda t, c=c: ridge(t, c))
                note("dimension", f"alpha={alpha:g},combiner={c:g}", name, lifted, second, len(dimensions))
    return spark.createDataFrame(out, "arch string, config string, weighting string, cv double, human double, synth double, fold_std double, mse double, non_zero int, objective double")


def two_stage(rows: DataFrame, vector: str, dim: int, dimensions: list[str], features: list[str], label: str, fold: str, alphas: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """The rows with each dimension's out-of-fold prediction (<name>_oof) and `prediction` by a combiner of them.

    Two passes: dimensions from the vector, then the combiner's moments of their out-of-fold predictions. Predictions of
    dimensions are within 1 and 5, as they are when a text is scored.
    """
    first = moments(rows, dimensions, [fold], None, vector, dim)
    places = [f"v{k}" for k in range(dim)]
    m = first.part([*places, *dimensions])
    models = fold_models(m, lambda t: ridge(t, alphas[0], len(dimensions)))
    oof = rows.withColumns({
        f"{d}_oof": F.least(F.greatest(by_fold(fold, models, lambda b, k=k: line(places, b[:, k] if b.ndim > 1 else b, vector)), F.lit(1.0)), F.lit(5.0)) for k, d in enumerate(dimensions)
    })
    inputs = [*(f"{d}_oof" for d in dimensions), *features]
    return out_of_fold(oof, inputs, label, fold, alphas[1])


def final_fit(rows: DataFrame, vector: str, dim: int, dimensions: list[str], features: list[str], label: str, alphas: tuple[float, float] = (0.1, 10.0)) -> dict[str, dict]:
    """Artifacts of a two-stage model of all rows: the combiner is fitted on in-sample, unclamped, unweighted predictions.

    These are linear in the vector, so the combiner's moments follow from the first stage's: one pass in all.
    """
    places = [f"v{k}" for k in range(dim)]
    m = moments(rows.withColumn("_all", F.lit(0)), [*dimensions, *features, label], ["_all"], None, vector, dim)
    first = ridge(m.part([*places, *dimensions]).total(), alphas[0], len(dimensions)).reshape(dim + 1, -1)
    whole = m.part([*places, *features, label]).total()
    lift = np.zeros((1 + len(dimensions) + len(features) + 1, len(whole)))
    lift[0, 0] = 1
    lift[1 : len(dimensions) + 1, : dim + 1] = first.T
    lift[len(dimensions) + 1 :, dim + 1 :] = np.eye(len(features) + 1)
    beta = ridge(lift @ whole @ lift.T, alphas[1])
    out = {d: {"coef": first[1:, k].tolist(), "intercept": float(first[0, k])} for k, d in enumerate(dimensions)}
    return out | {"combiner": {"architecture": "subscore_embedding_v7", "coef": beta[1:].tolist(), "intercept": float(beta[0]), "dimension_names": dimensions, "feature_names": features}}


def scaled_ridge(total: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge on standardised inputs, with the scaler folded into raw coefficients."""
    k = len(total) - 2
    free = np.full(k, np.inf)
    return bounded(total, -free, free, alpha, scaled=True)


def signed_bounds(names: Sequence[str], signs: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of coefficients by a contract of signs; 0 or none leaves a coefficient free."""
    s = np.array([signs.get(n, 0) for n in names])
    return np.where(s > 0, 0.0, -np.inf), np.where(s < 0, 0.0, np.inf)


def uplift(rows: DataFrame, base: str, target: str, features: list[str], false_low: Column, weights: tuple[float, float] = (50.0, 2.0), most: float = 40.0) -> tuple[list[float], Column]:
    """Non-negative coefficients of a correction towards max(0, target - base), and the corrected score.

    False lows weigh `weights[1]` times 1 and rows that need no uplift `weights[0]` times 1, so the rest stays as it is.
    """
    gap = F.greatest(F.col(target) - F.col(base), F.lit(0.0))
    weight = F.when(gap <= 0, weights[0]).when(false_low, weights[1]).otherwise(1.0)
    m = moments(rows.withColumns({"_gap": gap, "_all": F.lit(0)}), [*features, "_gap"], ["_all"], weight)
    k = len(features)
    beta = bounded(m.total(), np.zeros(k), np.full(k, np.inf), intercept=False)
    more = F.least(F.greatest(line(features, beta), F.lit(0.0)), F.lit(most))
    return [float(b) for b in beta[1:]], F.least(F.greatest(F.col(base) + more, F.lit(0.0)), F.lit(100.0))


def ordinal(rows: DataFrame, features: list[str], label: str, fold: str, thresholds: Sequence[float], alpha: float = 1.0) -> DataFrame:
    """The rows with `prediction`: 1 plus the clipped out-of-fold predictions that the label exceeds each threshold.

    All binary labels share one pass and one matrix.
    """
    flags = {f"_t{k}": (F.col(label) > t).cast("double") for k, t in enumerate(thresholds)}
    marked = rows.withColumns(flags)
    m = moments(marked, [*features, *flags], [fold])
    models = fold_models(m, lambda t: ridge(t, alpha, len(flags)))
    parts = [by_fold(fold, models, lambda b, k=k: line(features, b[:, k] if b.ndim > 1 else b)) for k in range(len(flags))]
    return rows.withColumn("prediction", sum((F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) for p in parts), F.lit(1.0)))


def noisy_labels(rows: DataFrame, label: str, key: str, copies: int = 3, sigma: float = 0.5, seed: int = 42) -> DataFrame:
    """Each row `copies` times, all but the first with Gaussian noise on the label, within 1 and 10; noise by a hash of the key."""
    uniform = lambda salt: (F.pmod(F.xxhash64(key, "_copy", F.lit(seed * 2 + salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * np.pi * uniform(1))
    many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    noisy = F.least(F.greatest(F.col(label) + sigma * normal, F.lit(1.0)), F.lit(10.0))
    return many.withColumn(label, F.when(F.col("_copy") == 0, F.col(label).cast("double")).otherwise(noisy)).drop("_copy")


def uncertainty_weight(std: Column) -> Column:
    return 1 / (std + 0.1)


def rank_regression(rows: DataFrame, features: list[str], label: str, fold: str, alpha: float = 0.1, knots: int = 101) -> DataFrame:
    """The rows with `prediction`: ridge on percentile ranks of the label, turned back by the label's quantiles.

    Ranks are over all rows; the inverse goes through `knots` exact quantiles.
    """
    from textweave.operators.ordering import average_ranks, quantiles
    from textweave.operators.scoring import isotonic

    n = rows.where(F.col(label).isNotNull()).count()
    ranked = rows.join(average_ranks(rows.where(F.col(label).isNotNull()), [], label, "_rank"), label).withColumn("_rank", F.col("_rank") / F.lit(max(1, n)))
    fitted = out_of_fold(ranked, features, "_rank", fold, alpha)
    at = [k / (knots - 1) for k in range(knots)]
    return fitted.withColumn("prediction", isotonic(F.col("prediction"), at, quantiles(rows, label, at))).drop("_rank")


def huber(rows: DataFrame, features: list[str], label: str, epsilon: float = 1.35, alpha: float = 0.0) -> tuple[float, list[float]]:
    """Intercept and coefficients of a linear model with Huber's loss, by Spark's own solver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=features, outputCol="f").transform(rows.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("label")).dropna())
    model = LinearRegression(featuresCol="f", loss="huber", epsilon=epsilon, regParam=alpha, maxIter=100).fit(x)
    return float(model.intercept), [float(c) for c in model.coefficients]


def pairwise(pairs: DataFrame, rows: DataFrame, key: str, features: list[str], label: str, alpha: float = 1.0) -> tuple[list[float], Column]:
    """Coefficients of ridge without intercept on differences of pairs (high, low, confidence), and the score on the label's
    scale by least squares on all rows."""
    side = lambda c: rows.select(F.col(key).alias(c), *[F.col(f).cast("double").alias(f"{c}_{f}") for f in features])
    diff = pairs.join(side("high"), "high").join(side("low"), "low").select(*[(F.col(f"high_{f}") - F.col(f"low_{f}")).alias(f) for f in features], F.lit(1.0).alias("_one"), F.lit(0).alias("_all"), "confidence")
    k = len(features)
    free = np.full(k, np.inf)
    w = bounded(moments(diff, [*features, "_one"], ["_all"], F.col("confidence")).total(), -free, free, alpha, intercept=False)
    whole = moments(rows.withColumn("_all", F.lit(0)), [*features, label], ["_all"]).total()
    lift = np.zeros((3, k + 2))
    lift[0, 0] = lift[2, -1] = 1
    lift[1, 1:-1] = w[1:]
    a = ridge(lift @ whole @ lift.T, 0.0)
    return [float(x) for x in w[1:]], line(features, [a[0], *(a[1] * w[1:])])


def subset_scores(m: Moments, label: str, subsets: dict[str, list[str]], alpha: float, human: str) -> list[tuple[str, float, float]]:
    """(name, cv, human) of ridge on each subset of inputs: leave-one-out, groups, best subsets, inputs of a combiner."""
    out = []
    for name, inputs in subsets.items():
        part = m.part([*inputs, label])
        s = scores_of(part, fold_models(part, lambda t: ridge(t, alpha)), human)
        out.append((name, s["cv"], s["human"]))
    return out


def leave_one_out(names: Sequence[str]) -> dict[str, list[str]]:
    return {"all": list(names)} | {f"without {n}": [x for x in names if x != n] for n in names}


def leave_module_out(names: Sequence[str]) -> dict[str, list[str]]:
    modules = sorted({n.split("_")[0] for n in names})
    return {"all": list(names)} | {f"without {m}": [n for n in names if n.split("_")[0] != m] for m in modules}


def best_subsets(names: Sequence[str], size: int) -> dict[str, list[str]]:
    return {"+".join(c): list(c) for c in itertools.combinations(names, size)}


def evaluated_weights(rows: DataFrame, score: Column, label: str, source: str, fold: str, human: str) -> DataFrame:
    """One row for a weighting of features: val, cv, cv_std, mse against labels on 0 to 100, mean and deviation, by source.

    Sources weigh alike in val and cv: human rows by n_s / n_h.
    """
    from textweave.functions.vectors import safe_corr

    counts = {r[0]: r[1] for r in rows.groupBy(source).count().collect()}  # a few sources
    weight = source_weights(counts, human, "equal")[human] if human in counts else 1.0
    scored = rows.withColumns({"_s": score, "_w": F.when(F.col(source) == human, weight).otherwise(1.0)})
    folds = scored.groupBy(fold).agg(safe_corr("_s", label, F.col("_w")).alias("r")).agg(F.avg("r").alias("cv"), F.stddev_pop("r").alias("cv_std")).first()
    h = F.col(source) == human
    gap = F.col("_s") - (F.col(label) - 1) / 9 * 100
    parts = scored.withColumns({"_h": F.when(h, F.col("_s")), "_o": F.when(~h, F.col("_s"))})
    one = parts.agg(safe_corr("_s", label, F.col("_w")).alias("val"), F.avg(gap * gap).alias("mse"), F.avg("_s").alias("score_mean"), F.stddev_pop("_s").alias("score_std"), safe_corr("_h", label).alias("human"), safe_corr("_o", label).alias("synth"))
    return one.select("*", F.lit(folds.cv).alias("cv"), F.lit(folds.cv_std).alias("cv_std"))


def bottleneck(linear: float, tree: float) -> str:
    """Whether the model or the data limits: by how much trees beat the linear model."""
    gap = tree - linear
    return "model" if gap > 0.05 else "moderate headroom" if gap > 0.02 else "data"
