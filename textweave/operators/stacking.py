"""Stacked boosted-tree pipelines: trees by module or by dimension out of fold, a ridge combiner of them, a blend with a linear
score; and the scores of the artifacts that such a pipeline leaves behind.

All recipes are fitted side by side (operators/boosting.py). The combiners and every figure come from one pass of moments of
the out-of-fold columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators import boosting, serving, training

MODULES = ("ce", "se", "ne", "cle", "bc")
#: Dimensions of the models before the vector models (fixed names).
LEGACY_DIMENSIONS = ("continuity", "topic_focus", "contradiction_integration", "cognitive_clarity", "narrative_closure")
BY_DIMENSION = ("dimension_aligned_v3", "ensemble_v5", "hybrid_v6")


@dataclass(frozen=True)
class Recipe:
    """parts: (name, inputs, target) of each stacked model. Blends are shares of a linear score beside the trees."""

    version: str
    config: str
    parts: tuple[tuple[str, tuple[str, ...], str], ...]
    weights: tuple[tuple[str, float], ...]
    architecture: str = "module_aligned_v1"
    depth: int = 3
    rounds: int = 20
    rate: float = 0.1
    stop: int | None = None
    alpha: float = 1.0
    blends: tuple[float, ...] = ()

    def model(self, part: int, held: int | None) -> boosting.Model:
        name, inputs, target = self.parts[part]
        return boosting.Model(f"{self.version}|{self.config}|{name}|{held}", inputs, target, held, self.weights, self.depth, self.rounds, self.rate, 1.0, self.stop if held is not None else None)


def by_module(features: Sequence[str], target: str) -> tuple[tuple[str, tuple[str, ...], str], ...]:
    """A part for each prefix of the features' names."""
    names = sorted({f.split("_")[0] for f in features})
    return tuple((m, tuple(sorted(f for f in features if f.split("_")[0] == m)), target) for m in names)


def by_dimension(features: Sequence[str], dimensions: Sequence[str]) -> tuple[tuple[str, tuple[str, ...], str], ...]:
    """A part for each dimension, of all features in order of name."""
    return tuple((d, tuple(sorted(features)), d) for d in dimensions)


def preselected(m: training.Moments, dimensions: Sequence[str], features: Sequence[str], human: str, alpha: float) -> list[str]:
    """The features to which a lasso on human rows gives a coefficient for any dimension; m: moments by (fold, source)."""
    chosen = set()
    for d in dimensions:
        beta = training.elastic_net(m.part([*features, d]).total(lambda g: g[1] == human), alpha, 1.0)
        chosen |= {f for f, b in zip(features, beta[1:], strict=True) if abs(b) > 1e-6}
    return sorted(chosen)


def correlation(total: np.ndarray, beta: np.ndarray) -> float:
    """Between a linear score of all names but the last, and the last, from their moments; 0 without spread."""
    lift = np.zeros((3, len(total)))
    lift[0, 0] = lift[2, -1] = 1
    lift[1, :-1] = beta
    s = lift @ total @ lift.T
    if s[0, 0] < 3:
        return 0.0
    c = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0]
    return float(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1])) if c[0, 0] > 1e-12 and c[1, 1] > 1e-12 else 0.0


def figures(m: training.Moments, weights: dict[str, float], human: str, alpha: float, blend: float | None = None, linear: bool = False) -> tuple[dict[str, float], np.ndarray]:
    """Figures of a combiner of m's names but the last, the label, and its coefficients on all rows; linear: the name before the
    label is a linear score, which takes no part in the combiner but in the blend.

    cv and fold_std are the mean correlation of held folds and the deviation of the human rows' in them; human and synth are
    those of the combiner of all rows.
    """
    weighted = m.reweighted(lambda g: weights.get(g[1], 0.0))
    inputs, label = m.names[: -2 if linear else -1], m.names[-1]

    def fit(keep) -> np.ndarray:
        beta = training.ridge(weighted.part([*inputs, label]).total(keep), alpha)
        if not linear:
            return beta
        share = blend or 0.0
        return np.append((1 - share) * beta, share)

    whole = fit(lambda g: True)
    held = {f: whole if linear and blend is not None else fit(lambda g, f=f: g[0] != f) for f in sorted({g[0] for g in m.by})}
    part = lambda keep, beta: correlation(m.total(keep), beta)
    own = [part(lambda g, f=f: g[0] == f and g[1] == human, b) for f, b in held.items()]
    out = {
        "cv": float(np.mean([part(lambda g, f=f: g[0] == f, b) for f, b in held.items()])) if held else 0.0,
        "human": part(lambda g: g[1] == human, whole), "synth": part(lambda g: g[1] != human, whole), "fold_std": float(np.std(own)) if own else 0.0,
    }
    return out, whole


def run(rows: DataFrame, recipes: Sequence[Recipe], features: Sequence[str], targets: Sequence[str], label: str, linear: str, fold: str, source: str, human: str = "human", final: bool = False, bins: int = boosting.BINS) -> tuple[list[dict], dict[str, dict]]:
    """A row of figures for each recipe and blend, and with `final` the artifacts of each recipe by `version|config`.

    targets holds the label; linear is the linear score on the label's scale. Rows with a null among them take no part.
    """
    found = [r[0] for r in rows.where(F.col(fold).isNotNull()).select(F.col(fold).cast("int")).distinct().collect()]  # a few folds
    held = [*sorted(found), *([None] if final else [])]
    models = [r.model(k, f) for r in recipes for k in range(len(r.parts)) for f in held]
    fitted, state = boosting.boost(rows, features, [*targets, linear], fold, source, models, human, bins)
    columns, names = [], {}
    for i, r in enumerate(recipes):
        for k in range(len(r.parts)):
            names[i, k] = f"o{i}_{k}"
            columns.append(boosting.fold_prediction(models, {f: r.model(k, f).name for f in held if f is not None}).alias(names[i, k]))
    at = [*targets, linear]
    table = state.select("fold", "source", *columns, F.get("y", F.lit(at.index(linear))).alias("_linear"), F.get("y", F.lit(at.index(label))).alias("_label"))
    m = training.moments(table, [*names.values(), "_linear", "_label"], ["fold", "source"])
    out, artifacts = [], {}
    for i, r in enumerate(recipes):
        own = [names[i, k] for k in range(len(r.parts))]
        for blend in (None, *r.blends):
            s, beta = figures(m.part([*own, *(["_linear"] if blend is not None else []), "_label"]), dict(r.weights), human, r.alpha, blend, blend is not None)
            trees = sum(len(fitted[r.model(k, f).name]["trees"]) for k in range(len(r.parts)) for f in held if f is not None)
            out.append({"version": r.version, "config": r.config, "blend": blend, "models": len(r.parts) * len(found), "trees": trees, **s, "objective": training.human_objective(s), "dual": training.dual_objective(s)})
            if final and blend is None:
                combiner = {"architecture": r.architecture, "intercept": float(beta[0]), "coef": [float(b) for b in beta[1:]], "module_names": [p[0] for p in r.parts]}
                artifacts[f"{r.version}|{r.config}"] = {p[0]: fitted[r.model(k, None).name] for k, p in enumerate(r.parts)} | {"combiner": combiner}
    return out, artifacts


def legacy_subscores(columns: Sequence[str], artifacts: dict[str, dict]) -> dict[str, Column]:
    """Each stacked model's prediction: of dimensions or of modules, by the artifacts' architecture. A feature that is not there
    counts 0; a model that is not there is an error."""
    by_dimension = serving.architecture(artifacts) in BY_DIMENSION
    names = LEGACY_DIMENSIONS if by_dimension else artifacts["combiner"].get("module_names", MODULES)
    missing = [n for n in names if n not in artifacts]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    value = lambda f: F.col(f) if f in columns else F.lit(0.0)
    return {n: boosting.tree_score([value(f) for f in artifacts[n]["inputs"]], artifacts[n]) for n in names}


def legacy_score(columns: Sequence[str], artifacts: dict[str, dict], subscores: dict[str, Column] | None = None) -> Column:
    """The combiner over the subscores, within 0 and 100; the ensemble's is put on 0 to 100 and blended with the linear score."""
    combiner = artifacts["combiner"]
    subscores = subscores or legacy_subscores(columns, artifacts)
    raw = sum((float(c) * s for c, s in zip(combiner["coef"], subscores.values(), strict=True)), F.lit(float(combiner["intercept"])))
    if serving.architecture(artifacts) != "ensemble_v5":
        return serving.within(raw)
    share = float(combiner.get("blend_alpha", 0.4))
    return serving.within(share * serving.linear_score(list(columns)) + (1 - share) * serving.within(serving.to_hundred(raw)))
