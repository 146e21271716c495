"""Pairwise ranking by a margin loss, and its blend with an absolute model.

The loss of a pair is its confidence times max(0, margin - score difference); a linear score is found by gradient steps with
moments of their own (Adam, decoupled weight decay). A step is one aggregation over the stored differences of the pairs:
sums of as many numbers as there are inputs reach the driver, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators import training
from textweave.sources.scratch import stored


def differences(pairs: DataFrame, rows: DataFrame, key: str, inputs: Sequence[str]) -> DataFrame:
    """(d_<input>, confidence, fold): inputs of the higher row less those of the lower, stored; fold is the rows' if both share it."""
    side = lambda c: rows.select(F.col(key).alias(c), F.col("fold").alias(f"fold_{c}"), *[F.col(f).cast("double").alias(f"{c}_{f}") for f in inputs])
    both = pairs.join(side("high"), "high").join(side("low"), "low")
    one = F.when(F.col("fold_high") == F.col("fold_low"), F.col("fold_high"))
    return stored(both.select(*[(F.col(f"high_{f}") - F.col(f"low_{f}")).alias(f"d_{f}") for f in inputs], F.col("confidence").cast("double").alias("confidence"), "fold_high", "fold_low", one.alias("fold")).dropna(subset=[*(f"d_{f}" for f in inputs), "confidence"]), "pairs")


def margin_loss(diff: DataFrame, inputs: Sequence[str], scale: Sequence[float], margin: float = 0.5, steps: int = 40, rate: float = 0.1, decay: float = 0.01, folds: Sequence[int] = ()) -> dict[int | None, np.ndarray]:
    """Weights of the inputs, for each fold from pairs that have no row in it, and under None from all pairs.

    All folds' models take their steps in one aggregation. scale: deviations by which inputs are divided while fitting. Pairs of
    no confidence and folds without pairs leave weights 0.
    """
    models: list[int | None] = [*folds, None]
    k, s = len(inputs), np.where(np.asarray(scale, float) > 0, scale, 1.0)
    w, m, v = (np.zeros((len(models), k)) for _ in range(3))
    use = [F.lit(True) if f is None else (F.col("fold_high") != f) & (F.col("fold_low") != f) for f in models]
    total = np.array([[x or 0.0 for x in diff.agg(*[F.sum(F.when(u, F.col("confidence"))) for u in use]).first()]]).T
    for step in range(1, steps + 1):
        sums = []
        for i, u in enumerate(use):
            score = sum((F.col(f"d_{f}") * float(x) for f, x in zip(inputs, w[i] / s, strict=True)), F.lit(0.0))
            short = F.when(u & (score < margin), F.col("confidence"))
            sums += [F.sum(short * F.col(f"d_{f}")) for f in inputs]
        found = np.array([x or 0.0 for x in diff.agg(*sums).first()]).reshape(len(models), k)
        g = -found / s / np.where(total > 0, total, 1.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w * (1 - rate * decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {f: np.where(total[i] > 0, w[i], 0.0) / s for i, f in enumerate(models)}


def onto_label(m: training.Moments, weights: np.ndarray, keep) -> np.ndarray:
    """Intercept and weights on the label's scale, by least squares on the rows of the kept groups; m: inputs, then label."""
    whole = m.total(keep)
    lift = np.zeros((3, len(whole)))
    lift[0, 0] = lift[2, -1] = 1
    lift[1, 1:-1] = weights
    a = training.ridge(lift @ whole @ lift.T, 0.0)
    return np.concatenate([[a[0]], a[1] * weights])


def ordered_share(diff: DataFrame, inputs: Sequence[str], models: dict) -> Column:
    """Aggregate of differences within folds: the share of pairs that the model of the other folds puts in order, ties half; pairs across folds or of a fold without a model do not count."""
    score = training.by_fold("fold", models, lambda w: sum((F.col(f"d_{f}") * float(x) for f, x in zip(inputs, w, strict=True)), F.lit(0.0)))
    return F.avg(F.when(score.isNotNull(), F.when(score > 0, 1.0).when(score == 0, 0.5).otherwise(0.0)))
