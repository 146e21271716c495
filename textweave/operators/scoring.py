"""Score transforms, calibration, interpretation bands and state classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transformed(x: Column, kind: str, p: float | None = None) -> Column:
    """inv: 1 - x; dir: x; dir_norm: min(x / p, 1); anything else: x."""
    if kind == "inv":
        return 1 - x
    if kind == "dir_norm" and p:
        return F.least(x / p, F.lit(1.0))
    return x


def weighted_score(terms: list[tuple[Column, float]]) -> Column:
    """100 times the weighted sum, within 0 and 100."""
    total = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in terms), F.lit(0.0))
    return F.least(F.greatest(100 * total, F.lit(0.0)), F.lit(100.0))


def isotonic(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation between thresholds, held beyond them; null stays null. Fewer than two or unequal lengths: identity."""
    if len(xs) < 2 or len(xs) != len(ys):
        return x
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= xs[0], ys[0])
    for a, b, c, d in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True):
        out = out.when(x <= b, c + (x - a) * ((d - c) / (b - a) if b > a else 0.0))
    return out.otherwise(ys[-1])


def band(score: Column) -> Column:
    """Six bands by upper edges 20, 35, 50, 65 and 80."""
    out = F.when(score <= 20, 0)
    for k, edge in enumerate((35, 50, 65, 80), 1):
        out = out.when(score <= edge, k)
    return out.otherwise(5)


def mental_state(n: Column, confidence: Column, trend: Column, slope: Column, score: Column, volatility: Column, sd7: Column) -> Column:
    """The ordered decision list; every comparison is strict."""
    return (
        F.when((n < 3) | (confidence < 0.1), "insufficient_data")
        .when((trend == "improving") & (slope < -1), "active_integration")
        .when((score > 55) & (F.coalesce(volatility > 0.25, F.lit(False)) | F.coalesce(sd7 > 12, F.lit(False))), "overwhelm")
        .when((score > 55) & (F.abs(slope) < 0.5), "stuck")
        .when((score < 35) & (F.abs(slope) < 0.5), "rigidity")
        .otherwise("baseline")
    )


#: The least change that counts as a move, and the widest that counts as stable.
NOISE_FLOOR, STABLE_BAND = 1.0, 3.0


def feedback(delta: Column, target: Column) -> tuple[Column, Column]:
    """Whether the score moved as its target says, and whether that is an effect; an unknown target is neither."""
    stable = F.abs(delta) <= STABLE_BAND
    moved = F.when(target == "decrease", delta < -NOISE_FLOOR).when(target == "increase", delta > NOISE_FLOOR).when(target == "stable", stable).otherwise(False)
    return moved, F.when(target == "stable", stable).otherwise(moved & (F.abs(delta) > NOISE_FLOOR))
