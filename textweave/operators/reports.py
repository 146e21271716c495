"""Evaluation reports of scored rows: (control_type, expected, model) in, a few rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of the spectrum from low to high, the two controls and the limits of the gates.
SPECTRUM = ("spectrum_1_2", "spectrum_3_4", "spectrum_5_6", "spectrum_7_8", "spectrum_9_10")
HIGH_BANDS = ("spectrum_7_8", "spectrum_9_10")
EMOTIONAL, NEUTRAL = "emotional_coherent_negative", "neutral_fragmented_positive"
MOST_MAE, MOST_HIGH_MAE, MOST_EMOTIONAL, LEAST_NEUTRAL = 12.0, 15.0, 40.0, 60.0


def error() -> Column:
    return F.col("model") - F.col("expected")


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """n, mae, rmse and both means for each group; without groups one row, with nulls if there are no rows."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(error())).alias("mae"), F.sqrt(F.avg(error() * error())).alias("rmse"),
        F.avg("expected").alias("mean_expected"), F.avg("model").alias("mean_model"),
    )


def gates(scored: DataFrame) -> DataFrame:
    """One row of the acceptance gates, in one aggregation; a gate without rows of its kind is not passed."""
    mean = lambda kind: F.avg(F.when(F.col("control_type") == kind, F.col("model")))
    high = F.avg(F.when(F.col("control_type").isin(*HIGH_BANDS), F.abs(error())))
    row = scored.agg(F.avg(F.abs(error())).alias("mae"), high.alias("high_mae"), mean(EMOTIONAL).alias("emotional"), mean(NEUTRAL).alias("neutral"), *[mean(b).alias(b) for b in SPECTRUM])
    rising = [F.col(a) < F.col(b) for a, b in zip(SPECTRUM[:-1], SPECTRUM[1:], strict=True)]
    tests = {
        "overall_mae_ok": F.col("mae") <= MOST_MAE,
        "high_band_mae_ok": F.col("high_mae") <= MOST_HIGH_MAE,
        "emotional_ok": F.col("emotional") <= MOST_EMOTIONAL,
        "neutral_ok": F.col("neutral") >= LEAST_NEUTRAL,
        "spectrum_ordered": rising[0] & rising[1] & rising[2] & rising[3],
    }
    return row.select(*[F.coalesce(test, F.lit(False)).alias(name) for name, test in tests.items()])


def worst(scored: DataFrame, id_cols: list[str], k: int = 5) -> DataFrame:
    """The k largest errors each way as (side, id columns, error); ties go to the smaller ids. A bounded top-k, no full sort."""
    rows = scored.select(*id_cols, error().alias("error"))
    low = rows.orderBy("error", *id_cols).limit(k).select(F.lit("false_low").alias("side"), *id_cols, "error")
    high = rows.orderBy(F.desc("error"), *id_cols).limit(k).select(F.lit("false_high").alias("side"), *id_cols, "error")
    return low.unionByName(high)
