"""Longitudinal features of each user's scored entries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweave.operators.scoring import band

DAY = 86_400_000_000.0


def entries(events: DataFrame, user: str = "user_id", ts: str = "ts", score: str = "value", same_minute: str = "first") -> DataFrame:
    """(user_id, day, score, n_same): entries in time, those of one user and minute as one.

    same_minute: "first" keeps the first by time, then the least score, and says in n_same how many there were; "error"
    raises where there are two. Rows with a null take no part.
    """
    if same_minute not in ("first", "error"):
        raise ValueError(f"same_minute is first or error, not {same_minute!r}")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(F.col(user).alias("user_id"), at.alias("us"), F.col(score).alias("score")).dropna()
    one = rows.groupBy("user_id", F.floor(F.col("us") / 60_000_000).alias("minute")).agg(F.min(F.struct("us", "score")).alias("e"), F.count("*").alias("n_same"))
    n_same = F.col("n_same")
    if same_minute == "error":
        n_same = F.when(n_same > 1, F.raise_error(F.lit("two entries of a user in one minute")).cast("long")).otherwise(n_same)
    return one.select("user_id", (F.col("e.us") / DAY).alias("day"), F.col("e.score").alias("score"), n_same.alias("n_same"))


def longitudinal(rows: DataFrame) -> DataFrame:
    """The te_ features from (user_id, day, score); all windows share one sort by (user_id, day)."""
    w = Window.partitionBy("user_id").orderBy("day")
    whole = Window.partitionBy("user_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("day"))
    t = rows.select("*", (F.col("day") - F.lag("day").over(w)).alias("gap"), (F.col("score") - F.lag("score").over(w)).alias("delta"), F.max("day").over(whole).alias("last"), F.max("score").over(whole).alias("top"), F.min("score").over(whole).alias("bottom"))
    t = t.withColumn("velocity", F.col("delta") / F.greatest("gap", F.lit(1e-6)))
    t = t.withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / F.greatest(F.lag("gap").over(w), F.lit(1e-6)))
    t = t.withColumn("_up", F.sum(F.coalesce((F.col("delta") >= 0).cast("int"), F.lit(1))).over(back)).withColumn("_down", F.sum(F.coalesce((F.col("delta") <= 0).cast("int"), F.lit(1))).over(back))
    recent = F.when(F.col("day") >= F.col("last") - 7, F.col("score"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = t.groupBy("user_id").agg(
        F.count("*").alias("te_n_entries"), (F.max("day") - F.min("day")).alias("te_time_span_days"), z(F.avg("gap")).alias("te_mean_gap_days"), z(F.max("gap")).alias("te_max_gap_days"),
        z(F.regr_slope("score", "day")).alias("te_slope"), z(F.avg("velocity")).alias("te_velocity_mean"), F.when(F.count("*") > 2, F.stddev_pop("velocity")).otherwise(0.0).alias("te_velocity_std"), z(F.avg("acceleration")).alias("te_acceleration_mean"),
        F.avg(recent).alias("te_rolling_7d_mean"), F.stddev_pop(recent).alias("te_rolling_7d_std"), F.avg("score").alias("te_baseline_mean"), F.stddev_pop("score").alias("te_baseline_std"),
        F.max_by("score", "day").alias("_latest"), F.max("last").alias("_last"),
        F.min(F.when(F.col("score") == F.col("top"), F.col("day"))).alias("_high"), F.min(F.when(F.col("score") == F.col("bottom"), F.col("day"))).alias("_low"),
        F.count_if(F.col("_up") == 0).alias("te_streak_improving"), F.count_if(F.col("_down") == 0).alias("te_streak_worsening"),
    )
    below = t.join(a.select("user_id", "_latest"), "user_id").groupBy("user_id").agg((100 * F.avg((F.col("score") <= F.col("_latest")).cast("double"))).alias("te_latest_percentile"))
    a = a.join(below, "user_id")
    return a.select(
        *[c for c in a.columns if c[0] != "_"], (7 * F.col("te_slope")).alias("te_slope_per_week"),
        F.when(F.col("te_baseline_std") > 1e-9, F.try_divide(F.col("_latest") - F.col("te_baseline_mean"), F.col("te_baseline_std"))).otherwise(0.0).alias("te_latest_zscore"),
        (F.col("_last") - F.col("_high")).alias("te_days_since_high"), (F.col("_last") - F.col("_low")).alias("te_days_since_low"),
        F.when(F.abs("te_slope") < 0.01, 0).otherwise(F.signum("te_slope").cast("int")).alias("te_trend_direction"),
        F.when(F.col("te_baseline_mean") > 1e-9, F.try_divide("te_baseline_std", "te_baseline_mean")).otherwise(0.0).alias("te_volatility"),
    )


def user_state(rows: DataFrame, now: float, half_life: float = 14.0) -> DataFrame:
    """Each user's state at `now` (in days): one aggregation of weights that halve every half_life days, one of te_ features.

    Entries after `now` weigh as those of now. The score is within 0 and 100, the latest one where all weights vanish. The
    trend is `unknown` under three entries. status: insufficient_data, stale (no entry for two half-lives) or ok.
    """
    ago = F.greatest(F.lit(float(now)) - F.col("day"), F.lit(0.0))
    weight = F.exp(-ago * (math.log(2.0) / max(half_life, 1e-6)))
    recent = 2.0 * half_life
    sums = rows.select("user_id", "day", "score", "n_same", ago.alias("ago"), weight.alias("w")).groupBy("user_id").agg(
        F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("score")).alias("total"), F.max_by("score", "day").alias("latest"), F.avg("score").alias("baseline_mes"),
        F.count("*").alias("n_entries"), F.count_if(F.col("ago") <= recent).alias("n_recent_entries"), F.min("ago").alias("days_since_last_entry"), F.sum(F.col("n_same") - 1).alias("n_same_minute"),
    )
    te = longitudinal(rows).select("user_id", "te_slope_per_week", "te_trend_direction", "te_volatility", "te_rolling_7d_std")
    current = F.when(F.col("weight") > 1e-9, F.try_divide("total", "weight")).otherwise(F.col("latest"))
    s = sums.join(te, "user_id").withColumn("current_mes", F.least(F.greatest(current, F.lit(0.0)), F.lit(100.0))).withColumn("confidence", 1 - F.exp(-F.col("weight") / 2))
    trend = F.when(F.col("n_entries") < 3, "unknown").when(F.col("te_trend_direction") < 0, "improving").when(F.col("te_trend_direction") > 0, "worsening").otherwise("stable")
    status = F.when(F.col("confidence") < 0.05, "insufficient_data").when(F.col("days_since_last_entry") > recent, "stale").otherwise("ok")
    return s.select(
        "user_id", "current_mes", "confidence", trend.alias("trend"), F.when(F.col("n_entries") < 3, 0.0).otherwise(F.col("te_slope_per_week")).alias("trend_slope"), "baseline_mes",
        (F.col("current_mes") - F.col("baseline_mes")).alias("deviation_from_baseline"), "n_entries", "n_recent_entries", "days_since_last_entry", band(F.col("current_mes")).alias("band"), status.alias("status"),
        F.col("te_volatility").alias("volatility"), F.col("te_rolling_7d_std").alias("rolling_7d_std"), "n_same_minute",
    )


def no_entries(user_id) -> dict:
    """The state of a user without any entry."""
    return {"user_id": user_id, "current_mes": 0.0, "confidence": 0.0, "trend": "unknown", "trend_slope": 0.0, "n_entries": 0, "days_since_last_entry": float("inf"), "status": "insufficient_data"}
