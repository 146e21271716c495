"""The test tables and the SQL fragments that several catalogues use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where an input has fewer splits than there are cores, as one small file; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Entries of users, one for each minute, from `events`.
ENTRIES = """
raw AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, us // 60000000 ORDER BY us, value) AS k FROM raw),
r AS (SELECT user_id, us / 86400000000.0 AS day, value AS score FROM one WHERE k = 1)
"""
#: The longitudinal features of users as x.
TE = (
    ENTRIES
    + """,
g AS (SELECT *, day - lag(day) OVER w AS gap, score - lag(score) OVER w AS delta, max(day) OVER p AS last, max(score) OVER p AS top, min(score) OVER p AS bottom
  FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day), p AS (PARTITION BY user_id)),
v AS (SELECT *, delta / greatest(gap, 1e-6) AS velocity FROM g),
a AS (SELECT *, (velocity - lag(velocity) OVER w) / greatest(lag(gap) OVER w, 1e-6) AS acc,
  sum(CASE WHEN delta < 0 THEN 0 ELSE 1 END) OVER b AS up, sum(CASE WHEN delta > 0 THEN 0 ELSE 1 END) OVER b AS down, last_value(score) OVER p AS latest
  FROM v WINDOW w AS (PARTITION BY user_id ORDER BY day), b AS (PARTITION BY user_id ORDER BY day DESC), p AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT user_id, count(*) AS te_n_entries, max(day) - min(day) AS te_time_span_days, coalesce(avg(gap), 0) AS te_mean_gap_days, coalesce(max(gap), 0) AS te_max_gap_days,
  coalesce(regr_slope(score, day), 0) AS te_slope, coalesce(avg(velocity), 0) AS te_velocity_mean, CASE WHEN count(*) > 2 THEN stddev_pop(velocity) ELSE 0 END AS te_velocity_std, coalesce(avg(acc), 0) AS te_acceleration_mean,
  avg(CASE WHEN day >= last - 7 THEN score END) AS te_rolling_7d_mean, stddev_pop(CASE WHEN day >= last - 7 THEN score END) AS te_rolling_7d_std, avg(score) AS te_baseline_mean, stddev_pop(score) AS te_baseline_std,
  count_if(up = 0)::BIGINT AS te_streak_improving, count_if(down = 0)::BIGINT AS te_streak_worsening, 100 * avg(CASE WHEN score <= latest THEN 1.0 ELSE 0.0 END) AS te_latest_percentile,
  max(last) - min(CASE WHEN score = top THEN day END) AS te_days_since_high, max(last) - min(CASE WHEN score = bottom THEN day END) AS te_days_since_low, max(latest) AS latest FROM a GROUP BY user_id)
"""
)
