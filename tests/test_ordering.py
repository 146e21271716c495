"""Order statistics by ranges: spread over tasks whatever the values, equal to a plain sort."""

import statistics

import pytest
from pyspark.sql import functions as F

from textweave.operators import ordering, ratings


def frame(spark, n=4000):
    return spark.range(n, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise("b").alias("g"), F.pmod(F.col("id") * 7919, F.lit(11)).alias("v"), F.lit(1.0).alias("same"))


def test_a_constant_value_is_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = ordering.arranged(frame(spark), ["same", "k"])
        sizes = [r["count"] for r in a.groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * 4000 / 4


def test_positions_within_keys(spark):
    rows = frame(spark)
    got = {r.k: r.position for r in ordering.positions(rows, ["g"], ["v", "k"]).collect()}
    plain = sorted(rows.collect(), key=lambda r: (r.g, r.v, r.k))
    want, seen = {}, {}
    for r in plain:
        want[r.k] = seen.get(r.g, 0)
        seen[r.g] = want[r.k] + 1
    assert got == want


def test_positions_with_null_keys_and_descending_order(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", None)], "g string, v int")
    got = sorted(((r.g or "", r.v or 0, r.position) for r in ordering.positions(rows, ["g"], [F.col("v").desc_nulls_last()]).collect()))
    assert got == [("", 1, 1), ("", 2, 0), ("a", 0, 1), ("a", 3, 0)]


def test_many_groups_meet_their_rows_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_GROUPS", 0)
    rows = frame(spark, 500)
    got = [(r.k, r.position) for r in ordering.positions(rows, ["g"], ["v", "k"]).collect()]
    monkeypatch.undo()
    assert sorted(got) == sorted((r.k, r.position) for r in ordering.positions(rows, ["g"], ["v", "k"]).collect())


def test_running_sums_and_average_ranks(spark):
    ranks = {(r.g, r.v): r.r for r in ordering.average_ranks(frame(spark), ["g"], "v", "r").collect()}
    rows = frame(spark).collect()
    for g in "ab":
        own = sorted(r.v for r in rows if r.g == g)
        for v in set(own):
            places = [i + 1 for i, x in enumerate(own) if x == v]
            assert ranks[g, v] == sum(places) / len(places)


def test_quantiles_of_several_columns_and_of_none(spark):
    import numpy as np

    rows = frame(spark, 101)
    got = ordering.all_quantiles(rows, {"k": [0.1, 0.55], "v": [0.5], "same": [0.9]})
    data = rows.toPandas()
    assert got["k"] == [float(np.quantile(data.k, q)) for q in (0.1, 0.55)] and got["v"] == [float(np.quantile(data.v, 0.5))] and got["same"] == [1.0]
    assert ordering.quantiles(rows.where("k < 0"), "k", [0.5]) == [None]


def test_empty_table(spark):
    assert ordering.positions(frame(spark).where("k < 0"), ["g"], ["k"]).count() == 0


def test_rank_correlations_of_counted_pairs(spark):
    """Nulls and NaN take no part, repeated rows count each, a constant side or fewer than three pairs give 0."""
    nan = float("nan")
    rows = [("a", float(k % 4), float(k * k % 5), 1.0) for k in range(40)] + [("a", None, 1.0, 1.0), ("a", 2.0, nan, 1.0), ("b", 1.0, 2.0, 1.0), ("b", 2.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, same double")
    got = {(r.g, r.feature): (r.rho, r.n) for r in ratings.spearman_table(df, ["x", "same"], ["y"], ["g"]).collect()}
    pairs = [r[1:3] for r in rows[:40]]
    ranks = [[sum(v < p[c] for v in col) + (col.count(p[c]) + 1) / 2 for p in pairs] for c, col in enumerate(([p[0] for p in pairs], [p[1] for p in pairs]))]
    assert got["a", "x"] == (pytest.approx(statistics.correlation(*ranks)), 40)
    assert got["a", "same"] == (0.0, 41) and got["b", "x"] == (0.0, 2)
    one = ratings.spearman(df.where("g = 'a'"), "x", "y").first()
    assert (one.rho, one.n) == (pytest.approx(statistics.correlation(*ranks)), 40)
    assert tuple(ratings.spearman(df.where("false"), "x", "y").first()) == (0.0, 0)
