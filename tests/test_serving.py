"""Scores, states and texts on small cases: nulls, limits, ties and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.functions.text import fixed
from textweave.operators import embedding, scoring, serving, temporal


def one(df):
    return df.collect()[0]


def test_linear_score_defaults(spark):
    row = spark.range(1)
    assert one(row.select(serving.linear_score([]).alias("s"))).s == 0.0  # missing inv features count 1, others 0
    full = row.select(*[F.lit(0.0).alias(n) for n, *_ in serving.LINEAR_TERMS])
    assert one(full.select(serving.linear_score(full.columns).alias("s"))).s == pytest.approx(43.0)
    assert sum(w for _, w, *_ in serving.LINEAR_TERMS) == pytest.approx(1.0)
    long = row.select(F.lit(9.0).alias("cle_length_cv"))
    assert one(long.select(serving.linear_score(long.columns).alias("s"))).s == pytest.approx(72.0)


def test_transforms(spark):
    row = spark.createDataFrame([(0.25,), (0.0,), (None,)], "x double")
    got = row.select(serving.harness_transform(F.col("x"), "inv_clip", 0.1).alias("a"), serving.harness_transform(F.col("x"), "inv_nz").alias("b")).collect()
    assert [tuple(r) for r in got] == [(0.9, 0.75), (1.0, 0.0), (None, 0.0)] or got[2].b == 0.0
    with pytest.raises(ValueError):
        serving.harness_transform(F.col("x"), "cube")


def test_calibration_kinds(spark):
    x = spark.createDataFrame([(-5.0,), (50.0,), (400.0,), (None,)], "x double")
    kinds = [None, {"kind": "linear_mes", "slope": 2.0, "intercept": 1.0}, {"kind": "isotonic_mes", "x_thresholds": [0.0, 100.0], "y_thresholds": [10.0, 20.0]}, {"kind": "isotonic_mes", "x_thresholds": [1.0], "y_thresholds": [1.0]}, {"kind": "else"}]
    got = x.select(*[serving.calibrated(F.col("x"), k).alias(f"k{i}") for i, k in enumerate(kinds)]).collect()
    assert [tuple(r) for r in got] == [(-5.0, -9.0, 10.0, -5.0, -5.0), (50.0, 101.0, 15.0, 50.0, 50.0), (400.0, 801.0, 20.0, 400.0, 400.0), (None,) * 5]


def test_dispatch(spark):
    scores = {"two_stage": F.lit(None).cast("double"), "hybrid": F.lit(7.0), "linear": F.lit(1.0)}
    full = {d: {} for d in serving.DIMENSIONS} | {"combiner": {"architecture": "subscore_embedding_v7"}, "hybrid": {}}
    ask = lambda method, artifacts: one(spark.range(1).select(serving.dispatched(method, artifacts, scores).alias("s"))).s
    assert ask("auto", full) == 7.0 and ask("linear", full) == 1.0 and ask("embedding", full) == 7.0
    assert ask("auto", {}) == 1.0
    assert serving.available({"combiner": {}}) == ["linear"]
    with pytest.raises(ValueError):
        ask("other", full)
    with pytest.raises(Exception):
        ask("embedding", {})
    with pytest.raises(FileNotFoundError):
        serving.architecture({})


def test_weak_dimensions_and_display_names(spark):
    values = {"precision_weighting": F.lit(2.5), "belief_integration": F.lit(1.0), "model_complexity": F.lit(1.0), "x": F.lit(None).cast("double"), "y": F.lit(2.6)}
    weak = one(spark.range(1).select(serving.weak_dimensions(values).alias("w"))).w
    assert [(r.name, r.value) for r in weak] == [("belief_integration", 1.0), ("model_complexity", 1.0)]
    assert one(spark.range(1).select(serving.display_name(F.lit("belief_integration")).alias("n"))).n == "Belief Integration"


@pytest.mark.parametrize(
    "n,confidence,trend,slope,score,vol,sd,want",
    [
        (2, 0.9, "stable", 0.0, 50.0, None, None, "insufficient_data"), (3, 0.05, "stable", 0.0, 50.0, None, None, "insufficient_data"), (5, 0.9, "improving", -2.0, 90.0, 0.9, 30.0, "active_integration"),
        (5, 0.9, "improving", -1.0, 50.0, None, None, "baseline"), (5, 0.9, "worsening", 2.0, 60.0, 0.3, None, "overwhelm"), (5, 0.9, "stable", 0.1, 60.0, 0.25, 12.0, "stuck"),
        (5, 0.9, "stable", 0.1, 30.0, None, None, "rigidity"), (5, 0.9, "stable", 0.5, 60.0, None, None, "baseline"), (5, 0.9, "stable", 0.0, 55.0, 0.9, 90.0, "baseline"),
    ],
)
def test_states(spark, n, confidence, trend, slope, score, vol, sd, want):
    c = [F.lit(x) if x is not None else F.lit(None).cast("double") for x in (n, confidence, trend, slope, score, vol, sd)]
    got = one(spark.range(1).select(scoring.mental_state(*c).alias("s")))
    assert got.s == want
    said = one(spark.range(1).select(serving.signals(F.lit(want), *c).alias("s"))).s
    assert said and all(said)


def test_prompts(spark):
    weak = F.array(F.struct(F.lit(1.5).alias("value"), F.lit("model_complexity").alias("name")))
    rows = spark.range(1).select(F.lit("overwhelm").alias("state"), F.array(F.lit("a"), F.lit("b")).alias("signals"), weak.alias("weakest"), F.lit("text").alias("journal_text"), F.lit(None).cast("string").alias("previous"))
    p = one(serving.prompts(rows))
    assert p.max_tokens == 300 and p.temperature == 0.5 and p.target == "decrease"
    assert "Signals: a; b" in p.user and "Model Complexity: 1.50" in p.user and "Previous" not in p.user and p.user.endswith("Entry:\ntext")


def test_feedback_deltas(spark):
    a = F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(3.0), F.lit("z"), F.lit(1.0))
    b = F.create_map(F.lit("x"), F.lit(2.0), F.lit("y"), F.lit(2.0), F.lit("w"), F.lit(1.0))
    d = one(spark.range(1).select(serving.subscore_deltas(a, b).alias("d"))).d
    assert {k: (v.delta, v.improved) for k, v in d.items()} == {"x": (1.0, True), "y": (-1.0, False)}


def test_requests(spark):
    rows = spark.createDataFrame([("short",), ("x" * 10,), ("x" * 50_001,), (None,)], "text string")
    got = [r.e for r in rows.select(serving.request_error(F.col("text")).alias("e")).collect()]
    assert got[1] is None and "under" in got[0] and "over" in got[2] and got[3] == "no text"


def test_user_state_limits(spark):
    rows = spark.createDataFrame([(1, 10.0, 150.0, 1), (1, 20.0, 150.0, 1), (2, 10.0, 40.0, 1), (3, 0.0, 10.0, 2), (3, 1.0, 20.0, 1), (3, 2.0, 30.0, 1), (3, 50.0, 40.0, 1)], "user_id long, day double, score double, n_same long")
    got = {r.user_id: r for r in temporal.user_state(rows, 48.0).collect()}
    assert got[1].current_mes == 100.0 and got[1].trend == "unknown" and got[1].trend_slope == 0.0
    assert got[2].status == "stale" and got[2].n_recent_entries == 0 and got[2].confidence == pytest.approx(1 - math.exp(-(0.5 ** (38 / 14)) / 2))
    assert got[3].days_since_last_entry == 0.0 and got[3].n_entries == 4 and got[3].n_same_minute == 1 and got[3].trend == "worsening"
    far = temporal.user_state(rows.where("user_id = 2"), 1e6).first()
    assert far.current_mes == 40.0 and far.status == "insufficient_data"


def test_entries_of_one_minute(spark):
    rows = spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:00:10' AS ts, 5.0D AS value UNION ALL SELECT 1L, timestamp'2024-01-01 00:00:40', 9.0D")
    assert [(r.score, r.n_same) for r in temporal.entries(rows).collect()] == [(5.0, 2)]
    with pytest.raises(Exception, match="one minute"):
        temporal.entries(rows, same_minute="error").collect()


def test_embedding_frame(spark):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.embedding for r in embedding.embed_sentences(rows, "text", load).collect()}
    assert got[2] is None and got[3] == [0.0, 1.0] and got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert embedding.embed_sentences(rows.where("false"), "text", load).count() == 0


def test_pooling():
    import numpy as np

    t, m = np.arange(12.0).reshape(2, 3, 2), np.array([[1, 1, 0], [0, 0, 0]])
    assert embedding.mean_pooling(t, m).tolist() == [[1.0, 2.0], [0.0, 0.0]]
    assert embedding.first_pooling(t, m).tolist() == [[0.0, 1.0], [6.0, 7.0]]


def test_numbers_are_printed_by_their_exact_value(spark):
    """Halves to even, and values whose shortest digits end in 5 but lie below the middle."""
    rng = np.random.default_rng(2)
    x = [34.25, 34.75, 0.15, 0.35, 1.005, 2.675, 6.85, 149.99999999999997 * 0.137, 0.5, 1.5, 0.05, -0.04, -0.0, 0.0, 1e13, 9.95, 0.995, 99.5, *(rng.integers(0, 40_000, 3000) / 200.0), *rng.normal(scale=50, size=1000)]
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", "x", *[fixed(F.col("x"), d, sign=d == 1).alias(f"d{d}") for d in range(3)]).collect()
    for r in got:
        assert (r.d0, r.d1, r.d2) == (f"{r.x:.0f}", f"{r.x:+.1f}", f"{r.x:.2f}")
    text = spark.range(1).select(serving.feedback_text(F.lit(34.25), F.lit("increase"), F.lit(True), F.create_map(F.lit("a"), F.struct(F.lit(0.0).alias("delta"), F.lit(False).alias("improved"))))).first()[0]
    assert text == "increased by 34.2, in the target direction: increase"
