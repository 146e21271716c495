"""Queries of scores, user states and the texts around them, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweave.functions.text import fixed
from textweave.functions.vectors import rounded
from textweave.operators import scoring, serving, temporal
from textweave.plans.tables import TE, table

#: Stand-ins for features, as expressions over `lineitem` that both engines read alike; two terms are missing on purpose.
FEATURES = {
    "ce_adj_p75": "l_discount * 10", "ne_fragment_sentence_rate": "l_tax * 8", "ce_inter_block_break_rate": "l_discount * 5", "bc_belief_sentence_count": "l_quantity", "ce_n_blocks": "l_linenumber * 4",
    "cle_length_cv": "l_tax * 20", "ne_start_to_centroid": "l_discount * 9", "se_dominant_cluster_frac": "l_tax * 10", "ne_end_to_centroid": "l_discount * 8", "cle_hedge_rate": "l_tax", "ne_start_end_sim": "l_discount * 7",
}
DIM = 16


def coefficients(seed: int, n: int = DIM) -> list[float]:
    """Sample coefficients by a rule."""
    return [((i * 7 + seed * 5) % 11 - 5) / 4 for i in range(n)]


#: A sample model: five dimensions, a combiner of them and two features with isotonic calibration, and a hybrid.
ARTIFACTS = {
    **{d: {"coef": coefficients(k), "intercept": 3.0} for k, d in enumerate(serving.DIMENSIONS)},
    "combiner": {
        "architecture": "subscore_embedding_v7", "coef": [-0.5, 0.25, -0.75, -0.5, -0.25, 0.5, 0.125], "intercept": 9.0,
        "calibration": {"kind": "isotonic_mes", "x_thresholds": [0.0, 30.0, 60.0, 100.0], "y_thresholds": [5.0, 25.0, 75.0, 95.0]},
    },
    "hybrid": {"coef": [*coefficients(6), 0.5, 0.25], "intercept": 5.0, "embedding_dim": DIM},
}


def linear_mes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in FEATURES.items()])
    score = serving.linear_score(rows.columns)
    return rounded(rows.select("l_orderkey", "l_linenumber", score.alias("score"), scoring.band(score).alias("band")))


def harness_score(spark, sf_dir):
    x = F.col("l_quantity")
    d = table(spark, sf_dir, "lineitem")
    return rounded(d.select("l_orderkey", "l_linenumber", serving.harness_transform(x, "inv_clip", 30.0).alias("inv_clip"), serving.harness_transform(F.col("l_discount"), "inv_nz").alias("inv_nz"), serving.harness_transform(x, "dir_norm", 25.0).alias("dir_norm")))


def embedding_scores(spark, sf_dir):
    """Every fifth row stands for a document without a vector and falls back to another score."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("e"))
    subs = {n: serving.subscore(F.col("e"), ARTIFACTS[n]["coef"], ARTIFACTS[n]["intercept"]) for n in serving.DIMENSIONS}
    features = [F.col("label") / 10, F.lit(None)]
    d = d.select("vec_id", "e", "label", *[c.alias(n) for n, c in subs.items()])
    two = serving.two_stage_score([F.col(n) for n in subs], features, ARTIFACTS["combiner"])
    hybrid = serving.hybrid_score(F.col("e"), features, ARTIFACTS["hybrid"])
    auto = serving.dispatched("auto", ARTIFACTS, {"two_stage": two, "hybrid": hybrid, "linear": F.col("label").cast("double")})
    return rounded(d.select("vec_id", *subs, two.alias("two_stage"), hybrid.alias("hybrid"), auto.alias("auto")))


def _now(events: DataFrame) -> float:
    """The latest time in days: the explicit `now` of a state at the end of the table."""
    return (events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0) / temporal.DAY


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value") / 4.973)
    return temporal.user_state(temporal.entries(events), _now(events))


def user_state(spark, sf_dir):
    return rounded(states(spark, sf_dir), 4)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    s = states(spark, sf_dir)
    s = s.withColumn("state", scoring.mental_state(c("n_entries"), c("confidence"), c("trend"), c("trend_slope"), c("current_mes"), c("volatility"), c("rolling_7d_std")))
    dims = {d: F.pmod(c("user_id") * (k + 3), F.lit(9)) / 2 + 0.5 for k, d in enumerate(serving.DIMENSIONS)}
    return s.withColumns({"signals": serving.signals(c("state"), c("n_entries"), c("confidence"), c("trend"), c("trend_slope"), c("current_mes"), c("volatility"), c("rolling_7d_std")), "weakest": serving.weak_dimensions(dims)})


def classify_users(spark, sf_dir):
    weak = F.array_join(F.transform("weakest", lambda r: F.concat(r["name"], F.lit("="), fixed(r["value"], 2))), ",")
    return classified(spark, sf_dir).select("user_id", "trend", "state", "band", F.array_join("signals", "; ").alias("signals"), weak.alias("weakest"))


def insight_prompts(spark, sf_dir):
    rows = classified(spark, sf_dir).select("user_id", "state", "signals", "weakest", F.concat(F.lit("entry of "), F.col("user_id").cast("string")).alias("journal_text"), F.when(F.col("user_id") % 2 == 0, "walk").alias("previous"))
    return serving.prompts(rows).select("user_id", "max_tokens", "temperature", "target", F.md5(F.col("system").cast("binary")).alias("system"), F.md5(F.col("user").cast("binary")).alias("user"))


def trend_summaries(spark, sf_dir):
    t = temporal.longitudinal(temporal.entries(table(spark, sf_dir, "events").withColumn("value", F.col("value") / 4.973)))
    trend = F.when(F.col("te_trend_direction") < 0, "improving").when(F.col("te_trend_direction") > 0, "worsening").otherwise("stable")
    return t.select("user_id", serving.trend_summary(F.col("te_n_entries"), F.col("te_time_span_days"), trend, F.col("te_slope_per_week"), F.col("te_volatility")).alias("summary"))


def feedback_results(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    target = F.element_at(F.array(F.lit("decrease"), F.lit("increase"), F.lit("stable")), (F.col("event_id") % 3 + 1).cast("int"))
    dims = lambda shift, names: F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), (F.pmod(F.col("event_id") + shift + k, F.lit(4 + k))).cast("double"))])
    moves = table(spark, sf_dir, "events").select("event_id", target.alias("target"), ((F.col("value") - F.lag("value").over(w)) * 0.137).alias("delta"), serving.subscore_deltas(dims(0, ["a", "b", "c"]), dims(3, ["b", "c", "d"])).alias("deltas")).where("delta IS NOT NULL")
    moved, effective = scoring.feedback(F.col("delta"), F.col("target"))
    rows = moves.select("event_id", "target", "deltas", "delta", moved.alias("moved"), effective.alias("effective"))
    return rounded(rows.select("event_id", "delta", "moved", "effective", F.element_at("deltas", "b")["delta"].alias("delta_b"), F.element_at("deltas", "c")["improved"].alias("improved_c"), F.size("deltas").alias("n_dimensions"), serving.feedback_text(F.col("delta"), F.col("target"), F.col("moved"), F.col("deltas")).alias("text")))


def batch_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.when(F.col("doc_id") % 7 != 0, F.pmod(F.length("text"), F.lit(101)).cast("double"))
    return serving.batch_scores(d, score, serving.request_error(F.col("text")), scoring.band(score)).drop("text")


def state_requests(spark, sf_dir):
    s = states(spark, sf_dir)
    error = serving.state_request_error(F.col("n_entries") - 1, F.pmod("user_id", F.lit(100)).cast("double"), F.col("trend"))
    return s.groupBy(F.coalesce(error, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def health(spark, sf_dir):
    """The manifest counts the table's rows and holds the linear score's correlation with the quantity on human rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", *[F.expr(e).alias(c) for c, e in FEATURES.items()])
    found = rows.agg(F.count("*").alias("n"), F.corr(F.when(F.col("l_returnflag") == "R", serving.linear_score(rows.columns)), F.col("l_quantity").cast("double")).alias("r")).first()
    return serving.health(spark, {"architecture": serving.architecture(ARTIFACTS), "n_entries": found.n, "metrics": {"v7_human_corr": found.r or 0.0}})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (linear_mes, harness_score, embedding_scores, user_state, classify_users, insight_prompts, trend_summaries, feedback_results, batch_scores, state_requests, health)
}


def _linear_sql() -> str:
    parts = []
    for name, weight, kind, p in serving.LINEAR_TERMS:
        x = f"({FEATURES[name]})::DOUBLE" if name in FEATURES else ("1.0::DOUBLE" if kind == "inv" else "0.0::DOUBLE")
        parts.append(f"{weight}::DOUBLE * " + (f"(1 - {x})" if kind == "inv" else f"least({x} / {p}::DOUBLE, 1)" if kind == "dir_norm" else x))
    return " + ".join(parts)


def band_sql(s: str) -> str:
    return f"CASE WHEN {s} <= 20 THEN 0 WHEN {s} <= 35 THEN 1 WHEN {s} <= 50 THEN 2 WHEN {s} <= 65 THEN 3 WHEN {s} <= 80 THEN 4 ELSE 5 END"


def _dot_sql(coef: list[float]) -> str:
    return f"list_dot_product(list_transform(e[:{len(coef)}], lambda x: x::DOUBLE), {coef}::DOUBLE[])"


_SUBS = ", ".join(f"least(greatest({_dot_sql(ARTIFACTS[d]['coef'])} + 3, 1), 5) AS {d}" for d in serving.DIMENSIONS)
_TWO = " + ".join([*(f"{c}::DOUBLE * {d}" for c, d in zip(ARTIFACTS["combiner"]["coef"], serving.DIMENSIONS)), "0.5::DOUBLE * label / 10", "9"])

STATE = (
    TE.replace("SELECT user_id, epoch_us(ts) AS us, value FROM", "SELECT user_id, epoch_us(ts) AS us, value / 4.973::DOUBLE AS value FROM")
    + """,
mx AS (SELECT max(epoch_us(ts)) / 86400000000.0 AS now FROM events),
ag AS (SELECT r.*, greatest(now - day, 0) AS ago, exp(-greatest(now - day, 0) * (ln(2.0) / 14.0)) AS w FROM r, mx),
du AS (SELECT user_id, count(*) - count(DISTINCT us // 60000000) AS n_same_minute FROM raw GROUP BY user_id),
su AS (SELECT user_id, sum(w) AS weight, sum(w * score) AS total, avg(score) AS baseline_mes, count(*) AS n_entries, count_if(ago <= 28)::BIGINT AS n_recent_entries, min(ago) AS days_since_last_entry FROM ag GROUP BY user_id),
st AS (SELECT su.*, n_same_minute, least(greatest(CASE WHEN weight > 1e-9 THEN total / weight ELSE latest END, 0), 100) AS current_mes, 1 - exp(-weight / 2) AS confidence, 7 * te_slope AS slope_week,
  CASE WHEN n_entries < 3 THEN 'unknown' WHEN abs(te_slope) < 0.01 THEN 'stable' WHEN te_slope < 0 THEN 'improving' ELSE 'worsening' END AS trend,
  CASE WHEN te_baseline_mean > 1e-9 THEN te_baseline_std / te_baseline_mean ELSE 0 END AS volatility, te_rolling_7d_std AS rolling_7d_std, te_time_span_days FROM su JOIN x USING (user_id) JOIN du USING (user_id)),
us AS (SELECT *, CASE WHEN n_entries < 3 THEN 0 ELSE slope_week END AS trend_slope FROM st),
cl AS (SELECT *, CASE WHEN n_entries < 3 OR confidence < 0.1 THEN 'insufficient_data' WHEN trend = 'improving' AND trend_slope < -1 THEN 'active_integration'
  WHEN current_mes > 55 AND (volatility > 0.25 OR rolling_7d_std > 12) THEN 'overwhelm' WHEN current_mes > 55 AND abs(trend_slope) < 0.5 THEN 'stuck' WHEN current_mes < 35 AND abs(trend_slope) < 0.5 THEN 'rigidity' ELSE 'baseline' END AS state FROM us),
sg AS (SELECT *, CASE state
  WHEN 'insufficient_data' THEN list_filter([CASE WHEN n_entries < 3 THEN printf('n_entries=%d (below 3)', n_entries) END, CASE WHEN confidence < 0.1 THEN printf('confidence=%.2f (below 0.1)', confidence) END], lambda z: z IS NOT NULL)
  WHEN 'active_integration' THEN ['trend=' || trend, printf('trend_slope=%.1f pts/week (below -1.0)', trend_slope)]
  WHEN 'overwhelm' THEN list_filter([printf('current_mes=%.1f (above 55.0)', current_mes), CASE WHEN volatility > 0.25 THEN printf('volatility=%.2f (above 0.25)', volatility) END, CASE WHEN rolling_7d_std > 12 THEN printf('rolling_7d_std=%.1f (above 12.0)', rolling_7d_std) END], lambda z: z IS NOT NULL)
  WHEN 'stuck' THEN [printf('current_mes=%.1f (above 55.0)', current_mes), printf('|trend_slope|=%.1f (below 0.5)', abs(trend_slope))]
  WHEN 'rigidity' THEN [printf('current_mes=%.1f (below 35.0)', current_mes), printf('|trend_slope|=%.1f (below 0.5)', abs(trend_slope))]
  ELSE [printf('current_mes=%.1f (in normal range)', current_mes)] END AS signals,
  list_sort(list_filter(["""
    + ", ".join(f"{{'value': user_id * {k + 3} % 9 / 2.0::DOUBLE + 0.5::DOUBLE, 'place': {k}, 'name': '{d}'}}" for k, d in enumerate(serving.DIMENSIONS))
    + """], lambda z: z.value <= 2.5))[:2] AS weakest FROM cl)"""
)
_PICK = lambda values: "CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"
_WEAK_LINES = """CASE WHEN len(weakest) > 0 THEN 'Weakest dimensions:' || chr(10) || array_to_string(list_transform(weakest, lambda z: '- ' || array_to_string(list_transform(string_split(z.name, '_'), lambda q: upper(q[1]) || q[2:]), ' ') || ': ' || printf('%.2f', z.value)), chr(10)) END"""

SQL: dict[str, str] = {
    "linear_mes": f"WITH z AS (SELECT l_orderkey, l_linenumber, least(greatest(100 * ({_linear_sql()}), 0), 100) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round(s, 6) AS score, {band_sql('s')} AS band FROM z",
    "harness_score": "SELECT l_orderkey, l_linenumber, round(1 - least(l_quantity, 30), 6) AS inv_clip, round(CASE WHEN l_discount > 0 THEN 1 - l_discount ELSE 0 END, 6) AS inv_nz, round(least(l_quantity / 25, 1), 6) AS dir_norm FROM lineitem",
    "embedding_scores": f"""WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 5 <> 0 THEN embedding END AS e FROM embeddings), s AS (SELECT vec_id, label, e, {_SUBS} FROM v),
t AS (SELECT *, (({_TWO}) - 1) / 9 * 100 AS two0, (({_dot_sql(ARTIFACTS['hybrid']['coef'][:DIM])} + 5 + 0.5::DOUBLE * label / 10) - 1) / 9 * 100 AS h0 FROM s),
u AS (SELECT *, CASE WHEN e IS NOT NULL THEN least(greatest(CASE WHEN two0 <= 0 THEN 5.0 WHEN two0 <= 30 THEN 5 + two0 * 20.0 / 30 WHEN two0 <= 60 THEN 25 + (two0 - 30) * 50.0 / 30 WHEN two0 <= 100 THEN 75 + (two0 - 60) * 20.0 / 40 ELSE 95.0 END, 0), 100) END AS two_stage,
  CASE WHEN e IS NOT NULL THEN least(greatest(h0, 0), 100) END AS hybrid FROM t)
SELECT vec_id, {", ".join(f"round(CASE WHEN e IS NOT NULL THEN {d} END, 6) AS {d}" for d in serving.DIMENSIONS)}, round(two_stage::DOUBLE, 6) AS two_stage, round(hybrid::DOUBLE, 6) AS hybrid, round(coalesce(two_stage, hybrid, label)::DOUBLE, 6) AS auto FROM u""",
    "user_state": f"""WITH {STATE} SELECT user_id, round(current_mes, 4) AS current_mes, round(confidence, 4) AS confidence, trend, round(trend_slope, 4) AS trend_slope, round(baseline_mes, 4) AS baseline_mes, round(current_mes - baseline_mes, 4) AS deviation_from_baseline, n_entries, n_recent_entries,
round(days_since_last_entry, 4) AS days_since_last_entry, {band_sql('current_mes')} AS band, CASE WHEN confidence < 0.05 THEN 'insufficient_data' WHEN days_since_last_entry > 28 THEN 'stale' ELSE 'ok' END AS status, round(volatility, 4) AS volatility, round(rolling_7d_std, 4) AS rolling_7d_std, n_same_minute FROM us""",
    "classify_users": f"""WITH {STATE} SELECT user_id, trend, state, {band_sql('current_mes')} AS band, array_to_string(signals, '; ') AS signals, array_to_string(list_transform(weakest, lambda z: z.name || '=' || printf('%.2f', z.value)), ',') AS weakest FROM sg""",
    "insight_prompts": f"""WITH {STATE}, p AS (SELECT *, {_WEAK_LINES} AS weak, {_PICK({k: v[0] for k, v in serving.STATES.items()})} AS target FROM sg)
SELECT user_id, {_PICK({k: v[1] for k, v in serving.STATES.items()})}::INT AS max_tokens, {_PICK({k: v[2] for k, v in serving.STATES.items()})}::DOUBLE AS temperature, target,
  md5(concat_ws(chr(10), 'Insights into journal entries: concise, grounded in the entry.', {_PICK({k: v[0] for k, v in serving.GUIDANCE.items()})}, weak, 'Directive: ' || {_PICK({k: v[1] for k, v in serving.GUIDANCE.items()})}, 'Avoid: ' || {_PICK({k: v[2] for k, v in serving.GUIDANCE.items()})})) AS system,
  md5(concat_ws(chr(10), 'State: ' || state, 'Signals: ' || array_to_string(signals, '; '), 'Target: ' || target, weak, CASE WHEN user_id % 2 = 0 THEN 'Previous insight: walk' END, 'Entry:', 'entry of ' || user_id)) AS user FROM p""",
    "trend_summaries": f"""WITH {STATE}, t AS (SELECT user_id, te_n_entries, te_time_span_days, 7 * te_slope AS sw, CASE WHEN te_baseline_mean > 1e-9 THEN te_baseline_std / te_baseline_mean ELSE 0 END AS v, CASE WHEN abs(te_slope) < 0.01 THEN 'stable' WHEN te_slope < 0 THEN 'improving' ELSE 'worsening' END AS trend FROM x)
SELECT user_id, printf('%d entries in %.0f days: ', te_n_entries, te_time_span_days) || trend || printf(' (%+.1f a week), volatility ', sw) || CASE WHEN v > 0.3 THEN 'high' WHEN v > 0.15 THEN 'moderate' ELSE 'low' END || printf(' (%.2f)', v) AS summary FROM t""",
    "feedback_results": """WITH m AS (SELECT event_id, ['decrease', 'increase', 'stable'][event_id % 3 + 1] AS target, (value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 0.137::DOUBLE AS delta,
  ((event_id + 3) % 4 - (event_id + 1) % 5)::DOUBLE AS db, ((event_id + 4) % 5 - (event_id + 2) % 6)::DOUBLE AS dc FROM events),
n AS (SELECT *, CASE target WHEN 'decrease' THEN delta < -1 WHEN 'increase' THEN delta > 1 ELSE abs(delta) <= 3 END AS moved, (db > 0)::INT + (dc > 0)::INT AS up, (db < 0)::INT + (dc < 0)::INT AS down FROM m WHERE delta IS NOT NULL)
SELECT event_id, round(delta, 6) AS delta, moved, moved AS effective, db AS delta_b, dc > 0 AS improved_c, 2 AS n_dimensions,
  CASE WHEN delta < 0 THEN 'decreased' WHEN delta > 0 THEN 'increased' ELSE 'unchanged' END || printf(' by %.1f, ', abs(delta)) || CASE WHEN target = 'stable' AND abs(delta) <= 3 THEN 'within the stable band' WHEN target = 'stable' THEN 'outside the stable band'
  WHEN moved THEN 'in the target direction: ' || target WHEN abs(delta) <= 1 THEN 'no significant movement, target: ' || target ELSE 'opposite to the target: ' || target END
  || CASE WHEN up + down > 0 THEN '; ' || concat_ws(', ', CASE WHEN up > 0 THEN printf('%d improved', up) END, CASE WHEN down > 0 THEN printf('%d declined', down) END) ELSE '' END AS text FROM n""",
    "batch_scores": f"""WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) < 10 THEN printf('text has %d characters, under 10', length(text)) WHEN length(text) > 50000 THEN printf('text has %d characters, over 50000', length(text)) WHEN doc_id % 7 = 0 THEN 'no score' END AS error, length(text) % 101 AS s FROM documents)
SELECT doc_id, CASE WHEN error IS NULL THEN round(s::DOUBLE, 2) ELSE -1.0::DOUBLE END AS mes_score, CASE WHEN error IS NULL THEN {list(serving.BANDS)}[{band_sql('s')} + 1] ELSE 'Error: ' || error END AS interpretation FROM d""",
    "state_requests": f"""WITH {STATE} SELECT CASE WHEN n_entries - 1 < 1 THEN 'no entries' WHEN user_id % 100 < 1 OR user_id % 100 > 90 THEN 'half-life out of 1 to 90 days' WHEN trend = 'unknown' THEN 'unknown trend' ELSE 'ok' END AS outcome, count(*) AS n FROM us GROUP BY 1""",
    "health": f"WITH z AS (SELECT l_quantity::DOUBLE AS q, l_returnflag = 'R' AS h, least(greatest(100 * ({_linear_sql()}), 0), 100) AS s FROM lineitem) SELECT 'ok' AS status, 'subscore_embedding_v7' AS architecture, count(*) AS n_training_entries, round(corr(s, q) FILTER (h), 4) AS human_corr FROM z",
}
