"""Scores from features and document vectors, calibration, dispatch, and the texts that go with a user's state."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.text import fixed
from textweave.functions.vectors import dot
from textweave.operators.scoring import isotonic, transformed

#: Feature, weight, transform and its parameter of the linear score.
LINEAR_TERMS: list[tuple[str, float, str, float | None]] = [
    ("ce_adj_p75", 0.17, "inv", None),
    ("ne_fragment_sentence_rate", 0.14, "dir", None),
    ("ce_inter_block_break_rate", 0.11, "dir", None),
    ("bc_belief_sentence_count", 0.11, "dir_norm", 18.0),
    ("ce_n_blocks", 0.10, "dir_norm", 20.0),
    ("cle_length_cv", 0.08, "dir", None),
    ("ce_skip_mean", 0.07, "inv", None),
    ("ne_start_to_centroid", 0.06, "inv", None),
    ("se_dominant_cluster_frac", 0.05, "inv", None),
    ("ne_arc_linearity", 0.03, "inv", None),
    ("ne_end_to_centroid", 0.03, "inv", None),
    ("cle_hedge_rate", 0.03, "dir", None),
    ("ne_start_end_sim", 0.02, "inv", None),
]
#: The five dimensions.
DIMENSIONS = ("prediction_coherence", "model_complexity", "compression_progress", "belief_integration", "precision_weighting")
#: Limits of the state classification's signals.
FEW_ENTRIES, LOW_CONFIDENCE, DECLINE, HIGH, LOW, VOLATILE, ROLLING, FLAT, WEAK = 3, 0.1, -1.0, 55.0, 35.0, 0.25, 12.0, 0.5, 2.5
#: The direction the score should take, the token limit and the temperature of each state.
STATES: dict[str, tuple[str, int, float]] = {
    "insufficient_data": ("stable", 300, 0.7),
    "active_integration": ("decrease", 500, 0.7),
    "overwhelm": ("decrease", 300, 0.5),
    "stuck": ("decrease", 500, 0.8),
    "rigidity": ("increase", 500, 0.8),
    "baseline": ("stable", 400, 0.7),
}
#: This engine's own wording: posture, directive and what to avoid.
GUIDANCE: dict[str, tuple[str, str, str]] = {
    "insufficient_data": ("There are too few entries to see a pattern.", "Invite more entries.", "Claims about the writer."),
    "active_integration": ("Disorder is falling.", "Name what is coming together.", "New subjects."),
    "overwhelm": ("Disorder is high and unsteady.", "Offer one concrete anchor.", "Long answers and open questions."),
    "stuck": ("Disorder is high and does not move.", "Show one pattern.", "Repeating what is known."),
    "rigidity": ("Disorder is low and does not move.", "Ask one question that opens a view.", "Confrontation."),
    "baseline": ("Disorder is in its usual range.", "Reflect in balance.", "Making a problem of ordinary change."),
}
BANDS = ("very low", "low", "moderate", "elevated", "high", "very high")
SHORTEST, LONGEST, MOST_ENTRIES = 10, 50_000, 50


def linear_score(columns: list[str]) -> Column:
    """The 13 weighted terms times 100, within 0 and 100. A missing `inv` feature counts 1, any other 0."""
    total = F.lit(0.0)
    for name, weight, kind, p in LINEAR_TERMS:
        value = F.lit(None).cast("double") if name not in columns else F.col(name).cast("double")
        total = total + weight * transformed(F.coalesce(value, F.lit(1.0 if kind == "inv" else 0.0)), kind, p)
    return F.least(F.greatest(100 * total, F.lit(0.0)), F.lit(100.0))


def harness_transform(x: Column, kind: str, p: float | None = None) -> Column:
    """The training harness's transforms; an unknown one raises."""
    if kind == "inv_clip":
        return 1 - F.least(x, F.lit(p if p else 1.0))
    if kind == "inv_nz":
        return F.when(x > 0, 1 - x).otherwise(0.0)
    if kind in ("inv", "dir", "dir_norm"):
        return transformed(x, kind, p)
    raise ValueError(f"unknown transform {kind}")


def subscore(embedding: Column, coefficients: list[float], intercept: float) -> Column:
    """A dimension from a document vector, within 1 and 5; null without a vector."""
    raw = dot(F.slice(embedding, 1, len(coefficients)), F.array(*map(F.lit, coefficients))) + intercept
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(1.0)), F.lit(5.0)))


def calibrated(score: Column, calibration: dict | None) -> Column:
    """Identity, linear or isotonic, by `kind`; unknown kinds and broken thresholds are the identity."""
    kind = (calibration or {}).get("kind")
    if kind == "linear_mes":
        return calibration.get("slope", 1.0) * score + calibration.get("intercept", 0.0)
    if kind == "isotonic_mes":
        return isotonic(score, calibration.get("x_thresholds", []), calibration.get("y_thresholds", []))
    return score


def to_hundred(raw: Column) -> Column:
    return (raw - 1) / 9 * 100


def within(score: Column) -> Column:
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def two_stage_score(subscores: list[Column], features: list[Column], combiner: dict) -> Column:
    """Five subscores and further features through the combiner's coefficients, calibrated, within 0 and 100."""
    inputs = [*subscores, *(F.coalesce(f.cast("double"), F.lit(0.0)) for f in features)]
    raw = sum((c * x for c, x in zip(combiner["coef"], inputs, strict=True)), F.lit(float(combiner["intercept"])))
    return within(calibrated(to_hundred(raw), combiner.get("calibration")))


def hybrid_score(embedding: Column, features: list[Column], model: dict) -> Column:
    """One linear model over the vector and features, within 0 and 100."""
    dim = model["embedding_dim"]
    raw = dot(F.slice(embedding, 1, dim), F.array(*map(F.lit, model["coef"][:dim]))) + float(model["intercept"])
    for c, x in zip(model["coef"][dim:], features, strict=True):
        raw = raw + c * F.coalesce(x.cast("double"), F.lit(0.0))
    return within(to_hundred(raw))


def architecture(artifacts: dict[str, dict]) -> str:
    """What the combiner says of itself; the oldest if it says nothing. No combiner is an error."""
    if "combiner" not in artifacts:
        raise FileNotFoundError("combiner")
    return artifacts["combiner"].get("architecture", "module_aligned_v1")


def available(artifacts: dict[str, dict]) -> list[str]:
    """The ways to score that the artifacts allow, best first; the linear one always."""
    try:
        kind = architecture(artifacts)
    except FileNotFoundError:
        return ["linear"]
    out = []
    if kind == "subscore_embedding_v7" and all(d in artifacts for d in DIMENSIONS):
        out.append("two_stage")
    if "hybrid" in artifacts:
        out.append("hybrid")
    return [*out, "linear"]


def dispatched(method: str, artifacts: dict[str, dict], scores: dict[str, Column]) -> Column:
    """auto: the first available score that is not null; embedding: the same without the linear one, an error if there is
    none; linear: that alone. Any other method raises."""
    there = [scores[m] for m in available(artifacts) if m in scores]
    if method == "auto":
        return F.coalesce(*there)
    if method == "linear":
        return scores["linear"]
    if method == "embedding":
        vectors = [scores[m] for m in available(artifacts) if m in scores and m != "linear"]
        return F.coalesce(*vectors, F.raise_error(F.lit("no document vector or no model for it")).cast("double")) if vectors else F.raise_error(F.lit("no model for vectors")).cast("double")
    raise ValueError(f"method {method!r} is none of auto, embedding, linear")


def interpretation(band: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), band + 1)


def signals(state: Column, n: Column, confidence: Column, trend: Column, slope: Column, score: Column, volatility: Column, rolling: Column) -> Column:
    """array<string>: the measurements that led to a state."""

    def fmt(pattern: str, x: Column) -> Column:
        if (place := re.search(r"%\.(\d)f", pattern)) is None:
            return F.format_string(pattern, x)
        return F.concat(F.lit(pattern[: place.start()]), fixed(x, int(place[1])), F.lit(pattern[place.end() :]))

    high = fmt(f"current_mes=%.1f (above {HIGH})", score)
    flat = fmt(f"|trend_slope|=%.1f (below {FLAT})", F.abs(slope))
    when = lambda test, text: F.when(test, text)
    kinds = {
        "insufficient_data": [when(n < FEW_ENTRIES, fmt(f"n_entries=%d (below {FEW_ENTRIES})", n)), when(confidence < LOW_CONFIDENCE, fmt(f"confidence=%.2f (below {LOW_CONFIDENCE})", confidence))],
        "active_integration": [F.concat(F.lit("trend="), trend), fmt(f"trend_slope=%.1f pts/week (below {DECLINE})", slope)],
        "overwhelm": [high, when(volatility > VOLATILE, fmt(f"volatility=%.2f (above {VOLATILE})", volatility)), when(rolling > ROLLING, fmt(f"rolling_7d_std=%.1f (above {ROLLING})", rolling))],
        "stuck": [high, flat],
        "rigidity": [fmt(f"current_mes=%.1f (below {LOW})", score), flat],
    }
    out = F.array(fmt("current_mes=%.1f (in normal range)", score))
    for name, parts in kinds.items():
        out = F.when(state == name, F.filter(F.array(*parts), lambda x: x.isNotNull())).otherwise(out)
    return out


def weak_dimensions(values: dict[str, Column], most: int = 2) -> Column:
    """array<struct<value,name>>: the weakest dimensions at or under WEAK, the first of the given order on a tie."""
    rows = F.array(*(F.struct(v.cast("double").alias("value"), F.lit(k).alias("place"), F.lit(name).alias("name")) for k, (name, v) in enumerate(values.items())))
    weak = F.slice(F.array_sort(F.filter(rows, lambda r: r["value"] <= WEAK)), 1, most)
    return F.transform(weak, lambda r: F.struct(F.round(r["value"], 2).alias("value"), r["name"].alias("name")))


def display_name(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "_", " "))


def prompts(rows: DataFrame) -> DataFrame:
    """Adds system, user, max_tokens, temperature and target to rows (state, signals, weakest, journal_text, previous).

    `previous` is the last insight or null. The wording of GUIDANCE is this engine's own; a caller may pass another table
    by joining it first. The lookup is a map literal, so nothing is shuffled.
    """
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("state"))
    guide = [pick({k: v[i] for k, v in GUIDANCE.items()}) for i in range(3)]
    target, tokens, heat = (pick({k: v[i] for k, v in STATES.items()}) for i in range(3))
    weak = F.transform("weakest", lambda r: F.concat(F.lit("- "), display_name(r["name"]), F.lit(": "), fixed(r["value"], 2)))
    some = F.when(F.size("weakest") > 0, F.concat(F.lit("Weakest dimensions:\n"), F.array_join(weak, "\n")))
    system = F.concat_ws("\n", F.lit("Insights into journal entries: concise, grounded in the entry."), guide[0], some, F.concat(F.lit("Directive: "), guide[1]), F.concat(F.lit("Avoid: "), guide[2]))
    previous = F.when(F.col("previous").isNotNull(), F.concat(F.lit("Previous insight: "), F.col("previous")))
    user = F.concat_ws("\n", F.concat(F.lit("State: "), F.col("state")), F.concat(F.lit("Signals: "), F.array_join("signals", "; ")), F.concat(F.lit("Target: "), target), some, previous, F.lit("Entry:"), F.col("journal_text"))
    return rows.select("*", system.alias("system"), user.alias("user"), tokens.alias("max_tokens"), heat.alias("temperature"), target.alias("target"))


def subscore_deltas(before: Column, after: Column) -> Column:
    """map<string,struct<delta,improved>> over the keys that both maps have; more is better."""
    both = F.map_filter(F.map_zip_with(before, after, lambda k, a, b: b - a), lambda k, d: d.isNotNull())
    return F.transform_values(both, lambda k, d: F.struct(F.round(d, 2).alias("delta"), (d > 0).alias("improved")))


def feedback_text(delta: Column, target: Column, moved: Column, deltas: Column, stable_band: float = 3.0, noise: float = 1.0) -> Column:
    """A sentence on how the score moved against its target, and how many dimensions did."""
    word = F.when(delta < 0, "decreased").when(delta > 0, "increased").otherwise("unchanged")
    ending = (
        F.when((target == "stable") & (F.abs(delta) <= stable_band), "within the stable band")
        .when(target == "stable", "outside the stable band")
        .when(moved, F.concat(F.lit("in the target direction: "), target))
        .when(F.abs(delta) <= noise, F.concat(F.lit("no significant movement, target: "), target))
        .otherwise(F.concat(F.lit("opposite to the target: "), target))
    )
    values = F.map_values(deltas)
    up, down = F.size(F.filter(values, lambda d: d["improved"])), F.size(F.filter(values, lambda d: d["delta"] < 0))
    counts = F.concat_ws(", ", F.when(up > 0, F.format_string("%d improved", up)), F.when(down > 0, F.format_string("%d declined", down)))
    return F.concat(word, F.lit(" by "), fixed(F.abs(delta), 1), F.lit(", "), ending, F.when(counts != "", F.concat(F.lit("; "), counts)).otherwise(""))


def trend_summary(n: Column, span: Column, trend: Column, slope_week: Column, volatility: Column) -> Column:
    level = F.when(volatility > 0.3, "high").when(volatility > 0.15, "moderate").otherwise("low")
    return F.concat(F.format_string("%d entries in ", n), fixed(span, 0), F.lit(" days: "), trend, F.lit(" ("), fixed(slope_week, 1, sign=True), F.lit(" a week), volatility "), level, F.lit(" ("), fixed(volatility, 2), F.lit(")"))


def request_error(text: Column) -> Column:
    """Why a text is refused, or null: its length must be within SHORTEST and LONGEST characters."""
    n = F.length(text)
    return F.when(text.isNull(), "no text").when(n < SHORTEST, F.format_string("text has %d characters, under %d", n, F.lit(SHORTEST))).when(n > LONGEST, F.format_string("text has %d characters, over %d", n, F.lit(LONGEST)))


def state_request_error(entries: Column, half_life: Column, trend: Column) -> Column:
    """Why a state request is refused, or null; a trend that the state query may call `unknown` is refused here."""
    return F.when(entries < 1, "no entries").when((half_life < 1) | (half_life > 90), "half-life out of 1 to 90 days").when(~F.coalesce(trend.isin("improving", "worsening", "stable"), F.lit(False)), "unknown trend")


def batch_scores(rows: DataFrame, score: Column, error: Column, band: Column) -> DataFrame:
    """Adds mes_score and interpretation: a row that cannot be scored has -1 and its error; the others go on."""
    failed = F.coalesce(error, F.when(score.isNull(), F.lit("no score")))
    return rows.withColumns({"mes_score": F.when(failed.isNull(), F.round(score, 2)).otherwise(-1.0), "interpretation": F.when(failed.isNull(), interpretation(band)).otherwise(F.concat(F.lit("Error: "), failed))})


def health(spark, manifest: dict) -> DataFrame:
    """One row from a model manifest: status, architecture, number of training entries, human correlation."""
    metrics = manifest.get("metrics", {})
    human = metrics.get("v7_human_corr", metrics.get("oof_human_corr", 0.0))
    return spark.createDataFrame([("ok", manifest.get("architecture", "unknown"), int(manifest.get("n_entries", 0)), round(float(human), 4))], "status string, architecture string, n_training_entries long, human_corr double")


def load_artifacts(spark, folder: str, names: list[str]) -> dict[str, dict]:
    """JSON documents of a folder by name, those that are there; a few small rows reach the driver."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select("_metadata.file_name", "value")
    found = {r.file_name.removesuffix(".json"): json.loads(r.value) for r in files.where(F.col("file_name").isin(*(f"{n}.json" for n in names))).collect()}
    return found
