"""Features of ordered sentences from their words: disorder (gd_), narrative (ne_), load (cle_) and belief conflict (bc_).

A document is one row with its sentences as an array, so nothing is shuffled: each sentence is marked once and the marks
are counted by array functions. Null arrays count as empty; other columns than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions import lexicons as lx
from textweave.functions import text as tx
from textweave.functions.candidates import candidates, may, near_words
from textweave.functions.vectors import dot

CONFLICT_SIM_T = 0.55
#: Sentences around a conflict in which an integration marker counts.
NEARBY = 2
#: The terms of gd_global_disorder_score.
DISORDER_WEIGHTS = {
    "gd_topic_reset_rate": 0.16, "gd_dangling_referent_rate": 0.13, "gd_abandoned_setup_rate": 0.12, "gd_no_compression_ending": 0.13, "gd_loop_repetition_rate": 0.13, "gd_corruption_rate": 0.30, "gd_runon_chain_rate": 0.10,
    "gd_meta_scaffold_rate": 0.05, "gd_unanchored_question_rate": 0.03, "gd_disorder_marker_count_norm": 0.20, "gd_block_reset_rate": 0.10, "gd_abandoned_setup_count_norm": 0.08, "gd_entity_drift_score": 0.12, "gd_compression_failure_score": 0.16,
}


def alternation(phrases: tuple[str, ...]) -> str:
    """The phrases as one pattern, gathered by first letter so that most places fail at once."""
    rests: dict[str, list[str]] = {}
    for p in phrases:
        rests.setdefault(p[0], []).append(p[1:].replace(".", r"\."))
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items()) + ")"


def has_phrase(low: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase stands in a lower-case text without a word character on either side.

    The character before is matched and not looked back at, so the phrases are tried at the beginnings of words alone.
    """
    return low.rlike(r"(?U)(?:^|\W)" + alternation(phrases) + r"(?!\w)")


def has_word(low: Column, patterns: tuple[str, ...]) -> Column:
    """The same for patterns that begin with a word character, with word boundaries."""
    return low.rlike(r"(?U)(?:^|\W)(?:" + "|".join(patterns) + r")\b")


#: Lists of phrases by the name of their mark.
PHRASES = {
    "temporal": lx.TEMPORAL_MARKERS, "past": lx.PAST_MARKERS, "future": lx.FUTURE_MARKERS, "glue": lx.GLUE_CONNECTORS, "connects": lx.CONNECTORS, "reflects": lx.REFLECTION_PHRASES, "closes": lx.CLOSURE_CUES,
    "gives_up": lx.ABANDONMENT_MARKERS, "restarts": lx.RESTART_CUES, "hedges": lx.HEDGE_CUES,
}
VERBS = alternation(lx.AUXILIARY_VERBS + lx.MODAL_VERBS + lx.IRREGULAR_PAST + lx.THIRD_PERSON_VERBS)
#: What a lower-case sentence must hold for a mark of wording() to be true.
WORDING_CANDIDATES = {
    **{k: near_words(alternation(v)) for k, v in PHRASES.items()}, "verb": near_words(rf"{VERBS}|{alternation(lx.BASE_VERBS)}") + rf"|(?:{'|'.join(lx.VERB_SUFFIXES)})(?:$|[^0-9A-Za-z_])", "broken": r"\.\.\.|…|—|–|--|!!!|\?\?\?",
}


def has_verb(low: Column) -> Column:
    suffixed = r"\w{4,}+(?<=" + "|".join(r"\w\w" + x for x in lx.VERB_SUFFIXES) + ")"
    return has_word(low, (VERBS, suffixed)) | low.rlike(r"(?U)(?:^|\W)(?=" + alternation(lx.BASE_VERBS) + r"\b)(?<!\bthe\s)(?<!\ba\s)(?<!\ban\s)")


def blank(t: Column) -> Column:
    return t.rlike(r"(?U)^\s*$")


def how_many(marks: Column, name: str) -> Column:
    return F.size(F.filter(marks, lambda x: x[name]))


def rate(count: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(count.cast("double"), of), F.lit(0.0))


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def last(marks: Column, back: int = 0) -> Column:
    return F.get(marks, F.size(marks) - 1 - back)


def runon(t: Column, w: Column) -> Column:
    """In a lower-case text: 25 tokens or more, and five spaced connectors or no full stop, semicolon or colon."""
    spaced = sum((F.length(t) - F.length(F.replace(t, F.lit(f" {c} ")))) / (len(c) + 2) for c in lx.RUNON_CONNECTORS)
    return (F.size(w) >= 25) & ((spaced >= 5) | ~t.rlike("[.;:]"))


def disorder(docs: DataFrame, sentences: str = "sentences", id_col: str = "doc_id") -> DataFrame:
    """The 17 gd_ features. Blank strings separate blocks and count as no sentence; without sentences all are 0."""
    s = F.col("_s")
    starts = F.filter(s, lambda x, i: ~blank(x) & ((i == 0) | F.coalesce(blank(F.get(s, i - 1)), F.lit(True))))
    resets = lambda x: has_word(F.lower(x), lx.TOPIC_RESET) | starts_with_referent(F.lower(x)) | has_word(F.lower(x), lx.SETUP)
    starts_with_referent = lambda x: x.rlike(r"(?U)^\s*(?:" + "|".join(lx.REFERENT_STARTS) + r")\b")
    base = docs.select(F.col(id_col), F.filter(F.coalesce(sentences, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("_s"))
    base = base.select(id_col, F.filter(s, lambda x: ~blank(x)).alias("_c"), starts.alias("_b"))
    tokens = base.select("*", F.transform("_c", lambda x: F.struct(x.alias("t"), F.lower(x).alias("l"), tx.letter_tokens(x).alias("w"))).alias("_w"))
    marked = tokens.select(
        id_col, "_b",
        F.transform("_w", lambda x: F.struct(
            has_word(x.l, lx.TOPIC_RESET).alias("reset"), starts_with_referent(x.l).alias("referent"), has_word(x.l, lx.REFLECTION_WORDS).alias("reflects"), has_word(x.l, lx.SETUP).alias("setup"),
            has_word(x.l, lx.OPEN_ENDINGS).alias("open"), tx.looping(x.w).alias("loop"), tx.corrupted(x.t).alias("corrupt"), runon(x.l, x.w).alias("runon"), (x.t.contains("?") & (F.size(x.w) <= 12)).alias("question"),
            has_word(x.t, (r"[A-Z][a-z]{2,}", *lx.ANCHOR_WORDS)).alias("anchor"), F.size(x.w).alias("n"),
        )).alias("m"),
        F.sort_array(F.filter(F.flatten(F.transform("_c", lambda x: F.regexp_extract_all(x, F.lit(r"(?U)[A-Z](?<=\b[A-Z])[a-z]{2,}\b"), F.lit(0)))), lambda x: ~x.isin(*lx.NOT_ENTITIES))).alias("e"),
    )
    m, e, b = F.col("m"), F.col("e"), F.col("_b")
    anchor = F.col("_anchor")  # a column of its own, or it would be found again for every sentence
    marked = marked.withColumn("_anchor", F.array_position(F.transform(m, lambda x: x.anchor), True))
    single = F.size(F.filter(e, lambda x, i: ~F.coalesce(F.get(e, i - 1) == x, F.lit(False)) & ~F.coalesce(F.get(e, i + 1) == x, F.lit(False))))
    counted = marked.select(
        id_col, F.size(m).alias("n"), how_many(m, "reset").alias("resets"), how_many(m, "setup").alias("setups"), how_many(m, "loop").alias("loops"), how_many(m, "corrupt").alias("corrupts"), how_many(m, "runon").alias("runons"),
        how_many(m, "question").alias("questions"), how_many(m, "reflects").alias("reflections"), flag(last(m)["open"]).alias("gd_no_compression_ending"),
        F.size(F.filter(m, lambda x, i: x.referent & ~x.reflects & ((anchor == 0) | (i < anchor)))).alias("dangling"),
        rate(F.size(F.filter(F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), resets)), F.size(b) - 1).alias("gd_block_reset_rate"),
        F.aggregate(m, F.lit(0), lambda a, x: a + x.n).alias("words"), F.size(e).alias("mentions"), single.alias("singles"),
    )
    c = F.col
    total = c("resets") + c("dangling") + 2 * c("setups") + c("loops") + c("corrupts") + c("runons") + c("questions") + c("gd_no_compression_ending")
    rates = {"gd_topic_reset_rate": "resets", "gd_dangling_referent_rate": "dangling", "gd_abandoned_setup_rate": "setups", "gd_loop_repetition_rate": "loops", "gd_corruption_rate": "corrupts", "gd_runon_chain_rate": "runons", "gd_meta_scaffold_rate": "setups", "gd_unanchored_question_rate": "questions"}
    step = counted.select(
        id_col, "n", "gd_no_compression_ending", "gd_block_reset_rate", *[rate(c(v), c("n")).alias(k) for k, v in rates.items()],
        F.least(c("setups") / 4, F.lit(1.0)).alias("gd_abandoned_setup_count_norm"), F.least(total / 8, F.lit(1.0)).alias("gd_disorder_marker_count_norm"), (total / F.greatest("words", F.lit(1)) * 500).alias("gd_disorder_markers_per_500w"),
        rate(c("singles"), c("mentions")).alias("gd_single_use_entity_rate"), F.least(rate(c("singles"), c("mentions")) * F.least(c("mentions") / 4, F.lit(1.0)), F.lit(1.0)).alias("gd_entity_drift_score"), (c("reflections") == 0).cast("double").alias("_none"),
    )
    failure = 0.45 * c("gd_no_compression_ending") + 0.25 * c("gd_abandoned_setup_count_norm") + 0.20 * c("gd_block_reset_rate") + 0.10 * c("_none")
    step = step.withColumn("gd_compression_failure_score", F.when(c("n") > 0, F.least(failure, F.lit(1.0))).otherwise(0.0))
    score = sum(c(k) * w for k, w in DISORDER_WEIGHTS.items()) + 0.15 * F.least(c("gd_disorder_markers_per_500w") / 20, F.lit(1.0))
    return step.withColumn("gd_global_disorder_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).drop("n", "_none")


def wording(docs: DataFrame, sentences: str = "sentences", id_col: str = "doc_id") -> DataFrame:
    """The eleven ne_ and five cle_ features of words and punctuation; all 0 with one sentence or none."""
    cluster = r"\.{3,}|…+"
    base = docs.select(F.col(id_col), F.filter(F.coalesce(sentences, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("_s"))
    low = base.withColumn("_l", F.transform("_s", F.lower))
    zipped = low.select(id_col, F.arrays_zip(F.col("_s").alias("t"), F.col("_l").alias("l"), candidates(F.col("_l"), list(WORDING_CANDIDATES.values())).alias("k")).alias("_z"))
    at = {name: k for k, name in enumerate(WORDING_CANDIDATES)}
    broken = lambda x, mark: may(x.k, at["broken"]) & mark
    marked = zipped.select(
        id_col,
        F.transform("_z", lambda x: F.struct(
            F.size(tx.word_tokens(x.t)).alias("n"), (may(x.k, at["verb"]) & has_verb(x.l)).alias("verb"), broken(x, x.t.rlike(r"(?:\.{3,}|…)\s*$")).alias("trails"), x.t.rlike(r"[.!?]\s*$").alias("ends"),
            broken(x, x.t.rlike(r"(?:—|--)\s*$")).alias("dash"), x.l.rlike(r"(?U)^\s*(?:but|and|so)\b").alias("joins"),
            *[(may(x.k, at[name]) & has_phrase(x.l, phrases)).alias(name) for name, phrases in PHRASES.items()], x.t.rlike(r"\?\s*$").alias("asks"),
            broken(x, F.regexp_count(x.t, F.lit("--|—|–")) >= 2).alias("dashes"), broken(x, F.regexp_count(x.t, F.lit(cluster)) >= 2).alias("clusters"),
            broken(x, x.t.rlike(r"!{3,}|\?{3,}|(?:—|--)\s*\S[\s\S]*\S")).alias("noisy"),
        )).alias("m"),
    )
    full = marked.select(
        id_col,
        F.transform("m", lambda x: x.withField("ne_fragment", F.when(x.n <= 4, ~(x.verb & x.ends)).otherwise(~x.verb | x.trails | ~x.ends)).withField("cle_fragment", x.trails | x.dash | ~x.verb | (x.joins & ~x.ends)).withField("breaks", x.trails | x.dashes | x.clusters).withField("noise", x.noisy | x.clusters)).alias("m"),
    )
    m = F.col("m")
    n = F.size(m)
    jumps = F.size(F.filter(m, lambda x, i: ((F.get(m, i - 1)["past"] & x.future) | (F.get(m, i - 1)["future"] & x.past)) & ~(F.get(m, i - 1)["glue"] | x.glue)))
    mean = F.aggregate(m, F.lit(0.0), lambda a, x: a + x.n) / n
    spread = F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, x: a + (x.n - F.col("_mean")) * (x.n - F.col("_mean"))) / n)
    shares = {
        "ne_temporal_markers_rate": "temporal", "ne_connectors_rate": "connects", "ne_reflection_rate": "reflects", "ne_fragment_sentence_rate": "ne_fragment", "ne_punct_break_rate": "breaks",
        "cle_fragment_rate": "cle_fragment", "cle_restart_rate": "restarts", "cle_hedge_rate": "hedges", "cle_punctuation_noise": "noise",
    }
    values = {name: rate(how_many(m, mark), n) for name, mark in shares.items()}
    values["ne_temporal_jump_rate"] = rate(jumps, n - 1)
    values |= {"ne_last_sentence_reflective": flag(last(m)["reflects"]), "ne_end_open_question": flag(last(m)["asks"]), "ne_end_fragment": flag(last(m)["ne_fragment"])}
    values |= {"ne_end_closure_cue": flag(last(m)["closes"] | last(m, 1)["closes"]), "ne_end_abandonment_cue": flag(last(m)["gives_up"] | last(m, 1)["gives_up"])}
    values["cle_length_cv"] = F.coalesce(F.try_divide(spread, F.col("_mean")), F.lit(0.0))
    measured = full.select(id_col, "m", F.when(n > 1, mean).otherwise(0.0).alias("_mean"))
    return measured.select(id_col, *[F.when(n > 1, v).otherwise(0.0).alias(k) for k, v in values.items()])


def belief_conflicts(docs: DataFrame, sentences: str = "sentences", embeddings: str = "embeddings", id_col: str = "doc_id") -> DataFrame:
    """The 12 bc_ features of sentences with unit vectors (arrays of one length); all 0 with one sentence or none.

    A conflict is two belief sentences of similarity CONFLICT_SIM_T or more and opposite polarity. Pairs are looked at
    inside the document's own row, from the first sentence to the later ones; they never become rows.
    """
    words = [w for pair in lx.POLAR_PAIRS for w in pair]
    bits = lambda t, order: sum((F.when(t.rlike(rf"(?U)\b{w}\b"), F.lit(1 << k)).otherwise(F.lit(0)) for k, w in enumerate(order)), F.lit(0).cast("long"))
    opposite = [w for pair in lx.POLAR_PAIRS for w in reversed(pair)]
    believes = lambda t: F.lower(t).rlike("|".join(lx.BELIEF_PATTERNS))
    rows = docs.select(F.col(id_col), F.transform(F.arrays_zip(F.col(sentences).alias("t"), F.col(embeddings).alias("e")), lambda x, i: F.struct(i.alias("i"), x.t.alias("t"), x.e.alias("e"))).alias("_z"))
    rows = rows.select(
        id_col, F.greatest(F.size("_z"), F.lit(0)).alias("n"), F.transform("_z", lambda x: has_phrase(F.lower(x.t), lx.INTEGRATION_MARKERS)).alias("g"),
        F.transform(F.filter("_z", lambda x: believes(x.t)), lambda x: F.struct(x.i.alias("i"), x.e.alias("e"), has_phrase(F.lower(x.t), lx.NEGATION_WORDS).alias("no"), bits(F.lower(x.t), words).alias("p"), bits(F.lower(x.t), opposite).alias("q"))).alias("b"),
    )
    b, g = F.col("b"), F.col("g")
    later = lambda x: F.filter(b, lambda y: (y.i > x.i) & ((x.no != y.no) | (x.p.bitwiseAND(y.q) != 0)))
    pairs = F.filter(F.flatten(F.transform(b, lambda x: F.transform(later(x), lambda y: F.struct(x.i.alias("i"), y.i.alias("j"), dot(x.e, y.e).alias("s"))))), lambda p: p.s >= CONFLICT_SIM_T)
    near = lambda p: F.exists(F.slice(g, F.greatest(p.i - NEARBY, F.lit(0)) + 1, p.j + NEARBY + 1 - F.greatest(p.i - NEARBY, F.lit(0))), lambda x: x)
    found = rows.select(id_col, "n", F.size(b).alias("k"), F.when(F.col("n") > 1, pairs).alias("c"), "g").select("*", F.size(F.filter("c", near)).alias("near"))
    c, some, m = F.col("c"), F.size("c") > 0, F.size("c")
    total = lambda of: F.aggregate(c, F.lit(0.0), lambda a, x: a + of(x))
    beliefs = F.when(F.col("n") > 1, F.col("k")).otherwise(0)
    z = lambda v: F.when(some, v).otherwise(0.0)
    whole = lambda v: F.when(some, v).otherwise(0).cast("int")
    return found.select(
        id_col, beliefs.alias("bc_belief_sentence_count"), rate(beliefs, F.col("n")).alias("bc_belief_sentence_rate"), whole(m).alias("bc_conflict_pair_count"), z(rate(m, F.col("k"))).alias("bc_conflict_rate"),
        z(F.array_max(F.transform(c, lambda x: x.s))).alias("bc_max_conflict_sim"), z(rate(total(lambda x: x.s), m)).alias("bc_mean_conflict_sim"),
        z(rate(total(lambda x: x.j - x.i), m)).alias("bc_conflict_span_mean"), whole(F.array_max(F.transform(c, lambda x: x.j - x.i))).alias("bc_conflict_span_max"),
        whole(F.col("near")).alias("bc_integrated_count"), z(rate(F.col("near"), m)).alias("bc_integration_rate"), whole(m - F.col("near")).alias("bc_unresolved_count"), z(rate(m - F.col("near"), m)).alias("bc_unresolved_rate"),
    )
