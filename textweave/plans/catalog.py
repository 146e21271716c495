"""Registered queries and the SQL that must give the same rows.

Sentence vectors are the rows of `embeddings` with label as document and vec_id as order; ten in a row are a block.
Scored entries are `events`; rating triples come from `lineitem`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweave.functions import lexicons as lx
from textweave.functions import text as tx
from textweave.functions.segments import block_sentences
from textweave.functions.vectors import rounded, unit
from textweave.operators import clusters, coherence, discourse, quality, ratings, reports, scoring, temporal
from textweave.plans import audits, boosting, learning, records, sampling, serving
from textweave.plans.tables import TE, spread, table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sent_id"), F.expr("vec_id div 10").alias("block_id"), "embedding")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 10 + 1).alias("a"), F.pmod("l_partkey", F.lit(10)).cast("double").alias("b"), F.pmod("l_suppkey", F.lit(7)).cast("double").alias("c"))
    return ratings.consensus(m, ["a", "b", "c"])


def ce_features(spark, sf_dir):
    return rounded(coherence.coherence(vectors(spark, sf_dir)))


def cle_similarity(spark, sf_dir):
    return rounded(coherence.similarity_load(vectors(spark, sf_dir)))


def ne_vectors(spark, sf_dir):
    return rounded(coherence.narrative(vectors(spark, sf_dir)))


def se_features(spark, sf_dir):
    return rounded(clusters.topic_clusters(vectors(spark, sf_dir)))


def document_vectors(spark, sf_dir):
    cells = vectors(spark, sf_dir).select("doc_id", F.posexplode("embedding").alias("pos", "v")).groupBy("doc_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m")).select("doc_id", unit(F.col("m.v")).alias("u"))
    return rounded(mean.select("doc_id", F.posexplode("u").alias("pos", "v")))


def te_features(spark, sf_dir):
    return rounded(temporal.longitudinal(temporal.entries(table(spark, sf_dir, "events"))), 4)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, (*reports.SPECTRUM, reports.EMOTIONAL, reports.NEUTRAL)))
    kind = F.get(kinds, F.col("l_linenumber").cast("int") - 1)
    return triples(spark, sf_dir).select("l_orderkey", "l_linenumber", kind.alias("control_type"), (F.col("a") * 10).alias("expected"), (F.col("b") * 10).alias("model"))


def eval_by_band(spark, sf_dir):
    return rounded(reports.summary(scored_rows(spark, sf_dir), "control_type"))


def eval_gates(spark, sf_dir):
    return reports.gates(scored_rows(spark, sf_dir))


def eval_worst(spark, sf_dir):
    return rounded(reports.worst(scored_rows(spark, sf_dir), ["l_orderkey", "l_linenumber"]))


def segment_blocks(spark, sf_dir):
    x = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(block_sentences(F.col("text")), F.array().cast("array<struct<block_id:int,text:string>>")).alias("x"))
    blocks = F.size(F.array_distinct(F.col("x.block_id")))
    return x.select("doc_id", blocks.alias("n_blocks"), F.size("x").alias("n_sentences"), F.md5(F.array_join(F.transform("x", lambda s: F.concat(s["block_id"].cast("string"), F.lit(":"), s["text"])), "\n").cast("binary")).alias("digest"))


def ne_end_similarity(spark, sf_dir):
    return rounded(coherence.end_similarity(vectors(spark, sf_dir)))


def feedback_effect(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    target = F.element_at(F.array(F.lit("decrease"), F.lit("increase"), F.lit("stable")), (F.col("event_id") % 3 + 1).cast("int"))
    moves = table(spark, sf_dir, "events").select("event_id", target.alias("target"), (F.col("value") - F.lag("value").over(w)).alias("mes_delta")).where("mes_delta IS NOT NULL")
    moved, effective = scoring.feedback(F.col("mes_delta"), F.col("target"))
    return rounded(moves.select("event_id", "target", "mes_delta", moved.alias("moved_correctly"), effective.alias("effective")))


def rater_consensus(spark, sf_dir):
    return rounded(triples(spark, sf_dir))


def rater_agreement(spark, sf_dir):
    return rounded(ratings.agreement(triples(spark, sf_dir), ["a", "b", "c"]))


def rating_histogram(spark, sf_dir):
    return triples(spark, sf_dir).groupBy(F.least(F.floor("consensus"), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def feature_correlations(spark, sf_dir):
    return rounded(ratings.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_discount"))


def rank_correlation(spark, sf_dir):
    return rounded(ratings.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


def ks_test(spark, sf_dir):
    return rounded(ratings.kolmogorov_smirnov(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], (F.col("l_returnflag") == "R").cast("int")))


def tertile_bins(spark, sf_dir):
    return ratings.tertiles(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 4).alias("low"), F.round(F.max("o_totalprice"), 4).alias("high"))


def balanced_sample(spark, sf_dir):
    return ratings.balanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


def source_folds(spark, sf_dir):
    return ratings.folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


def calibration_buckets(spark, sf_dir):
    m = triples(spark, sf_dir).select((F.col("a") * 10).alias("expected"), (F.col("b") * 10).alias("model"))
    return rounded(ratings.buckets(m, "expected"))


def linear_score(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    terms = [(scoring.transformed(F.col("l_discount"), "inv"), 0.4), (scoring.transformed(F.col("l_tax"), "dir"), 0.3), (scoring.transformed(F.col("l_quantity"), "dir_norm", 50.0), 0.3)]
    score = scoring.weighted_score(terms)
    return rounded(d.select("l_orderkey", "l_linenumber", score.alias("score"), scoring.isotonic(score, [0.0, 40.0, 60.0, 100.0], [0.0, 20.0, 80.0, 100.0]).alias("calibrated"), scoring.band(score).alias("band")))


def opening_repeats(spark, sf_dir):
    return quality.openings(table(spark, sf_dir, "documents"))


def text_markers(spark, sf_dir):
    return rounded(quality.markers(spread(table(spark, sf_dir, "documents"))))


def sentence_counts(spark, sf_dir):
    """Texts without a sentence, null ones too, have zeros."""
    s = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode_outer(tx.sentences(tx.normalize_text(F.col("text")))).alias("sent_id", "sentence"))
    short = F.count_if(F.size(tx.letter_tokens(F.col("sentence"))) <= 4)
    return s.groupBy("doc_id").agg(F.count("sentence").alias("n_sentences"), F.coalesce(F.max(F.length("sentence")), F.lit(0)).alias("longest"), short.alias("n_short"))


def sentence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", tx.sentences(tx.normalize_text(F.col("text"))).alias("sentences"))


def gd_features(spark, sf_dir):
    return rounded(discourse.disorder(sentence_arrays(spark, sf_dir)))


def ne_cle_wording(spark, sf_dir):
    return rounded(discourse.wording(sentence_arrays(spark, sf_dir)))


def bc_features(spark, sf_dir):
    """Turns of a conversation as sentences; a turn's vector has one of two directions, by the parity of its length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")).withColumn("odd", F.length("t") % 2 == 1)
    vector = F.when(F.col("odd"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8)))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t", vector.alias("e")))).alias("s"))
    docs = whole.select(F.col("conv_id").alias("doc_id"), F.col("s.t").alias("sentences"), F.col("s.e").alias("embeddings"))
    return rounded(discourse.belief_conflicts(docs))


def held_out_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ce_features, cle_similarity, ne_vectors, se_features, document_vectors, te_features, rater_consensus, rater_agreement, rating_histogram, feature_correlations,
        rank_correlation, ks_test, tertile_bins, balanced_sample, source_folds, calibration_buckets, linear_score, opening_repeats, text_markers, sentence_counts, held_out_texts,
        gd_features, ne_cle_wording, bc_features, eval_by_band, eval_gates, eval_worst, segment_blocks, ne_end_similarity, feedback_effect,
    )
}
FLAGSHIP = "ce_features"

_T = """
e AS (SELECT label AS doc_id, vec_id AS sent_id, vec_id // 10 AS block_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT *, lead(e) OVER w AS e1, lead(e, 2) OVER w AS e2, lead(e, 3) OVER w AS e3, lead(block_id) OVER w AS b1 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)),
d AS (SELECT doc_id, sent_id, block_id, e, list_dot_product(e, e1) AS s, list_dot_product(e, e2) AS s2, list_dot_product(e, e3) AS s3, block_id = b1 AS same FROM l),
t AS (SELECT *, lead(s) OVER w AS nx, lag(s) OVER w AS pv, lead(s) OVER w - s AS dr, sum(CASE WHEN s < 0.45 THEN 1 ELSE 0 END) OVER w AS run FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id))
"""
def _round(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_EDGE = r"[^\p{L}\p{N}_]"


def _has(patterns: tuple[str, ...], column: str = "t", start: str = "(?:^|{0})", flags: str = "(?i)") -> str:
    """DuckDB's test for any pattern between non-word characters."""
    pattern = f"{flags}{start.format(_EDGE)}(?:{'|'.join(patterns)})(?:$|{_EDGE})".replace("'", "''")
    return f"regexp_matches({column}, '{pattern}')"


_SENTENCES = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text FROM documents),
ss AS (SELECT r, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS ss FROM d),
s AS (SELECT r, unnest(ss) AS t, unnest(range(len(ss))) AS i FROM ss)
"""
_BASE = "|".join(lx.BASE_VERBS)
_PLAIN = lx.AUXILIARY_VERBS + lx.MODAL_VERBS + lx.IRREGULAR_PAST + lx.THIRD_PERSON_VERBS
_VERB = "(" + _has((*_PLAIN, r"[\p{L}\p{N}_]{2,}(?:ed|ing|es)")) + " OR " + _has(lx.BASE_VERBS, rf"regexp_replace(t, '(?i)\b(the|a|an)\s({_BASE})\b', 'x', 'g')") + ")"
_PHRASES = lambda phrases: _has(tuple(p.replace(".", r"\.") for p in phrases))


_TRIPLES = """
m AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) % 10 + 1 AS a, CAST(l_partkey % 10 AS DOUBLE) AS b, CAST(l_suppkey % 7 AS DOUBLE) AS c FROM lineitem),
q AS (SELECT *, list_sort([a, b, c]) AS s FROM m),
k AS (SELECT l_orderkey, l_linenumber, a, b, c, CASE WHEN s[3] - s[1] > 3 THEN CASE WHEN s[2] - s[1] >= s[3] - s[2] THEN (s[2] + s[3]) / 2 ELSE (s[1] + s[2]) / 2 END ELSE (s[1] + s[2] + s[3]) / 3 END AS consensus,
  s[3] - s[1] > 3 AS trimmed, s[3] - s[1] AS spread, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) AS deviation FROM q)
"""

_SCORED = f"z AS (SELECT l_orderkey, l_linenumber, {list((*reports.SPECTRUM, reports.EMOTIONAL, reports.NEUTRAL))}[l_linenumber] AS control_type, a * 10 AS expected, b * 10 AS model FROM k)"

#: A sentence with words w, and v those of over three letters in order, that repeats itself.
_LOOP = """len(w) >= 6 AND (len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) > 0 OR len(list_filter(range(1, len(w) - 2), lambda k: w[k] = w[k + 2] AND w[k + 1] = w[k + 3])) > 0 OR len(list_filter(range(1, greatest(len(v) - 1, 1)), lambda k: v[k] = v[k + 2])) > 0)"""

SQL: dict[str, str] = {
    "ce_features": f"""WITH {_T},
rl AS (SELECT doc_id, max(m) AS m FROM (SELECT doc_id, run, count(*) AS m FROM t WHERE s >= 0.45 GROUP BY doc_id, run) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS ce_n_sentences, count(s) AS ce_n_adj, coalesce(avg(s), 0) AS ce_adj_mean, coalesce(stddev_pop(s), 0) AS ce_adj_std, coalesce(min(s), 0) AS ce_adj_min, coalesce(max(s), 0) AS ce_adj_max,
  coalesce(median(s), 0) AS ce_adj_median, coalesce(quantile_cont(s, 0.1), 0) AS ce_adj_p10, coalesce(quantile_cont(s, 0.25), 0) AS ce_adj_p25, coalesce(quantile_cont(s, 0.75), 0) AS ce_adj_p75, coalesce(quantile_cont(s, 0.9), 0) AS ce_adj_p90,
  count_if(s < 0.45)::BIGINT AS ce_break_count, coalesce(avg((s < 0.45)::INT), 0) AS ce_break_rate, coalesce(min(dr), 0) AS ce_drop_min, coalesce(avg(dr), 0) AS ce_drop_mean, coalesce(stddev_pop(dr), 0) AS ce_drop_std,
  count_if(dr < -0.15)::BIGINT AS ce_sharp_drop_count, coalesce(avg((dr < -0.15)::INT), 0) AS ce_sharp_drop_rate, coalesce(avg(greatest(0, 0.45 - s)) FILTER (s IS NOT NULL), 0) AS ce_low_mass, coalesce(sum(greatest(0, 0.45 - s)) FILTER (s IS NOT NULL), 0) AS ce_low_mass_sum,
  coalesce(avg(s2), 0) AS ce_skip_mean, coalesce(min(s2), 0) AS ce_skip_min, count_if(s2 < 0.45)::BIGINT AS ce_skip_break_count, count(DISTINCT block_id) AS ce_n_blocks,
  count_if(s < 0.45 AND same)::BIGINT AS ce_intra_block_break_count, coalesce(avg((s < 0.45)::INT) FILTER (same), 0) AS ce_intra_block_break_rate,
  count_if(s < 0.45 AND NOT same)::BIGINT AS ce_inter_block_break_count, coalesce(avg((s < 0.45)::INT) FILTER (NOT same), 0) AS ce_inter_block_break_rate FROM t GROUP BY doc_id)
SELECT doc_id, ce_n_sentences, ce_n_adj, ce_break_count, ce_sharp_drop_count, ce_skip_break_count, ce_n_blocks, ce_intra_block_break_count, ce_inter_block_break_count, coalesce(rl.m, 0) AS ce_longest_coherent_run,
{_round(["ce_adj_mean", "ce_adj_std", "ce_adj_min", "ce_adj_max", "ce_adj_median", "ce_adj_p10", "ce_adj_p25", "ce_adj_p75", "ce_adj_p90", "ce_break_rate", "ce_drop_min", "ce_drop_mean", "ce_drop_std", "ce_sharp_drop_rate", "ce_low_mass", "ce_low_mass_sum", "ce_skip_mean", "ce_skip_min", "ce_intra_block_break_rate", "ce_inter_block_break_rate"])}
FROM o LEFT JOIN rl USING (doc_id)""",
    "cle_similarity": f"""WITH {_T}, o AS (SELECT doc_id, coalesce(stddev_pop(s), 0) AS cle_adj_sim_std, coalesce(max(s) - min(s), 0) AS cle_adj_sim_range, CASE WHEN avg(s) > 0 THEN stddev_pop(s) / avg(s) ELSE 0 END AS cle_adj_sim_cv,
  coalesce(avg((s < 0.5)::INT), 0) AS cle_adj_low_frac, count_if((s > pv AND s > nx) OR (s < pv AND s < nx)) / greatest(1, count(*) - 2) AS cle_zigzag_rate, (count_if(s2 > 0.7) + count_if(s3 > 0.7)) / count(*) AS cle_repetition_score,
  count_if(s < 0.5 AND nx > 0.65) / greatest(1, count(*) - 2) AS cle_resume_rate, count_if(coalesce(s < 0.5, false) OR coalesce(pv < 0.5, false)) / count(*) AS cle_semantic_break_rate, count_if(s < 0.5 AND pv < 0.5) / count(*) AS cle_semantic_isolated_rate FROM t GROUP BY doc_id)
SELECT doc_id, {_round(["cle_adj_sim_std", "cle_adj_sim_range", "cle_adj_sim_cv", "cle_adj_low_frac", "cle_zigzag_rate", "cle_repetition_score", "cle_resume_rate", "cle_semantic_break_rate", "cle_semantic_isolated_rate"])} FROM o""",
    "ne_vectors": f"""WITH {_T}, c AS (SELECT doc_id, pos, avg(v) AS v FROM (SELECT doc_id, unnest(e) AS v, unnest(range(len(e))) AS pos FROM e) GROUP BY doc_id, pos),
h AS (SELECT doc_id, list(v ORDER BY pos) AS h FROM c GROUP BY doc_id), u AS (SELECT doc_id, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS h FROM h),
k AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id DESC) AS r FROM e),
n AS (SELECT doc_id, avg(list_dot_product(e, h)) FILTER (k <= 3) AS ne_start_to_centroid, avg(list_dot_product(e, h)) FILTER (r <= 3) AS ne_end_to_centroid, any_value(e) FILTER (k = 1) AS a, any_value(e) FILTER (r = 1) AS b FROM k JOIN u USING (doc_id) GROUP BY doc_id),
p AS (SELECT doc_id, coalesce(sum(1 - s), 0) AS path, count(*) AS n FROM t GROUP BY doc_id HAVING count(*) > 1),
o AS (SELECT doc_id, list_dot_product(a, b) AS ne_start_end_sim, (1 - list_dot_product(a, b)) / (path + 1e-8) AS ne_arc_linearity, path / (n - 1) AS ne_semantic_wander, ne_start_to_centroid, ne_end_to_centroid, ne_end_to_centroid - ne_start_to_centroid AS ne_consolidation_delta FROM p JOIN n USING (doc_id))
SELECT doc_id, {_round(["ne_start_end_sim", "ne_arc_linearity", "ne_semantic_wander", "ne_start_to_centroid", "ne_end_to_centroid", "ne_consolidation_delta"])} FROM o""",
    "document_vectors": """WITH e AS (SELECT label AS doc_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings), c AS (SELECT doc_id, pos, avg(v) AS v FROM e GROUP BY doc_id, pos)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS v FROM c""",
    "te_features": f"""WITH {TE} SELECT user_id, te_n_entries, te_streak_improving, te_streak_worsening, CASE WHEN abs(te_slope) < 0.01 THEN 0 ELSE sign(te_slope)::INT END AS te_trend_direction,
round(7 * te_slope, 4) AS te_slope_per_week, round(CASE WHEN te_baseline_std > 1e-9 THEN (latest - te_baseline_mean) / te_baseline_std ELSE 0 END, 4) AS te_latest_zscore, round(CASE WHEN te_baseline_mean > 1e-9 THEN te_baseline_std / te_baseline_mean ELSE 0 END, 4) AS te_volatility,
{_round(["te_time_span_days", "te_mean_gap_days", "te_max_gap_days", "te_slope", "te_velocity_mean", "te_velocity_std", "te_acceleration_mean", "te_rolling_7d_mean", "te_rolling_7d_std", "te_baseline_mean", "te_baseline_std", "te_latest_percentile", "te_days_since_high", "te_days_since_low"], 4)} FROM x""",
    "rater_consensus": f"WITH {_TRIPLES} SELECT l_orderkey, l_linenumber, trimmed, {_round(['a', 'b', 'c', 'consensus', 'spread', 'deviation'])} FROM k",
    "rater_agreement": f"WITH {_TRIPLES} SELECT count(*) AS n, round(avg(spread), 6) AS mean_spread, round(max(spread), 6) AS max_spread, round(avg(trimmed::INT), 6) AS trimmed_share, round(corr(a, b), 6) AS r_ab, round(corr(a, c), 6) AS r_ac, round(corr(b, c), 6) AS r_bc FROM k",
    "rating_histogram": f"WITH {_TRIPLES} SELECT least(floor(consensus), 9)::INT AS bin, count(*) AS n FROM k GROUP BY 1",
    "feature_correlations": " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}, l_discount), 6) AS pearson, count(*) AS n FROM lineitem" for f in ("l_quantity", "l_extendedprice", "l_tax")),
    "rank_correlation": """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM k""",
    "ks_test": """WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE v),
c AS (SELECT feature, v, count_if(l_returnflag <> 'R') AS a, count_if(l_returnflag = 'R') AS b FROM u GROUP BY ALL),
w AS (SELECT feature, sum(a) OVER o / sum(a) OVER p AS fa, sum(b) OVER o / sum(b) OVER p AS fb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM c WINDOW o AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
k AS (SELECT feature, max(abs(fa - fb)) AS ks, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b FROM w GROUP BY feature), q AS (SELECT *, ks * ks * (n_a * n_b / (n_a + n_b)) AS s FROM k)
SELECT feature, round(ks, 6) AS ks, round(CASE WHEN s < 0.02 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * s))), 0), 1) END, 6) AS p, n_a, n_b FROM q""",
    "tertile_bins": """WITH q AS (SELECT quantile_cont(o_totalprice, 1.0::DOUBLE / 3) AS a, quantile_cont(o_totalprice, 2.0::DOUBLE / 3) AS b FROM orders)
SELECT CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'medium' ELSE 'high' END AS bin, count(*) AS n, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high FROM orders, q GROUP BY 1""",
    "balanced_sample": """WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM k WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))""",
    "source_folds": "SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 5)::INT AS fold FROM documents",
    "calibration_buckets": f"""WITH {_TRIPLES}, z AS (SELECT a * 10 AS x, b * 10 AS y, least(floor(a * 10 / 20) * 20, 80)::INT AS lo FROM k)
SELECT printf('%02d-%03d', lo, lo + 20) AS bucket, count(*) AS n, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(avg(x), 6) AS mean_expected, round(avg(y), 6) AS mean_model FROM z GROUP BY lo""",
    "linear_score": """WITH z AS (SELECT l_orderkey, l_linenumber, least(greatest(100 * ((1 - l_discount) * 0.4::DOUBLE + l_tax * 0.3::DOUBLE + least(l_quantity / 50.0::DOUBLE, 1) * 0.3::DOUBLE), 0), 100) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(s, 6) AS score, round(CASE WHEN s <= 40 THEN s * 0.5::DOUBLE WHEN s <= 60 THEN 20 + (s - 40) * 3 ELSE 80 + (s - 60) * 0.5::DOUBLE END, 6) AS calibrated,
  CASE WHEN s <= 20 THEN 0 WHEN s <= 35 THEN 1 WHEN s <= 50 THEN 2 WHEN s <= 65 THEN 3 WHEN s <= 80 THEN 4 ELSE 5 END AS band FROM z""",
    "sentence_counts": f"""WITH {_SENTENCES} SELECT any_value(doc_id) AS doc_id, count(t) AS n_sentences, coalesce(max(length(t)), 0)::INT AS longest, count_if(t IS NOT NULL AND len(regexp_extract_all(lower(t), '[a-z'']+')) <= 4)::BIGINT AS n_short FROM d LEFT JOIN s USING (r) GROUP BY r""",
    "text_markers": rf"""WITH {_SENTENCES}, w AS (SELECT r, regexp_extract_all(lower(t), '[a-z'']+') AS w FROM s), v AS (SELECT *, list_sort(list_filter(w, lambda x: length(x) > 3)) AS v FROM w),
l AS (SELECT r, count(*) AS n, count_if(LOOP) AS loops FROM v GROUP BY r), x AS (SELECT row_number() OVER () AS r, text AS t FROM documents)
SELECT doc_id, coalesce(n, 0)::INT AS n_sentences, round(coalesce(loops / n, 0), 6) AS loop_rate, regexp_matches(t, '(?i){lx.CORRUPTION}') AS corrupted, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_\p{{M}}\p{{Pc}}]+'))::INT AS n_tokens,
  len(list_filter(string_split_regex(t, '\n[{tx.WS}]*\n'), lambda z: NOT regexp_full_match(z, '[{tx.WS}]*')))::INT AS n_paragraphs, regexp_matches(t, '(?m)^[{tx.WS}]*[-*•][{tx.WS}]+') AS bullets FROM d LEFT JOIN l USING (r) JOIN x USING (r)""".replace("LOOP", _LOOP),
    "opening_repeats": """WITH o AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z'']+')[1:5], ' ') AS opening FROM documents)
SELECT doc_id, opening, count(*) OVER (PARTITION BY opening) AS n, coalesce(count(*) OVER (PARTITION BY opening) > 4 AND opening <> '', false) AS flagged FROM o""",
    "held_out_texts": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "gd_features": rf"""WITH {_SENTENCES},
w AS (SELECT *, regexp_extract_all(lower(t), '[a-z'']+') AS w FROM s),
v AS (SELECT *, list_sort(list_filter(w, lambda x: length(x) > 3)) AS v, {" + ".join(f"(length(t) - length(replace(lower(t), ' {c} ', ''))) // {len(c) + 2}" for c in lx.RUNON_CONNECTORS)} AS joins FROM w),
f AS (SELECT r, i, len(w) AS n, {_has(lx.TOPIC_RESET)} AS reset, {_has(lx.REFERENT_STARTS, start=r"^[\s\x0B]*")} AND NOT {_has(lx.REFLECTION_WORDS)} AS referent, {_has(lx.REFLECTION_WORDS)} AS reflects, {_has(lx.SETUP)} AS setup, {_has(lx.OPEN_ENDINGS)} AS open,
  {_LOOP} AS loop,
  regexp_matches(t, '(?i){lx.CORRUPTION}') AS corrupt, len(w) >= 25 AND (joins >= 5 OR NOT regexp_matches(t, '[.;:]')) AS runon, contains(t, '?') AND len(w) <= 12 AS question,
  {_has(("[A-Z][a-z]{2,}", *lx.ANCHOR_WORDS), flags="")} AS anchor FROM v),
g AS (SELECT *, min(i) FILTER (anchor) OVER (PARTITION BY r) AS first, max(i) OVER (PARTITION BY r) AS top FROM f),
a AS (SELECT r, count(*) AS n, count_if(reset) AS resets, count_if(referent AND (first IS NULL OR i <= first)) AS dangling, count_if(setup) AS setups, count_if(loop) AS loops, count_if(corrupt) AS corrupts, count_if(runon) AS runons, count_if(question) AS questions,
  count_if(reflects) AS reflections, CAST(count_if(open AND i = top) AS DOUBLE) AS ending, sum(n) AS words FROM g GROUP BY r),
e AS (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS x FROM s) WHERE regexp_full_match(x, '[A-Z][a-z]{{2,}}') AND x NOT IN ({", ".join(f"'{x}'" for x in lx.NOT_ENTITIES)}) GROUP BY r, x),
m AS (SELECT r, CAST(sum(c) AS DOUBLE) AS mentions, CAST(count_if(c = 1) AS DOUBLE) AS singles FROM e GROUP BY r),
q AS (SELECT *, resets + dangling + 2 * setups + loops + corrupts + runons + questions + ending AS total, coalesce(singles / mentions, 0) AS one FROM a LEFT JOIN m USING (r)),
o AS (SELECT r, ending AS gd_no_compression_ending, 0.0::DOUBLE AS gd_block_reset_rate, resets / n AS gd_topic_reset_rate, dangling / n AS gd_dangling_referent_rate, setups / n AS gd_abandoned_setup_rate, loops / n AS gd_loop_repetition_rate, corrupts / n AS gd_corruption_rate,
  runons / n AS gd_runon_chain_rate, setups / n AS gd_meta_scaffold_rate, questions / n AS gd_unanchored_question_rate, least(setups / 4, 1) AS gd_abandoned_setup_count_norm, least(total / 8, 1) AS gd_disorder_marker_count_norm, total / greatest(words, 1) * 500 AS gd_disorder_markers_per_500w,
  one AS gd_single_use_entity_rate, least(one * least(coalesce(mentions, 0) / 4, 1), 1) AS gd_entity_drift_score, least(0.45::DOUBLE * ending + 0.25::DOUBLE * least(setups / 4, 1) + 0.1::DOUBLE * (reflections = 0)::INT, 1) AS gd_compression_failure_score FROM q),
z AS (SELECT *, least({" + ".join(f"{w}::DOUBLE * {k}" for k, w in discourse.DISORDER_WEIGHTS.items())} + 0.15::DOUBLE * least(gd_disorder_markers_per_500w / 20, 1), 1) AS gd_global_disorder_score FROM o)
SELECT doc_id, {", ".join(f"round(coalesce({k}, 0), 6) AS {k}" for k in (*discourse.DISORDER_WEIGHTS, "gd_disorder_markers_per_500w", "gd_single_use_entity_rate", "gd_global_disorder_score"))} FROM d LEFT JOIN z USING (r)""",
    "ne_cle_wording": rf"""WITH {_SENTENCES},
f AS (SELECT r, i, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS n, {_VERB} AS verb, regexp_matches(t, '(?:\.{{3,}}|…)$') AS trails, regexp_matches(t, '[.!?]$') AS ends, regexp_matches(t, '(?:—|--)$') AS dash, {_has(("but", "and", "so"), start="^")} AS joins,
  {", ".join(f"{_PHRASES(v)} AS {k}" for k, v in {"temporal": lx.TEMPORAL_MARKERS, "past": lx.PAST_MARKERS, "future": lx.FUTURE_MARKERS, "glue": lx.GLUE_CONNECTORS, "connects": lx.CONNECTORS, "reflects": lx.REFLECTION_PHRASES, "closes": lx.CLOSURE_CUES, "gives_up": lx.ABANDONMENT_MARKERS, "restarts": lx.RESTART_CUES, "hedges": lx.HEDGE_CUES}.items())},
  regexp_matches(t, '\?$') AS asks, len(regexp_extract_all(t, '--|—|–')) >= 2 AS dashes, len(regexp_extract_all(t, '\.{{3,}}|…+')) >= 2 AS clusters, regexp_matches(t, '!{{3,}}|\?{{3,}}|(?:—|--)\s*\S(?s:.*)\S') AS noisy FROM s),
g AS (SELECT *, CASE WHEN n <= 4 THEN NOT (verb AND ends) ELSE NOT verb OR trails OR NOT ends END AS short, lag(past) OVER w AS past0, lag(future) OVER w AS future0, lag(glue) OVER w AS glue0, max(i) OVER (PARTITION BY r) AS top FROM f WINDOW w AS (PARTITION BY r ORDER BY i)),
o AS (SELECT r, count_if(temporal) / count(*) AS ne_temporal_markers_rate, count_if(connects) / count(*) AS ne_connectors_rate, count_if(reflects) / count(*) AS ne_reflection_rate, count_if(short) / count(*) AS ne_fragment_sentence_rate,
  count_if(trails OR dashes OR clusters) / count(*) AS ne_punct_break_rate, count_if(trails OR dash OR NOT verb OR (joins AND NOT ends)) / count(*) AS cle_fragment_rate, count_if(restarts) / count(*) AS cle_restart_rate, count_if(hedges) / count(*) AS cle_hedge_rate,
  count_if(noisy OR clusters) / count(*) AS cle_punctuation_noise, count_if(((past0 AND future) OR (future0 AND past)) AND NOT (glue OR glue0)) / (count(*) - 1) AS ne_temporal_jump_rate, CAST(count_if(reflects AND i = top) AS DOUBLE) AS ne_last_sentence_reflective,
  CAST(count_if(asks AND i = top) AS DOUBLE) AS ne_end_open_question, CAST(count_if(short AND i = top) AS DOUBLE) AS ne_end_fragment, CAST(bool_or(closes AND i >= top - 1) AS DOUBLE) AS ne_end_closure_cue, CAST(bool_or(gives_up AND i >= top - 1) AS DOUBLE) AS ne_end_abandonment_cue,
  CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0 END AS cle_length_cv FROM g GROUP BY r HAVING count(*) > 1)
SELECT doc_id, {", ".join(f"round(coalesce({k}, 0), 6) AS {k}" for k in ("ne_temporal_markers_rate", "ne_connectors_rate", "ne_reflection_rate", "ne_fragment_sentence_rate", "ne_punct_break_rate", "cle_fragment_rate", "cle_restart_rate", "cle_hedge_rate", "cle_punctuation_noise", "ne_temporal_jump_rate", "ne_last_sentence_reflective", "ne_end_open_question", "ne_end_fragment", "ne_end_closure_cue", "ne_end_abandonment_cue", "cle_length_cv"))}
FROM d LEFT JOIN o USING (r)""",
    "bc_features": rf"""WITH s AS (SELECT conv_id AS doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) % 2 = 1 AS odd, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT *, {" OR ".join("contains(lower(t), '" + p.replace("'", "''") + "')" for p in lx.BELIEF_PATTERNS)} AS believes, {_PHRASES(lx.NEGATION_WORDS)} AS no, {_PHRASES(lx.INTEGRATION_MARKERS)} AS marks, {", ".join(f"{_has((a,))} AS a{k}, {_has((b,))} AS b{k}" for k, (a, b) in enumerate(lx.POLAR_PAIRS))} FROM s),
p AS (SELECT x.doc_id, x.i, y.i AS j, CASE WHEN x.odd <> y.odd THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS sim FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.i < y.i
  WHERE x.believes AND y.believes AND (x.no <> y.no OR {" OR ".join(f"(x.a{k} AND y.b{k}) OR (x.b{k} AND y.a{k})" for k in range(len(lx.POLAR_PAIRS)))})),
q AS (SELECT p.*, EXISTS (SELECT 1 FROM f WHERE f.doc_id = p.doc_id AND f.marks AND f.i BETWEEN p.i - 2 AND p.j + 2) AS near FROM p),
c AS (SELECT doc_id, count(*) AS m, max(sim) AS top, avg(sim) AS mean, avg(j - i) AS span, max(j - i) AS longest, count_if(near) AS near FROM q GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n, CASE WHEN count(*) > 1 THEN count_if(believes) ELSE 0 END AS k FROM f GROUP BY doc_id)
SELECT doc_id, k::INT AS bc_belief_sentence_count, round(k / n, 6) AS bc_belief_sentence_rate, coalesce(m, 0)::INT AS bc_conflict_pair_count, round(coalesce(m / k, 0), 6) AS bc_conflict_rate, round(coalesce(top, 0), 6) AS bc_max_conflict_sim, round(coalesce(mean, 0), 6) AS bc_mean_conflict_sim,
  round(coalesce(span, 0), 6) AS bc_conflict_span_mean, coalesce(longest, 0)::INT AS bc_conflict_span_max, coalesce(near, 0)::INT AS bc_integrated_count, round(coalesce(near / m, 0), 6) AS bc_integration_rate, coalesce(m - near, 0)::INT AS bc_unresolved_count, round(coalesce((m - near) / m, 0), 6) AS bc_unresolved_rate FROM b LEFT JOIN c USING (doc_id)""",
    "ne_end_similarity": """WITH c AS (SELECT label AS doc_id, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
p AS (SELECT doc_id, pos, arg_max(v, vec_id) AS last, sum(v) - arg_max(v, vec_id) AS rest, count(*) AS n FROM c GROUP BY doc_id, pos)
SELECT doc_id, round(CASE WHEN max(n) > 1 THEN coalesce(sum(rest * last) / nullif(sqrt(sum(rest * rest)), 0), 0) ELSE 0 END, 6) AS ne_end_similarity FROM p GROUP BY doc_id""",
    "feedback_effect": """WITH m AS (SELECT event_id, ['decrease', 'increase', 'stable'][event_id % 3 + 1] AS target, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS mes_delta FROM events)
SELECT event_id, target, round(mes_delta, 6) AS mes_delta, CASE target WHEN 'decrease' THEN mes_delta < -1 WHEN 'increase' THEN mes_delta > 1 ELSE abs(mes_delta) <= 3 END AS moved_correctly,
  CASE target WHEN 'decrease' THEN mes_delta < -1 WHEN 'increase' THEN mes_delta > 1 ELSE abs(mes_delta) <= 3 END AS effective FROM m WHERE mes_delta IS NOT NULL""",
    "eval_by_band": f"""WITH {_TRIPLES}, {_SCORED}
SELECT control_type, count(*) AS n, round(avg(abs(model - expected)), 6) AS mae, round(sqrt(avg((model - expected) * (model - expected))), 6) AS rmse, round(avg(expected), 6) AS mean_expected, round(avg(model), 6) AS mean_model FROM z GROUP BY 1""",
    "eval_gates": f"""WITH {_TRIPLES}, {_SCORED}, g AS (SELECT avg(abs(model - expected)) AS mae, avg(abs(model - expected)) FILTER (l_linenumber IN (4, 5)) AS high, {", ".join(f"avg(model) FILTER (l_linenumber = {k}) AS m{k}" for k in range(1, 8))} FROM z)
SELECT coalesce(mae <= 12, false) AS overall_mae_ok, coalesce(high <= 15, false) AS high_band_mae_ok, coalesce(m6 <= 40, false) AS emotional_ok, coalesce(m7 >= 60, false) AS neutral_ok, coalesce(m1 < m2 AND m2 < m3 AND m3 < m4 AND m4 < m5, false) AS spectrum_ordered FROM g""",
    "eval_worst": f"""WITH {_TRIPLES}, {_SCORED}, e AS (SELECT l_orderkey, l_linenumber, model - expected AS error FROM z)
SELECT 'false_low' AS side, * FROM (SELECT l_orderkey, l_linenumber, round(error, 6) AS error FROM e ORDER BY e.error, l_orderkey, l_linenumber LIMIT 5)
UNION ALL SELECT 'false_high' AS side, * FROM (SELECT l_orderkey, l_linenumber, round(error, 6) AS error FROM e ORDER BY e.error DESC, l_orderkey, l_linenumber LIMIT 5)""",
    "segment_blocks": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS t FROM documents),
b AS (SELECT r, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT r, string_split_regex(t, '\n(?:[ \t]*\n)+') AS bs FROM d)),
l AS (SELECT r, i, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS b FROM b),
m AS (SELECT r, i, regexp_replace(regexp_replace(b, '(\.\.\.|[^.!?:;\n])\n(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\.\.\.|[^.!?:;\n])\n(\p{Lu})', '\1' || chr(1) || '\2', 'g') AS b FROM l),
f AS (SELECT r, i, unnest(fs) AS f, generate_subscripts(fs, 1) AS j FROM (SELECT r, i, string_split(replace(b, chr(10), ' '), chr(1)) AS fs FROM m)),
s AS (SELECT r, i, j, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM (SELECT r, i, j, string_split(regexp_replace(f, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM f)),
k AS (SELECT r, dense_rank() OVER (PARTITION BY r ORDER BY i) - 1 AS block_id, i, j, k, regexp_replace(s, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS s FROM s WHERE NOT regexp_full_match(s, '[\s\x0B\p{P}]*')),
a AS (SELECT r, count(DISTINCT block_id) AS n_blocks, count(*) AS n_sentences, string_agg(block_id || ':' || s, chr(10) ORDER BY i, j, k) AS x FROM k GROUP BY r)
SELECT doc_id, coalesce(n_blocks, 0)::INT AS n_blocks, coalesce(n_sentences, 0)::INT AS n_sentences, md5(coalesce(x, '')) AS digest FROM d LEFT JOIN a USING (r)""",
}

# White space is Unicode's in both engines.
SQL = {k: v.replace(r"\s\x0B", tx.WS) for k, v in SQL.items()}
for _more in (serving, audits, records, learning, boosting, sampling):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
SQL["whole_segmentation"] = f"SELECT doc_id, n_sentences, n_sentences AS n_in_blocks FROM ({SQL['segment_blocks']})"
