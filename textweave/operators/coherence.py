"""Similarity-flow features of ordered sentence vectors, one row for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweave.functions.vectors import dot, share, unit

BREAK_T, SHARP_DROP_T = 0.45, -0.15
LOW_T, HIGH_T, REPEAT_T = 0.50, 0.65, 0.70


def transitions(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, block_id, embedding) with similarities to the next sentences and their neighbours.

    One sort by (doc_id, sent_id) serves every window; a document's sentences are the only rows that meet.
    """
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    e = F.col("embedding")
    return (
        sentences.select("doc_id", "sent_id", "block_id", "embedding", *[F.lead("embedding", k).over(w).alias(f"_e{k}") for k in (1, 2, 3)], F.lead("block_id").over(w).alias("_b1"))
        .select("doc_id", "sent_id", "block_id", dot(e, F.col("_e1")).alias("s"), dot(e, F.col("_e2")).alias("skip2"), dot(e, F.col("_e3")).alias("skip3"), (F.col("block_id") == F.col("_b1")).alias("same"))
        .withColumn("next_s", F.lead("s").over(w))
        .withColumn("prev_s", F.lag("s").over(w))
        .withColumn("drop", F.col("next_s") - F.col("s"))
        .withColumn("run", F.sum((F.col("s") < BREAK_T).cast("int")).over(w))
    )


def coherence(sentences: DataFrame) -> DataFrame:
    """The 29 ce_ features. Documents of one sentence have zeros but for the two counts."""
    t = transitions(sentences)
    runs = t.where(F.col("s") >= BREAK_T).groupBy("doc_id", F.coalesce("run", F.lit(0)).alias("run")).agg(F.count("*").alias("m")).groupBy("doc_id").agg(F.max("m").alias("ce_longest_coherent_run"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    broken = F.col("s") < BREAK_T
    low = F.greatest(F.lit(0.0), BREAK_T - F.col("s"))
    pct = F.percentile("s", F.array(*map(F.lit, (0.1, 0.25, 0.75, 0.9))))
    out = t.groupBy("doc_id").agg(
        F.count("*").alias("ce_n_sentences"), F.count("s").alias("ce_n_adj"),
        z(F.avg("s")).alias("ce_adj_mean"), z(F.stddev_pop("s")).alias("ce_adj_std"), z(F.min("s")).alias("ce_adj_min"), z(F.max("s")).alias("ce_adj_max"),
        z(F.percentile("s", F.lit(0.5))).alias("ce_adj_median"), pct.alias("_p"),
        F.count_if(broken).alias("ce_break_count"), share(broken).alias("ce_break_rate"),
        z(F.min("drop")).alias("ce_drop_min"), z(F.avg("drop")).alias("ce_drop_mean"), z(F.stddev_pop("drop")).alias("ce_drop_std"),
        F.count_if(F.col("drop") < SHARP_DROP_T).alias("ce_sharp_drop_count"), share(F.col("drop") < SHARP_DROP_T).alias("ce_sharp_drop_rate"),
        z(F.avg(F.when(F.col("s").isNotNull(), low))).alias("ce_low_mass"), z(F.sum(F.when(F.col("s").isNotNull(), low))).alias("ce_low_mass_sum"),
        z(F.avg("skip2")).alias("ce_skip_mean"), z(F.min("skip2")).alias("ce_skip_min"), F.count_if(F.col("skip2") < BREAK_T).alias("ce_skip_break_count"),
        F.countDistinct("block_id").alias("ce_n_blocks"),
        F.count_if(broken & F.col("same")).alias("ce_intra_block_break_count"), share(F.when(F.col("same"), broken)).alias("ce_intra_block_break_rate"),
        F.count_if(broken & ~F.col("same")).alias("ce_inter_block_break_count"), share(F.when(~F.col("same"), broken)).alias("ce_inter_block_break_rate"),
    )
    out = out.select("*", *[z(F.get("_p", F.lit(k))).alias(f"ce_adj_p{n}") for k, n in enumerate((10, 25, 75, 90))]).drop("_p")
    return out.join(runs, "doc_id", "left").fillna(0, ["ce_longest_coherent_run"])


def similarity_load(sentences: DataFrame) -> DataFrame:
    """The nine cle_ features that come from vectors."""
    t = transitions(sentences)
    n, pairs = F.count("*"), F.greatest(F.lit(1), F.count("*") - 2)
    s, after, before = F.col("s"), F.col("next_s"), F.col("prev_s")
    zigzag = ((s > before) & (s > after)) | ((s < before) & (s < after))
    either = F.coalesce(s < LOW_T, F.lit(False)) | F.coalesce(before < LOW_T, F.lit(False))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return t.groupBy("doc_id").agg(
        z(F.stddev_pop("s")).alias("cle_adj_sim_std"),
        z(F.max("s") - F.min("s")).alias("cle_adj_sim_range"),
        z(F.when(F.avg("s") > 0, F.try_divide(F.stddev_pop("s"), F.avg("s")))).alias("cle_adj_sim_cv"),
        share(s < LOW_T).alias("cle_adj_low_frac"),
        (F.count_if(zigzag) / pairs).alias("cle_zigzag_rate"),
        ((F.count_if(F.col("skip2") > REPEAT_T) + F.count_if(F.col("skip3") > REPEAT_T)) / n).alias("cle_repetition_score"),
        (F.count_if((s < LOW_T) & (after > HIGH_T)) / pairs).alias("cle_resume_rate"),
        F.when(n > 1, F.count_if(either) / n).otherwise(0.0).alias("cle_semantic_break_rate"),
        (F.count_if((s < LOW_T) & (before < LOW_T)) / n).alias("cle_semantic_isolated_rate"),
    )


def narrative(sentences: DataFrame, edge: int = 3) -> DataFrame:
    """The vector part of the ne_ features: arc, wander, and closeness of both ends to the mean vector."""
    t = transitions(sentences).groupBy("doc_id").agg(F.coalesce(F.sum(1 - F.col("s")), F.lit(0.0)).alias("path"), F.count("*").alias("n"))
    cells = sentences.select("doc_id", F.posexplode("embedding").alias("pos", "v"))
    mean = cells.groupBy("doc_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    mean = mean.select("doc_id", unit(F.col("m.v")).alias("center"))
    w = Window.partitionBy("doc_id")
    ranked = sentences.select("doc_id", "embedding", F.row_number().over(w.orderBy("sent_id")).alias("k"), F.row_number().over(w.orderBy(F.desc("sent_id"))).alias("r"))
    ends = ranked.where((F.col("k") <= edge) | (F.col("r") <= edge)).join(mean, "doc_id").withColumn("c", dot(F.col("embedding"), F.col("center")))
    ends = ends.groupBy("doc_id").agg(
        F.avg(F.when(F.col("k") <= edge, F.col("c"))).alias("ne_start_to_centroid"), F.avg(F.when(F.col("r") <= edge, F.col("c"))).alias("ne_end_to_centroid"),
        F.min(F.when(F.col("k") == 1, F.col("embedding"))).alias("_a"), F.min(F.when(F.col("r") == 1, F.col("embedding"))).alias("_b"),
    )
    both = t.where("n > 1").join(ends, "doc_id").withColumn("ne_start_end_sim", dot(F.col("_a"), F.col("_b")))
    return both.select(
        "doc_id", "ne_start_end_sim", ((1 - F.col("ne_start_end_sim")) / (F.col("path") + 1e-8)).alias("ne_arc_linearity"), (F.col("path") / (F.col("n") - 1)).alias("ne_semantic_wander"),
        "ne_start_to_centroid", "ne_end_to_centroid", (F.col("ne_end_to_centroid") - F.col("ne_start_to_centroid")).alias("ne_consolidation_delta"),
    )


def end_similarity(sentences: DataFrame) -> DataFrame:
    """The last sentence against the mean of the others at length one; 0 for a single sentence. Sums are pre-aggregated."""
    v = F.col("v").cast("double")
    cells = sentences.select("doc_id", "sent_id", F.posexplode("embedding").alias("pos", "v")).groupBy("doc_id", "pos").agg(F.max_by(v, "sent_id").alias("last"), F.sum(v).alias("total"), F.count("*").alias("n"))
    rest = F.col("total") - F.col("last")
    similarity = F.try_divide(F.sum(rest * F.col("last")), F.sqrt(F.sum(rest * rest)))
    return cells.groupBy("doc_id").agg(F.when(F.max("n") > 1, F.coalesce(similarity, F.lit(0.0))).otherwise(0.0).alias("ne_end_similarity"))
