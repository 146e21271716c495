"""Queries of seeded draws, balanced folds, checkpoints, margin ranking and the sweep of vector models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.vectors import rounded
from textweave.operators import joins, pairwise, sampling, training
from textweave.plans.audits import FEATURES
from textweave.plans.learning import DIM, labelled, vectors
from textweave.plans.tables import table
from textweave.sources import checkpoint
from textweave.sources.scratch import scratch

SEED = 42
#: Sample weights of settings (place, weight).
SETTINGS = [("home", 5.0), ("work", 3.0), ("street", 1.5), ("water", 0.5)]


def weighted_draws(spark, sf_dir):
    """As many draws as there are documents, each by its length: how often a document is drawn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.weighted_draws(d, "doc_id", "n_chars", d.count(), SEED).groupBy("doc_id").agg(F.count("*").alias("times"), F.min("draw").alias("first"))


def seeded_choices(spark, sf_dir):
    """A setting for each customer by weight."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", sampling.weighted_choice(sampling.uniform(SEED, F.col("c_custkey")), SETTINGS).alias("setting"))


def class_balanced_folds(spark, sf_dir):
    """Folds of orders balanced by quarters of the price scale."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", sampling.quantized(F.col("o_totalprice"), (100_000.0, 200_000.0, 300_000.0)).alias("quarter"))
    return sampling.class_folds(o, "quarter", "o_orderkey", 5, SEED)


def checkpoint_appended(spark, sf_dir):
    """Orders appended in three batches: the second is retried, the third stops before it is named and is then resumed with
    other records; the first changes keys of the second."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"))
    path = scratch(spark, "checkpoint")
    part = lambda k: o.where(F.pmod("o_orderkey", F.lit(3)) == k)
    checkpoint.append_batch(part(0).unionByName(part(1).withColumn("price", F.lit(-1.0))), path, 0)
    checkpoint.append_batch(part(1), path, 1)
    checkpoint.append_batch(part(1).withColumn("price", F.lit(-2.0)), path, 1)
    checkpoint.write_batch(part(2).withColumn("price", F.lit(-3.0)), path, 2)  # stops here
    checkpoint.append_batch(checkpoint.pending_rows(o, path, "o_orderkey"), path, 2)
    return checkpoint.read_checkpoint(spark, path, "o_orderkey", "o_orderkey long, o_custkey long, price double")


def margin_ranking(spark, sf_dir):
    """Held-out figures of a margin loss, of an absolute ridge, and of their blends."""
    d = labelled(spark, sf_dir)
    pairs = joins.random_pairs(d, "id", "y", 1.5, 30_000)
    diff = pairwise.differences(pairs, d, "id", FEATURES)
    m = training.moments(d, [*FEATURES, "y"], ["fold", "source"])
    _, _, c = training.centred(m.total())
    scale = [float((c[i, i] / m.total()[0, 0]) ** 0.5) for i in range(len(FEATURES))]
    folds = sorted({g[0] for g in m.by})
    weights = pairwise.margin_loss(diff, FEATURES, scale, folds=folds)
    ranked = {f: pairwise.onto_label(m, weights[f], lambda g, f=f: g[0] != f) for f in folds}
    absolute = training.fold_models(m, lambda t: training.ridge(t, 0.1))
    out = []
    for share in (1.0, 0.7, 0.5, 0.3, 0.0):
        models = {f: share * ranked[f] + (1 - share) * absolute[f] for f in folds}
        s = training.scores_of(m, models, "human")
        ordered = diff.agg(pairwise.ordered_share(diff, FEATURES, {f: b[1:] for f, b in models.items()})).first()[0]
        out.append((share, float(ordered), s["cv"], s["human"], s["synth"], s["fold_std"]))
    return rounded(spark.createDataFrame(out, "margin_share double, ordered double, cv double, human double, synth double, fold_std double"), 3)


def vector_sweep(spark, sf_dir):
    """192 settings of ridge, lasso, elastic net, dimension and hybrid models of vectors under three weightings."""
    e = vectors(spark, sf_dir)
    more = {f"feat_{k}": F.pmod(F.col("vec_id") * (k + 3), F.lit(17 + k)) / 5.0 + F.get("embedding", F.lit(k)).cast("double") for k in range(4)}
    e = e.withColumns(more).withColumn("source", F.when(F.col("vec_id") % 3 == 0, "human").otherwise("synthetic"))
    dims, features = [f"dim_{k}" for k in range(3)], ["feat", *more]
    m = training.moments(e, [*dims, *features, "overall"], ["fold", "source"], None, "embedding", DIM)
    counts = {s: sum(int(x[0, 0]) for g, x in m.by.items() if g[1] == s) for s in ("human", "synthetic")}
    share = counts["human"] / counts["synthetic"] if counts["synthetic"] else 0.0
    weightings = {"equal": {"human": 1.0, "synthetic": 1.0}, "balanced": {"human": 1.0, "synthetic": share}, "human heavy": {"human": 1.0, "synthetic": 0.3 * share}}
    settings = {
        "ridge": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0], "lasso": [0.0001, 0.001, 0.01, 0.1, 1.0], "elastic_net": [(a, r) for a in (0.001, 0.01, 0.1, 1.0) for r in (0.1, 0.3, 0.5, 0.7, 0.9)],
        "dimension": [(a, c) for a in (0.1, 1.0, 10.0, 100.0) for c in (0.1, 1.0, 10.0)], "hybrid": [(k, a) for k in (1, 2, 3, 4, 5) for a in (0.1, 1.0, 10.0, 100.0)],
    }
    return rounded(training.vector_sweep(spark, m, [f"v{k}" for k in range(DIM)], dims, features, "overall", "human", settings, weightings), 4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (weighted_draws, seeded_choices, class_balanced_folds, checkpoint_appended, margin_ranking, vector_sweep)}

_UNIFORM = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 12) AS BIGINT)"
_TOTAL = sum(w for _, w in SETTINGS)


def _choice_sql() -> str:
    so_far, whens = 0.0, []
    for value, w in SETTINGS[:-1]:
        so_far += w
        whens.append(f"WHEN u / {sampling.SPAN}::DOUBLE * {_TOTAL}::DOUBLE <= {so_far}::DOUBLE THEN '{value}'")
    return f"WITH c AS (SELECT c_custkey, CAST({_UNIFORM.format(seed=SEED, key='c_custkey')} AS DOUBLE) AS u FROM customer) SELECT c_custkey, CASE {' '.join(whens)} ELSE '{SETTINGS[-1][0]}' END AS setting FROM c"


SQL: dict[str, str] = {
    "weighted_draws": f"""WITH l AS (SELECT doc_id, w, sum(w) OVER (ORDER BY doc_id, w ROWS UNBOUNDED PRECEDING) AS stop, sum(w) OVER () AS total FROM (SELECT doc_id, CAST(round(n_chars::DOUBLE * {sampling.UNIT}) AS HUGEINT) AS w FROM documents) WHERE w > 0),
u AS (SELECT i AS draw, CAST({_UNIFORM.format(seed=SEED, key="i")} AS HUGEINT) * (SELECT max(total) FROM l) // {sampling.SPAN} AS place FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS i))
SELECT doc_id, count(*) AS times, min(draw) AS first FROM u JOIN l ON place >= stop - w AND place < stop GROUP BY doc_id""",
    "seeded_choices": _choice_sql(),
    "class_balanced_folds": f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN (o_totalprice >= 100000)::INT + (o_totalprice >= 200000)::INT + (o_totalprice >= 300000)::INT END AS quarter FROM orders)
SELECT o_orderkey, quarter, CAST((row_number() OVER (ORDER BY quarter NULLS LAST, md5(o_orderkey::VARCHAR || ':{SEED}'), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM o""",
    "checkpoint_appended": "SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS price FROM orders",
}
