"""Seeded draws, balanced folds, carried values, checkpoints that stop half-way, margin ranking and the sweep of vector models."""

import glob
import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators import ordering, pairwise, sampling, training
from textweave.sources import checkpoint


def test_draws_follow_the_weights(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, None), (4, -1.0), (5, 15.0), (6, 0.5)] + [(None, 1.0)], "k long, w double")
    n = 4000
    got = Counter(r.k for r in sampling.weighted_draws(rows, "k", "w", n).collect())
    assert set(got) <= {1, 5, 6, None} and sum(got.values()) == n
    for k, w in ((1, 5.0), (5, 15.0), (6, 0.5), (None, 1.0)):
        assert abs(got[k] / n - w / 21.5) < 0.03
    again = sampling.weighted_draws(rows.repartition(3), "k", "w", n)
    assert Counter(r.k for r in again.collect()) == got


def test_draws_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, None)], "k long, w double")
    assert sampling.weighted_draws(rows, "k", "w", 10).count() == 0 and sampling.weighted_draws(rows.where("k > 5"), "k", "w", 10).count() == 0


def test_choice_takes_the_first_that_reaches_the_share(spark):
    u = spark.createDataFrame([(x,) for x in (0, sampling.SPAN // 4, sampling.SPAN // 4 + 1, sampling.SPAN - 1)], "u long")
    assert [r[0] for r in u.select(sampling.weighted_choice(F.col("u"), [("a", 1.0), ("b", 0.0), ("c", 3.0)])).collect()] == ["a", "a", "c", "c"]
    with pytest.raises(ValueError):
        sampling.weighted_choice(F.col("u"), [("a", 0.0)])


def test_class_counts_of_folds_differ_by_one(spark):
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else "abc"[i % 7 % 3]) for i in range(203)], "k long, c string")
    got = sampling.class_folds(rows, "c", "k", 5).collect()
    assert len(got) == 203
    for c in ("a", "b", "c", None):
        each = Counter(r.fold for r in got if r.c == c)
        assert max(each.values()) - min(each[f] for f in range(5)) <= 1
    whole = Counter(r.fold for r in got)
    assert max(whole.values()) - min(whole.values()) <= 1


def test_carried_values_cross_ranges(spark):
    rows = spark.range(500, numPartitions=4).select("id", F.when(F.col("id") % 97 == 3, F.col("id") * 10).alias("v"))
    got = {r.id: r.c for r in ordering.carried(rows, ["id"], "v", "c").collect()}
    assert got == {i: None if i < 3 else ((i - 3) // 97 * 97 + 3) * 10 for i in range(500)}


SCHEMA = "k long, v string"


def test_a_stop_between_writing_and_naming_loses_and_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), SCHEMA)
    read = lambda: sorted((r.k, r.v) for r in checkpoint.read_checkpoint(spark, path, "k", SCHEMA).collect())
    source = rows(*((k, f"v{k}") for k in range(6)))
    assert read() == [] and checkpoint.pending_rows(source, path, "k").count() == 6
    assert checkpoint.append_batch(rows((0, "v0"), (1, "old")), path, 0)
    checkpoint.write_batch(rows((2, "half"), (3, "half")), path, 1)  # the run stops here
    assert read() == [(0, "v0"), (1, "old")]
    left = checkpoint.pending_rows(source, path, "k")
    assert sorted(r.k for r in left.collect()) == [2, 3, 4, 5]
    assert checkpoint.append_batch(left.unionByName(rows((1, "v1"))), path, 1) and not checkpoint.append_batch(rows((9, "again")), path, 1)
    assert read() == [(k, f"v{k}") for k in range(6)] and checkpoint.pending_rows(source, path, "k").count() == 0


def test_torn_lines_are_left_out(spark, tmp_path):
    path = str(tmp_path / "c")
    checkpoint.append_batch(spark.createDataFrame([(1, "a"), (2, "é\n")], SCHEMA).coalesce(1), path, 0)
    (part,) = glob.glob(f"{path}/data/batch=0/part-*")
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with open(part, "a", encoding="utf-8") as f:
        f.write('{"v": "no key"}\n{"k": 7, "v": "to')
    got = checkpoint.read_checkpoint(spark, path, "k", SCHEMA).collect()
    assert sorted((r.k, r.v) for r in got) == [(1, "a"), (2, "é\n")]
    assert json.loads(open(part, encoding="utf-8").readline())["v"] == "a"


def test_a_stream_restarts_on_its_checkpoint(spark, tmp_path):
    """Two runs of one query append each input once."""
    source, path = str(tmp_path / "in"), str(tmp_path / "c")
    put = lambda *pairs: spark.createDataFrame(list(pairs), SCHEMA).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).json(source).writeStream.foreachBatch(checkpoint.appender(path)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()

    put((1, "a"), (2, "b"))
    run()
    put((2, "c"), (3, "d"))
    run()
    run()
    assert sorted((r.k, r.v) for r in checkpoint.read_checkpoint(spark, path, "k", SCHEMA).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def margin_table(spark, n=300):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(scale=0.3, size=n)
    return x, y, spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 3) for i in range(n)], "id long, a double, b double, c double, y double, fold int")


def test_margin_loss_steps_equal_plain_ones(spark):
    x, y, rows = margin_table(spark)
    rng = np.random.default_rng(3)
    picked = [(int(i), int(j)) for i, j in rng.integers(0, 300, (400, 2)) if y[i] - y[j] > 0.5]
    pairs = spark.createDataFrame([(i, j, float(y[i] - y[j])) for i, j in picked], "high long, low long, confidence double")
    diff = pairwise.differences(pairs, rows, "id", ["a", "b", "c"])
    scale = x.std(0).tolist()
    got = pairwise.margin_loss(diff, ["a", "b", "c"], scale, steps=15, folds=[0, 1])
    for fold in (0, 1, None):
        own = [(i, j) for i, j in picked if fold is None or (i % 3 != fold and j % 3 != fold)]
        d, c = np.array([(x[i] - x[j]) / scale for i, j in own]), np.array([y[i] - y[j] for i, j in own])
        w, m, v = np.zeros(3), np.zeros(3), np.zeros(3)
        for t in range(1, 16):
            g = -(c[:, None] * d)[d @ w < 0.5].sum(0) / c.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - 0.1 * 0.01) - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert got[fold] == pytest.approx(w / scale)
    models = {f: got[f] for f in (0, 1)}
    share = diff.agg(pairwise.ordered_share(diff, ["a", "b", "c"], models)).first()[0]
    held = [(i, j) for i, j in picked if i % 3 == j % 3 != 2]
    assert share >= 0.9 and len(held) > 20
    none = pairwise.margin_loss(diff.where("false"), ["a", "b", "c"], scale, steps=3)
    assert none[None].tolist() == [0, 0, 0]


def test_one_decomposition_gives_every_ridge(spark):
    rng = np.random.default_rng(1)
    z = np.concatenate([np.ones((60, 1)), rng.normal(size=(60, 5))], 1)
    z[:, 3] = z[:, 2]  # two equal inputs
    total = z.T @ z
    for targets in (1, 2):
        s = training.Spectrum(total, targets)
        for alpha in (0.0, 0.3, 50.0):
            assert s.ridge(alpha)[:, 0] == pytest.approx(np.atleast_2d(training.ridge(total, alpha, targets).T).T.reshape(-1, targets)[:, 0], abs=1e-8)
    assert (training.Spectrum(np.zeros((4, 4))).ridge(1.0) == 0).all()


def test_path_equals_single_fits():
    rng = np.random.default_rng(2)
    z = np.concatenate([np.ones((80, 1)), rng.normal(size=(80, 7))], 1)
    z[:, -1] = z[:, 1] * 2 - z[:, 3] + rng.normal(size=80) * 0.1
    total = z.T @ z
    penalties = [(1.0, 0.5), (0.1, 0.5), (0.01, 0.5), (0.001, 1.0), (1e-5, 1.0)]
    for got, (alpha, ratio) in zip(training.path(total, penalties), penalties):
        assert got == pytest.approx(training.elastic_net(total, alpha, ratio), abs=1e-5)
    assert all((b == 0).all() for b in training.path(np.zeros((4, 4)), penalties[:2]))


def test_sweep_of_192_settings_against_plain_fits(spark):
    from textweave.plans import sampling as plan

    sf = "/root/testdata/sf0.001"
    got = {(r.arch, r.config, r.weighting): r for r in plan.vector_sweep(spark, sf).collect()}
    assert len(got) == 192
    from textweave.plans.learning import DIM, vectors

    rows = vectors(spark, sf).collect()
    e = np.array([r.embedding[:DIM] for r in rows], float)
    y, fold, human = np.array([r.overall for r in rows]), np.array([r.fold for r in rows]), np.array([r.vec_id % 3 == 0 for r in rows])

    def fit(x, t, w, alpha):
        mean, mt = np.average(x, axis=0, weights=w), np.average(t, weights=w)
        b = np.linalg.solve(((x - mean) * w[:, None]).T @ (x - mean) + alpha * np.eye(x.shape[1]), ((x - mean) * w[:, None]).T @ (t - mt))
        return mt - mean @ b, b

    w = np.where(human, 1.0, human.sum() / (~human).sum())
    p = np.zeros(len(y))
    dims = np.array([[r.dim_0, r.dim_1, r.dim_2] for r in rows], float)
    oof = np.zeros_like(dims)
    for f in range(5):
        a, b = fit(e[fold != f], y[fold != f], w[fold != f], 10.0)
        p[fold == f] = a + e[fold == f] @ b
        for k in range(3):
            a, b = fit(e[fold != f], dims[fold != f, k], w[fold != f], 1.0)
            oof[fold == f, k] = a + e[fold == f] @ b
    r = got["ridge", "alpha=10", "balanced"]
    assert (r.cv, r.human, r.synth) == pytest.approx((np.corrcoef(p, y)[0, 1], np.corrcoef(p[human], y[human])[0, 1], np.corrcoef(p[~human], y[~human])[0, 1]), abs=1e-4)
    for f in range(5):
        a, b = fit(oof[fold != f], y[fold != f], w[fold != f], 0.1)
        p[fold == f] = a + oof[fold == f] @ b
    r = got["dimension", "alpha=1,combiner=0.1", "balanced"]
    assert r.cv == pytest.approx(np.corrcoef(p, y)[0, 1], abs=1e-4)
