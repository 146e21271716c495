"""Models from moments against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators import training

N, K = 400, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, K)) * [1, 2, 3, 0.5]
    y = x @ [1.0, -0.5, 0.0, 2.0] + rng.normal(size=N) + 5
    fold = np.arange(N) % 5
    source = np.where(np.arange(N) % 3 == 0, "human", "synthetic")
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), int(fold[i]), str(source[i]), x[i].tolist()) for i in range(N)], "id long, a_0 double, a_1 double, b_0 double, b_1 double, y double, fold int, source string, v array<double>").cache()
    return rows, x, y, fold, source


NAMES = ["a_0", "a_1", "b_0", "b_1"]


def closed(x, y, alpha, w=None):
    w = np.ones(len(y)) if w is None else w
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    b = np.linalg.solve(((x - mx) * w[:, None]).T @ (x - mx) + alpha * np.eye(x.shape[1]), ((x - mx) * w[:, None]).T @ (y - my))
    return np.concatenate([[my - mx @ b], b])


def test_ridge_and_out_of_fold(data):
    rows, x, y, fold, source = data
    m = training.moments(rows, [*NAMES, "y"], ["fold", "source"])
    assert training.ridge(m.total(), 3.0) == pytest.approx(closed(x, y, 3.0))
    w = {"human": 1.0, "synthetic": 0.25}
    assert training.ridge(m.reweighted(lambda g: w[g[1]]).total(), 3.0) == pytest.approx(closed(x, y, 3.0, np.array([w[s] for s in source])))
    p = np.zeros(N)
    for f in range(5):
        b = closed(x[fold != f], y[fold != f], 1.0)
        p[fold == f] = b[0] + x[fold == f] @ b[1:]
    got = [r.prediction for r in training.out_of_fold(rows, NAMES, "y", "fold").orderBy("id").collect()]
    assert got == pytest.approx(p.tolist())
    s = training.scores_of(m, training.fold_models(m, lambda t: training.ridge(t, 1.0)), "human")
    h = source == "human"
    assert s["cv"] == pytest.approx(np.corrcoef(p, y)[0, 1]) and s["human"] == pytest.approx(np.corrcoef(p[h], y[h])[0, 1]) and s["mse"] == pytest.approx(((p - y) ** 2).mean())


def test_nulls_take_no_part(spark, data):
    rows, x, y, *_ = data
    odd = rows.unionByName(rows.limit(3).withColumn("a_0", F.lit(None).cast("double"))).unionByName(rows.limit(2).withColumn("y", F.lit(None).cast("double")))
    assert training.ridge(training.moments(odd, [*NAMES, "y"], ["fold"]).total(), 1.0) == pytest.approx(closed(x, y, 1.0))
    assert training.moments(rows.where("false"), [*NAMES, "y"], ["fold"]).total().sum() == 0
    assert training.ridge(np.zeros((6, 6)), 1.0).tolist() == [0] * 5


def test_elastic_net_and_bounds(data):
    rows, x, y, *_ = data
    total = training.moments(rows, [*NAMES, "y"], ["fold"]).total()
    beta = training.elastic_net(total, 0.1, 0.5)
    r = y - beta[0] - x @ beta[1:]
    grad = -(x - x.mean(0)).T @ r / N + 0.05 * beta[1:]
    for g, b in zip(grad, beta[1:]):
        assert abs(g + 0.05 * np.sign(b)) < 1e-6 if b else abs(g) <= 0.05 + 1e-6
    low, high = training.signed_bounds(NAMES, {"a_1": 1, "b_1": -1})
    b = training.bounded(total, low, high)
    assert b[2] == 0 and b[4] == 0 and b[1] == pytest.approx(closed(x[:, [0, 2]], y, 0.0)[1], abs=1e-6)
    s = x.std(0)
    z = closed((x - x.mean(0)) / s, y, 2.0)
    assert training.scaled_ridge(total, 2.0)[1:] == pytest.approx(z[1:] / s, abs=1e-6)


def test_vector_models(data):
    rows, x, y, fold, _ = data
    d = rows.withColumns({"d0": F.least(F.greatest(F.lit(1.0), 3 + F.col("a_0") / 3), F.lit(5.0)), "d1": F.least(F.greatest(F.lit(1.0), 3 + F.col("b_1")), F.lit(5.0))})
    a = training.final_fit(d, "v", 4, ["d0", "d1"], ["a_1"], "y", (0.1, 1.0))
    d0, d1 = np.clip(3 + x[:, 0] / 3, 1, 5), np.clip(3 + x[:, 3], 1, 5)
    first = [closed(x, t, 0.1) for t in (d0, d1)]
    z = np.column_stack([*(b[0] + x @ b[1:] for b in first), x[:, 1]])
    assert [a["combiner"]["intercept"], *a["combiner"]["coef"]] == pytest.approx(closed(z, y, 1.0).tolist())
    assert a["d1"]["coef"] == pytest.approx(first[1][1:].tolist())
    out = training.two_stage(d, "v", 4, ["d0", "d1"], ["a_1"], "y", "fold", (0.1, 1.0))
    assert out.where("d0_oof < 1 OR d0_oof > 5 OR prediction IS NULL").count() == 0


def test_ordinal(data):
    rows, x, y, fold, _ = data
    cuts = [3.5, 5.0, 6.5]
    p = np.ones(N)
    for f in range(5):
        for c in cuts:
            b = closed(x[fold != f], (y[fold != f] > c).astype(float), 1.0)
            p[fold == f] += np.clip(b[0] + x[fold == f] @ b[1:], 0, 1)
    got = [r.prediction for r in training.ordinal(rows, NAMES, "y", "fold", cuts).orderBy("id").collect()]
    assert got == pytest.approx(p.tolist())


def test_pairwise(spark, data):
    rows, x, y, *_ = data
    pairs = [(i, j, float(y[i] - y[j])) for i in range(0, N, 7) for j in range(1, N, 11) if y[i] - y[j] > 1]
    w, score = training.pairwise(spark.createDataFrame(pairs, "high long, low long, confidence double"), rows, "id", NAMES, "y", 1.0)
    d = np.array([x[i] - x[j] for i, j, _ in pairs])
    c = np.array([c for *_, c in pairs])
    assert w == pytest.approx(np.linalg.solve((d * c[:, None]).T @ d + np.eye(K), (d * c[:, None]).sum(0)).tolist(), abs=1e-6)
    s = x @ w
    a = np.polyfit(s, y, 1)
    got = [r.s for r in rows.orderBy("id").select(score.alias("s")).collect()]
    assert got == pytest.approx((a[0] * s + a[1]).tolist(), abs=1e-6)


def test_uplift_goes_up_only(data):
    rows, *_ = data
    beta, corrected = training.uplift(rows, "b_0", "y", ["a_0", "b_1"], F.col("y") > 6)
    assert min(beta) >= 0
    r = rows.agg(F.min(corrected).alias("a"), F.max(corrected).alias("b")).first()
    assert r.a >= 0 and r.b <= 100


def test_source_weights_and_selection(data):
    rows, *_ = data
    assert training.source_weights({"human": 10, "x": 30}, "human") == {"human": 1.0, "x": pytest.approx(0.1)}
    assert training.source_weights({"human": 10, "x": 30}, "human", "equal") == {"human": 3.0, "x": 1.0}
    with pytest.raises(ValueError):
        training.source_weights({}, "human", "other")
    m = training.moments(rows, [*NAMES, "y"], ["fold"])
    assert training.strongest(m, "y", 1) in (["b_1"], ["a_1"])
    names = dict((n, c) for n, c, _ in training.subset_scores(training.moments(rows, [*NAMES, "y"], ["fold", "source"]), "y", training.leave_module_out(NAMES), 1.0, "human"))
    assert set(names) == {"all", "without a", "without b"} and names["all"] >= max(names["without a"], names["without b"])
