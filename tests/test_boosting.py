"""Boosted trees side by side against a plain fit of one model at a time, and the walk of trees as an expression."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators import boosting


def table(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.integers(0, 3, n)
    y = np.where(a > 4, 3.0, 0) + np.where((b > 0) & (c == 1), 2.0, 0) + rng.normal(scale=0.2, size=n).round(3)
    rows = [(int(a[i]), float(b[i]) if i % 50 else None, int(c[i]), float(y[i]), float(a[i] - b[i]), i % 4, "human" if i % 3 else "synthetic") for i in range(n)]
    return spark.createDataFrame(rows, "a int, b double, c int, y double, z double, fold int, source string").repartition(3), rows


def plain_fit(x, y, w, model):
    """One model on raw values: every distinct value is a cut, trees by recursion."""
    base = (w * y).sum() / w.sum()
    p = np.full(len(y), base)
    trees = []

    def grow(used, rest, depth):
        if depth == 0:
            return None
        g, h = w[used] * rest[used], w[used]
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[used, f] <= cut
                hl, hr = h[left].sum(), h[~left].sum()
                if hl < 1 or hr < 1:
                    continue
                gl, gr = g[left].sum(), g[~left].sum()
                gain = gl**2 / (hl + model.l2) + gr**2 / (hr + model.l2) - g.sum() ** 2 / (h.sum() + model.l2)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, cut))
        if best[1] is None:
            return None
        f, cut = best[1]
        left = x[used, f] <= cut
        leaf = lambda s: model.rate * g[s].sum() / (h[s].sum() + model.l2)
        return f, cut, leaf(left), leaf(~left), grow(used[left], rest, depth - 1), grow(used[~left], rest, depth - 1)

    def walk(tree, row):
        value = 0.0
        while tree is not None:
            f, cut, lv, rv, left, right = tree
            value, tree = (lv, left) if row[f] <= cut else (rv, right)
        return value

    for _ in range(model.rounds):
        tree = grow(np.flatnonzero(w > 0), y - p, model.depth)
        trees.append(tree)
        p = p + np.array([walk(tree, r) for r in x])
    return p, lambda k: base + sum(np.array([walk(t, r) for r in x]) for t in trees[:k]) if trees else p


MODELS = [
    boosting.Model("all-0", ("a", "b", "c"), "y", 0, (("human", 1.0), ("synthetic", 0.25)), depth=2, rounds=10, rate=0.3),
    boosting.Model("ab", ("a", "b"), "z", None, (("human", 1.0), ("synthetic", 1.0)), depth=3, rounds=5, rate=0.5),
    boosting.Model("human-1", ("c", "a"), "y", 1, (("human", 1.0),), depth=1, rounds=9, rate=0.3),
    boosting.Model("stopped-2", ("b", "c"), "y", 2, (("human", 1.0), ("synthetic", 0.5)), depth=3, rounds=12, rate=0.9, stop=2),
    boosting.Model("nobody", ("a",), "y", 0, (("nobody", 1.0),), rounds=2),
]


@pytest.fixture(scope="module")
def fitted(spark):
    df, rows = table(spark)
    return df, rows, *boosting.boost(df, ["a", "b", "c"], ["y", "z"], "fold", "source", MODELS, bins=256)


def test_models_side_by_side_equal_plain_fits(fitted, monkeypatch):
    _, rows, models, state = fitted
    x = np.array([[r[0], r[1] or 0.0, r[2]] for r in rows])
    got = {}
    for r in state.collect():
        got.setdefault((tuple(r.y), r.fold, r.source), []).append(list(r.p))
    for k, m in enumerate(MODELS[:3]):
        cols = ["abc".index(n) for n in m.inputs]
        w = np.array([dict(m.weights).get(r[6], 0.0) * (r[5] != m.held) for r in rows])
        y = np.array([r[3] if m.target == "y" else r[4] for r in rows])
        p, _ = plain_fit(x[:, sorted(cols)], y, w, m)
        for i, r in enumerate(rows):
            assert any(abs(v[k] - p[i]) < 1e-9 for v in got[(r[3], r[4]), r[5], r[6]])
    assert all(v[4] == 0 for vs in got.values() for v in vs)


def test_copies_of_rows_are_cells_of_the_same_number(spark, monkeypatch):
    """Passes read cells of equal bins, fold and source: ten copies of every row are as many cells, and fit the same trees; what
    is stored on the way changes nothing."""
    df, _ = table(spark, 60)
    seen, keep = {}, boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda rows, tag: seen.setdefault((len(seen), tag), keep(rows, tag)))
    monkeypatch.setattr(boosting, "KEEP", 2)
    models = [boosting.Model("m", ("a", "b", "c"), "y", 0, (("human", 0.1), ("synthetic", 0.05)), depth=3, rounds=3, rate=0.3, l2=0.1), boosting.Model("s", ("a", "c"), "z", 1, (("human", 1.0),), rounds=3, rate=0.9, stop=1)]
    many = df.crossJoin(spark.range(10)).drop("id")
    fitted, state = boosting.boost(many, ["a", "b", "c"], ["y", "z"], "fold", "source", models, bins=256)
    assert state.count() == 600 and max(d.count() for (_, tag), d in seen.items() if tag in ("cells", "boosted")) <= 60
    monkeypatch.setattr(boosting, "KEEP", 100)
    again, _ = boosting.boost(many, ["a", "b", "c"], ["y", "z"], "fold", "source", models, bins=256)
    for name in again:
        assert [t["feature"] for t in again[name]["trees"]] == [t["feature"] for t in fitted[name]["trees"]]
        assert [v for t in again[name]["trees"] for v in t["value"]] == pytest.approx([v for t in fitted[name]["trees"] for v in t["value"]])


def test_early_stopping_keeps_the_best_number_of_trees(fitted):
    _, rows, models, state = fitted
    m = MODELS[3]
    x = np.array([[r[1] or 0.0, r[2]] for r in rows])
    y = np.array([r[3] for r in rows])
    w = np.array([dict(m.weights)[r[6]] * (r[5] != m.held) for r in rows])
    _, first = plain_fit(x, y, w, m)
    own = np.array([r[5] == m.held and r[6] == "human" for r in rows])
    errors, best = [((y - first(k)) ** 2)[own].mean() for k in range(m.rounds + 1)], 0
    for k, e in enumerate(errors):
        if e < errors[best] - 1e-12:
            best = k
        elif k - best >= m.stop:
            break
    assert len(models["stopped-2"]["trees"]) == best < m.rounds


def test_expression_walks_the_trees(fitted):
    df, rows, models, state = fitted
    for k, m in enumerate(MODELS):
        own = models[m.name]
        assert json.loads(json.dumps(own, allow_nan=True)) == own
        got = sorted(round(r[0], 9) for r in df.select(boosting.tree_score([F.col(n) for n in m.inputs], own)).collect())
        assert got == sorted(round(r.p[k], 9) for r in state.collect())


def test_rows_without_target_fold_or_source_take_no_part(spark):
    df, rows = table(spark, 60)
    odd = df.unionByName(spark.createDataFrame([(1, 1.0, 1, None, 1.0, 0, "human"), (1, float("nan"), 1, 2.0, 1.0, None, "human"), (1, 1.0, 1, 2.0, float("nan"), 0, None)], df.schema))
    assert boosting.boost(odd, ["a"], ["y", "z"], "fold", "source", MODELS[4:])[1].count() == 60


def test_empty_table(spark):
    df, _ = table(spark, 8)
    models, state = boosting.boost(df.where("a < 0"), ["a", "b"], ["y"], "fold", "source", [boosting.Model("m", ("a", "b"), "y", None, (("human", 1.0),), rounds=2)])
    assert state.count() == 0 and models["m"]["base"] == 0 and all(t["feature"] == [-1] for t in models["m"]["trees"])


def plain_walk(model, row):
    out = model["base"]
    for t in model["trees"]:
        k = 0
        while t["feature"][k] >= 0:
            k = t["left"][k] if (row.get(model["inputs"][t["feature"][k]]) or 0.0) <= t["threshold"][k] else t["right"][k]
        out += t["value"][k]
    return out


@pytest.mark.parametrize("written", [0, 4096])
def test_uneven_trees_walk_to_their_own_depth(spark, monkeypatch, written):
    monkeypatch.setattr(boosting, "WRITTEN_NODES", written)
    uneven = {"feature": [0, -1, 1, -1, 0, -1, -1], "threshold": [1.0, 0.0, 2.0, 0.0, 5.0, 0.0, 0.0], "left": [1, 0, 3, 0, 5, 0, 0], "right": [2, 0, 4, 0, 6, 0, 0], "value": [0.0, 1.0, 0.0, 20.0, 0.0, 300.0, 4000.0]}
    model = {"base": 0.5, "inputs": ["a", "b"], "trees": [uneven, {"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [7.0]}]}
    rows = spark.createDataFrame([(float(a), float(b)) for a in range(8) for b in range(5)] + [(None, 1.0), (float("nan"), None)], "a double, b double")
    for r in rows.select("*", boosting.tree_score([F.col("a"), F.col("b")], model).alias("s")).collect():
        clean = {k: None if v is None or v != v else v for k, v in r.asDict().items()}
        assert r.s == plain_walk(model, clean)
    assert rows.select(boosting.tree_score([F.col("a")], {"base": 2.5, "inputs": ["a"], "trees": []})).first()[0] == 2.5


def pearson(a, b):
    return float(np.corrcoef(a, b)[0, 1])


def plain_ridge(x, y, w, alpha):
    mean, my = (w[:, None] * x).sum(0) / w.sum(), (w * y).sum() / w.sum()
    c = ((w[:, None] * (x - mean)).T @ (x - mean)) + alpha * np.eye(x.shape[1])
    beta = np.linalg.solve(c, (w[:, None] * (x - mean)).T @ (y - my))
    return my - mean @ beta, beta


def test_stacked_recipes_against_a_plain_pipeline(spark):
    from textweave.operators import stacking

    df, rows = table(spark)
    df = df.withColumn("line", F.col("a").cast("double"))
    recipes = [
        stacking.Recipe("v1", "parts", (("left", ("a", "b"), "z"), ("right", ("c",), "y")), (("human", 1.0), ("synthetic", 0.5)), depth=2, rounds=6, rate=0.4, blends=(0.25,)),
        stacking.Recipe("v3", "all", (("y", ("a", "b", "c"), "y"),), (("human", 2.0), ("synthetic", 1.0)), "ensemble_v5", depth=1, rounds=5, rate=0.4, alpha=10.0),
    ]
    got, artifacts = stacking.run(df, recipes, ["a", "b", "c"], ["z", "y"], "y", "line", "fold", "source", final=True, bins=256)
    x = np.array([[r[0], r[1] or 0.0, r[2]] for r in rows])
    y, z, line = (np.array([r[k] for r in rows], float) for k in (3, 4, 0))
    fold, human = np.array([r[5] for r in rows]), np.array([r[6] == "human" for r in rows])
    for recipe, blend in ((recipes[0], None), (recipes[0], 0.25), (recipes[1], None)):
        w = np.where(human, *(dict(recipe.weights)[s] for s in ("human", "synthetic")))
        oof = np.zeros((len(rows), len(recipe.parts)))
        for k, (_, inputs, target) in enumerate(recipe.parts):
            for f in range(4):
                p, _ = plain_fit(x[:, ["abc".index(n) for n in inputs]], z if target == "z" else y, np.where(fold == f, 0.0, w), recipe.model(k, f))
                oof[fold == f, k] = p[fold == f]
        a, b = plain_ridge(oof, y, w, recipe.alpha)
        whole = a + oof @ b
        if blend is None:
            cv = []
            for f in range(4):
                a, b = plain_ridge(oof[fold != f], y[fold != f], w[fold != f], recipe.alpha)
                cv.append(pearson(a + oof[fold == f] @ b, y[fold == f]))
        else:
            whole = blend * line + (1 - blend) * whole
            cv = [pearson(whole[fold == f], y[fold == f]) for f in range(4)]
        own = next(r for r in got if (r["version"], r["blend"]) == (recipe.version, blend))
        assert own["cv"] == pytest.approx(np.mean(cv)) and own["human"] == pytest.approx(pearson(whole[human], y[human])) and own["synth"] == pytest.approx(pearson(whole[~human], y[~human]))
    made = artifacts["v1|parts"]
    scored = df.select("a", "b", "c", stacking.legacy_score(df.columns, made | {"combiner": made["combiner"] | {"module_names": ["left", "right"]}}).alias("s")).collect()
    for r in scored:
        raw = made["combiner"]["intercept"] + sum(c * plain_walk(made[n], r.asDict()) for c, n in zip(made["combiner"]["coef"], ("left", "right")))
        assert r.s == pytest.approx(min(100.0, max(0.0, raw)))


def test_legacy_artifacts_that_lack_a_model_raise(spark):
    from textweave.operators import stacking

    with pytest.raises(FileNotFoundError):
        stacking.legacy_subscores([], {"combiner": {"architecture": "ensemble_v5", "coef": [], "intercept": 0.0}})
    with pytest.raises(FileNotFoundError):
        stacking.legacy_subscores([], {})


def test_preselection_by_lasso(spark):
    from textweave.operators import stacking, training

    df, _ = table(spark)
    m = training.moments(df.na.fill(0.0).withColumn("noise", F.lit(1.0)), ["a", "b", "c", "noise", "y", "z"], ["fold", "source"])
    assert stacking.preselected(m, ["y", "z"], ["a", "b", "c", "noise"], "human", 0.01) == ["a", "b", "c"]
    assert stacking.preselected(m, ["y", "z"], ["a", "b", "c", "noise"], "human", 1e6) == []


def test_tree_score_runs_on_batches(spark):
    """small models are scored on whole Arrow batches, with missing inputs as 0 and terms added in order."""
    model = {"base": 0.5, "trees": [{"feature": [1, -1, -1], "threshold": [0.25, 0.0, 0.0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0.0, 0.1, -0.3]}, {"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [0.7]}]}
    d = spark.createDataFrame([(1, 1.0, 0.25), (2, 1.0, 0.5), (3, None, None), (4, 0.0, float("nan")), (5, 0.0, float("inf"))], "k int, a double, b double").select("k", boosting.tree_score([F.col("a"), F.col("b")], model).alias("s"))
    assert "ArrowEvalPython" in d._jdf.queryExecution().optimizedPlan().toString()
    low, high = 0.5 + 0.1 + 0.7, 0.5 + -0.3 + 0.7
    assert [r.s for r in d.orderBy("k").collect()] == [low, high, low, low, high]
