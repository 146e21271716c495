"""Isotonic calibration against the largest-least formula, at any length of the runs."""

import numpy as np
import pytest

from textweave.operators import calibration


def plain(x, y, w):
    """The fit at each place: the largest over beginnings of the least mean of a stretch that reaches it."""
    n = len(x)
    s, m = np.concatenate([[0], np.cumsum(y * w)]), np.concatenate([[0], np.cumsum(w)])
    return np.array([max(min((s[b + 1] - s[a]) / (m[b + 1] - m[a]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def curve(rows):
    """Distinct predictions, mean labels within 0 and 100, counts."""
    p = np.array([r[0] for r in rows])
    y = np.clip([r[1] for r in rows], 0, 100)
    x = np.unique(p)
    return x, np.array([y[p == v].mean() for v in x]), np.array([(p == v).sum() for v in x])


def sample(kind, n=150):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(0, 100, n), 0)
    y = {"up": p + rng.normal(size=n) * 30, "down": 100 - p, "flat": p * 0 + 7.0, "step": np.where(p > 50, 200.0, -3.0)}[kind]
    return list(zip(p.tolist(), y.tolist(), strict=True))


@pytest.mark.parametrize("kind, most", [("up", 4), ("down", 4), ("flat", 10), ("step", 10), ("up", 1000)])
def test_blocks_are_the_fit(spark, kind, most):
    rows = sample(kind)
    blocks = calibration.isotonic_blocks(spark.createDataFrame(rows, "p double, t double"), "p", "t", most=most).orderBy("lo").collect()
    x, y, w = curve(rows)
    want = plain(x, y, w)
    assert [b.value for b in blocks] == sorted(b.value for b in blocks) and sum(b.weight for b in blocks) == len(rows)
    got = [next(b.value for b in blocks if b.lo <= v <= b.hi) for v in x]
    assert got == pytest.approx(want.tolist())


def test_keys_are_fitted_and_met_apart(spark):
    rows = [("a", *r) for r in sample("up")] + [(None, *r) for r in sample("step")] + [("a", None, 1.0), ("a", float("nan"), 1.0), ("a", 3.0, None), ("none", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, p double, t double")
    blocks = calibration.isotonic_blocks(df, "p", "t", ["k"], most=8)
    asks = [(k, p, 0) for k in ("a", None, "none") for p in (-5.0, 0.0, 12.34, 50.0, 50.5, 99.9, 500.0, None)]
    met = calibration.calibrated(spark.createDataFrame(asks, "k string, p double, extra int"), "p", blocks, "c", ["k"])
    assert met.columns == ["k", "p", "extra", "c"]
    got = {(r.k, r.p): r.c for r in met.collect()}
    assert len(got) == len(asks)
    for k, kind in (("a", "up"), (None, "step")):
        x, y, w = curve(sample(kind))
        want = plain(x, y, w)
        for p in (-5.0, 0.0, 12.34, 50.0, 50.5, 99.9, 500.0):
            assert got[k, p] == pytest.approx(float(np.interp(p, x, want)))
        assert got[k, None] is None
    assert all(got["none", p] is None for p in (0.0, None))


def test_thresholds_and_empty_tables(spark):
    empty = spark.createDataFrame([], "p double, t double")
    blocks = calibration.isotonic_blocks(empty, "p", "t")
    assert blocks.count() == 0 and calibration.calibrated(empty, "p", blocks).columns == ["p", "t", "calibrated"]
    two = calibration.isotonic_blocks(spark.createDataFrame([(1.0, 5.0), (2.0, 3.0), (3.0, 9.0)], "p double, t double"), "p", "t")
    assert sorted(map(tuple, calibration.thresholds(two).collect())) == [(1.0, 4.0), (2.0, 4.0), (3.0, 9.0)]


def test_rows_that_count_several_times(spark):
    """Cells of equal prediction and label with their number give the blocks of the rows."""
    rows = sample("up", 40)
    cells = [(p, t, k % 4 + 1) for k, (p, t) in enumerate(rows)]
    blocks = calibration.isotonic_blocks(spark.createDataFrame(cells, "p double, t double, n long"), "p", "t", times="n")
    each = calibration.isotonic_blocks(spark.createDataFrame([(p, t) for p, t, n in cells for _ in range(n)], "p double, t double"), "p", "t")
    got, want = ([tuple(r) for r in b.orderBy("lo").collect()] for b in (blocks, each))
    assert len(got) == len(want) > 1 and sum(r[3] for r in got) == sum(n for *_, n in cells)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)


def test_combiner_search_calibrates_cells(spark, tmp_path, monkeypatch):
    """Four copies of a table give the calibration no more rows than one copy has; the result is the SQL's."""
    import duckdb

    from textweave.plans import learning

    one = "/root/testdata/sf0.001/lineitem.parquet"
    con = duckdb.connect()
    # Orders shifted by 35 keep their folds and labels, so the copies' rows are alike but for their keys.
    con.sql(f"COPY (SELECT l.* REPLACE (l_orderkey + 35 * 1000000 * r.range AS l_orderkey) FROM range(4) r, '{one}' l) TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    given, calibrated = [], calibration.calibrated

    def counted(rows, *rest):
        given.append(rows.count())
        return calibrated(rows, *rest)

    monkeypatch.setattr(calibration, "calibrated", counted)
    ours = learning.combiner_search(spark, str(tmp_path)).select("inputs", "alpha", "mae", "best").collect()
    theirs = con.sql(f"SELECT inputs, alpha, mae, best FROM ({learning.SQL['combiner_search']})").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)
    assert given[0] <= len(theirs) * con.sql(f"SELECT count(*) FROM '{one}' WHERE l_returnflag = 'R'").fetchall()[0][0]
