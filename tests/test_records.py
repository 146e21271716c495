"""Sources, joins and ordering on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.functions import generated, text, vectors
from textweave.operators import audits, joins, ordering, ratings
from textweave.sources import files, journals
from textweave.sources.scratch import cached, scratch


def test_unicode_white_space(spark):
    d = spark.createDataFrame([("One. Two. Three.  ",), (None,), ("",)], "t string")
    got = [r.s for r in d.select(text.sentences(text.normalize_text(F.col("t"))).alias("s")).collect()]
    assert got == [["One.", "Two.", "Three."], None, []]
    assert [r.n for r in d.select(text.word_count(F.col("t")).alias("n")).collect()] == [3, None, 0]


def test_correlation_with_nulls(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, -100.0), (50.0, None), (float("nan"), 3.0)], "a double, b double")
    assert d.agg(vectors.safe_corr("a", "b").alias("r")).first().r == pytest.approx(1.0)
    assert d.agg(vectors.safe_corr("a", "b", F.lit(2.0)).alias("r")).first().r == pytest.approx(1.0)
    assert d.limit(2).agg(vectors.safe_corr("a", "b").alias("r")).first().r == 0.0


def test_csv_with_line_breaks(spark):
    rows = [(1, 'a "quoted", text\nwith a line'), (2, "plain"), (3, "é")]
    path = scratch(spark, "csv")
    files.write_csv(spark.createDataFrame(rows, "id long, t string"), path)
    back = files.read_csv(spark, path)
    assert sorted((int(r.id), r.t) for r in back.collect()) == rows
    bad = back.unionByName(spark.createDataFrame([("x", "y")], "id string, t string"))
    assert files.typed(bad, {"id": "long"}).count() == 3
    with pytest.raises(Exception):
        files.typed(bad, {"id": "long"}, drop_bad=False).collect()


def test_union_probes_columns(spark):
    parts = {"a": spark.createDataFrame([(" ", "x"), ("y", None)], "journal string, content string"), "b": spark.createDataFrame([(1,)], "n int"), "c": spark.createDataFrame([("z",)], "text string")}
    got = files.union_texts(parts, {"a": "human"}).orderBy("row").collect()
    assert [(r.source_file, r.source, r.journal, r.row) for r in got] == [("a", "human", "x", 0), ("a", "human", "y", 1), ("c", "c", "z", 2)]


def test_json_lines(spark):
    path = scratch(spark, "json")
    spark.createDataFrame([('{"id": 1, "journal_text": "a"}',), ("[1]",), ("broken {",), ("",), ('{"id": 2}',)], "value string").coalesce(1).write.text(path)
    got = files.read_many_records(spark, [path], "id long, journal_text string").orderBy("id").collect()
    assert [(r.id, r.journal_text) for r in got] == [(1, "a"), (2, None)] and got[0].source_file.startswith("part-")
    assert files.read_many_records(spark, [path], "id long, journal_text string", 1).count() == 1
    assert journals.read_records(spark, path, "id long", skip_invalid=True).count() == 2


def test_checkpoint_and_cache(spark):
    lines = spark.createDataFrame([(1, '{"key": 1, "v": 1}'), (2, '{"key": 1, "v"'), (3, '{"key": 1, "v": 3}'), (4, '{"v": 3}')], "at long, value string")
    assert [tuple(r) for r in files.last_records(lines, "key", "key long, v long").collect()] == [(1, 3)]
    path = scratch(spark, "cache")
    assert cached(spark.range(3), path).count() == 3
    assert cached(spark.range(9), path).count() == 3  # there already
    assert cached(spark.range(9).withColumn("x", F.lit(1)), path).count() == 9  # other columns


def test_quota(spark):
    assert [r.n for r in files.quota_plan(spark, 7).orderBy("level").collect()] == [2, 2, 1, 1, 1]


def test_answers(spark):
    raw = ['```json\n{"journal_text": " x "}\n```', '{"journal_text": 5}', 'so {"journal_text": "y"} ok', "{broken}", "", None, "} {", '{"journal_text": "a"} {"journal_text": "b"}']
    d = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r.t for r in d.select(generated.unwrapped_text(F.col("raw")).alias("t")).collect()] == ["x", "", "y", "", "", "", "", ""]
    fields = generated.label_fields(F.col("raw"))
    got = spark.createDataFrame([('{"overall_entropy": 7.9}',), ("no",), ('{"overall_entropy": "x"}',)], "raw string").select(fields["overall_entropy"].alias("o"), fields["bad"].alias("bad")).collect()
    assert got[0].o == 7 and not got[0].bad and got[1].bad and got[2].bad


def test_disallowed(spark):
    t = ["the mes is", "themes", "mental entropy", "a@b.org", "call 555-123-4567", "12 Long Oak Street here", "fine text", "Subscore"]
    got = spark.createDataFrame([(x,) for x in t], "t string").select(generated.disallowed(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True, True, True, True, False, True]


def test_joins_that_check(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, v double")
    assert joins.aligned(left, left.withColumn("v", F.col("v") + 1e-12), "id", "v").count() == 2
    for other in (left.withColumn("v", F.col("v") + 1e-3), left.limit(1), left.withColumn("v", F.lit(None).cast("double"))):
        with pytest.raises(Exception, match="aligned"):
            joins.aligned(left, other, "id", "v").collect()
    with pytest.raises(Exception, match="no entry"):
        joins.lookup(left, spark.createDataFrame([(1, "a")], "id long, name string"), "id").collect()


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_nearest_by_pivots(spark, block):
    """Clustered, equal, opposite and zero vectors, nulls and odd lengths, in many chunks and in one."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(30, 5)), rng.normal(size=(30, 5)) * 0.05 + [4, 0, 0, 0, 1]]).round(2)
    v[[7, 19]] = 0
    v[30:44] = v[2]
    v[50] = -v[2]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0]), (None, [1.0] * 5)], "id long, v array<double>")
    norm = np.linalg.norm(v, axis=1)
    u = v / np.where(norm == 0, 1, norm)[:, None]
    got = {}
    for r in joins.nearest(rows, "id", "v", 3, block=block).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.cosine))
    assert len(got) == 60
    for i in range(60):
        best = sorted((-round(float(u[i] @ u[j]), 9), j) for j in range(60) if j != i)[:3]
        assert [o for _, o, _ in sorted(got[i])] == [j for _, j in best] and [c for _, _, c in sorted(got[i])] == pytest.approx([-s for s, _ in best])
    assert joins.nearest(rows.where("id = 90"), "id", "v").count() == 0
    rows = rows.where("id < 60")
    few = joins.neighbour_smoothness(rows.limit(3).withColumn("y", F.lit(1)), "id", "v", "y").first()
    assert few.n == 3 and few.mean_gap is None


def test_nearest_keeps_no_pairs_beyond_the_best(spark, monkeypatch):
    """Vectors in no clusters: what is kept between jobs is a few rows for each vector, however many blocks there are."""
    kept, keep = {}, joins.stored
    monkeypatch.setattr(joins, "stored", lambda df, tag: kept.setdefault(tag, keep(df, tag)))
    x = np.random.default_rng(5).normal(size=(600, 64))
    rows = spark.createDataFrame([(i, v.tolist(), float(i % 7)) for i, v in enumerate(x)], "id long, v array<float>, y double")
    got = {(r.id, r["rank"]): r.other for r in joins.nearest(rows, "id", "v", 3, block=50).collect()}
    assert max(df.count() for df in kept.values()) <= 600 * 4
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")
    assert got == {(i, k + 1): top[i, k] for i in range(600) for k in range(3)}


def test_smoothness_looks_for_neighbours_once(spark, monkeypatch):
    """The mean and the median of the gaps come from one search."""
    seen = spark.sparkContext.accumulator(0)

    def plain(rows, *_):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.selectExpr("id", "(id + 1) % 8 AS other").mapInArrow(run, "id long, other long")

    monkeypatch.setattr(joins, "nearest", plain)
    rows = spark.createDataFrame([(i, [1.0, i + 1.0], float(i)) for i in range(8)], "id long, v array<double>, y double")
    r = joins.neighbour_smoothness(rows, "id", "v", "y").first()
    assert (r.n, r.mean_gap, r.median_gap) == (8, 14 / 8, 1.0) and seen.value == 8


def test_positions_in_ranges_of_bounded_size(spark, monkeypatch):
    """A larger table has more ranges, and a rank's rows meet again in as many partitions."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("id"), (F.col("id") % 11).cast("double").alias("a_x"), (F.col("id") % 5).cast("double").alias("b_x"))
    a = ordering.arranged(rows, ["id"], 3000)
    assert a.groupBy("_part").count().agg(F.max("count")).first()[0] <= 200 and a.select("_part").distinct().count() >= 20
    placed = ordering.positions(rows, [], ["id"], "at", 3000)
    assert placed.where("at <> id").count() == 0 and placed.count() == 3000
    got = audits.composite_rank(rows, "id", ["a_x"], ["b_x"])
    assert got.rdd.getNumPartitions() >= 20 and got.count() == 3000


def test_capped_records_stay_in_their_splits(spark, tmp_path):
    """The cap is exact over many files, and no partition gathers the records of the others."""
    path = str(tmp_path / "many")
    spark.range(200).selectExpr("to_json(struct(id)) AS value").repartition(8).write.text(path)
    get = lambda most: files.read_many_records(spark, [path], "id long", most)
    assert [get(k).distinct().count() for k in (0, 1, 77, 200, 1000)] == [0, 1, 77, 200, 200]
    parts = [r[0] for r in get(1000).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(parts) > 1 and max(parts) < 200


def test_ordering(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, 500)
    rows = spark.createDataFrame([(i, int(i % 3), float(v)) for i, v in enumerate(x)], "id long, g long, v double")
    got = {(r.g, r.v): r.rank for r in ordering.average_ranks(rows, ["g"], "v", "rank").collect()}
    for g in range(3):
        own = np.sort(x[np.arange(500) % 3 == g])
        for v in set(own.tolist()):
            assert got[g, v] == np.mean(np.flatnonzero(own == v) + 1)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert ordering.quantiles(rows, "v", shares) == pytest.approx(np.quantile(x, shares).tolist())
    assert ordering.quantiles(rows.where("false"), "v", [0.5]) == [None]
    place = {r.id: r.position for r in ordering.positions(rows, [], ["v", "id"]).collect()}
    assert [place[i] for i in np.lexsort((np.arange(500), x))] == list(range(500))


def test_spread_join_keeps_nulls(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i}") for i in range(100)], "id long, k string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for most in (3, 10_000):
        got = ordering.spread_join(rows, counts, "k", "n", most).collect()
        assert len(got) == 100 and all(r.n is not None for r in got)


def test_golden_anchor_widens(spark):
    rows = spark.createDataFrame([(1, 1.5, 0.2, "synthetic", 800), (2, 1.5, 0.9, "human", 300), (3, 3.8, 0.0, "human", 150), (4, 5.0, 0.0, "human", 90)], "id long, overall double, label_std double, source string, text_length int")
    got = {r.target: (r.id, r.n_candidates) for r in audits.golden_anchors(rows, "id").collect()}
    assert got == {"very_low": (2, 2), "low": (3, 1), "medium": (3, 1)}


def test_golden_order(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 3.0, 6.0)], "t int, a double, b double")
    got = {r.name: (r.ordered, r.accuracy) for r in audits.golden_order(rows, ["a", "b"], "t").collect()}
    assert got["a"] == (True, 1.0) and got["b"][0] is False and got["b"][1] == pytest.approx(2 / 3)


def test_folds_are_even(spark):
    rows = spark.range(103)
    sizes = sorted(r["count"] for r in ratings.shuffled_folds(rows, "id").groupBy("fold").count().collect())
    assert sizes == [20, 20, 20, 20, 23]
