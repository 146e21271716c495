import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.functions import segments, text
from textweave.operators import clusters, coherence, discourse, ratings, reports, scoring, training
from textweave.sources import journals
from textweave.streaming.entries import windowed_scores


def axis(*places):
    return [[1.0 if i == p else 0.0 for i in range(4)] for p in places]


def sentences(spark, docs):
    rows = [(d, i, 0, v) for d, vs in docs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "doc_id int, sent_id int, block_id int, embedding array<double>")


def test_coherence_small_documents(spark):
    got = {r.doc_id: r for r in coherence.coherence(sentences(spark, {1: axis(0), 2: axis(0, 0), 3: axis(0, 1, 0, 1)})).collect()}
    assert (got[1].ce_n_sentences, got[1].ce_n_adj, got[1].ce_adj_mean) == (1, 0, 0.0)
    assert (got[2].ce_adj_mean, got[2].ce_longest_coherent_run, got[2].ce_drop_mean) == (1.0, 1, 0.0)
    assert (got[3].ce_break_count, got[3].ce_skip_mean, got[3].ce_longest_coherent_run) == (3, 1.0, 0)


def plain_linkage(x, threshold):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                d = np.mean([1 - x[i] @ x[j] for i in groups[a] for j in groups[b]])
                if best is None or d < best[0] - 1e-12:
                    best = (d, a, b)
        if best[0] > threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(x), int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


def test_average_linkage():
    rng = np.random.default_rng(3)
    for n in (2, 3, 8, 15):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1)[:, None]
        assert clusters.average_linkage(x, 0.52).tolist() == plain_linkage(x, 0.52).tolist()


def test_trimmed_mean(spark):
    rows = spark.createDataFrame([(4.0, 4.0, 7.0), (1.0, 5.0, 9.0), (1.0, 8.0, 9.0)], "a double, b double, c double")
    got = [(r.consensus, r.trimmed) for r in ratings.consensus(rows, ["a", "b", "c"], 3.0).collect()]
    assert got == [(5.0, False), (7.0, True), (8.5, True)]


def test_correlation_of_a_constant_is_zero(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert ratings.correlations(rows, ["x"], "y").first().pearson == 0.0


def test_text(spark):
    df = spark.createDataFrame([("A b.  C d!\r\nE f",), ("",)], "t string")
    got = [r.s for r in df.select(text.sentences(text.normalize_text(F.col("t"))).alias("s")).collect()]
    assert got == [["A b.", "C d!", "E f"], []]


def test_bands_and_calibration(spark):
    df = spark.createDataFrame([(20.0,), (20.1,), (81.0,)], "x double")
    got = df.select(scoring.band(F.col("x")).alias("b"), scoring.isotonic(F.col("x"), [0.0, 40.0], [0.0, 80.0]).alias("c")).collect()
    assert [r.b for r in got] == [0, 1, 5]
    assert got[0].c == pytest.approx(40.0) and got[2].c == 80.0


def test_json_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": 1, "journal_text": " a "}\n\nnot json\n{"id": 2, "journal_text": null}\n')
    path = str(tmp_path / "in.jsonl")
    kept = journals.text_of(journals.read_records(spark, path, "id long, journal_text string", skip_invalid=True))
    assert [r.journal_text for r in kept.collect()] == ["a"]
    with pytest.raises(Exception):
        journals.read_records(spark, path, "id long, journal_text string").collect()
    journals.write_texts(kept, str(tmp_path / "out"))
    journals.write_records(kept, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().journal_text == "a"


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", 1, 2.0), ("2024-01-01 01:00:00", 1, 4.0)], "ts string, user_id int, value double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts string, user_id int, value double").parquet(str(tmp_path / "in"))
    q = windowed_scores(source, "1 day", "1 day").writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM scores").first()
    assert (r.n, r.mean, r["std"]) == (2, 3.0, 1.0)


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, sentences array<string>, embeddings array<array<double>>, n string")


TEXTS = [
    (1, ["I love this because it helps.", "I hate my life...", "Anyway whatever"], [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]], "x"),
    (2, None, None, None),
    (3, ["Hi."], [[1.0, 0.0]], "x"),
    (4, ["I am sure I can.", "", "It went bad -- and I can't go on.", "Yesterday was ok.", "Tomorrow too!!!"], [[1.0, 0.0]] * 5, "x"),
    (5, [], [], "x"),
    (6, ["I'm happy.", "I always fail at sad things, i'm sad too.", "Now i see it."], [[1.0, 0.0]] * 3, "x"),
]


def test_disorder_features(spark):
    got = {r.doc_id: r.asDict() for r in discourse.disorder(texts(spark, TEXTS)).collect()}
    assert all(v == 0 for d in (2, 5) for k, v in got[d].items() if k != "doc_id")
    assert len(got[1]) == 18
    assert (got[1]["gd_no_compression_ending"], got[1]["gd_topic_reset_rate"]) == (1.0, pytest.approx(1 / 3))
    assert got[3]["gd_compression_failure_score"] == pytest.approx(0.1)
    # Four sentences in two blocks; the second block opens with a pronoun and nobody was named before.
    assert (got[4]["gd_block_reset_rate"], got[4]["gd_dangling_referent_rate"], got[4]["gd_entity_drift_score"]) == (1.0, 0.25, 0.5)


def test_wording_features(spark):
    got = {r.doc_id: r.asDict() for r in discourse.wording(texts(spark, TEXTS)).collect()}
    assert all(v == 0 for d in (2, 3, 5) for k, v in got[d].items() if k != "doc_id")
    assert (got[4]["ne_temporal_jump_rate"], got[4]["cle_punctuation_noise"], got[4]["ne_fragment_sentence_rate"]) == (0.25, 0.4, 0.4)
    assert (got[1]["ne_end_abandonment_cue"], got[1]["ne_punct_break_rate"]) == (1.0, pytest.approx(1 / 3))


def test_belief_conflicts(spark):
    got = {r.doc_id: r for r in discourse.belief_conflicts(texts(spark, TEXTS)).collect()}
    assert (got[1].bc_conflict_pair_count, got[1].bc_max_conflict_sim, got[1].bc_unresolved_rate) == (1, 0.8, 1.0)
    assert [got[d].bc_belief_sentence_count for d in (2, 3, 5)] == [0, 0, 0]
    assert (got[4].bc_conflict_span_max, got[4].bc_conflict_rate) == (2, 0.5)
    assert (got[6].bc_conflict_pair_count, got[6].bc_integration_rate) == (1, 1.0)


def test_verbs_after_articles(spark):
    rows = [("the run",), ("we run",), ("Walking on",), ("a plan for a change",), ("green chair",)]
    df = spark.createDataFrame(rows, "t string").select("t", discourse.has_verb(F.lower("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == {"the run": False, "we run": True, "Walking on": True, "a plan for a change": False, "green chair": False}


@pytest.mark.parametrize("words, loops", [("a b c d e f", False), ("a a c d e f", True), ("a b a b e f", True), ("a b c a b f", False), ("long x long y long z", True), ("a a", False)])
def test_looping(spark, words, loops):
    df = spark.createDataFrame([(words.split(),)], "w array<string>").select(text.looping(F.col("w")))
    assert df.first()[0] is loops


def test_block_sentences(spark):
    rows = [(1, "I was thinking\nActually, no. Fine...\nThen on\nand on.\n\n \n...\n\nLast one!"), (2, ""), (3, None), (4, "?!\r\n\r\n--"), (5, "A\nB\nC")]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id int, t string").select("id", segments.block_sentences(F.col("t")).alias("x")).collect()}
    assert [tuple(x) for x in got[1]] == [(0, "I was thinking"), (0, "Actually, no."), (0, "Fine..."), (0, "Then on and on."), (1, "Last one!")]
    assert (got[2], got[3], got[4]) == ([], None, [])
    assert [x.text for x in got[5]] == ["A", "B", "C"]


def test_reports_without_rows(spark):
    empty = spark.createDataFrame([], "control_type string, expected double, model double, id int")
    assert set(reports.gates(empty).first()) == {False}
    assert reports.summary(empty).first().n == 0
    assert reports.worst(empty, ["id"]).count() == 0


def test_feedback(spark):
    rows = [(-2.0, "decrease"), (-1.0, "decrease"), (1.5, "increase"), (3.0, "stable"), (-3.5, "stable"), (9.0, "other")]
    df = spark.createDataFrame(rows, "d double, t string").select(*scoring.feedback(F.col("d"), F.col("t")))
    assert [tuple(r) for r in df.collect()] == [(True, True), (False, False), (True, True), (True, True), (False, False), (False, False)]


def test_ridge_out_of_fold(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(60, 3)), rng.uniform(0.5, 2, 60)
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60) / 10
    rows = [(*map(float, a), float(b), float(c), i % 4) for i, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0, 0)], "a double, b double, c double, y double, w double, fold int")
    got = training.out_of_fold(df, ["a", "b", "c"], "y", "fold", 0.7, F.col("w")).collect()
    for fold in range(4):
        t = np.arange(60) % 4 != fold
        mean_x, mean_y = np.average(x[t], axis=0, weights=w[t]), np.average(y[t], weights=w[t])
        xc, yc = x[t] - mean_x, y[t] - mean_y
        coef = np.linalg.solve((xc.T * w[t]) @ xc + 0.7 * np.eye(3), (xc.T * w[t]) @ yc)
        assert [r.prediction for r in got[:60] if r.fold == fold] == pytest.approx(list((x[~t] - mean_x) @ coef + mean_y))
    assert got[60].prediction is None
    assert training.out_of_fold(df.limit(0), ["a"], "y", "fold").count() == 0


def test_average_linkage_is_the_plain_one():
    import numpy as np

    from textweave.operators.clusters import average_linkage

    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 3, 12, 30):
        for _ in range(6):
            x = rng.normal(size=(n, 3)).round(int(rng.integers(0, 3)))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            groups = [[i] for i in range(n)]
            d = 1 - x @ x.T
            while len(groups) > 1:
                best = min((round(np.mean([d[i, j] for i in a for j in b]), 12), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q)
                if best[0] > 0.52:
                    break
                groups[best[1]] += groups.pop(best[2])
            got = average_linkage(x)
            same = {(i, j) for g in groups for i in g for j in g}
            if len(np.unique(np.round(d, 9))) > n * (n - 1) // 3 or n < 3:  # without many ties
                assert {(i, j) for i in range(n) for j in range(n) if got[i] == got[j]} == same


def test_linkage_by_sums_equals_distances(monkeypatch):
    """Clusters of many sizes, copies, and vectors far from all; a large document never has all distances at once."""
    rng = np.random.default_rng(4)
    for n, k, scale in ((300, 5, 0.8), (500, 40, 0.9), (400, 400, 0.5)):
        x = rng.normal(size=(k, 64))[rng.integers(0, k, n)] + rng.normal(scale=scale, size=(n, 64))
        x[:20] = x[20]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert (clusters.linkage_by_sums(x) == clusters.average_linkage(x)).all()
        plain = clusters.cluster_features(x)
        monkeypatch.setattr(clusters, "DENSE", 100)
        assert clusters.cluster_features(x) == pytest.approx(plain, abs=1e-9)
        monkeypatch.undo()
    x = np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=(1500, 32)) * 0.1 + np.eye(32)[0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    clusters.cluster_features(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * x.nbytes
