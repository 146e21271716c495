"""The .npy source and cache, token windows and the ordered text sink."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators import embedding
from textweave.sources import arrays, journals


def frame(spark, n, width=3, start=0):
    return spark.createDataFrame([(k, [float(k * width + j) / 2 for j in range(width)]) for k in range(start, start + n)], "id long, v array<double>").repartition(3)


def test_npy_round_trip_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "RANGE_BYTES", 40)
    path = str(tmp_path / "a")
    arrays.write_npy(frame(spark, 20), path, "id", "v", 3, "float64")
    back = arrays.read_npy(spark, path)
    assert back.dtypes == [("file", "string"), ("row", "bigint"), ("id", "bigint"), ("embedding", "array<double>")]
    assert {r.id: list(r.embedding) for r in back.collect()} == {r.id: list(r.v) for r in frame(spark, 20).collect()}
    assert back.rdd.getNumPartitions() > 10
    # A second write replaces what counts; files that no manifest names do not.
    arrays.write_npy(frame(spark, 2), path, "id", "v", 3, "float64")
    assert arrays.read_npy(spark, path).count() == 2
    assert len([n for n in os.listdir(path) if not n.endswith(".ids.npy")]) > 3


def test_npy_files_of_others(spark, tmp_path):
    whole = np.arange(24, dtype=np.float32).reshape(8, 3)
    np.save(tmp_path / "x.npy", whole)
    np.save(tmp_path / "y.npy", whole[:0])
    got = arrays.read_npy(spark, str(tmp_path)).orderBy("file", "row").collect()
    assert [r.row for r in got] == list(range(8)) and [list(r.embedding) for r in got] == whole.tolist() and {r.id for r in got} == {None}
    assert arrays.read_npy(spark, str(tmp_path / "x.npy")).count() == 8
    for name, bad in (("flat", np.arange(3.0)), ("wide", np.zeros((2, 4), np.float32)), ("text", np.array([["a"]])), ("columns", np.asfortranarray(whole))):
        folder = tmp_path / name
        folder.mkdir()
        np.save(folder / "x.npy", whole)
        np.save(folder / "z.npy", bad)
        with pytest.raises(Exception, match="ValueError"):
            arrays.read_npy(spark, str(folder)).count()


def test_npy_refuses_odd_vectors(spark, tmp_path):
    for k, rows in enumerate(([(1, None)], [(None, [1.0, 2.0])], [(1, [1.0, None])], [(1, [1.0])], [(1, [1.0]), (2, [1.0, 2.0, 3.0])])):
        with pytest.raises(Exception, match="ValueError"):
            arrays.write_npy(spark.createDataFrame(rows, "id long, v array<double>").coalesce(1), str(tmp_path / f"b{k}"), "id", "v", 2)
        assert not os.path.exists(tmp_path / f"b{k}" / arrays.MANIFEST)
    arrays.write_npy(spark.createDataFrame([], "id long, v array<double>"), str(tmp_path / "none"), "id", "v", 2)
    assert json.loads((tmp_path / "none" / arrays.MANIFEST).read_text())["parts"] == []


def test_cache_is_kept_only_for_the_same_rows_width_and_type(spark, tmp_path):
    calls = []

    def compute(width):
        def run(inputs):
            calls.append(width)
            return inputs.select("id", F.array_repeat(F.col("id") * 1.5, width).alias("embedding"))

        return run

    path = str(tmp_path / "cache")
    steps = [(5, 2, "float32", False), (5, 2, "float32", True), (6, 2, "float32", False), (6, 3, "float32", False), (6, 3, "float64", False), (6, 3, "float64", True)]
    for n, width, kind, kept in steps:
        got, was = arrays.cached_vectors(frame(spark, n), "id", compute(width), path, width, kind)
        assert was is kept
        assert {r.id: list(r.embedding) for r in got.collect()} == {k: [k * 1.5] * width for k in range(n)}
    assert calls == [2, 2, 3, 3]
    # Other ids of the same number, and a torn file, are computed again.
    assert not arrays.cached_vectors(frame(spark, 6, start=1), "id", compute(3), path, 3, "float64")[1]
    for name in os.listdir(path):
        if name.endswith(".ids.npy"):
            (tmp_path / "cache" / name).write_bytes(b"")
    assert not arrays.cached_vectors(frame(spark, 6, start=1), "id", compute(3), path, 3, "float64")[1]


def marked():
    e = embedding.word_encoder(4)()
    return e._replace(begin=(1,), end=(2,))


@pytest.mark.parametrize("pooling", ["mean", "first"])
@pytest.mark.parametrize("beyond", ["windows", "cut"])
def test_token_windows(spark, pooling, beyond):
    texts = {0: "a bb ccc dddd eeeee ff", 1: None, 2: "", 3: "x", 4: "long " * 23, 5: "é ü"}
    df = spark.createDataFrame([(k, t, "kept") for k, t in texts.items()], "k int, t string, e string").coalesce(1)
    got = embedding.embed_windows(df, "t", marked, most=6, pooling=pooling, beyond=beyond, prefix="q: ")
    found = {(r.k, r.window): r for r in got.collect()}
    encoder, want = marked(), {}
    for k, t in texts.items():
        if t is None:
            want[k, None] = (None, None)
            continue
        ids = encoder.ids(["q: " + t])[0]
        for j, b in enumerate(range(0, max(1, len(ids)), 4)):
            if j and beyond == "cut":
                break
            window = [1, *ids[b : b + 4], 2]
            tokens = encoder.forward(np.array([window]), np.ones((1, len(window))))[0]
            v = tokens.mean(0) if pooling == "mean" else tokens[0]
            want[k, j] = (len(window) - 2, v / np.linalg.norm(v))
    assert set(found) == set(want)
    for key, (n, v) in want.items():
        assert found[key].n_tokens == n and (found[key].embedding is None if v is None else found[key].embedding == pytest.approx(v.tolist(), abs=1e-6))


def test_windows_of_like_length_share_a_call(monkeypatch):
    monkeypatch.setattr(embedding, "CALL_TOKENS", 12)
    seen = []

    def forward(ids, mask):
        seen.append((ids.shape, int(mask.sum())))
        return ids[:, :, None].astype(float)

    encoder = embedding.TokenEncoder(lambda t: [], forward)
    out = embedding.pooled_windows([[5], [1] * 6, [7], [2] * 6, [3] * 20], encoder, embedding.mean_pooling)
    assert [v.tolist() for v in out] == [[1.0]] * 5
    assert seen == [((1, 20), 20), ((2, 6), 12), ((2, 1), 2)]


def test_windows_of_odd_calls(spark):
    df = spark.createDataFrame([("",)], "t string")
    assert embedding.embed_windows(df, "t", embedding.word_encoder()).first().embedding is None
    with pytest.raises(ValueError):
        embedding.embed_windows(df, "t", embedding.word_encoder(), beyond="other")
    with pytest.raises(ValueError):
        embedding.embed_windows(df, "t", embedding.word_encoder(), column="t")
    assert embedding.embed_windows(df.limit(0), "t", embedding.word_encoder()).count() == 0


def test_texts_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, f"entry {k}\nline") for k in range(50)], "k int, journal_text string").repartition(7)
    journals.write_texts(df, str(tmp_path / "o"), ["k"])
    names = sorted(n for n in os.listdir(tmp_path / "o") if n.startswith("part-"))
    whole = "".join((tmp_path / "o" / n).read_text() for n in names)
    assert whole == "".join(f"entry {k}\nline\n\n" for k in range(50))
