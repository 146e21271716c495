"""The training-data operators against brute force, with nulls, ties, repeats, long texts and empty tables."""

import os
import uuid
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textweave.llm import bpe, common, components, langid, near_dedup, packing, queries, rules, substring_dedup, suffix_dedup, token_files, topk, urls, windows

SF = "/root/testdata/sf0.001"
ODD = ["Hello wORLD!! it's x<|endoftext|>y  á b", None, "", " \n ", "q\x1cw e\u0085r", "I'LL don't 123 ½ İ ΑΣ ﬁ 日本語 🎉🎉", "a" * 3000 + "!" * 500, "x\u00a0y　z ''s", "́ áb"]
COLUMNS = "doc_id long, text string, lang string, th long, key string, ids string"


def documents(spark, texts, ids=None):
    """With clashing extra columns."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, 7, "k", "z") for i, t in zip(ids, texts)], COLUMNS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    passage, base = say(80), say(200)
    out = [say(rng.integers(1, 150)) for _ in range(30)]
    out += [f"{say(30)} {passage} {say(20)}" for _ in range(8)]
    out += [base, base, base.replace(" ", "\n", 3), f"{base} {say(4)}", f"{say(3)} {base}", base[:-40] + say(5)]
    out += [None, "", "  ", say(4), "ab " * 300, say(3000)]
    return out


def test_bpe_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.word_bpe())
    for r, t in zip(bpe.encode_documents(documents(spark, ODD + texts), queries.word_bpe()).orderBy("doc_id").collect(), ODD + texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_forced_cuts_are_never_inside_a_token():
    b = bpe.tokenizer(queries.word_bpe())
    assert not b.inside.all() and b.inside[ord("t"), ord("h")]


def test_packing(spark, texts):
    docs = documents(spark, texts + ODD)
    rows = packing.pack(packing.token_pieces(docs, queries.word_bpe(), 256), 256, pieces_per_task=12).collect()
    b = bpe.tokenizer(queries.word_bpe()).library
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts + ODD):
        ids = [*b.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(s, min(256, len(ids) - s)) for s in range(0, len(ids), 256)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own]
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    sizes = np.array([r.length for r in rows])
    assert packing.lower_bound(sizes, 256) <= len(bins) <= packing.lower_bound(sizes, 256) + 2


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 40))
        assert packing.lower_bound(sizes, 100) <= packing.best_fit_decreasing(sizes, 100)[0].max() + 1


def test_suffix_dedup(spark, texts):
    for width, gram, group in ((40, 16, 2048), (40, 16, 1), (40, 16, 3), (400, 160, 2048)):
        got = suffix_dedup.remove_repeats(documents(spark, texts), width, gram, group).orderBy("doc_id").withColumn("h", F.sha2("kept", 256)).collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got] == brute.removed_bytes(texts, width)
    cleaned = suffix_dedup.cleaned(spark.createDataFrame([(1, "é" * 300, 300), (2, "é" * 300, 300), (3, None, None)], "doc_id long, text string, n_chars long"))
    assert [(r.text, r.n_chars) for r in cleaned.orderBy("doc_id").collect()] == [("", 0), ("", 0), (None, None)]


def test_substring_dedup(spark, texts):
    for width in (12, 50):
        got = substring_dedup.remove_repeats(documents(spark, texts), width).orderBy("doc_id").withColumn("h", F.sha2(F.col("kept").cast("binary"), 256)).collect()
        assert [(r.doc_id, r.n_words, r.n_removed, r.h) for r in got] == brute.removed_words(list(enumerate(texts)), width)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [t, t, t, "x"], [None, 5, 5, 6])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (5, 60), (5, 60), (6, 0)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(docs, 40, 16).collect()) == [(0, len(t)), (5, len(t)), (5, len(t)), (6, 0)]
    assert sorted((r.doc_id or 0, r.class_id) for r in near_dedup.near_duplicates(docs).collect()) == [(0, 5), (5, 5), (5, 5), (6, 6)]


def test_near_duplicates(spark, texts):
    docs = documents(spark, texts)
    idf = near_dedup.document_frequencies(docs)
    of, h, w, _, _ = near_dedup.shingles(pa.array([t or "" for t in texts]), idf)
    bags = [dict(zip(h[of == i].tolist(), w[of == i].tolist())) for i in range(len(texts))]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = sum(min(bags[i][x], bags[j][x]) for x in bags[i].keys() & bags[j].keys())
            union = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if union and shared / union >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def chained_groups(groups, satellites):
    """Two bases of similarity 0.83 a group, with satellites alike to their own base only."""
    rng = np.random.default_rng(11)
    out = []

    def changed(words, size, times):
        words = list(words)
        for at in rng.choice(np.arange(0, len(words) - size, size + 5), times, replace=False):
            words[at : at + size] = rng.choice(words, size)
        return words

    for g in range(groups):
        a = [f"g{g}w{i}" for i in rng.integers(0, 150, 200)]
        for base in (a, changed(a, 14, 1)):
            out += [(g, base)] + [(g, changed(base, 1, 3)) for _ in range(satellites)]
    return [g for g, _ in out], [" ".join(w) for _, w in out]


def test_links_of_texts_that_lead_nothing(spark, monkeypatch):
    size = 30
    group, texts = chained_groups(10, size)
    idf = near_dedup.document_frequencies(documents(spark, texts))
    base = [i // (size + 1) * (size + 1) for i in range(len(texts))]
    near = near_dedup.similarities(pa.array(texts), pa.array([texts[i] for i in base]), idf)
    bases = sorted(set(base))
    across = near_dedup.similarities(pa.array([texts[i] for i in bases[::2]]), pa.array([texts[i] for i in bases[1::2]]), idf)
    whole = [g for g in range(10) if across[g] >= 0.8 and min(s for s, h in zip(near, group) if h == g) >= 0.8]
    assert len(whole) >= 4
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 16)  # several blocks of a bucket
    monkeypatch.setattr(near_dedup, "CROWD", 20)
    classes = defaultdict(set)
    for r in near_dedup.near_duplicates(documents(spark, texts)).collect():
        classes[group[r.doc_id]].add(r.class_id)
    assert [len(classes[g]) for g in whole] == [1] * len(whole)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (1, 2)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(230, 8)).round(1)
    v[100:140] = v[50]
    rows = [(i, v[i].tolist()) for i in range(230)] + [(300, None), (350, [float("nan")] * 8), (400, [None] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).orderBy("query_id", "rank").collect()
    q = np.floor(v * 256).astype(int)
    want = []
    for i in range(0, 230, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(230) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("scale", [256, 1 << 27])
def test_top_k_counts_an_id_once(spark, scale):
    rng = np.random.default_rng(3)
    ids = [*range(60), *[7] * 4, *[8] * 3, 50, 50, 9, 9]
    v = rng.normal(size=(60, 4)).round(1)
    v[7], v[8] = v[0] * 4, v[0] * 3
    v = np.concatenate([v[ids[:-4]], v[[50]], rng.normal(size=(3, 4)).round(1) * 2])
    got = topk.top_k(spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id long, embedding array<double>"), 5, 50, scale).orderBy("query_id", "rank").collect()
    q = [[int(x) for x in row] for row in np.floor(v * scale)]
    want = []
    for i in (0, 50):
        best = {}
        for a, x in zip(ids, q):
            for b, y in zip(ids, q):
                if a == i != b:
                    score = sum(m * n for m, n in zip(x, y))
                    best[b] = max(best.get(b, score), score)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:5])]
    assert [tuple(r) for r in got] == want


def test_top_k_bands_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SHARD_BYTES", 8 * 6 * 20)
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 6 * 5)
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(400, 6)) * rng.gamma(1, 1, (400, 1))).round(2)
    v[200:260] = v[3]
    rows = [(i, x.tolist(), "q", 1.0) for i, x in enumerate(v)] + [(None, v[0].tolist(), "q", 1.0), (1000, [], "q", 1.0), (1050, [9.0] * 5, "q", 1.0), (7, v[7].tolist(), "r", 2.0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, norm double"), 5, 50).orderBy("query_id", "rank").collect()
    q = np.floor(v * 256).astype(int)
    want = []
    for i in range(0, 400, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert [tuple(r) for r in got] == want


def test_top_k_sql_on_repeated_ids_and_odd_lengths(spark):
    """Code and SQL agree where ids repeat, with the same vector or another, and where lengths differ."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 4)).round(1).tolist()
    rows = [*enumerate(v), (7, v[7]), (7, v[7]), (8, [9.0] * 4), (50, v[50]), (50, v[51]), (300, [9.0] * 5), (350, []), (None, v[0]), (9, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(queries.SQL["op1_topk"]).fetchall()
    assert sorted(tuple(r) for r in topk.top_k(df, 5, 50).select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_top_k_without_queries(spark):
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_urls(spark):
    rows = ["http://A.Example.COM/en/1?x", "http://www.example.com/en/2#f", "https://x.net/es/3", "x.net/es/3", None, "http://com", "http://notexample.com/en/", "a://b.net/frx", ""]
    got = urls.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("x.net", "/es/3", "net/es/"), ("", "", None), ("", "", None),
        ("com", "", None), ("notexample.com", "/en/", "com/"), ("b.net", "/frx", None), ("", "", None),
    ]
    assert [r.verdict for r in got][:3] == ["block", "allow", "block"]


def test_url_templates(spark):
    rng = np.random.default_rng(4)
    kinds = ["/{}", "/{}.html", "/{}/", "/a/{}", "/x/y/{}/z.php", "", "/deep/er/{}/and/on"]
    rows = [None, "no scheme", "http://", "x://h"] + ["http://many.net/es/1"] * 7
    for host in ("a.net", "b.net", "c.example.com", "www.example.com", "d.org"):
        favour = rng.integers(0, len(kinds), (5, 2))
        for _ in range(120):
            lang = rng.integers(0, 5)
            kind = kinds[rng.choice(favour[lang]) if rng.random() < 0.8 else rng.integers(0, len(kinds))]
            rows.append(f"http://{host}/{['en', 'es', 'fr', 'de', 'p' + str(rng.integers(100))][lang]}{kind.format(rng.integers(1, 999))}")
    rows += [f"http://many.net/{''.join(rng.choice(list('qwrt'), 4))}/{i % 3}" for i in range(90)] + [f"http://many.net/es/{i}" for i in range(9)]
    pages = list(enumerate(rows)) + [(None, "http://a.net/es/1"), (3, "http://a.net/es/1"), (3, "http://a.net/es/1")]
    # Brute force by position, as ids repeat.
    want = brute.url_verdicts([(k, u) for k, (_, u) in enumerate(pages)], urls.RULES)
    got = urls.judge(spark.createDataFrame([(i, u, "h", "s") for i, u in pages], "page_id long, url string, host string, shapes string")).select("page_id", "verdict", "rule").collect()
    assert sorted(((r.page_id, r.verdict) for r in got), key=str) == sorted(((i, want[k]) for k, (i, _) in enumerate(pages)), key=str)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_url_templates_tell_deep_branches_apart(spark):
    """Branches that part at the sixth segment alone have verdicts of their own; an urls of very many segments ends."""
    urls_of = [f"http://d.net/q/w/e/r/t/{b}/{'x/' if b == 'good' else ''}{i}" for i in range(40) for b in ("bad", "good")]
    rules = [("block", f"d.net/q/w/e/r/t/bad/{i}") for i in range(10, 30)] + [("allow", f"d.net/q/w/e/r/t/good/x/{i}") for i in range(10, 30)]
    urls_of += ["http://d.net/" + "s/" * 30, "http://d.net"]
    got = urls.judge(spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string"), rules).collect()
    want = brute.url_verdicts(list(enumerate(urls_of)), rules)
    assert {r.page_id: r.verdict for r in got} == want
    free = {("bad" in r.path, r.verdict) for r in got if r.rule is None and "/t/" in r.path}
    assert free == {(True, "block"), (False, "allow")}


def test_url_templates_without_broadcast(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one = urls.judge(pages).select("page_id", "verdict").collect()
    monkeypatch.setattr(urls, "BROADCAST_SHAPES", 0)
    assert sorted(one) == sorted(urls.judge(pages).select("page_id", "verdict").collect())


def test_more_distinct_words_than_21_bits():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 4, (3, 200))
    for n_words in (4, 1 << 21, 1 << 22, 1 << 31):
        a, b, c = words * ((n_words - 1) // 3)
        codes = rules.window_codes(a, b, c, n_words)
        assert (codes[:, None] == codes).tolist() == ((words[:, :, None] == words[:, None]).all(0)).tolist()


def test_rules(spark, texts):
    entries = rules.ledger(documents(spark, texts))
    got = {r.doc_id: r for r in entries.collect()}
    for i, t in enumerate(texts):
        w = brute.WORD.findall(t or "")
        where = defaultdict(list)
        for p in range(len(w) - 2):
            where[tuple(w[p : p + 3])].append(p)
        covered = {p + k for ps in where.values() if len(ps) > 1 for p in ps for k in range(3)}
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
    parts = {r.rule: r for r in rules.ablations(entries).collect()}
    assert parts["few_words"].n_failed == sum(len(brute.WORD.findall(t or "")) < 50 for t in texts)


def test_policies_and_ablations_come_from_the_bits(spark, texts):
    entries = common.stored(rules.ledger(documents(spark, [*texts, "# " * 60, "a " * 20 + "b c d e " * 12 + "f"])), "ledger")
    got = rules.judged(entries, {"one": "quality@1", "two": "quality@2"}).collect()
    names = {1 << bit: name for bit, name, _ in rules.RULES}
    only = [names.get(r.fail_bits) for r in got]
    for r, rule in zip(got, only, strict=True):
        assert (r.one, r.two) == (r.fail_bits == 0, r.fail_bits & 15 == 0)
        assert (r.deciding_rule, r.n_deciding) == (rule, only.count(rule) if rule else None)
    assert len(got) == len(texts) + 2 and len({x for x in only if x}) > 1
    for a in rules.ablations(entries, "quality@2").collect():
        bit = next(b for b, n in names.items() if n == a.rule)
        seen = [r.fail_bits & 15 for r in got]
        assert (a.n_failed, a.n_only_this, a.n_kept_without) == (sum(b & bit > 0 for b in seen), seen.count(bit), sum(b & ~bit == 0 for b in seen))
    assert rules.judged(rules.ledger(documents(spark, ["x"]).where("false")), {"kept": "quality@1"}).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.learning_fold(docs.doc_id)))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(~langid.learning_fold(F.col("doc_id")))
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = langid.identify(documents(spark, [None, "", "123 --", "é"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred != "und"


def test_language_mixture_is_the_plain_one(spark):
    """Training, mixtures and the choice of the set against plain Python, on pure, mixed, tied, odd and empty texts."""
    rng = np.random.default_rng(11)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "jklmnopé", "dd": "stuvwxyz"}
    say = lambda x, n: " ".join("".join(rng.choice(list(letters[x]), rng.integers(2, 7))) for _ in range(n))
    learn = [(say(x, 60), x) for x in letters for _ in range(4)] + [(None, "aa"), ("x y", None), ("", "bb"), ("12 --", "cc")]
    ask = [say(x, n) for x in letters for n in (1, 3, 40)] + [f"{say(a, 25)} {say(b, n)}" for a, b, n in (("aa", "dd", 25), ("bb", "cc", 9), ("cc", "aa", 2))]
    ask += [f"{say('aa', 30)} {say('dd', 30)} {say('cc', 30)}", None, "", " 12 -- ", "é", "Ab1cD, x-Y!", say("bb", 30).upper(), "ΑΣ ΟΔΟΣ İx", *ODD]
    model = langid.train(spark.createDataFrame([(*r, 1) for r in learn], "text string, lang string, n int"))
    plain = brute.language_model(learn, langid.BUCKETS)
    assert model["languages"] == list(plain)
    got = langid.identify(documents(spark, ask), model).orderBy("doc_id").collect()
    want = [brute.language_mixture(plain, t, langid.STEPS, langid.FLOOR) for t in ask]
    assert [(r.lang_pred, r.n_languages) for r in got] == [(x, n) for x, _, n in want]
    assert [r.score for r in got] == pytest.approx([s for _, s, _ in want], abs=1e-4)
    assert {n for *_, n in want} >= {0, 1, 2, 3}


def test_token_counts(spark, texts):
    docs = documents(spark, texts + ODD)
    got = {r.doc_id: r.n_tokens for r in token_files.count_document_tokens(docs, queries.word_bpe(), queries.END_OF_TEXT).collect()}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.word_bpe())
    lib.encode_special_tokens = True
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts + ODD)}
    assert got == want
    folder = f"{common.shared_root(spark)}/several-{uuid.uuid4().hex}"
    order = token_files.write_token_files(docs, queries.word_bpe(), folder, queries.END_OF_TEXT, file_documents=3)
    found = token_files.document_lengths(token_files.token_blocks(spark, folder, block_tokens=50), queries.END_OF_TEXT)
    assert {r.doc_id: r.n_tokens for r in order.join(found, ["file", "ordinal"]).collect()} == want
    assert order.select("file").distinct().count() > 5
    ranges = token_files.document_lengths(token_files.token_blocks(spark, folder, block_tokens=50, whole_bytes=100), queries.END_OF_TEXT)
    assert sorted(ranges.collect()) == sorted(found.collect())


def test_token_files_beyond_a_row(spark, tmp_path):
    """A file above the 2 GB of a row, and one next to it; ends at both sides of block borders."""
    size, block = (1 << 31) + (1 << 20), 1 << 23
    ends = [0, block - 1, block, 5 * block - 1, size // 2 - 2]
    with open(tmp_path / "part-00001-x c000.txt", "wb") as f:
        f.truncate(size)
        for at in ends:
            f.seek(2 * at)
            f.write(b"\x07\x00")
    np.array([1, 7, 7, 2], "<u2").tofile(tmp_path / "part-00002-y-c000.txt")
    got = token_files.document_lengths(token_files.token_blocks(spark, str(tmp_path), block_tokens=block), 7).orderBy("file", "ordinal").collect()
    begins = [0, *(e + 1 for e in ends)]
    want = [(k, b, e - b) for k, (b, e) in enumerate(zip(begins, [*ends, size // 2], strict=True))]
    first = (1 << 32, 2 << 32)
    assert [(r.ordinal, r.start, r.n_tokens) for r in got if r.file == first[0]] == want
    assert [(r.ordinal, r.start, r.n_tokens) for r in got if r.file == first[1]] == [(0, 0, 1), (1, 2, 0), (2, 3, 1)]


def test_token_file_of_part_of_a_token(spark, tmp_path):
    (tmp_path / "part-00000-c000.txt").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of tokens"):
        token_files.token_blocks(spark, str(tmp_path)).collect()


def test_near_duplicate_recall(spark):
    """Pairs by themselves of similarity 0.8 to 0.9, where no other text can link them: none is lost, none below 0.8 joined."""
    rng = np.random.default_rng(11)
    texts = []
    for pair in range(420):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        other = list(words)
        for at in rng.choice(32, 3 + pair % 3, replace=False) * 6 + 4:  # apart, so that each takes five windows
            other[at] = f"n{rng.integers(0, 3000)}"
        texts += [" ".join(words), " ".join(other)]
    idf = brute.word_idf(texts)
    s = [brute.weighted_jaccard(a, b, idf) for a, b in zip(texts[::2], texts[1::2])]
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    linked = [classes[2 * k] == classes[2 * k + 1] for k in range(len(s))]
    # Words that share a slot of the frequency table move a similarity a little.
    near = [k for k, x in enumerate(s) if 0.802 <= x < 0.9]
    assert len(near) >= 200 and sum(x < 0.81 for x in s) > 20
    assert all(linked[k] for k in near)
    assert not any(linked[k] for k, x in enumerate(s) if x < 0.798)
    assert len(set(classes.values())) == len(texts) - sum(linked)


def test_an_input_that_changes_between_scans_is_an_error(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    @F.udf("string")
    def other(t):
        import time

        return f"{t} {time.time()}"

    with pytest.raises(RuntimeError):
        token_files.count_document_tokens(docs.withColumn("text", other.asNondeterministic()("text")), queries.word_bpe(), queries.END_OF_TEXT)


def test_blocks_are_stitched(spark):
    ids = np.array([5, 9, 9, 1, 2, 3, 9, 4], "<u2").tobytes()
    blocks = spark.createDataFrame([(0, k, 3 * k, bytearray(ids[6 * k : 6 * k + 6])) for k in range(3)], "file int, block long, first long, tokens binary")
    got = token_files.document_lengths(blocks, 9).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens) for r in got] == [(0, 1), (2, 0), (3, 3), (7, 1)]


def test_empty_tables(spark):
    none = documents(spark, ["x"]).where("false")
    model = {"languages": [], "log_p": np.zeros((langid.BUCKETS, 0), np.float32)}
    for df in (
        bpe.encode_documents(none, queries.word_bpe()), packing.pack_documents(none, queries.word_bpe()), suffix_dedup.remove_repeats(none), substring_dedup.remove_repeats(none),
        near_dedup.near_duplicates(none), rules.ledger(none), langid.identify(none, model), token_files.count_document_tokens(none, queries.word_bpe(), queries.END_OF_TEXT),
        urls.judge(spark.createDataFrame([], "page_id long, url string")), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    theirs = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(theirs, key=str)


def rows_of_one_id(spark):
    """Null ids, repeated rows, one id on two texts, null and empty texts, with clashing extra columns."""
    t = " ".join(f"w{i}" for i in range(70))
    return documents(spark, [t, t, t, t + " x", "x y", None, "", None], [None, 5, 5, 5, None, 6, 7, 6])


def test_every_row_has_a_result(spark):
    docs = rows_of_one_id(spark)
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    ids = sorted(str(r.doc_id) for r in docs.collect())
    results = {
        "rules": rules.ledger(docs), "languages": langid.identify(docs, model), "counts": token_files.count_document_tokens(docs, queries.word_bpe(), queries.END_OF_TEXT),
        "bpe": bpe.encode_documents(docs, queries.word_bpe()), "packing": packing.pack_documents(docs, queries.word_bpe()).where("piece = 0"),
    }
    for name, df in results.items():
        got = df.collect()
        assert sorted(str(r.doc_id) for r in got) == ids, name
    # Equal rows have equal results, but for their places.
    for name in ("rules", "languages", "bpe"):
        fives = [tuple(r) for r in results[name].where("doc_id = 5").collect()]
        assert len(fives) == 3 and len(set(map(str, fives))) <= 2, name
    pages = spark.createDataFrame([(None, "http://a.net/es/1"), (1, "http://a.net/es/1"), (1, "http://a.net/es/1"), (2, None), (3, "")], "page_id long, url string")
    got = sorted((str(r.page_id), r.verdict, r.host) for r in urls.judge(pages).collect())
    assert got == [("1", "block", "a.net"), ("1", "block", "a.net"), ("2", "allow", ""), ("3", "allow", ""), ("None", "block", "a.net")]


def test_very_long_texts(spark):
    """One text of some megabytes with over 2 ** 21 distinct words beside short ones."""
    long = " ".join(map(str, range((1 << 21) + 5)))
    again = "start " + long[:3000]
    docs = documents(spark, [long, again, "a b"])
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    assert (got[0].n_words, got[0].n_repeat_words, got[1].n_words) == ((1 << 21) + 5, 0, len(again.split()))
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed == {0: 3000, 1: 3000, 2: 0}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    whole = len(long[:3000].split()) - (0 if long[3000] == " " else 1)
    assert words == {0: ((1 << 21) + 5, 0), 1: (len(again.split()), whole), 2: (2, 0)}


def test_windows_longer_than_a_packed_slice(monkeypatch):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 5, 500).astype(np.uint64)
    offsets = np.array([0, 3, 420, 500])
    want = windows.anchored(values, offsets, 20, 6)[1:]
    monkeypatch.setattr(windows, "PACKED", 7)
    for x, y in zip(want, windows.anchored(values, offsets, 20, 6)[1:]):
        assert x.tolist() == y.tolist()


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(windows, "HOT_ROWS", 2)
    monkeypatch.setattr(windows, "HOT_KEYS", 4)
    rng = np.random.default_rng(6)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = say(70)
    texts = [f"{say(20)} {passage} {say(20)}" for _ in range(25)] + [passage] * 4 + [say(90) for _ in range(10)]
    docs = documents(spark, texts)
    got = suffix_dedup.remove_repeats(docs, group_stretches=5).orderBy("doc_id").withColumn("h", F.sha2("kept", 256)).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got] == brute.removed_bytes(texts, 400)
    got = substring_dedup.remove_repeats(docs).orderBy("doc_id").withColumn("h", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.h) for r in got] == brute.removed_words(list(enumerate(texts)), 50)


def test_packing_certificates(spark, texts):
    pieces = packing.token_pieces(documents(spark, texts + ODD), queries.word_bpe(), 256)
    for per_task in (12, 1000):
        rows = packing.pack(pieces, 256, pieces_per_task=per_task).collect()
        assert all(1 <= r.bound <= r.bins for r in rows)
    assert len({r.sequence_id for r in rows if r.packed_in >= 0}) == rows[-1].bins


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [r for r in rows if len(r[1].split()) > 150]
    passage = " ".join(good[0][1].split()[20:100])
    for k, r in enumerate(good[1:5]):
        t = f"{r[1]} {passage}"
        rows.append((1000 + k, t, r[2], r[3], len(t)))
    rows += [(None, good[6][1], "en", "s", 1), (good[7][0], good[7][1], "en", "s", 1), (2000, good[8][1] + " z", None, None, None), (2001, None, None, None, None), (2002, "", "en", "s", 0), (None, None, None, None, None), (2003, "123 456 --", "en", "s", 9)]
    return rows


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = pipeline_documents(spark)
    table = lambda rows: spark.createDataFrame(rows, PIPELINE)
    run = lambda name, rows: [tuple(r) for r in stages[name](spark, table(rows), SF).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    same = lambda a, b: sorted(a, key=repr) == sorted(b, key=repr)

    model = langid.train(table([r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]))
    plain = []
    for r in rows:
        best, score, _ = langid.infer(model, pa.array([r[1] or ""]))
        if best[0] >= 0 and score[0] >= 0.5:
            plain.append(r)
    now = run("language ID", rows)
    assert same(now, plain) and 0 < len(plain) < len(rows)

    plain = []
    for r in now:
        w = brute.WORD.findall(r[1])
        found = defaultdict(list)
        for p in range(len(w) - 2):
            found[tuple(w[p : p + 3])].append(p)
        repeat = len({p + k for ps in found.values() if len(ps) > 1 for p in ps for k in range(3)})
        lines = [x for x in r[1].split("\n") if brute.WORD.search(x)]
        symbols = sum(r[1].count(c) for c in rules.SYMBOLS)
        chars = sum(map(len, w))
        if not (len(w) < 50 or 100 * repeat > 50 * len(w) or 2 * symbols > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * len(w) or chars > 25 * len(w)):
            plain.append(r)
    now = run("quality rules", now)
    assert same(now, plain) and plain

    idf = near_dedup.document_frequencies(table(now))
    of, h, w, _, _ = near_dedup.shingles(pa.array([r[1] for r in now]), idf)
    bags = [dict(zip(h[of == i].tolist(), w[of == i].tolist())) for i in range(len(now))]
    root = list(range(len(now)))
    for i in range(len(now)):
        for j in range(i):
            shared = sum(min(bags[i][x], bags[j][x]) for x in bags[i].keys() & bags[j].keys())
            if shared / (sum(bags[i].values()) + sum(bags[j].values()) - shared) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    groups = defaultdict(list)
    for i, x in enumerate(root):
        groups[x].append(now[i])
    least = sorted(min((r[0] is None, r[0] or 0) for r in g) for g in groups.values())
    before, now = now, run("MinHash near-dedup", now)
    assert sorted((r[0] is None, r[0] or 0) for r in now) == least and len(now) < len(before) and set(now) <= set(before)

    cleaned = run("suffix-array dedup", now)
    want = []
    for r, (gone_text) in zip(now, brute.kept_bytes([r[1] for r in now], corpus_pipeline.REPEAT_BYTES)):
        t = gone_text.decode(errors="ignore")
        want.append((*r[:1], t, *r[2:4], len(t)))
    assert same(cleaned, want) and any(len(a[1]) < len(b[1]) for a, b in zip(sorted(cleaned, key=repr), sorted(now, key=repr)))

    packed = stages["best-fit packing"](spark, table(cleaned), SF).collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.word_bpe())
    assert sum(r.length for r in packed) == sum(len(lib.encode(r[1], add_special_tokens=False).ids) + 1 for r in cleaned)
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Columns that stages use inside come back as they were, for repeated rows and null ids too."""
    import corpus_pipeline

    rows = pipeline_documents(spark)
    rows += rows[:3]
    extra = ["th", "_d", "_t", "_th", "_runs", "_row", "label", "n", "b", "bucket", "__kept_0"]
    wide = spark.createDataFrame([(*r, *(f"{c}:{r[0]}:{r[1]}" for c in extra)) for r in rows], PIPELINE + "".join(f", {c} string" for c in extra))
    plain = spark.createDataFrame(rows, PIPELINE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns, name
        kept = got.collect()
        texts = {(r[0], r[1]) for r in rows}
        for r in kept:
            for c in extra:
                i, _, t = r[c].partition(":")[2].partition(":")
                assert r[c].startswith(f"{c}:") and i == str(r.doc_id) and any(str(d) == i and str(x) == t for d, x in texts)
        want = [tuple(r) for r in stage(spark, plain, SF).collect()]
        assert sorted((tuple(r)[:5] for r in kept), key=repr) == sorted(want, key=repr), name


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], PIPELINE)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in packed.select("doc_id").collect()}
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()}
    copies = near_dedup.near_duplicates(docs).where("class_id <> doc_id").select("doc_id").collect()
    assert not kept & {r.doc_id for r in copies}


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    say = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [
        (1, say("a")), (None, say("a")), (None, say("b")), (1, say("c")), (2, say("c")), (2, say("d")), (5, say("e")), (5, say("e")), (5, say("e")),
        (None, say("f")), (None, say("f")), (7, None), (7, None), (8, say("g")), (8, say("g") + " h"),
    ]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, [t for _, t in rows], [i for i, _ in rows]), SF)
    got = sorted(((r.doc_id, (r.text or "-")[0]) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a"), (None, "b"), (1, "c"), (2, "d"), (5, "e"), (None, "f"), (7, "-"), (7, "-"), (8, "g")], key=str)
