"""Source mix, point-in-time join and divergence audit: against their SQL on odd tables, and against plain Python."""

import bisect
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textweave.llm import divergence, mixing, point_in_time, queries

NAMES = ["op11_source_mix", "op12_point_in_time", "op13_source_divergence"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, place long, target double, k string, t long, event string, gid long, n string, th string, term string"


def odd_documents(n, seed=3):
    """Rows with nulls in every column, repeated rows and ids, empty, blank and long texts, one source of a third of all."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Ca", "dé", "ÄÖ", "日本", "x1", "e_f", "g-h") for b in ("", "r", "ss", "t")]
    out = []
    for i in range(n):
        text = rng.choice([None, "", " \t\n", " ".join(rng.choices(words, k=rng.randrange(1, 60))), "Same words here again", "a\x0bb c　d"] + [" ".join(rng.choices(words, k=40))] * 4)
        out.append((rng.choice([i, i, i, None, i // 7]), text, rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot", "hot", "hot", "b", "Á", None, "", "z"]), rng.choice([i, None])))
    out += out[:9] + [(n, "word " * 20_000, "en", "b", 5)]
    return [(*r, 1, 2.0, "k", 3, "event", 4, "n", "th", "term") for r in out]


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string, t string, event long, k int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


def cells(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module", params=["odd", "empty", "one"])
def world(spark, tmp_path_factory, request):
    n = {"odd": 400, "empty": 0, "one": 0}[request.param]
    rows = {"odd": odd_documents(n), "empty": [], "one": [(None, None, None, None, None, 1, 2.0, "k", 3, "event", 4, "n", "th", "term")]}[request.param]
    labels = [(i if i % 11 else None, 1, 0, "x", "t", 5, 6) for i in range(0, n + 20, 2)] * 2 if request.param == "odd" else [(1, 1, 0, "x", "t", 5, 6)] * (request.param == "one")
    folder = str(tmp_path_factory.mktemp(request.param))
    return folder, tables(spark, folder, rows, labels)


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables_give_the_rows_of_the_sql(spark, world, name):
    folder, con = world
    df = queries.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    ours = [tuple(r[c] for c in names) for r in df.collect()]
    theirs = con.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall()
    assert cells(ours) == cells(theirs)


def plain_targets(sizes):
    """Water filling by rounds: whoever is above its limit stops there, and the rest is dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in order if s not in fixed]
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if part[s] > 2 * sizes[s]]
        if not above:
            return fixed | part
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_mix_reaches_its_targets_in_many_shards(spark):
    docs = spark.createDataFrame(odd_documents(900, 8), COLUMNS)
    got = mixing.mix(docs, shard_words=2_000, shard_docs=50).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken, shards = plain_targets(sizes), Counter(), defaultdict(set)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        shards[r.source].add(r.shard)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK * (len(shards[s]) + 1)
    assert len(shards["hot"]) > 5
    again = mixing.mix(docs.repartition(7), shard_words=2_000, shard_docs=50).collect()
    assert cells(map(tuple, again)) == cells(map(tuple, got))


def plain_apportion(votes, seats):
    won = Counter()
    for _ in range(seats):
        best = max(sorted(votes), key=lambda p: (votes[p] / (2 * won[p] + 1)))
        won[best] += 1
    return won


def test_apportionment_awards_seat_by_seat(spark):
    rng = random.Random(1)
    groups = {"a": ({i: rng.randrange(0, 500) for i in range(40)}, 300), "b": ({i: 7 for i in range(9)}, 5), "c": ({1: 10_000, 2: 1}, 77), "d": ({1: 0}, 3), "e": ({i: i for i in range(30)}, 4)}
    rows = [(g, p, v, s) for g, (votes, s) in groups.items() for p, v in votes.items()]
    got = mixing.apportion(spark.createDataFrame(rows, "g string, p long, v long, s long"), "g", "p", "v", "s").collect()
    for g, (votes, seats) in groups.items():
        want = plain_apportion({p: v for p, v in votes.items() if v}, seats if any(votes.values()) else 0)
        assert {r.p: r.quota for r in got if r.g == g} == {p: want[p] for p in votes}


def plain_best(versions, key, t):
    usable = [v for v in versions if key is not None and v[0] == key and v[1] is not None and v[1] <= t and v[2] <= t < v[3]]
    return max(((v[1], v[2], v[4]) for v in usable), default=None)


@pytest.mark.parametrize("bits", [0, 3, 40])
def test_as_of_joins_like_a_plain_search(spark, bits):
    """Short, long and endless versions, negative times, ties, repeated asks, nulls."""
    rng = random.Random(bits)
    versions = []
    for i in range(300):
        event = rng.randrange(-200, 800)
        versions.append((rng.choice(["hot", "hot", "b", None]), rng.choice([event] * 9 + [None]), event + rng.randrange(-20, 40), event + rng.choice([0, 5, 30, 400, 100_000]), i, rng.choice([None, i])))
    versions += versions[:20]
    asks = [(rng.choice(["hot", "b", "none", None]), rng.choice([rng.randrange(-250, 1500)] * 9 + [None]), i % 50) for i in range(300)] * 2
    v = spark.createDataFrame(versions, "key string, event long, arrival long, expiry long, tie long, extra long")
    a = spark.createDataFrame(asks, "key string, t long, event int")
    got = point_in_time.as_of(a, v, "key", "t", "event", "arrival", "expiry", "tie", ["extra"], bits).collect()
    assert len(got) == len(asks)
    for r in got:
        want = plain_best(versions, r.key, r.t) if r.t is not None else None
        assert (None if r.found is None or r.found.event is None else (r.found.event, r.found.arrival, r.found.tie)) == want


def test_as_of_without_versions_or_asks(spark):
    v = spark.createDataFrame([("a", 1, 1, 9, 1, 2)], "key string, event long, arrival long, expiry long, tie long, extra long")
    a = spark.createDataFrame([("a", 5), ("b", 5)], "key string, t long")
    use = lambda a, v: point_in_time.as_of(a, v, "key", "t", "event", "arrival", "expiry", "tie", ["extra"]).collect()
    assert use(a.where("false"), v) == [] and [r.found for r in use(a, v.where("false"))] == [None, None]
    assert sorted(((r.key, r.found and r.found.payload.extra) for r in use(a, v))) == [("a", 2), ("b", None)]


def test_staircase_keeps_only_what_can_still_win():
    rng = random.Random(4)
    stairs, every = point_in_time.Staircase(), []
    for t in range(600):
        for _ in range(rng.randrange(3)):
            v = ((rng.randrange(t - 50, t + 1), rng.randrange(5), len(every)), t + rng.randrange(1, 80))
            every.append(v)
            stairs.add(*v, None)
        alive = [p for p, e in every if e > t]
        found = stairs.best(t)
        assert (found and found[0]) == max(alive, default=None)
        assert stairs.priority == sorted(stairs.priority) and stairs.expiry == sorted(stairs.expiry, reverse=True)
        assert len(set(stairs.expiry)) == len(stairs.expiry)
    assert bisect.bisect(stairs.priority, (10**9,)) == len(stairs.priority)


def test_dyadic_nodes_cover_blocks_once(spark):
    rows = spark.range(60).select((F.col("id") - 20).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("m"))
    got = rows.select("a", (F.col("a") + F.col("m")).alias("b"), point_in_time.nodes(F.col("a"), F.col("a") + F.col("m"), 6).alias("n")).collect()
    for r in got:
        assert sorted(x for n in r.n for x in range(n.node << n.level, (n.node + 1) << n.level)) == list(range(r.a, r.b + 1))


def plain_audit(docs, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = share(counts[lang, source])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = sorted((-sum(f(p[t], x[t]) for t in kept), s.encode()) for s in own if s != source for x in [share(counts[lang, s])])
        q = share(sum((counts[lang, s] for s in own), Counter()))
        terms = sorted((-f(p[t], q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return out


@pytest.mark.parametrize("light", [0, 3, 100])
def test_audit_splits_heavy_and_light_terms(spark, monkeypatch, light):
    """All terms in tiles, some, none; small tiles and blocks of groups so that there are several of each."""
    monkeypatch.setattr(divergence, "TILE", 5)
    rng = random.Random(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(" ".join(rng.choices(words[: rng.randrange(5, 60)], k=30)), rng.choice(["en", "fr", None]), rng.choice([f"s{i}" for i in range(9)] + [None])) for _ in range(300)]
    docs += [(None, "en", "silent"), ("!!", "xx", "alone"), ("1 2", "xx", "other")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    got = [tuple(r) for r in divergence.audit(df, least=4, light=light).collect()]
    assert sorted(got) == sorted(plain_audit(docs, 4, 10))


def test_tiles_of_several_blocks_of_groups(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(divergence, "BLOCK", 3)
    rng = np.random.default_rng(1)
    base, dense = rng.integers(1, 50, 8), rng.integers(1, 10**9, (8, 4))
    found = {}
    for ga in range(3):
        for gb in range(ga, 3):
            rows = [i for i in range(8) if i // 3 in (ga, gb)]
            tile = pa.table({"lang": ["x"] * len(rows), "ga": [ga] * len(rows), "gb": [gb] * len(rows), "gid": rows, "base": base[rows], "width": pa.array([4] * len(rows), pa.int32()), "at": pa.array([[0, 2]] * len(rows), pa.list_(pa.int32())), "p": pa.array([dense[i, [0, 2]].tolist() for i in rows], pa.list_(pa.int64()))})
            for r in divergence.compare_tile(tile).to_pylist():
                assert (r["a"], r["b"]) not in found
                found[r["a"], r["b"]] = r["value"]
    full = dense.copy()
    full[:, [1, 3]] = base[:, None]
    assert found == {(a, b): sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(full[a], full[b])) for a in range(8) for b in range(a + 1, 8)}


def test_frequencies_are_exact_for_counts_beyond_doubles(spark):
    n, total, kept = 987_654_321_987_654, 1_234_567_891_234_567, 1_000_003
    got = spark.range(1).select(divergence.frequency(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
