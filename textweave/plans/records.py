"""Queries of sources, joins, text checks and vectors, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions import generated
from textweave.functions import text as tx
from textweave.functions.segments import all_sentences, block_sentences
from textweave.functions.vectors import rounded
from textweave.operators import audits, clusters, coherence, discourse, embedding, joins, scoring, serving
from textweave.operators.ordering import positions
from textweave.plans.tables import spread, table
from textweave.sources import arrays, files, journals
from textweave.sources.scratch import cached, scratch, stored

#: Answers of a language model in several shapes, built alike in both engines from `events`.
ANSWERS = {
    0: """concat('```json\\n{"journal_text": " a', event_id, ' "}\\n```')""",
    1: """concat('{"journal_text": "b', event_id, '", "overall_entropy": ', event_id % 10, '}')""",
    2: """concat('Here it is: {"journal_text": "c', event_id, '", "belief_integration": 4.7} thanks')""",
    3: """concat('{"journal_text": ', event_id, ', "model_complexity": "x"}')""",
    4: """concat('{"journal_text": "d', event_id)""",
    5: "''",
}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN {e}" for k, e in ANSWERS.items()) + " END"
    return table(spark, sf_dir, "events").select("event_id", F.expr(case).alias("raw"))


def unwrapped_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("event_id", generated.unwrapped_text(F.col("raw")).alias("journal_text"))


def label_answers(spark, sf_dir):
    fields = generated.label_fields(F.col("raw"))
    rows = answers(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in fields.items()])
    return rows.groupBy("bad", "belief_integration", "overall_entropy").agg(F.count("*").alias("n"), F.sum(F.coalesce("prediction_coherence", F.lit(0))).alias("coherence"))


def text_checks(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", t.alias("t")).withColumn("low", F.lower("t"))
    found = {"disallowed": generated.disallowed(F.col("t"), F.col("low")), "valid": generated.valid_entry(F.col("t"), F.col("low"))}
    return d.select("doc_id", tx.word_count(F.col("t")).cast("long").alias("n_words"), tx.em_dashes(F.col("t")).cast("long").alias("em_dashes"), *[c.alias(n) for n, c in found.items()])


def whole_segmentation(spark, sf_dir):
    """Sentences without blocks are those of the blocks: their number must be the same."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(all_sentences(F.col("text")), F.array().cast("array<string>")).alias("s"), F.coalesce(F.size(block_sentences(F.col("text"))), F.lit(0)).alias("b"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.greatest("b", F.lit(0)).alias("n_in_blocks"))


def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", "text", "lang"), path)
    back = files.typed(files.read_csv(spark, path), {"doc_id": "long"})
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def csv_bad_rows(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price")), path)
    return rounded(files.typed(files.read_csv(spark, path), {"o_orderkey": "long", "price": "double"}).agg(F.count("*").alias("n"), F.sum("price").alias("price")), 2)


def csv_union(spark, sf_dir):
    """Three tables with their text under other names; the third has it in the second known column for most rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = {
        "a": d.where("doc_id % 3 = 0").select(F.col("text").alias("journal")),
        "b": d.where("doc_id % 3 = 1").select(F.col("text").alias("content"), F.lit(1).alias("other")),
        "c": d.where("doc_id % 3 = 2").select(F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("text")).alias("journal"), F.col("text").alias("entry")),
    }
    u = files.union_texts(parts, {"a": "human", "b": "human", "c": "synthetic"})
    return u.groupBy("source_file", "source").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"), F.sum(F.length("journal")).alias("n_chars"))


def json_records(spark, sf_dir):
    """Journal records written as JSON lines, read back with their file, and capped beyond their number."""
    path = scratch(spark, "json")
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("journal_text")).write.json(path)
    rows = files.read_many_records(spark, [path], "doc_id long, journal_text string", 1_000_000_000)
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("journal_text")).alias("n_chars"), F.min(F.col("source_file").startswith("part-")).alias("named"))


def json_document(spark, sf_dir):
    path = scratch(spark, "report")
    summary = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))).alias("entries"))
    files.write_report(summary, path)
    return files.read_document(spark, path, "entries array<struct<o_orderstatus:string,n:long>>").select(F.inline("entries"))


def record_ids(spark, sf_dir):
    """Every third record has an id that is no number and gets its place."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise((F.col("o_orderkey") * 2).cast("string")).alias("rid"))
    return files.with_record_ids(r, "rid", "o_orderkey").select("o_orderkey", "id")


def checkpoint_last(spark, sf_dir):
    """An append-only log of JSON lines in which each user's last line counts and every fourth line is cut off."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("user_id").alias("key"), F.col("event_id").alias("v")))
    lines = e.select(F.col("event_id").alias("at"), F.when(F.col("event_id") % 4 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    return files.last_records(lines, "key", "key long, v long")


def resumed(spark, sf_dir):
    """What a run has left to do whose checkpoint holds the documents with labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return journals.pending(d, table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def feature_cache(spark, sf_dir):
    """A feature table that is computed once and read from its place the second time."""
    path = scratch(spark, "features")
    features = lambda: table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    cached(features(), path)
    return cached(features().withColumn("n", F.raise_error(F.lit("computed again")).cast("int")), path)


def quota_plan(spark, sf_dir):
    """As many entries as there are documents, dealt over the levels."""
    return files.quota_plan(spark, table(spark, sf_dir, "documents").count())


def few_shot_examples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10 + 1).cast("int").alias("level"))
    return files.few_shot_examples(d, "text", "level", "doc_id").select("kind", "level", F.md5(F.col("text").cast("binary")).alias("text"))


def _passes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("row_id"), F.col("o_custkey").alias("v"))
    return {"a": o, "b": o.where("row_id % 11 <> 0").withColumn("v", F.col("v") + 1), "c": o.where("row_id < 800").withColumn("v", F.col("v") * 2)}


def zipped_passes(spark, sf_dir):
    return joins.zip_rows(_passes(spark, sf_dir), "row_id", "v")


def lookup_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(25)).cast("int").alias("n_nationkey"))
    return joins.lookup(orders, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


def label_refresh(spark, sf_dir):
    """Metadata of rows joined once row numbers and labels are checked to be aligned."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    fresh = rows.select("o_orderkey", (F.col("o_totalprice") + 1e-11).alias("o_totalprice"))
    return rounded(joins.aligned(rows, fresh, "o_orderkey", "o_totalprice").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price")), 2)


def scores_with_default(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return joins.with_default(d, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id", {"score": 0.0})


def golden_texts(spark, sf_dir):
    targets = spark.createDataFrame([(n, p) for n, p, _, _ in audits.TARGETS], "target string, percentile int")
    texts = table(spark, sf_dir, "nation").select(F.get(F.array(*[F.lit(n) for n, *_ in audits.TARGETS[:-1]]), F.col("n_nationkey")).alias("target"), F.col("n_name").alias("text")).where("target IS NOT NULL")
    return joins.golden_texts(targets, texts)


def nearest_vectors(spark, sf_dir):
    """The three nearest of every vector of the table, with their ids."""
    return rounded(joins.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3).select("id", "rank", "other", "cosine"), 4)


def neighbour_smoothness(spark, sf_dir):
    return rounded(joins.neighbour_smoothness(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"), 4)


def random_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("s"))
    return joins.random_pairs(rows, "o_orderkey", "s", 1.5, 200)


def profile_vectors(spark, sf_dir):
    """Sentence vectors of a model-free encoder, as columns and through the Arrow frame of an injected one."""
    d = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    vectors = embedding.embed_sentences(d, "c_name", _profile_encoder, "v")
    both = vectors.withColumn("w", embedding.letter_profile(F.col("c_name")))
    return rounded(both.select("c_custkey", F.round(F.get("w", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("by_encoder")), 4)


def _profile_encoder():
    import numpy as np

    return lambda texts: np.array([[sum(t.lower().count(c) for c in g) for g in embedding.PROFILE] for t in texts], float)


def token_windows(spark, sf_dir):
    """Every whole text of `documents` as pooled vectors of windows of at most 512 tokens, by an encoder without weights."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    v = embedding.embed_windows(d, "text", embedding.word_encoder())
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return rounded(v.select("doc_id", "window", "n_tokens", at(0).alias("first"), at(7).alias("last")), 4)


def vector_cache(spark, sf_dir):
    """The vectors of `embeddings` through an .npy cache: computed, kept, and computed again as the element type changes."""
    e = F.col("embedding")
    d = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, F.isnull))
    width = d.agg(F.max(F.size(e))).first()[0] or 1
    d, path = d.where(F.size(e) == width), scratch(spark, "npy")
    out = None
    for step, kind in enumerate(("float32", "float32", "float64")):
        got, kept = arrays.cached_vectors(d, "vec_id", lambda r: r.select("vec_id", "embedding"), path, width, kind)
        part = stored(got.select(F.lit(step).alias("step"), F.lit(kept).alias("kept"), "id", F.size("embedding").alias("places"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total")), "npy")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


def text_sink(spark, sf_dir):
    """Texts of `documents` written as plain text in order of id; the paragraphs of the files in their order."""
    path = scratch(spark, "texts")
    journals.write_texts(journals.text_of(table(spark, sf_dir, "documents").select("doc_id", "text")), path, ["doc_id"])
    back = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    return positions(back, [], ["f", "b", "k"], "place").select("place", F.md5(F.col("value").cast("binary")).alias("text"), F.length("value").alias("n_chars"))


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to score: segmentation, vectors, the families of features in one row, 13 terms and band.

    Entries are the turns of conversations. One shuffle brings each text's sentences together by id. Sentences with their vectors
    and the arrays of each text are written once, as every family of features reads them.
    """
    d = spread(table(spark, sf_dir, "conversations")).where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    s = d.select("doc_id", F.posexplode(block_sentences(F.col("text"))).alias("sent_id", "s")).select("doc_id", "sent_id", "s.block_id", F.col("s.text").alias("sentence"))
    v = stored(s.withColumn("embedding", embedding.letter_profile(F.col("sentence"))), "sentences")
    arrays = v.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "sentence", "embedding"))).alias("a")).select("doc_id", F.col("a.sentence").alias("sentences"), F.col("a.embedding").alias("embeddings"))
    arrays = stored(arrays, "texts")
    row = d.select("doc_id")
    for part in (coherence.coherence(v), coherence.narrative(v), coherence.similarity_load(v), clusters.topic_clusters(v), discourse.wording(arrays), discourse.belief_conflicts(arrays), discourse.disorder(arrays)):
        row = row.join(part, "doc_id", "left")
    row = row.fillna(0.0)
    score = serving.linear_score(row.columns)
    return row.withColumns({"mes_score": score, "band": scoring.band(score)})


def text_to_score(spark, sf_dir):
    s = scored_texts(spark, sf_dir)
    return rounded(s.select("doc_id", "band", "mes_score", *[n for n, *_ in serving.LINEAR_TERMS]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        unwrapped_answers, label_answers, text_checks, whole_segmentation, csv_round_trip, csv_bad_rows, csv_union, json_records, json_document, record_ids, checkpoint_last, resumed, feature_cache, quota_plan,
        few_shot_examples, zipped_passes, lookup_join, label_refresh, scores_with_default, golden_texts, nearest_vectors, neighbour_smoothness, random_pairs, profile_vectors, token_windows, vector_cache, text_sink, text_to_score,
    )
}

_ANSWERS = "a AS (SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {k} THEN {e.replace(chr(92) + 'n', chr(39) + ', chr(10), ' + chr(39))}" for k, e in ANSWERS.items()) + " END AS raw FROM events)"
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
_FIELDS = generated.LABEL_FIELDS
_STRIP = f"^[{tx.WS}]+|[{tx.WS}]+$"


def random_pairs_sql(least: float, most: int, seed: int = 42) -> str:
    """Table `pairs` (high, low, confidence) of a table r (k, s): what joins.random_pairs() draws."""
    draw = lambda salt: f"CAST('0x' || substr(md5('{seed * 2 + salt}:' || id), 1, 12) AS BIGINT) % (SELECT count(*) FROM r)"
    return f"""places AS (SELECT k, s, row_number() OVER (ORDER BY k, s) - 1 AS place FROM r),
draws AS (SELECT id, {draw(0)} AS a, {draw(1)} AS b FROM (SELECT unnest(range({5 * most})) AS id)),
met AS (SELECT id, CASE WHEN x.s >= y.s THEN x.k ELSE y.k END AS high, CASE WHEN x.s >= y.s THEN y.k ELSE x.k END AS low, abs(x.s - y.s) AS c FROM draws JOIN places x ON x.place = a JOIN places y ON y.place = b WHERE a <> b AND abs(x.s - y.s) >= {least}),
pairs AS (SELECT high, low, max(c) AS confidence FROM met GROUP BY high, low ORDER BY min(id) LIMIT {most})"""


SQL: dict[str, str] = {
    "unwrapped_answers": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' || event_id WHEN 2 THEN 'c' || event_id ELSE '' END AS journal_text FROM events""",
    "label_answers": """WITH a AS (SELECT event_id, event_id % 6 AS k FROM events), f AS (SELECT k IN (2, 3, 4, 5) AS bad, CASE WHEN k IN (0, 1, 2, 3, 4, 5) THEN 5 END AS belief_integration, CASE WHEN k = 1 THEN event_id % 10 ELSE 5 END::INT AS overall_entropy FROM a)
SELECT bad, belief_integration, overall_entropy, count(*) AS n, (3 * count(*))::BIGINT AS coherence FROM f GROUP BY ALL""",
    "text_checks": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, '[^{tx.WS}]+'))::BIGINT AS n_words, (length(t) - length(replace(t, '—', '')))::BIGINT AS em_dashes,
  regexp_matches(t, '{generated.EMAIL}') OR regexp_matches(t, '{generated.PHONE}') OR regexp_matches(t, '{generated.ADDRESS}') OR {" OR ".join(f"contains(lower(t), '{w}')" if " " in w else f"regexp_matches(lower(t), '{generated.banned_word(w)}')" for w in generated.BANNED)} AS disallowed,
  length(t) BETWEEN 50 AND 3000 AND {" AND ".join("NOT contains(lower(t), '" + w.replace("'", "''") + "')" for w in generated.BANNED_PARTS)} AS valid FROM d""",
    "csv_round_trip": "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY lang",
    "csv_bad_rows": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderkey % 7 <> 0",
    "csv_union": f"""WITH d AS (SELECT doc_id % 3 AS k, nullif(regexp_replace(text, '{_STRIP}', '', 'g'), '') AS t FROM documents), c AS (SELECT k, count(*) AS n, sum(length(t)) AS n_chars FROM d WHERE t IS NOT NULL GROUP BY k)
SELECT ['a', 'b', 'c'][k + 1] AS source_file, ['human', 'human', 'synthetic'][k + 1] AS source, n, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS first, (sum(n) OVER (ORDER BY k) - 1)::BIGINT AS last, n_chars::BIGINT AS n_chars FROM c""",
    "json_records": "SELECT count(*) AS n, sum(length(text))::BIGINT AS n_chars, true AS named FROM documents WHERE text IS NOT NULL",
    "json_document": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "record_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN row_number() OVER (ORDER BY o_orderkey) ELSE o_orderkey * 2 END AS id FROM orders",
    "checkpoint_last": "SELECT user_id AS key, max(event_id) AS v FROM events WHERE event_id % 4 <> 0 AND user_id IS NOT NULL GROUP BY 1",
    "resumed": "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "feature_cache": "SELECT doc_id, length(text)::INT AS n FROM documents",
    "quota_plan": "SELECT level::INT AS level, CAST(t // 5 + (level - 6 < t % 5)::INT AS INTEGER) AS n FROM (SELECT count(*) AS t FROM documents), (SELECT unnest(range(6, 11)) AS level)",
    "few_shot_examples": f"""WITH d AS (SELECT doc_id, (doc_id % 10 + 1)::INT AS level, regexp_replace(text, '{_STRIP}', '', 'g') AS t FROM documents),
h AS (SELECT t, level, doc_id FROM d WHERE level >= 7 AND length(t) BETWEEN 150 AND 1600 QUALIFY row_number() OVER (PARTITION BY t ORDER BY level DESC, doc_id) = 1)
SELECT 'high' AS kind, level, md5(t) AS text FROM (SELECT * FROM h WHERE level >= 8 ORDER BY level DESC, doc_id LIMIT 3) UNION ALL SELECT 'high', level, md5(t) FROM (SELECT * FROM h WHERE level = 7 ORDER BY doc_id LIMIT 9)
UNION ALL SELECT 'low', level, md5(t) FROM (SELECT * FROM d WHERE level = 2 AND length(t) BETWEEN 200 AND 700 ORDER BY doc_id LIMIT 3)""",
    "zipped_passes": "SELECT o_orderkey - 1 AS row_id, o_custkey AS a, o_custkey + 1 AS b, o_custkey * 2 AS c FROM orders WHERE (o_orderkey - 1) % 11 <> 0 AND o_orderkey - 1 < 800",
    "lookup_join": "SELECT n_name, count(*) AS n FROM orders JOIN nation ON o_custkey % 25 = n_nationkey GROUP BY 1",
    "label_refresh": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1",
    "scores_with_default": "SELECT doc_id, coalesce(quality, 0)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)",
    "golden_texts": f"WITH t(target, percentile, k) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {p}, {k})' for k, (n, p, _, _) in enumerate(audits.TARGETS))}) SELECT target, percentile, n_name AS text FROM t LEFT JOIN nation ON n_nationkey = k AND k < 4",
    "nearest_vectors": f"""WITH e AS (SELECT vec_id AS id, {_UNIT} AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v), 9) AS cosine FROM u a JOIN u b ON a.id <> b.id) SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY p.cosine DESC, other)::INT AS rank, round(cosine, 4) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY p.cosine DESC, other) <= 3""",
    "neighbour_smoothness": f"""WITH e AS (SELECT vec_id AS id, label AS y, {_UNIT} AS v FROM embeddings), u AS (SELECT id, y, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT a.id, abs(a.y - b.y) AS gap FROM u a JOIN u b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) <= 5)
SELECT (SELECT count(*) FROM e) AS n, 5 AS k, round(avg(gap), 4) AS mean_gap, round(median(gap), 4) AS median_gap FROM p""",
    "random_pairs": f"WITH r AS (SELECT o_orderkey AS k, (o_custkey % 10)::DOUBLE AS s FROM orders), {random_pairs_sql(1.5, 200)} SELECT high, low, confidence FROM pairs",
    "profile_vectors": f"""WITH c AS (SELECT c_custkey, [{", ".join(f"(length(c_name) - length(regexp_replace(lower(c_name), '[{g}]', '', 'g')))::DOUBLE" for g in embedding.PROFILE)}] AS c FROM customer)
SELECT c_custkey, round(c[1] / sqrt(list_dot_product(c, c)), 4) AS first, round(c[1] / sqrt(list_dot_product(c, c)), 4) AS by_encoder FROM c""",
    "token_windows": r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, list_transform(w, lambda x: length(x) * 1000 + ord(x)) AS ids FROM d),
p AS (SELECT doc_id, b, list_slice(ids, b * 512 + 1, b * 512 + 512) AS ids FROM (SELECT doc_id, ids, unnest(range(0, greatest(1, (coalesce(len(ids), 0) + 511) // 512))) AS b FROM e)),
v AS (SELECT doc_id, CASE WHEN ids IS NULL THEN NULL ELSE b END AS w, len(ids) AS n, list_transform(range(0, 8), lambda k: list_avg(list_transform(ids, lambda i: i * (2 * k + 3) % 97 / 97.0::DOUBLE))) AS v FROM p)
SELECT doc_id, w::INT AS window, n::INT AS n_tokens, round((v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12))::FLOAT::DOUBLE, 4) AS first, round((v[8] / greatest(sqrt(list_dot_product(v, v)), 1e-12))::FLOAT::DOUBLE, 4) AS last FROM v""",
    "vector_cache": """WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
u AS (SELECT * FROM e WHERE len(v) = (SELECT max(len(v)) FROM e)) SELECT step, step = 1 AS kept, id, len(v)::INT AS places, round(coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE)), 0), 4) AS total FROM u, (SELECT unnest([0, 1, 2])::INT AS step)""",
    "text_sink": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS p FROM d), u AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM p)
SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS place, md5(t) AS text, length(t)::INT AS n_chars FROM u""",
}
