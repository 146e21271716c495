"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.llm import bpe, common, data_sql, divergence, langid, mixing, near_dedup, packing, point_in_time, rules, substring_dedup, suffix_dedup, token_files, topk, url_sql, urls


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: <|endoftext|> of word_bpe_49k.json.
END_OF_TEXT = 49407


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once; verdicts of two versions of a policy and the ablations are read from its bits."""
    entries = common.stored(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    found = rules.judged(entries, {"kept": "quality@1", "kept_by_next": "quality@2", "_base": "base@1"})
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "fail_bits", "kept_by_next", "deciding_rule", "n_deciding")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.learning_fold(docs.doc_id)))
    found = langid.identify(docs, model)
    return found.select("doc_id", (~langid.learning_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "n_languages")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_document_tokens(table(spark, sf_dir, "documents"), word_bpe(), END_OF_TEXT).select("doc_id", "n_tokens")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), word_bpe())
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times come from the id's hash; a label's source is that of its document, the least one where an id repeats."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = lambda k: F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1 + 8 * k, 8), 16, 10).cast("long")
    event = F.pmod(part(0), F.lit(50_000))
    versions = docs.where("doc_id IS NOT NULL").select("source", "doc_id", "n_chars", "lang", event.alias("event"), (event - 60 + F.pmod(part(1), F.lit(600))).alias("arrival"), (event + F.pmod(part(2), F.lit(900))).alias("expiry"))
    sources = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"))
    asks = labels.select("doc_id", F.pmod(part(3), F.lit(50_000)).alias("t")).join(sources.hint("merge"), "doc_id", "left")
    found = point_in_time.as_of(asks, versions, "source", "t", "event", "arrival", "expiry", "doc_id", ["n_chars", "lang"])
    age = F.col("t") - F.col("found.event")
    fresh = age <= 120
    status = F.when(age.isNull(), "none").when(fresh, "fresh").otherwise("stale")
    return found.select("doc_id", "t", F.col("found.tie").alias("version_id"), age.alias("age"), status.alias("status"), *[F.when(fresh, F.col(f"found.payload.{c}")).alias(c) for c in ("n_chars", "lang")])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_near_dedup, op3_url_filter, op4_quality_rules, op5_packing, op6_suffix_dedup, op7_language_id, op8_token_counts, op9_substring_dedup, op10_bpe, op11_source_mix, op12_point_in_time, op13_source_divergence)
}

SQL: dict[str, str] = {
    "op11_source_mix": data_sql.mix_sql(),
    "op12_point_in_time": data_sql.point_in_time_sql(),
    "op13_source_divergence": data_sql.divergence_sql(),
    "op3_url_filter": url_sql.url_filter_sql(),
    "op1_topk": """
WITH every AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT * FROM every WHERE len(v) = (SELECT len(v) FROM every GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op4_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines, text FROM d),
tri AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
full_lines AS (SELECT r, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
m AS (
  SELECT r, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(full_lines.lines) - len(list_distinct(full_lines.lines)) AS BIGINT) AS n_dup_lines, len(full_lines.lines) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN full_lines USING (r) LEFT JOIN rep USING (r)
), j AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (2 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT AS BIGINT) AS fail_bits FROM m
), x(bit, deciding_rule) AS (VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'symbols'), (8, 'repeated_lines'), (16, 'short_words'), (32, 'long_words')),
a AS (SELECT bit, deciding_rule, count(*) AS n_deciding FROM j JOIN x ON fail_bits = bit GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, fail_bits & 15 = 0 AS kept_by_next, deciding_rule, n_deciding
FROM d JOIN j USING (r) LEFT JOIN a ON bit = fail_bits
""",
}
