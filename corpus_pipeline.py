"""A corpus pipeline of five stages over `documents`; each works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.llm import langid, near_dedup, packing, rules, suffix_dedup
from textweave.llm.apart import columns_apart
from textweave.llm.common import small_side, stored, sub_batches, texts_of
from textweave.llm.queries import word_bpe
from textweave.llm.windows import text_hash

#: A document goes if no language takes at least this share of its words.
LEAST_SHARE = 0.5
#: Bytes of a repeat that goes, and of its anchor: 50 words of three letters and a space on average.
REPEAT_BYTES, ANCHOR_BYTES = 200, 80
ORACLE_SQL = None


def kept_rows(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text a function keeps, in one pass without a shuffle; every row has its own verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, limit=langid.READ_BYTES):
                yield batch.filter(pa.array(judge(texts_of(batch))))

    return docs.mapInArrow(run, docs.schema)


@columns_apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of which no language holds LEAST_SHARE.

    Null and empty texts have no letter. Repeated rows and rows of null ids are judged row by row; no rows give none.
    """
    model = spark.sparkContext.broadcast(langid.train(docs.where(langid.learning_fold(docs.doc_id))))

    def judge(texts: pa.Array) -> np.ndarray:
        best, score, _ = langid.infer(model.value, texts)
        return (best >= 0) & (score >= LEAST_SHARE)

    return kept_rows(docs, judge)


@columns_apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a rule of the policy quality@1.

    Verdicts are those of (id, text), so repeated rows go or stay together and a null id is an id like others.
    """
    verdicts = rules.apply_policy(rules.ledger(docs.withColumn("_row", F.struct("doc_id", text_hash().alias("th"))), id_col="_row"))
    gone = stored(verdicts.where("NOT kept").select(F.col("doc_id.doc_id").alias("_d"), F.col("doc_id.th").alias("_t")).distinct(), "rejected")
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents but those of the given ids and text hashes; null ids meet null ids."""
    side = small_side(gone, gone.count())
    return docs.join(side, docs.doc_id.eqNullSafe(side["_d"]) & (text_hash() == side["_t"]), "left_anti").select(docs.columns)


@columns_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, that of the least id, then text hash; a null id counts as above all others."""
    classes = stored(near_dedup.row_classes(docs).where("label IS NOT NULL"), "classes")
    rows = classes.groupBy("label", "doc_id", "th").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("least")
    first = classes.groupBy("label").agg(least, F.count("*").alias("m")).where("m > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    rows = stored(rows.join(first, "label").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), stays.alias("stays"), "n"), "copies")
    gone = rows.where("NOT stays OR n > 1")
    repeated = rows.where("stays AND n > 1").select("_d", "_t")
    kept = without(docs, gone.select("_d", "_t"))
    many = repeated.count()
    if not many:
        return kept
    side = small_side(repeated, many)
    again = docs.withColumn("_th", text_hash())
    again = again.join(side, again.doc_id.eqNullSafe(side["_d"]) & (again["_th"] == side["_t"]), "left_semi").dropDuplicates(["doc_id", "_th"])
    return kept.unionByName(again.select(docs.columns))


@columns_apart
def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose runs of REPEAT_BYTES and more that also start elsewhere; n_chars follows. No document goes.

    A character that a cut leaves incomplete goes with it. Null texts stay null, repeated rows lose all of their text.
    """
    return suffix_dedup.cleaned(docs, REPEAT_BYTES, ANCHOR_BYTES)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; a null or empty text is the separator alone."""
    return packing.pack_documents(docs, word_bpe()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_repeats),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
