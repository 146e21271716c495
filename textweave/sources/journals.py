"""Readers and writers of journal records as JSON lines and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ["journal", "journal_text", "full_text", "text", "entry", "content"]


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, skip_invalid: bool = False) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, bad ones raise or, on request, are dropped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    mode = "PERMISSIVE" if skip_invalid else "FAILFAST"
    parsed = lines.select("value", F.from_json("value", schema, {"mode": mode}).alias("r"))
    if skip_invalid:
        parsed = parsed.where(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"))
    return parsed.select("r.*")


def text_of(records: DataFrame, strip: bool = True) -> DataFrame:
    """The first of the known text columns that is there and not null; rows without one are left out."""
    there = [F.col(c).cast("string") for c in TEXT_COLUMNS if c in records.columns]
    if not there:
        raise ValueError(f"none of {TEXT_COLUMNS} in {records.columns}")
    text = F.coalesce(*there)
    return records.withColumn("journal_text", F.regexp_replace(text, r"^\s+|\s+$", "") if strip else text).where("journal_text IS NOT NULL")


def write_records(texts: DataFrame, path: str) -> None:
    """One {"journal_text": ...} a line, characters unescaped."""
    texts.select("journal_text").write.mode("errorifexists").json(path)


def write_texts(texts: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """Entries as plain text, a blank line between two; with an order that ends in a unique key, files and entries stand in it.

    Ranges of the order are written by a task each: the files, by name, are the whole in order.
    """
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order) if order else texts
    dealt.select("journal_text").write.mode("errorifexists").option("lineSep", "\n\n").text(path)


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in an append-only result: what a resumed run has left to do."""
    return source.join(done.select(key).distinct(), key, "left_anti")
