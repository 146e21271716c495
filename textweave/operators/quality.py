"""Checks of generated entries: repeated openings, markup residue, loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions import text as t
from textweave.operators.ordering import spread_join


#: Phrases that a generator overuses.
OVERUSED = ("i keep", "the hum of", "just closed my laptop", "i'm sitting", "sitting in")


def openings(docs: DataFrame, limit: int = 4) -> DataFrame:
    """(doc_id, opening, n, flagged): openings of five words used more than `limit` times are flagged, null ones not.

    Counts are pre-aggregated per opening; very common ones, the empty one above all, meet their rows by a broadcast.
    """
    rows = docs.select("doc_id", t.opening(F.col("text")).alias("opening"))
    counts = rows.groupBy("opening").agg(F.count("*").alias("n"))
    return spread_join(rows, counts, "opening", "n").withColumn("flagged", F.coalesce((F.col("n") > limit) & (F.col("opening") != ""), F.lit(False)))


def top_openings(docs: DataFrame, k: int = 10) -> DataFrame:
    """(opening, n): the most common openings, ties to the one of the smaller id first. A bounded top-k."""
    rows = docs.select("doc_id", F.coalesce(t.opening(F.col("text")), F.lit("")).alias("opening"))
    return rows.groupBy("opening").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first").limit(k).select("opening", "n")


def occurrences(text: Column, phrase: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase)))) / len(phrase)).cast("int")


def checked(docs: DataFrame, most: int = 4, ratio: float = 0.75) -> DataFrame:
    """(doc_id, n, flagged, kept): an opening used more than `most` times, or an overused phrase that more than a share
    `ratio` of the rows holds and this row twice. Rows without an id are never flagged and never kept.
    """
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    shares = rows.agg(F.count("*").alias("n"), *[F.count_if(F.contains("text", F.lit(p))).alias(f"p{k}") for k, p in enumerate(OVERUSED)]).first()
    often = [p for k, p in enumerate(OVERUSED) if shares.n and shares[f"p{k}"] / shares.n > ratio]
    worn = F.lit(False)
    for p in often:
        worn = worn | (occurrences(F.col("text"), p) >= 2)
    marked = rows.select("doc_id", t.opening(F.col("text")).alias("opening"), worn.alias("worn"))
    counted = spread_join(marked, marked.groupBy("opening").agg(F.count("*").alias("n")), "opening", "n")
    flagged = F.col("doc_id").isNotNull() & ((F.col("n") > most) | F.col("worn"))
    return counted.select("doc_id", "n", flagged.alias("flagged"), (F.col("doc_id").isNotNull() & ~flagged).alias("kept"))


def check_summary(docs: DataFrame, most: int = 4, ratio: float = 0.75) -> DataFrame:
    """One row: rows in all, kept and not, and how many hold each overused phrase."""
    phrases = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("text")).agg(*[F.count_if(F.contains("text", F.lit(p))).alias(f"phrase_{k}") for k, p in enumerate(OVERUSED)]).first()
    counts = checked(docs, most, ratio).agg(F.count("*").alias("total_rows"), F.count_if("kept").alias("kept_rows"), F.count_if(~F.col("kept")).alias("flagged_rows"))
    return counts.select("*", *[F.lit(n).cast("long").alias(c) for c, n in phrases.asDict().items()])


def markers(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, loop_rate, corrupted, n_tokens, n_paragraphs, bullets) of each text."""
    s = t.sentences(t.normalize_text(F.col("text")))
    loops = F.size(F.filter(F.transform("s", t.letter_tokens), t.looping))
    return docs.select("doc_id", "text", s.alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.try_divide(loops, F.size("s")), F.lit(0.0)).alias("loop_rate"), t.corrupted(F.col("text")).alias("corrupted"),
        F.size(t.word_tokens(F.col("text"))).alias("n_tokens"), t.paragraphs(F.col("text")).alias("n_paragraphs"), t.has_bullets(F.col("text")).alias("bullets"),
    )
