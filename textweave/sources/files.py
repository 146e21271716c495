"""CSV and JSON sources and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.functions.text import strip
from textweave.sources.journals import TEXT_COLUMNS


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header and quoted line breaks; every column is a string unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in as many files as there are partitions."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)


def typed(rows: DataFrame, kinds: dict[str, str], drop_bad: bool = True) -> DataFrame:
    """Columns cast to their types. A row that does not fit is dropped, or raises with drop_bad=False."""
    if not drop_bad:
        return rows.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    cast = rows.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})
    return cast.dropna(subset=list(kinds))


def probed_text(columns: list[str]) -> Column:
    """The first known text column that is not blank; null if there is none."""
    there = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in TEXT_COLUMNS if c in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def union_texts(parts: dict[str, DataFrame], source: dict[str, str] | None = None) -> DataFrame:
    """(source_file, source, journal, row): tables of unlike columns as one, blank texts left out, rows in order of name.

    row is dense from 0 within the whole, by file and position: positions are numbered in slices of a partition's id, and
    the offsets of slices are summed, so there is no task of all rows.
    """
    picked = [
        df.select(F.lit(name).alias("source_file"), F.lit((source or {}).get(name, name)).alias("source"), probed_text(df.columns).alias("journal"), F.monotonically_increasing_id().alias("_at"))
        for name, df in sorted(parts.items())
    ]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), picked).where("journal IS NOT NULL")
    rows = rows.withColumn("_slice", F.shiftright("_at", 33))
    inside = F.row_number().over(Window.partitionBy("source_file", "_slice").orderBy("_at"))
    counts = rows.groupBy("source_file", "_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("source_file", "_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each input split
    starts = counts.select("source_file", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.withColumn("_k", inside).join(starts, ["source_file", "_slice"]).select("source_file", "source", "journal", (F.col("_start") + F.col("_k") - 1).alias("row"))


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file, under a given schema; bad JSON raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file, characters unescaped."""
    report.coalesce(1).write.json(path)


def read_many_records(spark: SparkSession, paths: list[str], schema: T.StructType | str, most: int | None = None) -> DataFrame:
    """JSON objects of many files with source_file and source_path; lines of another kind are left out. `most` stops there.

    Records are numbered within their input split and the records of splits are summed, so no task reads what others parsed.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))
    objects = lines.where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
    parsed = objects.select("source_file", "source_path", F.from_json("value", schema).alias("r")).select("source_file", "source_path", "r.*")
    if most is None:
        return parsed
    counts = objects.groupBy(F.spark_partition_id().alias("_slice")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each input split
    starts = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = parsed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_slice", F.shiftright("_at", 33).cast("int"))
    capped = numbered.join(F.broadcast(starts), "_slice").where(F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) < most)
    return capped.select(parsed.columns)


def with_record_ids(records: DataFrame, id_col: str, order: str) -> DataFrame:
    """Adds `id`: the record's own if it is a whole number, else its place in the order from 1."""
    from textweave.operators.ordering import positions

    placed = positions(records, [], [order], "_place", records.count())
    return placed.withColumn("id", F.coalesce(F.col(id_col).try_cast("long"), F.col("_place") + 1)).drop("_place")


def last_records(lines: DataFrame, key: str, schema: T.StructType | str, order: str = "at") -> DataFrame:
    """An append-only checkpoint of JSON lines (value, order) as one row a key: the last wins, corrupt lines are skipped."""
    parsed = lines.where(F.try_parse_json("value").isNotNull()).select(order, F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", order).alias("r")).select("r.*")


def quota_plan(spark: SparkSession, total: int, levels: range = range(6, 11)) -> DataFrame:
    """(level, n): a total dealt over levels, the rest to the lowest."""
    share, rest = divmod(total, len(levels))
    return spark.createDataFrame([(level, share + (1 if k < rest else 0)) for k, level in enumerate(levels)], "level int, n int")


def few_shot_examples(rows: DataFrame, text: str, level: str, order: str) -> DataFrame:
    """(kind, level, text): up to three distinct texts of level 8 and more and nine of 7, of 150 to 1,600 characters, twelve
    in all; and the first three of level 2 and 200 to 700 characters."""
    t = strip(F.col(text))
    base = rows.select(t.alias("text"), F.col(level).alias("level"), F.col(order).alias("_o")).withColumn("_n", F.length("text"))
    high = base.where((F.col("level") >= 7) & F.col("_n").between(150, 1600))
    # Of equal texts the one of the highest level, then the first.
    high = high.groupBy("text").agg(F.min(F.struct((-F.col("level")).alias("l"), "_o")).alias("m")).select("text", (-F.col("m.l")).alias("level"), "m._o")
    pick = lambda df, k: df.orderBy(F.desc("level"), "_o").limit(k)
    top = pick(high.where("level >= 8"), 3).unionByName(pick(high.where("level = 7"), 9)).withColumn("kind", F.lit("high"))
    low = pick(base.where((F.col("level") == 2) & F.col("_n").between(200, 700)), 3).withColumn("kind", F.lit("low"))
    return top.unionByName(low.select(top.columns)).select("kind", "level", "text")
