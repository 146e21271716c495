"""A folder that all executors share, for tables between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a session of one machine gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts lineage, and later jobs see the same rows."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(df: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table at a path if it is there with the wanted columns, otherwise this one, written there.

    For feature and vector tables: give each model and input a path of its own.
    """
    spark = df.sparkSession
    wanted = columns or df.columns
    try:
        old = spark.read.parquet(path)
        if old.columns == wanted:
            return old
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    df.select(*wanted).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.select(*wanted).schema).parquet(path)
