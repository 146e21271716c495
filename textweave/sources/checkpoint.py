"""An append-only checkpoint of JSON records that survives a failure at any point.

A batch is written as JSON lines in a folder of its own and then named in a second folder. Only named batches are read: a
batch whose writing stopped half-way, or that was written and not named, is as if it had never been there, and writing it
again replaces what is left of it. The batch id makes an append idempotent, as foreachBatch() of a stream needs it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """The records of a batch, in place of what an earlier try left; not yet part of the checkpoint."""
    rows.write.mode("overwrite").json(f"{path}/data/batch={int(batch_id)}")


def name_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Makes a written batch part of the checkpoint."""
    spark.range(1).select(F.lit(str(int(batch_id))).alias("value")).write.mode("overwrite").text(f"{path}/named/batch={int(batch_id)}")


def named_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the checkpoint; none if nothing was appended yet."""
    try:
        return spark.read.text(f"{path}/named").select(F.col("value").cast("long").alias("batch")).where("batch IS NOT NULL").distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "batch long")


def append_batch(rows: DataFrame, path: str, batch_id: int) -> bool:
    """Appends a batch; one that is there already is left alone. Says whether it was appended now."""
    spark = rows.sparkSession
    if named_batches(spark, path).where(F.col("batch") == int(batch_id)).limit(1).count():
        return False
    write_batch(rows, path, batch_id)
    name_batch(spark, path, batch_id)
    return True


def appender(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch()."""
    return lambda rows, batch_id: append_batch(rows, path, batch_id) and None


def read_checkpoint(spark: SparkSession, path: str, key: str, schema: T.StructType | str) -> DataFrame:
    """One row a key of the named batches: that of the last batch, and of its last line. Torn lines and lines without the key
    are left out; without an append there are no rows."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    named = named_batches(spark, path)
    if not named.limit(1).count():
        return spark.createDataFrame([], fields)
    lines = spark.read.option("basePath", f"{path}/data").text(f"{path}/data").select(F.col("batch").cast("long").alias("batch"), "value", F.monotonically_increasing_id().alias("_at"))
    lines = lines.join(named, "batch", "left_semi").where(F.try_parse_json("value").isNotNull())
    parsed = lines.select("batch", "_at", F.from_json("value", fields).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max(F.struct("batch", "_at", "r"))["r"].alias("r")).select("r.*")


def pending_rows(source: DataFrame, path: str, key: str) -> DataFrame:
    """The rows whose key is not in the checkpoint yet: what a resumed run has left to do."""
    kind = source.schema[key].dataType
    done = read_checkpoint(source.sparkSession, path, key, T.StructType([T.StructField(key, kind)]))
    return source.join(done, key, "left_anti")
