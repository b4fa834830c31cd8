"""Replacing the offers of messages batch by batch, so that a batch that is repeated changes nothing.

A batch is written to a folder of its own and counts once its number stands in the ledger, which is one rename. A batch that
failed in between is written again under its number; of a batch in the ledger nothing is written a second time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that count."""
    at, files = _files(spark, f"{path}/ledger")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()) if files.exists(at) else []


def write(path: str, message_id: str = "message_id"):
    """For foreachBatch: put the rows of a batch in the place of all earlier rows of their messages."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        entry, files = _files(spark, f"{path}/ledger/{number}")
        if files.exists(entry):
            return
        rows.withColumnRenamed(message_id, "message_id").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        made, _ = _files(spark, f"{path}/ledger/_{uuid.uuid4().hex}")
        files.mkdirs(made)
        if not files.rename(made, entry):
            raise OSError(f"batch {number} was written but not entered")

    return batch


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each message's rows of the last batch that has any."""
    known = batches(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/batch={n}" for n in known))
    last = rows.groupBy(c("message_id").alias("_id")).agg(F.max("batch").alias("_batch"))
    return rows.join(last, c("message_id").eqNullSafe(c("_id")) & (c("batch") == c("_batch")), "left_semi").drop("batch")
