"""Tables that outlive a job: partitioned results, the shared folder, output of streams."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that all machines see: in spark.checkpoint.dir, or on one machine in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    root = root if ":" in root else f"file://{os.path.abspath(root)}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a shared folder, so that it is made once however often it is read."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(results: DataFrame, path: str, by: list[str], order: list[str | Column]) -> None:
    """Writes ``results`` into folders by the columns ``by``, files range-sorted by ``order``.

    Only the folders of values that ``results`` has are replaced; those of others stay as they are, and a job that runs
    twice leaves the same. A large folder gets several files, since the ranges go over ``by`` and ``order`` together.
    """
    sorted_ = results.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: DataFrame, where: Column | None = None) -> DataFrame:
    """What ``write_partitioned`` wrote, with the columns of ``schema``; folders that ``where`` rules out aren't read."""
    rows = spark.read.schema(schema.schema).parquet(path).select(schema.columns)
    return rows if where is None else rows.filter(where)


def stream_to_folder(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that is there and stops: each batch into a folder of its own, by its number.

    A batch that runs again, after a failure between its output and its commit, overwrites its own folder, so every row
    is there once; a restart with the same ``checkpoint`` takes up only what is new.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
