"""Helpers shared by the training-data operators: shared folders, files, Arrow mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch that goes to a Python worker: texts can be long, so a batch stays small.
ARROW_ROWS = 1000
#: Bytes from which on no more rows are added to a batch. Spark's own batches end at
#: spark.sql.execution.arrow.maxBytesPerBatch, so long texts are never gathered beyond the larger of the two.
ARROW_BYTES = 16 << 20

#: What separates words in every word count here: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or on one machine a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a folder of its own in the shared root; Spark or a task creates it when it writes."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared root and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``row``, a struct<file, index> that no other row has and that stays the same, and ``document``, the row.

    Rows of a scan of files have their place in the file. Where that isn't known or isn't different for each
    row (in a join over a scan, say), rows are first stored with numbers.
    """
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")).alias("row")
    try:
        placed = docs.select(place, document)
        if placed.groupBy("row").count().filter("count > 1").isEmpty():
            return placed
    except AnalysisException:  # no scan of files
        pass
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("index")).alias("row")
    return stored(docs.select(number, document), "rows")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``place`` within the tree, by ``order``, and ``nodes``, the tree's rows.

    Rows are range-sorted and stored; prefix sums over the parts, one row for each tree and part, give the places.
    """
    keys = ["tree", *order]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    kept = stored(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    runs = kept.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("tree")).alias("nodes"))
    return kept.join(runs, ["tree", "part"]).withColumn("place", F.col("base") + F.col("at") - F.col("first")).drop("part", "at", "first", "base")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI and the path in it; usable in tasks."""
    if uri.startswith("file:") or "://" not in uri:
        path = unquote(urlparse(uri).path) if uri.startswith("file:") else uri
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: Iterator[bytes] | list[bytes], attempt: str) -> int:
    """Writes a file under a name of this attempt, then renames it: a task that runs twice leaves one whole file."""
    system, path = file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    size, tmp = 0, f"{os.path.dirname(path)}/_{attempt}-{os.path.basename(path)}"
    with system.open_output_stream(tmp, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(tmp, path)
    return size


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` whose batches have about ``rows`` rows, whatever the session's batch size: batches of Spark are cut,
    and joined as long as they stay within ``rows`` and ARROW_BYTES."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                if held and (n + piece.num_rows > rows or size + piece.nbytes > ARROW_BYTES):
                    yield whole(held)
                    held, n, size = [], 0, 0
                held.append(piece)
                n, size = n + piece.num_rows, size + piece.nbytes
        if held:
            yield whole(held)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(task, schema)


def map_arrow(df: DataFrame, step: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """Each Arrow batch as a dict of lists through ``step``, which returns the columns of ``schema``."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = step({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return map_batches(df, run, schema, rows)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))
