"""Streams over a table's files, run until all that is there has been read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path


def read_stream(spark: SparkSession, sf_dir: str, table: str, time: str | None = None, files: int | None = None, size: str | None = None) -> DataFrame:
    """A table as a stream of its files. The time column becomes a timestamp, as watermarks need. files, size: most of them in a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if size:
        reader = reader.option("maxBytesPerTrigger", size)
    rows = reader.parquet(f"{sf_dir}/{table}.parquet") if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return rows.withColumn(time, F.col(time).cast("timestamp")) if time else rows


def drain(rows: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", progress: str | None = None) -> None:
    """Run a stream over all that is there, handing each micro-batch to `each`; progress is kept in a checkpoint (a new one if none is named)."""
    spark = rows.sparkSession
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", progress or shared_path(spark, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def collected(rows: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """What a stream puts out: all batches in append mode, the last one in complete mode. A batch that runs again replaces its own files.

    A place is a folder that a later run of the same stream goes on from. Update mode is refused: keys that only an earlier batch
    has updated would be lost.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"output mode {mode}")
    spark, folder = rows.sparkSession, f"{place}/rows" if place else shared_path(rows.sparkSession, "stream-out")
    drain(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n if mode == 'append' else 0}"), mode, f"{place}/progress" if place else None)
    return spark.read.schema(rows.schema).parquet(f"{folder}/batch=*")
