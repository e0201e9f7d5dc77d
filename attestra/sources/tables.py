"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, as in tests, where the session names no shared folder.
LOCAL_DIR = "/tmp/checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or else in the context's checkpoint directory; a cluster without either raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_.get() if set_.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = LOCAL_DIR
    return f"{named.rstrip('/')}/attestra/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: cuts lineage, survives lost executors and tells the planner true sizes. The files go when the application ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # known only once it is there
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that nothing reads any more, if it is there."""
    place, system = _at(spark, path)
    system.delete(place, True)
