"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, as in tests, where the session names no shared folder.
LOCAL_DIR = "/tmp/checkpoints"
#: Fewest and most bits of a bitmap of keys, and bits for each key between them.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 20, 1 << 28, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint directory.

    Where neither is set, a cluster has no such folder and this raises; in local mode it is LOCAL_DIR.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_.get() if set_.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        named = LOCAL_DIR
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestra/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors and gives the planner true sizes.

    The files go when the application ends, if discard() has not deleted them before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # known only once it is there
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that saved() returned; nothing that is still to be computed may read it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_id(text: Column) -> Column:
    """16 bytes that name a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id, text and tid only, so that extra columns of any name do no harm."""
    return documents.select("doc_id", "text").withColumn("tid", text_id(F.col("text")))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near size, each of one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have width bytes, as rows of uint8."""
    data, _ = strings(column)
    return data.reshape(-1, width)


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, partitions: int | None = None) -> DataFrame:
    """Deal rows by keys and call work(rows, starts) on many whole groups at once; starts has each group's first row and the end.

    Keys have no nulls. A group is held in memory, so callers bound its size.
    """
    dealt = (df.repartition(partitions, *keys) if partitions else df.repartition(*keys)).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            starts = _starts(kept, keys)
            if len(starts) > 2:
                cut = int(starts[-2])
                yield from work(kept.slice(0, cut).combine_chunks(), starts[:-1]).to_batches()
                kept = kept.slice(cut)
        if kept is not None and kept.num_rows:
            yield from work(kept.combine_chunks(), _starts(kept, keys)).to_batches()

    return dealt.mapInArrow(run, schema)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(1, np.int64)
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        column = rows[key]
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), rows.num_rows)


def bit_filter(df: DataFrame, column: str, hashed: bool = False, keys: int | None = None) -> np.ndarray:
    """A bitmap over the xxhash64 of a column, or over a column of hashes. A clear bit proves absence; a set bit only suggests presence.

    It has BITS_A_KEY bits for each of the table's rows (or of `keys`), in powers of two from LEAST_BITS to MOST_BITS (32 MB), so
    it may be sent to every task whatever the table's size; beyond, more rows than need be pass. Callers check hits exactly.
    """
    n = df.count() if keys is None else keys
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))
    place = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(bits))
    words = (
        df.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
        .select("word", F.expr("shiftleft(one, bit)").alias("value"))
        .groupBy("word")
        .agg(F.bit_or("value").alias("value"))
        .toArrow()
    )
    out = np.zeros(bits >> 6, np.int64)
    if words.num_rows:
        out[words["word"].to_numpy()] = words["value"].to_numpy()
    return out


def repeated_filter(df: DataFrame, key: str, times: str | None, name: str) -> np.ndarray:
    """The bitmap of the hashes in column `key` that occur more than once, each row counting as often as `times` says (once if None)."""
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    repeated = saved(df.groupBy(key).agg(n.alias("__n")).where("__n > 1").select(key), name)
    out = bit_filter(repeated, key, hashed=True)
    discard(repeated)
    return out


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap may hold."""
    place = np.mod(hashes.astype(np.int64), np.int64(len(filter_) << 6))
    return (filter_[place >> 6] >> (place & 63)) & 1 == 1


def keep_likely(df: DataFrame, key: str, filter_: np.ndarray) -> DataFrame:
    """The rows of df whose key the bitmap may hold: cuts what a later exact join on the key shuffles."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_hold(filter_, batch.column(len(columns)).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], names=columns).filter(pa.array(keep))

    return df.withColumn("__place", F.xxhash64(key)).mapInArrow(run, df.schema)
