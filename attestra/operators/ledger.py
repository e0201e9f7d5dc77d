"""Hash-chained ledgers: appending and checking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def link(prev: Column, body: Column) -> Column:
    """The hash of a row: of the hash before it and its own content."""
    return F.sha2(F.concat_ws("|", prev, body), 256)


def chain(rows: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """The rows with prev_hash and hash.

    A chain is sequential by nature, so a key's rows come in order to one task, which carries nothing but the last hash from
    row to row: a chain of any length needs no memory. A null body adds nothing to what is hashed.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, last = object(), GENESIS
        for batch in batches:
            before, after = [], []
            for k, content in zip(batch.column(key).to_pylist(), batch.column(body).to_pylist(), strict=True):
                if k != book:
                    book, last = k, GENESIS
                before.append(last)
                last = hashlib.sha256((last if content is None else f"{last}|{content}").encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "prev_hash", "hash"])

    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, rows.withColumn("prev_hash", F.lit("")).withColumn("hash", F.lit("")).schema)


def breaks(ledger: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """key, valid, checked, broken_at: the first row whose prev_hash is not the hash before it or whose hash is not its content's."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag("hash", 1, GENESIS).over(w)
    wrong = ~(F.col("prev_hash").eqNullSafe(before) & F.col("hash").eqNullSafe(link(F.col("prev_hash"), F.col(body))))
    rows = ledger.withColumn("wrong", wrong).withColumn("n", F.row_number().over(w))
    first = F.min(F.when(F.col("wrong"), F.struct(order, "n")))
    out = rows.groupBy(key).agg(first.alias("f"), F.count(F.lit(1)).alias("rows"))
    return out.select(key, F.col("f").isNull().alias("valid"), F.coalesce("f.n", "rows").cast("bigint").alias("checked"), F.col(f"f.{order}").alias("broken_at"))
