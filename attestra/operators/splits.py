"""Splits that keep what belongs together together, and what leaks between splits all the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from .spatial import connected

FRACTIONS = {"train": 0.6, "validation": 0.2, "test": 0.2}
#: Groups of more than one row in so many are dealt one by one on the driver: there are no more of them than that.
LARGE = 2000
#: Hard negatives that a block has at most.
HARD = 3


def dealt(groups: DataFrame, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """grp, split of groups (grp, n, positive): whole groups, so that each split has its share of the rows of either kind of group.

    Large groups go one by one, largest first, to the split that lacks most of its share; the others by a hash of their name, in the
    proportions that are still lacking then. A split's share strays by little more than a percent, unless a few groups are most
    of the rows.
    """
    spark = groups.sparkSession
    sized = saved(groups, "groups")
    split = None
    for kind, total in ((r["positive"], r["n"]) for r in sized.groupBy("positive").agg(F.sum("n").alias("n")).collect()):
        lacking = {s: f * total for s, f in fractions.items()}
        placed = []
        for r in sized.where((F.col("positive") == kind) & (F.col("n") * LARGE > total)).orderBy(F.desc("n"), "grp").collect():
            best = max(lacking, key=lambda s: (lacking[s] / fractions[s], s))
            lacking[best] -= r["n"]
            placed.append((r["grp"], best))
        left = {s: max(0.0, v) for s, v in lacking.items()}
        sum_ = sum(left.values()) or 1.0
        u = F.conv(F.substring(F.md5(F.col("grp").cast("string")), 1, 12), 16, 10).cast("bigint") / float(1 << 48)
        by_hash, upto = F.when(F.lit(False), F.lit("")), 0.0
        names = [s for s in left if left[s] > 0] or [next(iter(fractions))]
        for s in names[:-1]:
            upto += left[s] / sum_
            by_hash = by_hash.when(u < upto, s)
        named = spark.createDataFrame(placed, f"grp {groups.schema['grp'].dataType.simpleString()}, placed string")
        one = sized.where(F.col("positive") == kind).join(F.broadcast(named), "grp", "left").select("grp", F.coalesce("placed", by_hash.otherwise(names[-1])).alias("split"))
        split = one if split is None else split.unionByName(one)
    return split if split is not None else spark.createDataFrame([], f"grp {groups.schema['grp'].dataType.simpleString()}, split string")


def grouped_split(pairs: DataFrame, texts: DataFrame, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """pairs (a, b, duplicate, text_score, block, and other columns) with grp, split and hard.

    Groups are the components over pairs and over equal texts (id, key): neither a record nor a text is in two splits. hard numbers
    the HARD highest scored negatives of each block; it is null for other pairs.
    """
    pairs = saved(pairs, "records")
    alike = texts.where(F.col("key") != "").groupBy("key").agg(F.min("id").alias("b")).join(texts, "key").where("id <> b").select(F.col("id").alias("a"), "b")
    roots = connected(pairs.sparkSession, pairs.select("a", "b").unionByName(alike))
    rows = saved(pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("grp")), "a"), "grouped")
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bool_or("duplicate").alias("positive"))
    order = Window.partitionBy("block").orderBy("duplicate", F.desc("text_score"), "a", "b")
    hard = F.when(~F.col("duplicate") & (F.col("nth") <= HARD), F.col("nth"))
    return rows.join(dealt(groups, fractions), "grp").withColumn("nth", F.row_number().over(order)).withColumn("hard", hard).drop("nth")


def contaminated(records: DataFrame) -> DataFrame:
    """key, splits, records of what stands in more than one split of records (key, split); empty keys don't count."""
    found = records.where(F.col("key") != "").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.countDistinct("split").alias("n"), F.count(F.lit(1)).alias("records"))
    return found.where("n > 1").select("key", "splits", "records")
