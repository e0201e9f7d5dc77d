"""What the earlier media of other reports say about a photo or video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved

HOUR = 3600
# Media gates.
RECYCLED_S, OLD_S, FUTURE_S, MISMATCH_KM = 48 * HOUR, 48 * HOUR, HOUR, 25.0
# Names of editing apps.
EDITORS = (
    "photoshop", "lightroom", "gimp", "snapseed", "picsart", "canva", "pixlr", "affinity",
    "photopea", "vsco", "facetune", "meitu", "inshot", "capcut", "photodirector", "paint.net",
    "fotor", "polarr", "remini", "photoroom", "picmonkey", "photoscape", "luminar",
)


def edited(software: Column) -> Column:
    """Whether the program that saved a file is an editor; firmware is none."""
    low = F.lower(software)
    return F.exists(F.array(*(F.lit(name) for name in EDITORS)), lambda name: low.contains(name))


def file_flags(taken_s, observed_s, received_s, km, same_file, has_metadata, recycled=None, software=None):
    """Flags of one file in their fixed order; unknown values set none."""
    observed = F.coalesce(observed_s, received_s)
    old = taken_s < observed - OLD_S
    rules = [
        ("duplicate_media", same_file),
        ("recycled_suspect", F.lit(False) if recycled is None else recycled),
        ("old_capture", old),
        ("future_capture", ~F.coalesce(old, F.lit(False)) & (taken_s > received_s + FUTURE_S)),
        ("location_mismatch", km > MISMATCH_KM),
        ("no_metadata", ~has_metadata),
        ("edited", F.lit(False) if software is None else has_metadata & edited(software)),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules)))


def hamming_pairs(rows: DataFrame, key: str, most: int = 8) -> DataFrame:
    """a, b, bits: pairs of keys with 64-bit hashes (h) at most `most` bits apart, and their least distance.

    The bits are cut into (most + 1) / 3 bands, rounded up, of which one at least differs by two bits at most in such a pair: with one
    bit or none flipped on either side both give the same key, so bands are wide and few others share a key. Equal hashes are met
    once per hash.
    """
    bands = -(-(most + 1) // 3)
    edge = [64 * k // bands for k in range(bands + 1)]
    known = saved(rows.select("h").where("h is not null").distinct(), "hashes")

    def keys(k: int) -> Column:
        own = F.shiftrightunsigned("h", edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1 if bands > 1 else -1).cast("bigint"))
        near = [F.lit(0).cast("bigint"), *(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(i)) for i in range(edge[k + 1] - edge[k]))]
        return F.transform(F.array(*near), lambda flip: F.struct(F.lit(k).alias("band"), own.bitwiseXOR(flip).alias("bits_")))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes become many rows
    each = known.repartition(parts, "h").select("h", F.inline(F.concat(*(keys(k) for k in range(bands)))))
    bits = F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).cast("bigint")
    other = each.withColumnRenamed("h", "g")
    apart = each.join(other.hint("merge"), ["band", "bits_"]).where((F.col("h") < F.col("g")) & (bits <= most)).select("h", "g").distinct()
    turned = F.inline(F.array(F.struct("h", "g"), F.struct(F.col("g").alias("h"), F.col("h").alias("g"))))
    near = apart.select(turned).unionByName(known.select("h", F.col("h").alias("g"))).withColumn("bits", bits)
    a, b = rows.select(F.col(key).alias("a"), "h"), rows.select(F.col(key).alias("b"), F.col("h").alias("g"))
    return a.join(near, "h").join(b, "g").where("a < b").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def copied(media: DataFrame) -> DataFrame:
    """media of those (media, report, reporter, at_s, sha) whose file an earlier report of another reporter has; ties by media.

    A report without a reporter stands for itself. A file's earliest report and the earliest one of anybody else decide for all of its
    copies, so copies meet in sums that combine before they are shuffled and never in pairs. Null sha or at_s is no copy.
    """
    who = F.coalesce(F.concat(F.lit("by "), F.col("reporter").cast("string")), F.concat(F.lit("report "), F.col("report").cast("string")))
    m = media.where("sha is not null and at_s is not null").select("media", "sha", F.struct("at_s", "media").alias("key"), who.alias("who"))
    of_reporter = m.groupBy("sha", "who").agg(F.min("key").alias("key"))
    first = of_reporter.groupBy("sha").agg(F.min(F.struct("key", "who")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    second = of_reporter.join(first, "sha").where(F.col("who") != F.col("first.who")).groupBy("sha").agg(F.min("key").alias("second"))
    both = m.join(first.join(second, "sha"), "sha")
    return both.where(F.when(F.col("who") == F.col("first.who"), F.col("second") < F.col("key")).otherwise(F.col("first.key") < F.col("key"))).select("media")


def recycled(media: DataFrame, hashes: DataFrame) -> DataFrame:
    """media (media, seen_s, observed_s) with first_seen: when the earliest near-identical one was stored, RECYCLED_S before it was observed.

    hashes: media, h, one row a frame. Frames at most 8 of 64 bits apart are near-identical.
    """
    pairs = hamming_pairs(hashes.select("media", "h"), "media").select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = media.select(F.col("media").alias("b"), F.col("seen_s").alias("first_seen"))
    mine = media.select(F.col("media").alias("a"), "observed_s")
    old = both.join(seen, "b").join(mine, "a").where(F.col("first_seen") < F.col("observed_s") - RECYCLED_S)
    return old.groupBy(F.col("a").alias("media")).agg(F.min("first_seen").alias("first_seen"))
