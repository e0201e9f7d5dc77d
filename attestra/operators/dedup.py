"""Which reports repeat earlier ones, and the originals that chains of repeats lead to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_DEDUP
from ..functions.text import core, edit_similarity, without_repost
from ..sources.tables import saved
from .spatial import radius_join
from .tiles import by_groups

# Gates of citizen duplicates (km, seconds), least edit similarity, hours in which a link and a text are shared, and
# how many of the latest candidates a post's text is compared with.
CITIZEN_KM, CITIZEN_S, SIMILAR, LINK_H, TEXT_H, CANDIDATES = 1.0, 900, 0.75, 72, 24, 200
HOUR = 3600
#: Posts whose candidates are held at once.
OWN = 1 << 14


def earlier(a_s: Column, a_id: Column, b_s: Column, b_id: Column) -> Column:
    """Whether a came before b: by time, then id."""
    return (a_s < b_s) | ((a_s == b_s) & (a_id < b_id))


def resolved(parents: DataFrame) -> DataFrame:
    """id, original: where the pointers (id, parent) end. Pointers lead to earlier rows, so there are no rings.

    A round follows four pointers of the round before, so a chain of n takes log4(n) rounds; the last is the one in which no fourth
    pointer was there to follow.
    """
    at = saved(parents.select("id", F.col("parent").alias("original")), "pointers")
    while True:
        rows = at.select("id", F.col("original").alias("p0"))
        for step in range(3):
            rows = rows.join(at.select(F.col("id").alias(f"p{step}"), F.col("original").alias(f"p{step + 1}")), f"p{step}", "left")
        new = saved(rows.select("id", F.coalesce("p3", "p2", "p1", "p0").alias("original"), F.col("p3").isNotNull().alias("moved")), "pointers")
        at = new.select("id", "original")
        if new.where("moved").isEmpty():
            return at


def same_text(a: Column, b: Column, least: float = SIMILAR) -> Column:
    """A literal repost, repost prefixes aside, or a similar text; false for empty texts."""
    x, y = without_repost(a), without_repost(b)
    return F.coalesce((x != "") & ((x == y) | (edit_similarity(x, y) >= least)), F.lit(False))


def citizen_parents(reports: DataFrame, km: float = CITIZEN_KM, seconds: int = CITIZEN_S, most_lat: float = 40) -> DataFrame:
    """id, parent: citizen reports that say the same as an earlier one within km and seconds, and the earliest such.

    reports: id, at_s, lat, lng, raw_text, source_type, place_precision. Only precise points count. Neighbours meet by grid cell
    and time slot.
    """
    c = reports.where((F.col("source_type") == "CITIZEN_APP") & (F.coalesce("place_precision", F.lit("gps")) == "gps")).select("id", "at_s", "lat", "lng", "raw_text")
    slot = F.floor(F.col("at_s") / seconds)
    pairs = radius_join(c.withColumn("slot", F.explode(F.array(slot, slot - 1))), c.withColumn("slot", slot), km, most_lat, radius=EARTH_DEDUP)
    near = pairs.where((F.col("slot") == F.col("r_slot")) & (F.col("r_at_s") > F.col("at_s") - seconds) & earlier(F.col("r_at_s"), F.col("r_id"), F.col("at_s"), F.col("id")))
    return near.where(same_text(F.col("raw_text"), F.col("r_raw_text"))).groupBy("id").agg(F.min_by("r_id", F.struct("r_at_s", "r_id")).alias("parent"))


def by_link(posts: DataFrame) -> DataFrame:
    """id, parent, parent_s: the earliest post with the same link within LINK_H before, within slots of that length.

    posts: id, at_s, link; a post with several links has a row for each, and the earliest of all counts. Each post has a second row
    where its window begins. From the newest to the oldest, the last post passed before that row is the earliest of the window, so
    that each row is looked at once, however many share a link.
    """
    width = LINK_H * HOUR
    own = F.floor(F.col("at_s") / width)
    rows = posts.select("id", "at_s", "link").where("link is not null and at_s is not null").withColumn("own", own)
    there = rows.withColumn("slot", F.explode(F.array(own, own + 1))).select("link", "slot", F.col("at_s").alias("t"), F.struct("at_s", "id").alias("post"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("bigint").alias("at_s"))
    asked = rows.select("link", F.col("own").alias("slot"), (F.col("at_s") - width).alias("t"), F.lit(None).cast(there.schema["post"].dataType).alias("post"), "id", F.col("at_s").cast("bigint").alias("at_s"))
    w = Window.partitionBy("link", "slot").orderBy(F.desc("t"), F.col("post").isNull().desc(), F.desc("post.id")).rowsBetween(Window.unboundedPreceding, 0)
    first = there.unionByName(asked).withColumn("first", F.last("post", ignorenulls=True).over(w)).where("post is null")
    before = first.where(F.col("first.id") != F.col("id")).where(earlier(F.col("first.at_s"), F.col("first.id"), F.col("at_s"), F.col("id")))
    return before.groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.id").alias("parent"), F.col("first.at_s").alias("parent_s"))


def latest(start: np.ndarray, seen: np.ndarray, rows: np.ndarray, most: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, candidate): for each of `rows` the `most` latest rows before it, from its place's start on, seen within `within` seconds of it.

    Steps back from all rows at once, one row further at each; a row that has its number, or nothing before it, is done.
    """
    got, step = np.zeros(len(start), np.int64), 0
    found: list[tuple[np.ndarray, np.ndarray]] = [(rows[:0], rows[:0])]
    while len(rows):
        step += 1
        rows = rows[rows - step >= start[rows]]
        hit = rows[np.abs(seen[rows - step] - seen[rows]) <= within]
        got[hit] += 1
        found.append((hit, hit - step))
        rows = rows[got[rows] < most]
    i, j = (np.concatenate(v) for v in zip(*found, strict=True))
    return i, j


def feed_parents(posts: DataFrame) -> DataFrame:
    """id, parent, rule of posts and headlines (id, at_s, seen_s, district, state, link, headline_key, raw_text) that repeat an earlier one.

    Rule 1: the same link within LINK_H. Of the CANDIDATES latest earlier ones of the same place, seen within TEXT_H: rule 2, the same
    headline key; rule 3, a similar text. The first rule that applies wins, and with it the earliest post. Places without a
    district or state are equal to each other.

    A place is dealt by slots of TEXT_H with what lies within TEXT_H of them, so that one with any number of posts fills many tasks.
    There each post meets its candidates only; of those with one text just the earliest goes on to be compared.
    """
    width = TEXT_H * HOUR
    slot = F.floor(F.col("seen_s") / width)
    text = F.regexp_replace(core(F.col("raw_text")), r"\s+", " ")
    place = F.xxhash64(F.struct(F.coalesce("district", F.lit("")), F.coalesce("state", F.lit(""))))
    keyed = posts.where("seen_s is not null and at_s is not null").select(
        F.col("id").cast("bigint").alias("id"), F.col("at_s").cast("bigint").alias("at_s"), F.col("seen_s").cast("bigint").alias("seen_s"), F.coalesce("district", F.lit("")).alias("d"), F.coalesce("state", F.lit("")).alias("s"),
        place.alias("p"), F.col("headline_key").alias("head"), F.explode(F.array(text)).alias("text"), slot.alias("home"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"),
    )

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        code = lambda c: rows[c].combine_chunks().dictionary_encode()
        heads, texts = code("head"), code("text")
        named = (group, code("d").indices.to_numpy(), code("s").indices.to_numpy())  # places of one hash are told apart
        order = np.lexsort((rows["id"].to_numpy(), rows["at_s"].to_numpy(), *named))
        id_, at, seen, own = (v[order] for v in (rows["id"].to_numpy(), rows["at_s"].to_numpy(), rows["seen_s"].to_numpy(), rows["home"].to_numpy() == rows["slot"].to_numpy()))
        head, text = (v.indices.fill_null(-1).to_numpy()[order] for v in (heads, texts))
        empty = next((i for i, t in enumerate(texts.dictionary.to_pylist()) if t == ""), -2)
        new = np.logical_or.reduce([np.diff(v[order], prepend=-1) != 0 for v in named])
        start = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
        out = [(np.zeros(0, np.int64),) * 3]
        owners = np.flatnonzero(own)
        for first in range(0, len(owners), OWN):
            i, j = latest(start, seen, owners[first : first + OWN], CANDIDATES, width)
            titled = (head[i] >= 0) & (head[i] == head[j])
            alike = ~titled & (text[i] >= 0) & (text[j] >= 0) & (text[i] != empty)
            for hit, rule in ((titled, 2), (alike, 3)):
                x, y = i[hit], j[hit]
                t = text[y] if rule == 3 else 0 * y
                by = np.lexsort((y, t, x))  # rows stand in order of time and id
                x, y, t = x[by], y[by], t[by]
                keep = (np.diff(x, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0)
                out.append((x[keep], y[keep], np.full(keep.sum(), rule)))
        i, j, rule = (np.concatenate(v) for v in zip(*out, strict=True))
        words = rows["text"].combine_chunks()
        return pa.table({"id": id_[i], "rule": pa.array(rule, pa.int32()), "o_s": at[j], "parent": id_[j], "text": words.take(pa.array(order[i])), "o_text": words.take(pa.array(order[j]))})

    met = by_groups(keyed.select("p", "slot", "d", "s", "id", "at_s", "seen_s", "head", "text", "home"), ["p", "slot"], work, "id bigint, rule int, o_s bigint, parent bigint, text string, o_text string")
    by_text = met.where((F.col("rule") == 2) | (edit_similarity(F.col("text"), F.col("o_text")) >= SIMILAR)).select("id", "rule", "o_s", "parent")
    links = by_link(posts).select(F.col("id").cast("bigint").alias("id"), F.lit(1).alias("rule"), F.lit(0).cast("bigint").alias("o_s"), F.col("parent").cast("bigint").alias("parent"))
    return links.unionByName(by_text).groupBy("id").agg(F.min(F.struct("rule", "o_s", "parent")).alias("m")).select("id", "m.parent", "m.rule")
