"""One text sent by many: reports whose normalised text several reporters sent within minutes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLAG_FACTORS, FLAG_FLOOR, text_key
from .tiles import by_groups

# Reporters, seconds within which they send one text, and its least length.
REPORTERS, WITHIN_S, LEAST_TEXT = 3, 600, 30
#: Reports of one text are dealt by so many seconds, so that a text of any number of copies fills many tasks.
SLOT_S = 6 * 3600


def crowded(at: np.ndarray, who: np.ndarray, seconds: int, least: int) -> np.ndarray:
    """Which rows, sorted by time, lie in a span of `seconds` that ends at a row and holds `least` different senders: one pass with a sliding count."""
    out = np.zeros(len(at), bool)
    held: dict[int, int] = {}
    first = done = 0
    for i, (t, w) in enumerate(zip(at.tolist(), who.tolist(), strict=True)):
        held[w] = held.get(w, 0) + 1
        while at[first] < t - seconds:
            v = int(who[first])
            held[v] -= 1
            if not held[v]:
                del held[v]
            first += 1
        # rows of one second are one moment: the span is judged once its last row is in
        if len(held) >= least and (i + 1 == len(at) or at[i + 1] != t):
            out[max(first, done) : i + 1] = True
            done = i + 1
    return out


def coordinated(reports: DataFrame) -> DataFrame:
    """id of the reports (id, at_s, reporter, raw_text) whose text REPORTERS reporters or more sent within WITHIN_S of each other, it among them.

    Texts are equal when lower-cased and with runs of punctuation and blanks as one space, and have LEAST_TEXT characters then. A
    null reporter is one of its own. Null texts and times take no part.
    """
    key = F.explode(F.array(text_key(F.col("raw_text")))).alias("key")  # made once
    rows = reports.select("id", "at_s", "reporter", key).where((F.length("key") >= LEAST_TEXT) & F.col("at_s").isNotNull())
    who = F.when(F.col("reporter").isNull(), F.xxhash64(F.lit("report"), "id")).otherwise(F.xxhash64(F.lit("reporter"), "reporter"))
    slot = F.floor(F.col("at_s") / SLOT_S)
    near = F.array_distinct(F.array(F.floor((F.col("at_s") - WITHIN_S) / SLOT_S), slot, F.floor((F.col("at_s") + WITHIN_S) / SLOT_S)))
    dealt = rows.select(F.md5("key").alias("k"), F.explode(near).alias("slot"), "at_s", who.alias("who"), F.col("id").cast("bigint").alias("id"), slot.alias("home"))

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        at, who, id_, home, slot = (table[c].to_numpy() for c in ("at_s", "who", "id", "home", "slot"))
        found = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= REPORTERS:
                order = a + np.argsort(at[a:b], kind="stable")
                hit = order[crowded(at[order], who[order], WITHIN_S, REPORTERS)]
                found.append(id_[hit[home[hit] == slot[hit]]])
        return pa.table({"id": pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())})

    return by_groups(dealt, ["k", "slot"], work, "id bigint")


def halved(credibility: Column, already: Column) -> Column:
    """The credibility of a copy: reduced once, floored, to four decimals (halves up, but for the noise of doubles)."""
    return F.when(already, credibility).otherwise(F.greatest(F.lit(FLAG_FLOOR), F.round(credibility * FLAG_FACTORS["coordinated"] + 1e-9, 4)))
