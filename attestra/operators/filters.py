"""Composable filters over events, reports and warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IST = timezone(timedelta(hours=5, minutes=30))
#: Longest range of days that a filter accepts.
MOST_DAYS = 366
# Hours of the named time ranges; any other name means a week.
RANGE_HOURS = {"24h": 24, "48h": 48}


def day_bound(text: str, end: bool) -> tuple[int, bool]:
    """(seconds, exclusive) of a bound: a date means IST midnights, the end one exclusive at the next; a timestamp is inclusive."""
    if len(text) == 10:
        day = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=IST)
        return int((day + timedelta(days=1) if end else day).timestamp()), end
    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()), False


def contains(text: Column, part: str) -> Column:
    """Case-insensitive containment in which % and _ are ordinary characters."""
    return F.lower(text).contains(part.lower())


def within(lat: Column, lng: Column, west: float, south: float, east: float, north: float) -> Column:
    """Strictly inside a box: its edge is outside."""
    return (lng > west) & (lng < east) & (lat > south) & (lat < north)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class EventFilter:
    """What a list of events is narrowed to. Without statuses, all but rejected ones."""

    statuses: Sequence[str] = ()
    verdicts: Sequence[str] = ()
    severities: Sequence[str] = ()
    event_types: Sequence[str] = ()
    sources: Sequence[str] = ()
    state: str | None = None
    district: str | None = None
    least_confidence: float | None = None
    start: str | None = None
    end: str | None = None
    time_range: str | None = None
    box: tuple[float, float, float, float] | None = None
    text: str | None = None
    as_of: int | None = field(default=None)

    def apply(self, events: DataFrame, reports: DataFrame | None = None) -> DataFrame:
        """The events that satisfy every condition given; `sources` needs the reports."""
        if self.start and self.end:
            (a, _), (b, exclusive) = day_bound(self.start, False), day_bound(self.end, True)
            if a > b or (exclusive and a >= b) or b - a > MOST_DAYS * 86_400:
                raise ValueError("the range is empty or too long")
        some = [F.col("review_status").isin(*self.statuses) if self.statuses else F.col("review_status") != "REJECTED"]
        some += [F.col(c).isin(*v) for c, v in (("verdict", self.verdicts), ("severity", self.severities), ("event_type", self.event_types)) if v]
        some += [F.lower(c) == v.strip().lower() for c, v in (("state", self.state), ("district", self.district)) if v is not None]
        if self.least_confidence is not None:
            some.append(F.col("confidence") >= self.least_confidence)
        if self.start:
            some.append(F.col("verified_s") >= day_bound(self.start, False)[0])
        if self.end:
            bound, exclusive = day_bound(self.end, True)
            some.append(F.col("verified_s") < bound if exclusive else F.col("verified_s") <= bound)
        if self.time_range and self.time_range != "all":
            some.append(F.col("verified_s") >= self.as_of - RANGE_HOURS.get(self.time_range, 168) * 3600)
        if self.box:
            some.append(within(F.col("lat"), F.col("lng"), *self.box))
        if self.text:
            some.append(reduce(lambda a, b: a | b, [F.coalesce(contains(F.col(c), self.text.strip()), F.lit(False)) for c in ("code", "district", "state")]))
        out = events.where(all_of(some))
        if self.sources:
            out = out.join(reports.where(F.col("source_type").isin(*self.sources)).select(F.col("verified_id").alias("__event")), F.col("id") == F.col("__event"), "left_semi")
        return out


def report_status(social_on: bool = True) -> Column:
    """duplicate, fused, stale, held or unfused: the first that holds."""
    social = F.col("source_type").isin("SOCIAL_MEDIA", "NEWS_MEDIA")
    unplaced = F.coalesce("place_precision", F.lit("gps")).isin("state", "none")
    held = social & (F.lit(not social_on) | unplaced | F.array_contains("flags", "not_an_observation"))
    return (
        F.when(F.col("duplicate_of").isNotNull(), "duplicate")
        .when(F.col("verified_id").isNotNull(), "fused")
        .when(F.coalesce("stale", F.lit(False)), "stale")
        .when(held, "held")
        .otherwise("unfused")
    )


def in_force(as_of: int) -> Column:
    """Actual alerts and updates that have begun and have an end that is not past; no end is not in force."""
    begun = F.coalesce("effective_s", "sent_s") <= as_of
    return (F.col("status") == "actual") & F.col("msg_type").isin("alert", "update") & begun & (F.col("expires_s") >= as_of)


def clusterable(as_of: int, hours: int) -> Column:
    """Recent, unassigned, no duplicate, precisely placed, not stale; social posts only if they observe something themselves."""
    precise = F.coalesce("place_precision", F.lit("gps")).isin("gps", "district")
    recent = F.col("at_s").between(as_of - hours * 3600, as_of + 900)
    social = F.col("source_type").isin("SOCIAL_MEDIA", "NEWS_MEDIA")
    return F.col("verified_id").isNull() & F.col("duplicate_of").isNull() & precise & ~F.coalesce("stale", F.lit(False)) & recent & (~social | ~F.array_contains("flags", "not_an_observation"))
