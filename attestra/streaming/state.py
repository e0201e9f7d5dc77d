"""Keyed operators with state and timers: the life of alerts, and answers that are remembered for a time.

Rows of a key are handled in order of time; a batch that is cut elsewhere gives the same rows, as long as none comes later than
the watermark allows. Event time drives every clock, so a replay gives what the live stream gave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerting import ACTIVE, ELIGIBLE, EXPIRED, Alert, after, classified, decided

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; what was set before is set again."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Timed(StatefulProcessor):
    """One value and at most one timer a key."""

    value_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.value_schema)

    def wake_at(self, seconds: int | None) -> None:
        """Set the key's timer anew, or none."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if seconds is not None:
            self.handle.registerTimer(seconds * 1000)

    def close(self) -> None:
        pass


class AlertLife(Timed):
    """Versions of an event in, what becomes of its alert out.

    Each version is new, updated or seen by what was last acted on; seen ones change nothing. The others are met with the rules
    and the alert there is: it is created, updated, escalated, resolved, or left alone within the cooldown. An alert that nothing
    updated for its time expires, when a later version comes or the clock passes, whichever is first. A version that comes after a
    later one of its event was handled is late and changes nothing.
    """

    value_schema = "at_s bigint, severity int, confidence double, sources int, status string, a_severity int, a_confidence double, a_sources int, updated_s bigint, expires_s bigint, alerts int"
    schema = "code string, version bigint, at_s bigint, class string, action string, status string, alerts int"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        code, v = key[0], self.value.get()
        at, last = (v[0], tuple(v[1:4]) if v[1] is not None else None) if v else (-(1 << 62), None)
        alert = Alert(*v[4:]) if v else Alert()
        out = []
        for r in sorted(rows, key=lambda r: (r.at_s, r.version)):
            if r.at_s < at:
                out.append((code, r.version, r.at_s, "late", "NO_ACTION", alert.status, alert.alerts))
                continue
            at = r.at_s
            if alert.expires(at):
                alert = alert.ended(EXPIRED, alert.expires_s)
                out.append((code, None, alert.updated_s, None, "EXPIRE", EXPIRED, alert.alerts))
            kind, action = classified(last, r), "NO_ACTION"
            if kind != "seen":
                last = (r.severity, r.confidence, r.sources)
                if r.review_status in ELIGIBLE:
                    action = decided(alert, r, at)
                    alert = after(alert, action, r, at)
            out.append((code, r.version, at, kind, action, alert.status, alert.alerts))
        self.value.update((at, *(last or (None, None, None)), *alert.values()))
        self.wake_at(alert.expires_s if alert.status in ACTIVE else None)
        return iter([Row(**dict(zip(_names(self.schema), o, strict=True))) for o in out])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        v = self.value.get()
        alert = Alert(*v[4:])
        if alert.status not in ACTIVE or alert.expires_s * 1000 > expiredTimerInfo.getExpiryTimeInMs():
            return iter([])
        alert = alert.ended(EXPIRED, alert.expires_s)
        self.value.update((*v[:4], *alert.values()))
        return iter([Row(**dict(zip(_names(self.schema), (key[0], None, alert.updated_s, None, "EXPIRE", EXPIRED, alert.alerts), strict=True)))])


class Remembered(Timed):
    """Reports of a cell in; whether a model's answer for it was at hand (hit), failed a while ago (failed) or was asked for (fetch).

    An answer serves for good_s seconds and a failure is not tried again for failed_s; then the key's state is gone. ask(row) gives
    the answer, null for a failure.
    """

    value_schema = "expires_s bigint, answer bigint"
    schema = "cell bigint, id bigint, state string, answer bigint"

    def __init__(self, ask: Callable[[Row], int | None], good_s: int, failed_s: int):
        self.ask, self.good_s, self.failed_s = ask, good_s, failed_s

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        v = self.value.get()
        expires, answer = v if v else (-(1 << 62), None)
        out = []
        for r in sorted(rows, key=lambda r: (r.at_s, r.id)):
            if expires > r.at_s:
                state = "failed" if answer is None else "hit"
            else:
                state, answer = "fetch", self.ask(r)
                expires = r.at_s + (self.failed_s if answer is None else self.good_s)
            out.append(Row(cell=key[0], id=r.id, state=state, answer=answer))
        self.value.update((expires, answer))
        self.wake_at(expires)
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        v = self.value.get()
        if v and v[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
        return iter([])


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def alert_lives(versions: DataFrame) -> DataFrame:
    """What becomes of the alerts of a stream of versions (code, version, at_s, ts, severity, confidence, sources, review_status, rule), with a watermark on ts."""
    return versions.groupBy("code").transformWithState(AlertLife(), AlertLife.schema, "append", "EventTime")


def remembered(reports: DataFrame, ask: Callable[[Row], int | None], good_s: int, failed_s: int) -> DataFrame:
    """What a stream of reports (cell, id, at_s, ts, and what ask reads) finds in memory, with a watermark on ts."""
    return reports.groupBy("cell").transformWithState(Remembered(ask, good_s, failed_s), Remembered.schema, "append", "EventTime")


#: Lists of marks that a trigger has.
SLOTS = 64


class Throttled(Timed):
    """Candidates of a trigger in; which are handled at which tick. At most `most` go out a tick, oldest first, the others wait for later ones.

    A trigger that is delivered again brings its candidates again: one that waits or was handled within keep_s is left alone. What
    waits lies in the state in blocks of a tick's size by its place in the queue, so a call reads little more than it puts out; marks
    lie in SLOTS lists by event, so a delivery takes a call a list and not a call a candidate. Once all is out and keep_s has passed, the state goes.
    """

    value_schema = "head bigint, tail bigint, tick int, next_s bigint, last_s bigint"
    schema = "trigger string, event_id bigint, tick int, at_s bigint"

    def __init__(self, most: int, every_s: int, keep_s: int):
        self.most, self.every_s, self.keep_s = most, every_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.queue = handle.getMapState("queue", "block bigint", "events array<bigint>")
        self.marks = handle.getMapState("marks", "slot bigint", "events array<bigint>, until_s array<bigint>")

    def _tick(self, trigger: str, v: list, at: int) -> Iterator[Row]:
        end = min(v[1], v[0] + self.most)
        while v[0] < end:
            block, first = divmod(v[0], self.most)
            some = self.queue.getValue((block,))[0][first : first + end - v[0]]
            v[0] += len(some)
            if v[0] % self.most == 0:
                self.queue.removeKey((block,))
            for event in some:
                yield Row(trigger=trigger, event_id=event, tick=v[2], at_s=at)
        v[2], v[3], v[4] = v[2] + 1, at + self.every_s, at

    def _wait(self, v: list, events: list[int]) -> None:
        """Put events at the end of the queue, a block at a time; a block that a tick left unfinished is gone on with."""
        first = 0
        while first < len(events):
            block, n = divmod(v[1], self.most)
            held = list(self.queue.getValue((block,))[0]) if n else []
            some = events[first : first + self.most - n]
            self.queue.updateValue((block,), (held + some,))
            first, v[1] = first + len(some), v[1] + len(some)

    def _kept(self, v: list) -> None:
        self.value.update(tuple(v))
        self.wake_at(v[3] if v[0] < v[1] else v[4] + self.keep_s)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.value.get()
        v = list(before or (0, 0, 0, -(1 << 62), 0))
        found = {(r.opened_s, r.event_id): r.at_s for r in sorted(rows, key=lambda r: -r.at_s)}
        if not found:
            return
        at = min(found.values())
        if v[0] < v[1] and at >= v[3]:
            yield from self._tick(key[0], v, at)
        free = self.most if v[0] == v[1] and at >= v[3] else 0  # places of this tick, which need no queue
        out, queued, marks, new = 0, [], {}, set()
        for (_, event), at_s in sorted(found.items()):
            slot = event % SLOTS
            if slot not in marks:
                held = self.marks.getValue((slot,)) if before and self.marks.containsKey((slot,)) else None
                marks[slot] = dict(zip(*held, strict=True)) if held else {}
            if marks[slot].get(event, at_s) > at_s:
                continue
            new.add(slot)
            if out < free:
                out += 1
                marks[slot][event] = at + self.keep_s
                yield Row(trigger=key[0], event_id=event, tick=v[2], at_s=at)
                continue
            due = (at + self.every_s if out else v[3]) + (v[1] + len(queued) - v[0]) // self.most * self.every_s
            marks[slot][event] = due + self.keep_s
            queued.append(event)
        self._wait(v, queued)
        for slot in sorted(new):
            self.marks.updateValue((slot,), (list(marks[slot]), list(marks[slot].values())))
        if out:
            v[2], v[3], v[4] = v[2] + 1, at + self.every_s, at
        self._kept(v)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        v, now = list(self.value.get()), timerValues.getCurrentWatermarkInMs()
        while v[0] < v[1] and v[3] * 1000 <= now:
            yield from self._tick(key[0], v, v[3])
        if v[0] == v[1] and (v[4] + self.keep_s) * 1000 <= now:
            self.queue.clear()
            self.marks.clear()
            self.value.clear()
        else:
            self._kept(v)


def throttled(candidates: DataFrame, most: int, every_s: int, keep_s: int) -> DataFrame:
    """When a stream of candidates (trigger, event_id, opened_s, at_s, ts) is handled, with a watermark on ts."""
    return candidates.groupBy("trigger").transformWithState(Throttled(most, every_s, keep_s), Throttled.schema, "append", "EventTime")
