"""Open events kept by a stream: a report extends an event, makes one with reports that had no company, or merges several."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import connected
from ..operators.tiles import LOOKS, components, tiled
from ..sources.tables import exists, remove, saved
from .runner import drain
from .state import Timed

#: Least width in km and length in hours of a tile whose reports are one state: a call a key is dear, its rows are cheap.
WIDE_KM, LONG_H = 300.0, 48.0
_LINKS = "a bigint, b bigint, a_s bigint, b_s bigint"
_LIVE = "node bigint, root bigint, at_s bigint"
_LOG = "event bigint, change string, members bigint, added bigint"


class OpenTile(Timed):
    """The reports of one tile and slot, and the component of each; what comes in is linked to it, whatever its order.

    Out come stars only: a new report with the least of its component, and a component's old least with its new one. The state goes
    once the clock has passed the time in which a report could still be linked to one of the slot.
    """

    value_schema = "ids array<bigint>, at array<bigint>, lat array<double>, lng array<double>, top array<bigint>"

    def __init__(self, gates: dict[str, tuple[float, int]]):
        self.gates = gates

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        family, slot = key[0], key[3]
        eps, hours = self.gates[family]
        v = self.value.get()
        known = [list(x) for x in v] if v else [[], [], [], [], []]
        seen, old = set(known[0]), dict(zip(known[0], known[4], strict=True))
        for r in rows:
            if r.id not in seen:
                seen.add(r.id)
                for part, x in zip(known, (r.id, r.at_s, r.lat, r.lng), strict=False):
                    part.append(x)
        ids, at, lat, lng = (np.array(x) for x in known[:4])
        root = components(at, lat, lng, np.array([0, len(ids)]), np.array([eps]), np.array([hours * 3600]))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        top = least[root].tolist()
        times = dict(zip(known[0], known[1], strict=True))
        pairs = {(old.get(i, i), t) for i, t in zip(known[0], top, strict=True) if old.get(i, i) != t}
        self.value.update((known[0], known[1], known[2], known[3], top))
        if not v:
            self.handle.registerTimer(int(((slot + 1) * max(LOOKS * hours, LONG_H) + hours) * 3_600_000))
        return iter([Row(a=a, b=b, a_s=times[a], b_s=times[b]) for a, b in sorted(pairs)])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.value.clear()
        return iter([])


class Events:
    """The events of a stream, in a folder: those that may still grow as one table a batch, closed ones and the changes appended.

    Only reports with company are members. A batch that runs again starts from the table of the one before it and replaces its own
    files.
    """

    def __init__(self, spark: SparkSession, place: str, delay_s: int, look_s: int):
        self.spark, self.place, self.delay_s, self.look_s = spark, place, delay_s, look_s

    def _live(self, n: int) -> DataFrame:
        path = f"{self.place}/live/{n}"
        return self.spark.read.schema(_LIVE).parquet(path) if n >= 0 and exists(self.spark, path) else self.spark.createDataFrame([], _LIVE)

    def apply(self, batch: DataFrame, n: int) -> None:
        """Join a batch of links into the open events, note what changed, and close events that no accepted report can reach any more."""
        new = saved(batch.distinct(), "links")
        before = self._live(n - 1)
        if new.isEmpty():
            self._write(before, "live", n)
            return
        ends = new.select(F.col("a").alias("node"), F.col("a_s").alias("at_s")).unionByName(new.select(F.col("b").alias("node"), F.col("b_s").alias("at_s")))
        times = ends.unionByName(before.select("node", "at_s")).groupBy("node").agg(F.max("at_s").alias("at_s"))
        roots = connected(self.spark, new.select("a", "b").unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        now = saved(roots.join(times, "node").join(before.select("node", F.col("root").alias("was")), "node", "left"), "members")
        state = now.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("was").isNull()).alias("added"), F.countDistinct("was").alias("joined"), F.max("at_s").alias("last_s"))
        change = F.when(F.col("joined") == 0, "created").when(F.col("joined") > 1, "merged").when(F.col("added") > 0, "extended")
        self._write(state.withColumn("change", change).where("change is not null").select(F.col("root").alias("event"), "change", "members", "added"), "log", n)
        horizon = now.agg(F.max("at_s")).first()[0] - self.delay_s - self.look_s
        closed = state.where(F.col("last_s") < horizon).select("root")
        self._write(now.join(closed, "root", "left_semi").select("node", "root", "at_s"), "closed", n)
        self._write(now.join(closed, "root", "left_anti").select("node", "root", "at_s"), "live", n)
        remove(self.spark, f"{self.place}/live/{n - 2}")

    def _write(self, rows: DataFrame, kind: str, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.place}/{kind}/{n if kind == 'live' else f'batch={n}'}")
        if kind == "live":
            self.spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{self.place}/newest")

    def _kept(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.place}/{kind}"
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], f"{schema}, batch int")

    def members(self) -> DataFrame:
        """id, event of every report with company."""
        n = self.spark.read.parquet(f"{self.place}/newest").first()["n"] if exists(self.spark, f"{self.place}/newest") else -1
        both = self._kept("closed", _LIVE).select("node", "root").unionByName(self._live(n).select("node", "root"))
        return both.select(F.col("node").alias("id"), F.col("root").alias("event"))

    def log(self) -> DataFrame:
        """batch, event, change (created, extended or merged), members then, members added by that batch."""
        return self._kept("log", _LOG)


def dealt(reports: DataFrame, gates: dict[str, tuple[float, int]], most_lat: float = 40.0) -> DataFrame:
    """Reports (id, at_s, lat, lng, family, ts) of the gates' families with the tiles (ty, tx, slot) whose state they belong to, and their gate."""
    table = F.create_map(*(F.lit(x) for k, v in gates.items() for x in (k, F.array(F.lit(float(v[0])), F.lit(float(v[1]))))))
    gate = F.try_element_at(table, F.col("family"))
    rows = reports.where(F.col("family").isin(*gates)).select(F.col("id").cast("bigint").alias("id"), F.col("at_s").cast("bigint").alias("at_s"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "family", "ts", gate.alias("gate"))
    return tiled(rows, F.col("gate")[0], F.col("gate")[1], most_lat, WIDE_KM, LONG_H)


def open_events(reports: DataFrame, gates: dict[str, tuple[float, int]], place: str, delay_s: int, most_lat: float = 40.0) -> Events:
    """Run a stream of reports (id, at_s, lat, lng, family, ts) over all that is there, into the events in `place`.

    Reports may come in any order within delay_s; a later run with the same place goes on where this one ended. What comes out does not
    depend on the order or on how the batches are cut: it is what family_components gives for all accepted reports at once.
    """
    spark = reports.sparkSession
    keyed = dealt(reports.withWatermark("ts", f"{delay_s} seconds"), gates, most_lat)
    links = keyed.drop("gate").groupBy("family", "ty", "tx", "slot").transformWithState(OpenTile(gates), _LINKS, "append", "EventTime")
    events = Events(spark, place, delay_s, max(h for _, h in gates.values()) * 3600)
    drain(links, events.apply, progress=f"{place}/progress")
    return events
