"""Streaming operators and the parsers of incoming feeds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.parsers import cap_alerts, hourly, latest_revision, metar, rss_items
from ..sources.tables import shared_path
from ..streaming.runner import collected, drain, read_stream
from ..streaming.state import remembered, rocksdb, throttled
from .registry import query


@query("SELECT DISTINCT user_id, event_type FROM events")
def stm02_broadcast_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key is sent once while its state lives (the driver's month of events lies within the watermark)."""
    rows = read_stream(spark, sf_dir, "events", "ts").withWatermark("ts", "40 days")
    return collected(rows.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 5) AS good, count(*) FILTER (WHERE NOT coalesce(value >= 5, false)) AS dead FROM events GROUP BY 1")
def stm01_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail the check go to the dead-letter table, the others on; a batch that runs again replaces its own files."""
    good, dead = split_letters(spark, sf_dir)
    both = good.withColumn("to", F.lit("good")).unionByName(dead.drop("reason").withColumn("to", F.lit("dead")))
    return both.groupBy("event_type").agg(F.count_if(F.col("to") == "good").alias("good"), F.count_if(F.col("to") == "dead").alias("dead"))


#: The least value that passes.
LEAST_VALUE = 5


def split_letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The good rows and the dead letters of the events' stream, as it wrote them; a dead letter names its reason."""
    good, dead = shared_path(spark, "good"), shared_path(spark, "dead")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value").schema

    def split(batch: DataFrame, n: int) -> None:
        ok = F.coalesce(F.col("value") >= LEAST_VALUE, F.lit(False))
        batch.where(ok).write.mode("overwrite").parquet(f"{good}/batch={n}")
        reason = F.when(F.col("value").isNull(), "no value").otherwise("too small")
        batch.where(~ok).withColumn("reason", reason).write.mode("overwrite").parquet(f"{dead}/batch={n}")

    drain(read_stream(spark, sf_dir, "events").select("event_id", "event_type", "value"), split)
    back = lambda path, kind: spark.read.schema(kind).parquet(f"{path}/batch=*")
    return back(good, schema), back(dead, StructType([*schema, StructField("reason", StringType())]))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 5) AS kept, count(*) FILTER (WHERE value < 5 AND value * 10 >= 5) AS mended, count(*) FILTER (WHERE value IS NULL OR value * 10 < 5) AS dead FROM events GROUP BY 1")
def dom27_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters that the stream wrote, read back and mended (a value in tenths), checked again and put to the rest; those that still fail stay dead."""
    good, dead = split_letters(spark, sf_dir)
    mended = dead.withColumn("value", F.when(F.col("reason") == "too small", F.col("value") * 10))
    ok = F.coalesce(F.col("value") >= LEAST_VALUE, F.lit(False))
    fate = good.select("event_type", F.lit("kept").alias("to")).unionByName(mended.select("event_type", F.when(ok, "mended").otherwise("dead").alias("to")))
    return fate.groupBy("event_type").agg(*(F.count_if(F.col("to") == to).alias(to) for to in ("kept", "mended", "dead")))


@query("SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stm04_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that last until two hours pass without a report; each report extends its own."""
    rows = read_stream(spark, sf_dir, "events", "ts").withWatermark("ts", "1 day")
    s = rows.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return collected(s.select("user_id", F.unix_timestamp("session_window.start").alias("first_s"), "n"), "complete")


#: Hours that a report of each kind looks back over, by its hazard's family (as the reports frame maps kinds to hazards), and the
#: minutes by which clocks may run ahead.
LOOK_BACK = {"click": 6, "view": 6, "signup": 3, "purchase": 24, "error": 12}
SLACK_MIN = 15
_HOURS = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {h}" for k, h in LOOK_BACK.items()) + " END"


@query(
    f"SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND b.ts >= a.ts - to_hours({_HOURS.format(c='a.event_type')}) AND b.ts <= a.ts + INTERVAL {SLACK_MIN} MINUTES GROUP BY 1"
)
def stm03_family_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each report the others of its place and kind in its family's look-back and 15 minutes after: an interval join of the stream with
    itself, whose bounds let the watermarks clear its state."""
    rows = read_stream(spark, sf_dir, "events", "ts").withWatermark("ts", "1 day").select("event_id", "user_id", "event_type", "ts")
    a = rows.select(F.col("event_id").alias("a"), F.col("user_id").alias("u"), F.col("event_type").alias("k"), F.col("ts").alias("a_ts"))
    widest = F.expr(f"interval {max(LOOK_BACK.values())} hours")
    hours = F.expr(_HOURS.format(c="k"))
    near = a.join(rows, (F.col("u") == F.col("user_id")) & (F.col("k") == F.col("event_type")) & (F.col("ts") >= F.col("a_ts") - widest) & (F.col("ts") <= F.col("a_ts") + F.expr(f"interval {SLACK_MIN} minutes")))
    own = near.where((F.col("a") != F.col("event_id")) & (F.unix_micros("ts") >= F.unix_micros("a_ts") - hours * F.lit(3_600_000_000).cast("bigint")))
    return collected(own.select(F.col("a").alias("event_id"))).groupBy("event_id").agg(F.count(F.lit(1)).alias("near"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stm07_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive written by micro-batches of 60 seconds or 5 MB of files, whichever comes first; read back and counted."""
    rows = read_stream(spark, sf_dir, "events", size=str(5 << 20)).select("event_id", "event_type")
    folder = shared_path(spark, "archive")
    out = rows.writeStream.option("checkpointLocation", shared_path(spark, "stream")).trigger(processingTime="60 seconds").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")).start()
    try:
        out.processAllAvailable()
    finally:
        out.stop()
    back = spark.read.schema(rows.schema).parquet(f"{folder}/batch=*")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


#: Seconds that a model's answer for a cell stays good, and a failure is not tried again.
GOOD_S, FAILED_S = 600, 60


def _ask(report: Row) -> int | None:
    """The model, as a stand-in: every fourth request fails, the others name the report that asked."""
    return None if report.id % 4 == 0 else report.id


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id - user_id % 20 AS cell, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, row_number() OVER (PARTITION BY user_id - user_id % 20 ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
s AS (SELECT cell, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS state, CAST(NULL AS BIGINT) AS answer, CAST(-1 AS BIGINT) AS expires FROM r GROUP BY cell UNION ALL
  SELECT r.cell, r.n, r.id, CASE WHEN expires <= at_s THEN 'fetch' WHEN answer IS NULL THEN 'failed' ELSE 'hit' END, CASE WHEN expires > at_s THEN answer WHEN r.id % 4 <> 0 THEN r.id END, CASE WHEN expires > at_s THEN expires WHEN r.id % 4 <> 0 THEN at_s + {GOOD_S} ELSE at_s + {FAILED_S} END
  FROM s JOIN r ON r.cell = s.cell AND r.n = s.n + 1)
SELECT cell, id, state, answer FROM s WHERE n > 0"""
)
def stm08_cached_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a stream met with the answers that a model gave for their cell: an answer serves for GOOD_S, a failure for FAILED_S.

    The stream itself asks, remembers and forgets: state of each cell with an end, which the event time's clock clears.
    """
    rows = read_stream(spark, sf_dir, "events", "ts").withWatermark("ts", "1 hour")
    reports = rows.select((F.col("user_id") - F.col("user_id") % 20).alias("cell"), F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("at_s"), "ts")
    with rocksdb(spark):
        return collected(remembered(reports, _ask, GOOD_S, FAILED_S))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id % 4) AS partitions, max(event_id) AS last FROM events GROUP BY 1, 2")
def snk03_bronze_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream archived by source and day with the (partition, offset) of each line, then compacted by these: a line that came twice is one.

    Users stand for partitions and event ids for offsets; every line is delivered twice. Equal events at two places stay two.
    """
    folder = shared_path(spark, "bronze")
    line = [F.pmod("user_id", F.lit(4)).cast("int").alias("partition"), F.col("event_id").alias("offset"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "user_id", "ts", "value", "props"]
    rows = read_stream(spark, sf_dir, "events", "ts").select(*line)
    again = read_stream(spark, sf_dir, "events", "ts").select(*line)
    out = rows.unionByName(again).writeStream.format("json").partitionBy("event_type", "day").option("checkpointLocation", shared_path(spark, "stream")).option("path", folder).trigger(availableNow=True).start()
    out.awaitTermination()
    lines = spark.read.schema("partition int, offset bigint, event_type string, day string").json(folder).dropDuplicates(["partition", "offset"])
    return lines.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("partitions"), F.max("offset").alias("last"))


@query("SELECT e.event_id, count(DISTINCT strftime(p.ts, '%Y-%m-%d')) AS late FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'error' AND e.event_type = 'purchase' AND p.ts > e.ts AND p.ts <= e.ts + INTERVAL 24 HOURS GROUP BY 1")
def stm05_late_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that errors of the same user in the 24 hours after score anew, once for each day's trigger.

    A stream-stream interval join whose state the watermarks bound; (trigger, event) is handled once while it is remembered. How
    many files a batch takes (maxFilesPerTrigger) is the throttle.
    """
    rows = read_stream(spark, sf_dir, "events", "ts", files=50).withWatermark("ts", "1 day")
    e = rows.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("e_ts"))
    p = rows.where("event_type = 'error'").select(F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
    pairs = e.join(p, (F.col("user_id") == F.col("p_user")) & (F.col("p_ts") > F.col("e_ts")) & (F.col("p_ts") <= F.col("e_ts") + F.expr("interval 24 hours")))
    triggers = pairs.select("event_id", F.date_format("p_ts", "yyyy-MM-dd").alias("trigger"), "p_ts")
    once = triggers.dropDuplicatesWithinWatermark(["event_id", "trigger"])
    return collected(once.select("event_id", "trigger")).distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("late"))


# Events a trigger handles a tick, hours in which an event is open, and seconds in which (trigger, event) is remembered.
MOST_A_TICK, OPEN_S, MARK_S = 50, 86_400, 86_400
#: Seconds between ticks, and the least value of an error that triggers.
TICK_S, REMARKABLE = 300, 50.0
_GROUPS = 5


@query(
    f"""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, user_id % {_GROUPS} AS g FROM events), t AS (SELECT DISTINCT g, s // 21600 AS q FROM e WHERE event_type = 'error' AND value >= {REMARKABLE}),
c AS (SELECT concat(g, '@', q) AS trigger, event_id, q * 21600 AS due, CAST((row_number() OVER (PARTITION BY g, q ORDER BY s, event_id) - 1) // {MOST_A_TICK} AS INTEGER) AS tick FROM t JOIN e USING (g) WHERE event_type = 'purchase' AND s <= q * 21600 AND s > q * 21600 - {OPEN_S})
SELECT trigger, event_id, tick, due + tick * {TICK_S} AS at_s FROM c WHERE tick = 0 OR due + tick * {TICK_S} <= (SELECT max(s) FROM e WHERE event_type = 'error' AND value >= {REMARKABLE}) - 3600"""
)
def stm05_throttled_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late evidence scores the open events of its region anew: 50 a tick, oldest first, the others carried on, each once a trigger.

    Errors of REMARKABLE value trigger; those of one region and quarter of a day are deliveries of one trigger, which speaks to the
    purchases of the 24 hours before. The queue of a trigger is keyed state, its ticks are timers of event time.
    """
    with rocksdb(spark):
        return collected(throttled(triggered(spark, sf_dir), MOST_A_TICK, TICK_S, MARK_S))


def triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the triggers' stream: a trigger meets its open events once, however often it is delivered while it is remembered."""
    rows = read_stream(spark, sf_dir, "events", "ts").where((F.col("event_type") == "error") & (F.col("value") >= REMARKABLE)).withWatermark("ts", "1 hour")
    group, quarter = F.col("user_id") % _GROUPS, F.floor(F.unix_timestamp("ts") / 21600)
    triggers = rows.select("ts", group.alias("g"), F.concat(group, F.lit("@"), quarter).alias("trigger"), (quarter * 21600).alias("at_s"))
    triggers = triggers.dropDuplicatesWithinWatermark(["trigger"])  # a second delivery speaks to the same events, which have their marks
    opened = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("opened_s"), (F.col("user_id") % _GROUPS).alias("g"))
    opened = opened.withColumn("day", F.explode(F.array(F.floor(F.col("opened_s") / OPEN_S), F.floor(F.col("opened_s") / OPEN_S) + 1)))
    spoken = (F.col("opened_s") <= F.col("at_s")) & (F.col("opened_s") > F.col("at_s") - OPEN_S)
    return triggers.withColumn("day", F.floor(F.col("at_s") / OPEN_S)).join(opened, ["g", "day"]).where(spoken).select("trigger", "event_id", "opened_s", "at_s", "ts")


def _after(status: str, kind: str, value: float, level: float) -> str:
    """ACTIVE from the first report, ESCALATED once a value beats the last by half, RESOLVED by a signup."""
    return "RESOLVED" if kind == "signup" else "ESCALATED" if status != "NONE" and value > 1.5 * level else "ACTIVE" if status in ("NONE", "RESOLVED") else status


_REACHED = ("ACTIVE", "ESCALATED", "RESOLVED")
_STRETCH = "user_id bigint, part int, kind string, value double, level double, ends array<string>, moves array<bigint>"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each user's sorted rows in this part: the first row, the last value, and for each status after the first row the one at the end and the moves between."""
    part = TaskContext.get().partitionId()
    schema = pa.schema({"user_id": pa.int64(), "part": pa.int32(), "kind": pa.string(), "value": pa.float64(), "level": pa.float64(), "ends": pa.list_(pa.string()), "moves": pa.list_(pa.int64())})
    now: dict[str, Any] | None = None
    for batch in batches:
        done = []
        for user, kind, value in zip(*(batch.column(x).to_pylist() for x in ("user_id", "event_type", "value")), strict=True):
            value = float("nan") if value is None else value
            if now is None or now["user_id"] != user:
                if now is not None:
                    done.append(now)
                now = {"user_id": user, "part": part, "kind": kind, "value": value, "level": value, "ends": list(_REACHED), "moves": [0, 0, 0]}
                continue
            for i, status in enumerate(now["ends"]):
                now["ends"][i] = _after(status, kind, value, now["level"])
                now["moves"][i] += now["ends"][i] != status
            now["level"] = value
        yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now], schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each user's stretches in order, from status NONE."""
    for batch in batches:
        ends, counts = [], []
        for stretches in batch.column("stretches").to_pylist():
            status, level, moves = "NONE", 0.0, 0
            for s in stretches:
                first = _after(status, s["kind"], s["value"], level)
                i = _REACHED.index(first)
                moves += (first != status) + s["moves"][i]
                status, level = s["ends"][i], s["level"]
            ends.append(status)
            counts.append(moves)
        yield pa.RecordBatch.from_pydict({"user_id": batch.column("user_id"), "status": pa.array(ends, pa.string()), "moves": pa.array(counts, pa.int64())})


def lifecycle(rows: DataFrame) -> DataFrame:
    """user_id, status, moves (transitions) after all rows of each user in order of ts, event_id.

    Rows are sorted over all parts, so one user may fill many; a part gives one stretch a user, and those are joined in order.
    """
    keys = ["user_id", "ts", "event_id", "event_type", "value"]
    stretches = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_stretches, _STRETCH)
    whole = stretches.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("part", "kind", "value", "level", "ends", "moves"))).alias("stretches"))
    return whole.mapInArrow(_joined, "user_id bigint, status string, moves bigint")


@query()
def alr04_alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's alert after all events of the stream, by a keyed state machine over each user's events in order."""
    return lifecycle(collected(read_stream(spark, sf_dir, "events", "ts").select("user_id", "ts", "event_id", "event_type", "value")))


_XML = """concat('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>W-', c_custkey, '</identifier><sent>2024-01-01T00:00:00+05:30</sent><status>Actual</status><msgType>Alert</msgType><info><event>Flood</event><severity>', CASE c_custkey % 4 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Extreme' WHEN 2 THEN 'Bad' ELSE 'Minor' END, '</severity><expires>2024-01-02T00:00:00+05:30</expires><area><areaDesc>District ', c_custkey % 40, '</areaDesc><polygon>10,70 10,', 71 + c_custkey % 5, ' x,y 12,72</polygon></area></info><info><severity>Minor</severity></info></alert>')"""


@query("SELECT c_custkey, concat('W-', c_custkey) AS identifier, CASE c_custkey % 4 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Extreme' WHEN 2 THEN 'Unknown' ELSE 'Minor' END AS severity, 1704047400 AS sent_s, 1704133800 AS expires_s, concat('District ', c_custkey % 40) AS area, 4 AS vertices, 71 + c_custkey % 5 AS east FROM customer")
def src04_cap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAP documents made from customers, parsed: the first info block counts, unknown severities and bad vertices are handled."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: the keys are few bytes, their documents dear to parse
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition(parts, "c_custkey").select("c_custkey", F.expr(_XML).alias("xml"))
    return cap_alerts(rows, "xml", "a").select("c_custkey", "a.identifier", "a.severity", "a.sent_s", "a.expires_s", "a.area", F.size("a.ring").alias("vertices"), F.col("a.ring")[1]["lng"].cast("bigint").alias("east"))


@query("SELECT c_custkey, concat('g', c_custkey) AS guid, 'Rain' AS title, 1704067200 AS at_s FROM customer UNION ALL SELECT c_custkey, concat('h', c_custkey), 'Fog', NULL FROM customer")
def src05_rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.expr("concat('<rss><channel><item><guid>g', c_custkey, '</guid><title>Rain</title><pubDate>Mon, 01 Jan 2024 05:30:00 +0530</pubDate></item><item><guid>h', c_custkey, '</guid><title>Fog</title><pubDate>soon</pubDate></item></channel></rss>')")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.inline(rss_items(xml)))


@query("SELECT s_suppkey, round((s_suppkey % 40) * 1.852, 1) AS wind_kmh, CASE WHEN s_suppkey % 3 = 0 THEN round(55 * 1.852, 1) END AS gust_kmh, CASE WHEN s_suppkey % 5 = 0 THEN 10000 ELSE 100 * (1 + s_suppkey % 50) END AS visibility_m, -(s_suppkey % 9) AS temperature_c, 'TS,RA+,VCTS' AS codes, s_suppkey % 2 = 0 AS convective FROM supplier")
def src09_metar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METAR texts made from suppliers, parsed; what follows the trend group does not count."""
    raw = F.expr("concat('METAR VIDP 221530Z 350', lpad(s_suppkey % 40, 2, '0'), CASE WHEN s_suppkey % 3 = 0 THEN 'G55' ELSE '' END, 'KT ', CASE WHEN s_suppkey % 5 = 0 THEN '9999' ELSE lpad(100 * (1 + s_suppkey % 50), 4, '0') END, ' +TSRA VCTS ', CASE WHEN s_suppkey % 2 = 0 THEN 'FEW030CB' ELSE 'SCT100' END, ' M0', s_suppkey % 9, '/M10 Q1008 TEMPO 0500 FG=')")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", metar(raw).alias("m"))
    return rows.select("s_suppkey", "m.wind_kmh", "m.gust_kmh", "m.visibility_m", "m.temperature_c", F.array_join("m.weather_codes", ",").alias("codes"), "m.convective")


@query("SELECT p_partkey, h AS hour, CASE h WHEN 1 THEN p_size * 1.0 WHEN 2 THEN NULL ELSE p_size + 1.0 END AS rain FROM part, (SELECT unnest([1, 2, 3]) AS h)")
def src12_series_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("hour"), F.array(F.col("p_size").cast("double"), F.lit(None).cast("double"), F.col("p_size") + 1.0).alias("rain"))
    return hourly(p, "hour", ["rain"])


_FETCHED = {"identifier": "l_orderkey", "fetched_s": "l_linenumber", "polygon_status": "CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'absent' ELSE 'ok' END"}
_POLYGON = "CASE WHEN (l_orderkey + l_linenumber) % 4 >= 2 THEN concat('p', l_linenumber) END"


@query(
    f"""WITH f AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FETCHED.items())}, {_POLYGON} AS polygon FROM lineitem), k AS (SELECT identifier, arg_max(polygon_status, fetched_s) AS s, max(fetched_s) AS at FROM f WHERE polygon_status <> 'failed' GROUP BY 1)
SELECT n.identifier, n.revision, CASE WHEN k.s = 'ok' THEN concat('p', k.at) END AS polygon FROM (SELECT identifier, max(fetched_s) AS revision FROM f GROUP BY 1) n LEFT JOIN k USING (identifier)"""
)
def src07_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revision of each warning and its polygon: one that was fetched replaces the old, an absent one clears it, a failed fetch leaves it."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*(f"{e} AS {c}" for c, e in _FETCHED.items()), f"{_POLYGON} AS polygon")
    return latest_revision(rows).select("identifier", F.col("fetched_s").alias("revision"), "polygon")


@query("SELECT l_suppkey, l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def src10_insert_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey").distinct().join(known, "l_orderkey", "left_anti").select("l_suppkey", "l_orderkey")
