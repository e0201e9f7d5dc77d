"""The alert engine: rules, fingerprints, decisions and the latest alert of each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.alerting import COOLDOWN_S, CONFIDENCE_STEP, TTL_S, VERSION_STEP
from ..operators.fusion import SEVERITIES
from ..sources.bindings import DAY, cte, frame
from ..streaming.runner import collected, read_stream
from ..streaming.state import alert_lives, rocksdb
from .registry import query

# The default rules (id, priority, event types, least severity, confidence and number of sources).
RULES = [
    ("RULE_CRITICAL_EVENT", 10, None, 3, 0.90, 2),
    ("RULE_HIGH_CONFIDENCE_FLOOD", 20, ["URBAN_FLOOD", "RIVER_BREACH"], 2, 0.70, 2),
    ("RULE_GENERAL_THREAT", 50, None, 1, 0.80, 3),
]


def severity_rank(c: str):
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col(c)) - 1


def matched(events: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """The events with rule_id, the applicable rule of least priority (null if none). The rules are a literal: a row finds its own.

    Only published and approved events are matched.
    """
    eligible = F.col("review_status").isin("AUTO_PUBLISHED", "HUMAN_APPROVED")
    choices = []
    for rule_id, priority, types, severity, confidence, sources in rules:
        fits = (severity_rank("severity") >= severity) & (F.col("confidence") >= confidence) & (F.col("sources") >= sources)
        if types is not None:
            fits &= F.col("event_type").isin(types)
        choices.append(F.when(fits, F.struct(F.lit(priority).alias("priority"), F.lit(rule_id).alias("rule_id"))))
    return events.withColumn("rule_id", F.when(eligible, F.array_min(F.array(*choices))["rule_id"]))


def eligible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "verified").select("id", "event_type", "severity", "confidence", "review_status", (F.col("id") % 5).alias("sources"))


_RULE = """CASE WHEN review_status NOT IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED') THEN NULL WHEN severity = 'CRITICAL' AND confidence >= 0.9 AND id % 5 >= 2 THEN 'RULE_CRITICAL_EVENT'
 WHEN event_type IN ('URBAN_FLOOD', 'RIVER_BREACH') AND severity IN ('HIGH', 'CRITICAL') AND confidence >= 0.7 AND id % 5 >= 2 THEN 'RULE_HIGH_CONFIDENCE_FLOOD' WHEN severity <> 'LOW' AND confidence >= 0.8 AND id % 5 >= 3 THEN 'RULE_GENERAL_THREAT' END"""


@query(cte("verified") + f"SELECT id, {_RULE} AS rule_id FROM verified")
def alr01_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(eligible_events(spark, sf_dir)).select("id", "rule_id")


@query(cte("verified") + f"SELECT id, sha256(concat('EV-', id, '|', {_RULE})) AS fingerprint FROM verified WHERE {_RULE} IS NOT NULL")
def alr02_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched(eligible_events(spark, sf_dir)).where("rule_id is not null")
    return m.select("id", F.sha2(F.concat_ws("|", F.concat(F.lit("EV-"), "id"), "rule_id"), 256).alias("fingerprint"))


_STATE = "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'ESCALATED' WHEN 3 THEN 'RESOLVED' WHEN 4 THEN 'EXPIRED' ELSE 'ACKNOWLEDGED' END"


def decision(now_s):
    """What to do with the latest alert of an event (state, old_severity, old_confidence, old_sources, updated_s) once its rule is known.

    A severity or confidence rise escalates an open alert; LEVEL_2, by confidence, wins over LEVEL_1.
    """
    live = F.col("state").isin("ACTIVE", "ESCALATED", "ACKNOWLEDGED")
    worse = severity_rank("severity") > F.col("old_severity")
    surer = F.round(F.col("confidence") - F.col("old_confidence"), 6) >= CONFIDENCE_STEP
    changed = (F.col("sources") > F.col("old_sources")) | (F.col("confidence") != F.col("old_confidence"))
    return (
        F.when(F.col("rule_id").isNull(), F.when(live, "RESOLVE").otherwise("NO_ACTION"))
        .when(F.col("state").isNull(), "CREATE")
        .when(~live, F.when(now_s - F.col("updated_s") > COOLDOWN_S, "CREATE").otherwise("NO_ACTION"))
        .when(surer, "ESCALATE_LEVEL_2")
        .when(worse, "ESCALATE_LEVEL_1")
        .when(changed, "UPDATE")
        .otherwise("NO_ACTION")
    )


@query(
    cte("verified")
    + f""", m AS (SELECT id, {_RULE} AS rule_id, {_STATE} AS state, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END AS rank, id % 3 AS old_rank, confidence, ((id * 41) % 1001) / 1000.0 AS old_confidence, id % 5 AS sources, id % 4 AS old_sources, id % 601 AS age FROM verified)
SELECT id, CASE WHEN rule_id IS NULL THEN CASE WHEN state IN ('ACTIVE', 'ESCALATED', 'ACKNOWLEDGED') THEN 'RESOLVE' ELSE 'NO_ACTION' END WHEN state IS NULL THEN 'CREATE' WHEN state IN ('RESOLVED', 'EXPIRED') THEN CASE WHEN age > 300 THEN 'CREATE' ELSE 'NO_ACTION' END
 WHEN round(confidence - old_confidence, 6) >= 0.1 THEN 'ESCALATE_LEVEL_2' WHEN rank > old_rank THEN 'ESCALATE_LEVEL_1' WHEN sources > old_sources OR confidence <> old_confidence THEN 'UPDATE' ELSE 'NO_ACTION' END AS decision FROM m"""
)
def alr03_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    m = matched(eligible_events(spark, sf_dir))
    rows = m.withColumn("state", F.expr(_STATE)).withColumn("old_severity", i % 3).withColumn("old_confidence", (i * 41 % 1001) / 1000).withColumn("old_sources", i % 4).withColumn("updated_s", -(i % 601))
    return rows.select("id", decision(F.lit(0)).alias("decision"))


@query(
    cte("readings")
    + ", a AS (SELECT order_id, line, recorded_s, line % 3 <> 0 AS active FROM readings) SELECT order_id, line FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY active DESC, recorded_s DESC, line) AS n FROM a) WHERE n = 1"
)
def alr06_latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest active alert of each event, else the newest of any state."""
    a = frame(spark, sf_dir, "readings").select("order_id", "line", "recorded_s", (F.col("line") % 3 != 0).alias("active"))
    w = Window.partitionBy("order_id").orderBy(F.desc("active"), F.desc("recorded_s"), "line")
    return a.withColumn("n", F.row_number().over(w)).where("n = 1").select("order_id", "line")


@query(cte("readings") + "SELECT order_id, line, CASE WHEN n = 1 THEN 'new' WHEN rainfall_mm IS DISTINCT FROM before THEN 'updated' ELSE 'seen' END AS kind FROM (SELECT order_id, line, rainfall_mm, lag(rainfall_mm) OVER w AS before, row_number() OVER w AS n FROM readings WINDOW w AS (PARTITION BY order_id ORDER BY line, station, recorded_s, rainfall_mm NULLS FIRST))")
def alr07_version_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("order_id").orderBy("line", "station", "recorded_s", "rainfall_mm")
    rows = frame(spark, sf_dir, "readings").select("order_id", "line", "rainfall_mm", F.lag("rainfall_mm").over(w).alias("before"), F.row_number().over(w).alias("n"))
    return rows.select("order_id", "line", F.when(F.col("n") == 1, "new").when(~F.col("rainfall_mm").eqNullSafe(F.col("before")), "updated").otherwise("seen").alias("kind"))


#: Minutes by which the clock of alerts trails the newest version, so that versions may come out of order.
CLOCK_MIN = 60
#: Versions of events, as expressions that both engines read: an event is a district's day, each report a version of it.
VERSIONS = {
    "code": f"concat('EV-', user_id - user_id % 20, '-', at_s - at_s % {DAY})",
    "version": "event_id",
    "severity": "CAST((event_id * 7 + user_id) % 4 AS INT)",
    "confidence": "(600 + event_id * 37 % 401) / 1e3",
    "sources": "CAST(event_id * 3 % 6 AS INT)",
    "review_status": "CASE WHEN event_id % 9 = 4 THEN 'QUARANTINED' WHEN event_id % 2 = 0 THEN 'AUTO_PUBLISHED' ELSE 'HUMAN_APPROVED' END",
    "event_type": "CASE WHEN (user_id - user_id % 20) % 40 = 0 THEN 'URBAN_FLOOD' ELSE 'HEATWAVE' END",
}


def versions(rows: DataFrame) -> DataFrame:
    """A stream of reports (event_id, user_id, ts) as versions of events, each with the rule that it matches (null for none)."""
    v = rows.withColumn("at_s", F.unix_timestamp("ts")).selectExpr("ts", "at_s", *(f"{e} AS {c}" for c, e in VERSIONS.items()))
    named = v.withColumn("rank", F.col("severity")).withColumn("severity", F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity") + 1))
    return matched(named).select("code", "version", "at_s", "ts", F.col("rank").alias("severity"), "confidence", "sources", "review_status", F.col("rule_id").alias("rule"))


def lives(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a stream of versions does to the alerts of its events, once all of it was read."""
    with rocksdb(spark):
        return collected(alert_lives(versions(rows.withWatermark("ts", f"{CLOCK_MIN} minutes"))))


_LIVE = "status IN ('ACTIVE', 'ESCALATED', 'ACKNOWLEDGED')"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events),
v AS (SELECT at_s, {', '.join(f'{x} AS {c}' for c, x in VERSIONS.items())} FROM e),
r AS (SELECT code, version, at_s, severity, confidence, sources, review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED') AS fit, (severity >= 3 AND confidence >= 0.9 AND sources >= 2) OR (event_type = 'URBAN_FLOOD' AND severity >= 2 AND confidence >= 0.7 AND sources >= 2) OR (severity >= 1 AND confidence >= 0.8 AND sources >= 3) AS rule, row_number() OVER (PARTITION BY code ORDER BY at_s, version) AS n FROM v),
s AS (
  SELECT code, 0 AS n, CAST(NULL AS BIGINT) AS version, CAST(NULL AS BIGINT) AS at_s, CAST(NULL AS VARCHAR) AS class, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS INT) AS l_sev, CAST(NULL AS DOUBLE) AS l_conf, CAST(NULL AS INT) AS l_src,
    CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INT) AS a_sev, CAST(NULL AS DOUBLE) AS a_conf, CAST(NULL AS INT) AS a_src, CAST(NULL AS BIGINT) AS upd, CAST(NULL AS BIGINT) AS exp, 0 AS alerts FROM r GROUP BY code
  UNION ALL
  SELECT code, n, version, at_s, class, action, ended, CASE WHEN class = 'seen' THEN l_sev ELSE severity END, CASE WHEN class = 'seen' THEN l_conf ELSE confidence END, CASE WHEN class = 'seen' THEN l_src ELSE sources END,
    CASE WHEN action = 'CREATE' THEN 'ACTIVE' WHEN starts_with(action, 'ESC') THEN 'ESCALATED' WHEN action = 'RESOLVE' THEN 'RESOLVED' ELSE status END, CASE WHEN action = 'CREATE' OR starts_with(action, 'ESC') THEN severity ELSE a_sev END,
    CASE WHEN action = 'CREATE' OR action = 'UPDATE' OR starts_with(action, 'ESC') THEN confidence ELSE a_conf END, CASE WHEN action = 'CREATE' OR action = 'UPDATE' OR starts_with(action, 'ESC') THEN sources ELSE a_src END,
    CASE WHEN action <> 'NO_ACTION' THEN at_s ELSE upd END, CASE WHEN action IN ('CREATE', 'UPDATE') THEN at_s + {TTL_S} ELSE exp END, CASE WHEN action = 'CREATE' THEN alerts + 1 ELSE alerts END
  FROM (
    SELECT *, CASE WHEN class = 'seen' OR NOT fit THEN 'NO_ACTION' WHEN NOT rule THEN CASE WHEN {_LIVE} THEN 'RESOLVE' ELSE 'NO_ACTION' END WHEN status IS NULL THEN 'CREATE' WHEN NOT {_LIVE} THEN CASE WHEN at_s - upd > {COOLDOWN_S} THEN 'CREATE' ELSE 'NO_ACTION' END
      WHEN round(confidence - a_conf, 6) >= {CONFIDENCE_STEP} THEN 'ESCALATE_LEVEL_2' WHEN severity > a_sev THEN 'ESCALATE_LEVEL_1' WHEN sources > a_src OR confidence <> a_conf THEN 'UPDATE' ELSE 'NO_ACTION' END AS action
    FROM (
      SELECT s.code, r.n, r.version, r.at_s, r.severity, r.confidence, r.sources, r.fit, r.rule, l_sev, l_conf, l_src, a_sev, a_conf, a_src, exp, alerts,
        CASE WHEN l_sev IS NULL THEN 'new' WHEN r.severity <> l_sev OR round(abs(r.confidence - l_conf), 6) >= {VERSION_STEP} OR r.sources > l_src THEN 'updated' ELSE 'seen' END AS class,
        CASE WHEN {_LIVE} AND exp <= r.at_s THEN exp END AS ended, CASE WHEN {_LIVE} AND exp <= r.at_s THEN 'EXPIRED' ELSE status END AS status, CASE WHEN {_LIVE} AND exp <= r.at_s THEN exp ELSE upd END AS upd
      FROM s JOIN r ON r.code = s.code AND r.n = s.n + 1
    )
  )
), last AS (SELECT code, max(n) AS n FROM s GROUP BY 1)
SELECT code, version, at_s, class, action, status, alerts FROM s WHERE n > 0
UNION ALL SELECT code, NULL, ended, NULL, 'EXPIRE', 'EXPIRED', alerts - CASE WHEN action = 'CREATE' THEN 1 ELSE 0 END FROM s WHERE ended IS NOT NULL
UNION ALL SELECT code, NULL, exp, NULL, 'EXPIRE', 'EXPIRED', alerts FROM s JOIN last USING (code, n) WHERE {_LIVE} AND exp * 1000 <= (SELECT max(epoch_ms(ts)) FROM events) - {CLOCK_MIN} * 60000"""
)
def alr04_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of every event's alert by one keyed operator with a timer: version class, decision, cooldown and expiry, as a history.

    A row a version, and one for each alert that nothing updated in time; the clock is the newest version's time less CLOCK_MIN.
    """
    return lives(spark, read_stream(spark, sf_dir, "events", "ts").select("event_id", "user_id", "ts"))
