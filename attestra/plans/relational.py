"""Filters, joins, aggregates, sorts and set operations of the dashboard, search and facet queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import EventFilter, clusterable, contains, day_bound, in_force, report_status
from ..sources.bindings import AS_OF, DAY, HOUR, cte, flags, frame
from ..sources.tables import saved
from .registry import query

OPEN = ("AUTO_PUBLISHED", "HUMAN_APPROVED")
#: Tasks that one event's reports are dealt to, where they are shuffled.
SALTS = 8
#: The driver's orders lie years before its events, so windows over verified events are read at the end of the orders.
EVENTS_AS_OF = 915_148_800
STATUS_SQL = """CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN verified_id IS NOT NULL THEN 'fused' WHEN stale THEN 'stale'
  WHEN source_type IN ('SOCIAL_MEDIA', 'NEWS_MEDIA') AND (coalesce(place_precision, 'gps') IN ('state', 'none') OR list_contains(string_split(coalesce(flags_csv, ''), ','), 'not_an_observation')) THEN 'held'
  ELSE 'unfused' END"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").withColumn("flags", flags())


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "verified")


def named_only(events: DataFrame, rows: DataFrame) -> DataFrame:
    """The events (verified_id) that rows name, as a table of known size."""
    named = rows.select("verified_id").where("verified_id is not null").distinct()
    return saved(events.join(named, "verified_id", "left_semi"), "named-events")


def change_pct(now: Column, before: Column) -> Column:
    """Change in per cent; from nothing, 100 for any growth and 0 for none."""
    return F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise(F.round((now - before) / before * 100, 1))


_PCT = "CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 100.0 ELSE 0.0 END ELSE round(({a} - {b}) * 100.0 / {b}, 1) END"


def _pct(a: str, b: str) -> str:
    return _PCT.format(a=a, b=b)


@query(
    cte("reports", "verified", "warnings")
    + f""", r AS (SELECT count(*) AS total_reports, count(*) FILTER (WHERE source_type = 'CITIZEN_APP') AS citizen_reports,
  count(*) FILTER (WHERE at_s >= {AS_OF - DAY}) AS a, count(*) FILTER (WHERE at_s >= {AS_OF - 2 * DAY} AND at_s < {AS_OF - DAY}) AS b,
  count(*) FILTER (WHERE at_s >= {AS_OF - DAY} AND source_type = 'CITIZEN_APP') AS c, count(*) FILTER (WHERE at_s >= {AS_OF - 2 * DAY} AND at_s < {AS_OF - DAY} AND source_type = 'CITIZEN_APP') AS d FROM reports),
e AS (SELECT count(*) FILTER (WHERE review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED')) AS verified_events, count(*) FILTER (WHERE review_status IN ('PENDING_HUMAN_REVIEW', 'QUARANTINED')) AS awaiting_review,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_events FROM verified WHERE review_status <> 'REJECTED'),
w AS (SELECT count(*) AS active_alerts FROM warnings WHERE expires_s IS NULL OR expires_s > {AS_OF})
SELECT total_reports, {_pct("a", "b")} AS total_reports_delta_pct, citizen_reports, {_pct("c", "d")} AS citizen_reports_delta_pct, verified_events, critical_events, awaiting_review, active_alerts FROM r, e, w"""
)
def agg01_kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's summary: one pass over each table."""
    now, before = F.col("at_s") >= AS_OF - DAY, (F.col("at_s") >= AS_OF - 2 * DAY) & (F.col("at_s") < AS_OF - DAY)
    citizen = F.col("source_type") == "CITIZEN_APP"
    r = frame(spark, sf_dir, "reports").agg(
        F.count(F.lit(1)).alias("total_reports"),
        change_pct(F.count_if(now), F.count_if(before)).alias("total_reports_delta_pct"),
        F.count_if(citizen).alias("citizen_reports"),
        change_pct(F.count_if(now & citizen), F.count_if(before & citizen)).alias("citizen_reports_delta_pct"),
    )
    status = F.col("review_status")
    e = verified(spark, sf_dir).where(status != "REJECTED").agg(
        F.count_if(status.isin(*OPEN)).alias("verified_events"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_events"), F.count_if(status.isin("PENDING_HUMAN_REVIEW", "QUARANTINED")).alias("awaiting_review")
    )
    w = frame(spark, sf_dir, "warnings").agg(F.count_if(F.col("expires_s").isNull() | (F.col("expires_s") > AS_OF)).alias("active_alerts"))
    return r.join(e).join(w)  # one row each


@query(
    cte("reports")
    + """, d AS (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cm FROM reports WHERE duplicate_of IS NULL)
SELECT CASE WHEN cm < 15 THEN '< 15 cm' WHEN cm < 30 THEN '15 - 30 cm' WHEN cm < 60 THEN '30 - 60 cm' WHEN cm < 120 THEN '60 - 120 cm' ELSE '> 120 cm' END AS bucket, count(*) AS n FROM d WHERE cm >= 0 GROUP BY 1"""
)
def agg02_depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cm = F.col("cm")
    rows = frame(spark, sf_dir, "reports").where("duplicate_of is null").select(F.get_json_object("props", "$.k").try_cast("double").alias("cm")).where(cm >= 0)
    bucket = F.when(cm < 15, "< 15 cm").when(cm < 30, "15 - 30 cm").when(cm < 60, "30 - 60 cm").when(cm < 120, "60 - 120 cm").otherwise("> 120 cm")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("cm").alias("low")).orderBy("low").drop("low")


@query(
    cte("verified")
    + """SELECT district, state, count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MODERATE') AS moderate,
 count(*) FILTER (WHERE severity NOT IN ('CRITICAL', 'HIGH', 'MODERATE')) AS low FROM verified WHERE review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED') AND district IS NOT NULL GROUP BY 1, 2 ORDER BY total DESC, district, state LIMIT 10"""
)
def agg03_top_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    rows = verified(spark, sf_dir).where(F.col("review_status").isin(*OPEN) & F.col("district").isNotNull())
    out = rows.groupBy("district", "state").agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(s == x).alias(x.lower()) for x in ("CRITICAL", "HIGH", "MODERATE")), F.count_if(~s.isin("CRITICAL", "HIGH", "MODERATE")).alias("low")
    )
    return out.orderBy(F.desc("total"), "district", "state").limit(10)


@query(
    cte("verified")
    + """SELECT CASE WHEN confidence < 0.2 THEN '0.0 - 0.2' WHEN confidence < 0.4 THEN '0.2 - 0.4' WHEN confidence < 0.6 THEN '0.4 - 0.6' WHEN confidence < 0.8 THEN '0.6 - 0.8' ELSE '0.8 - 1.0' END AS bucket, count(*) AS n,
 count(*) FILTER (WHERE review_status = 'AUTO_PUBLISHED') AS auto_published, count(*) FILTER (WHERE review_status = 'HUMAN_APPROVED') AS human_approved FROM verified WHERE review_status <> 'REJECTED' GROUP BY 1"""
)
def agg04_confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    bucket = F.when(c < 0.2, "0.0 - 0.2").when(c < 0.4, "0.2 - 0.4").when(c < 0.6, "0.4 - 0.6").when(c < 0.8, "0.6 - 0.8").otherwise("0.8 - 1.0")
    rows = verified(spark, sf_dir).where("review_status <> 'REJECTED'").groupBy(bucket.alias("bucket"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_status") == "AUTO_PUBLISHED").alias("auto_published"), F.count_if(F.col("review_status") == "HUMAN_APPROVED").alias("human_approved"), F.min(c).alias("low"))
    return out.orderBy("low").drop("low")


@query(cte("verified") + f"SELECT event_type, severity, count(*) AS n FROM verified WHERE review_status <> 'REJECTED' AND verified_s >= {EVENTS_AS_OF - 168 * HOUR} GROUP BY 1, 2")
def agg05_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EventFilter(time_range="7d", as_of=EVENTS_AS_OF).apply(verified(spark, sf_dir)).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    cte("verified")
    + """SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM verified WHERE review_status <> 'REJECTED' GROUP BY 2
UNION ALL SELECT 'status', review_status, count(*) FROM verified GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM verified WHERE review_status <> 'REJECTED' GROUP BY 2
UNION ALL SELECT 'verdict', verdict, count(*) FROM verified WHERE review_status <> 'REJECTED' AND verdict IS NOT NULL GROUP BY 2
UNION ALL SELECT 'state', state, count(*) FROM verified WHERE review_status <> 'REJECTED' AND state IS NOT NULL GROUP BY 2"""
)
def agg06_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets in one pass: each event counts once for each facet that it has a value in."""
    shown = F.col("review_status") != "REJECTED"
    facet = lambda name, c, ok: F.struct(F.lit(name).alias("facet"), F.when(ok, F.col(c)).alias("value"))
    each = F.array(facet("type", "event_type", shown), facet("status", "review_status", F.lit(True)), facet("severity", "severity", shown), facet("verdict", "verdict", shown), facet("state", "state", shown))
    return verified(spark, sf_dir).select(F.inline(each)).where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    cte("verified")
    + """, d AS (SELECT state, district, count(*) AS n FROM verified WHERE review_status <> 'REJECTED' AND state IS NOT NULL GROUP BY 1, 2)
SELECT state, CAST(sum(n) AS BIGINT) AS n, array_to_string(list(concat(district, '=', n) ORDER BY n DESC, district) FILTER (WHERE district IS NOT NULL), ';') AS districts FROM d GROUP BY 1"""
)
def agg06_state_district_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States with their districts nested, the largest first; an unknown district counts in its state only."""
    d = verified(spark, sf_dir).where("review_status <> 'REJECTED' and state is not null").groupBy("state", "district").agg(F.count(F.lit(1)).alias("n"))
    inner = F.sort_array(F.collect_list(F.when(F.col("district").isNotNull(), F.struct((-F.col("n")).alias("m"), "district"))))
    text = F.array_join(F.transform(inner, lambda x: F.concat(x["district"], F.lit("="), (-x["m"]).cast("string"))), ";")
    return d.groupBy("state").agg(F.sum("n").alias("n"), text.alias("districts"))


@query(
    cte("reports")
    + f"""SELECT source_type, count(*) AS total, count(*) FILTER (WHERE at_s >= {AS_OF - DAY}) AS last_day, max(at_s) AS newest_s,
 CASE WHEN {AS_OF} - max(at_s) <= 1800 THEN 'ok' WHEN {AS_OF} - max(at_s) <= 86400 THEN 'stale' ELSE 'failing' END AS feed_state FROM reports GROUP BY 1"""
)
def agg07_feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.lit(AS_OF) - F.max("at_s")
    state = F.when(age <= 1800, "ok").when(age <= DAY, "stale").otherwise("failing")
    return frame(spark, sf_dir, "reports").groupBy("source_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("at_s") >= AS_OF - DAY).alias("last_day"), F.max("at_s").alias("newest_s"), state.alias("feed_state"))


@query(
    cte("reports", "verified")
    + """SELECT r.source_type, coalesce(r.place_precision, 'gps') AS place_precision, count(*) AS reports, count(*) FILTER (WHERE v.review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED')) AS approved,
 count(*) FILTER (WHERE v.review_status = 'REJECTED') AS rejected, count(*) FILTER (WHERE coalesce(flags_csv, '') <> '') AS flagged FROM reports r LEFT JOIN verified v ON v.id = r.verified_id GROUP BY 1, 2"""
)
def agg09_source_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports are counted by event first, so that one event's reports, or those of none, meet it as few rows."""
    kind = ["source_type", F.coalesce("place_precision", F.lit("gps")).alias("place_precision")]
    r = reports(spark, sf_dir).groupBy("verified_id", *kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("flags") > 0).alias("flagged"))
    v = verified(spark, sf_dir).select(F.col("id").alias("verified_id"), "review_status")
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    status = F.col("review_status")
    return (
        r.join(named_only(v, r), "verified_id", "left")
        .groupBy("source_type", "place_precision")
        .agg(F.sum("n").alias("reports"), of(status.isin(*OPEN)).alias("approved"), of(status == "REJECTED").alias("rejected"), F.sum("flagged").alias("flagged"))
    )


@query(
    cte("reports", "verified")
    + """SELECT r.district AS publisher, count(*) AS reports, count(DISTINCT v.id) FILTER (WHERE v.review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED')) AS events FROM reports r LEFT JOIN verified v ON v.id = r.verified_id
 WHERE r.district IS NOT NULL GROUP BY 1 ORDER BY reports DESC, publisher LIMIT 50"""
)
def agg10_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verified(spark, sf_dir).select(F.col("id").alias("verified_id"), "review_status")
    rows = frame(spark, sf_dir, "reports").where("district is not null").join(v, "verified_id", "left")
    out = rows.groupBy(F.col("district").alias("publisher")).agg(F.count(F.lit(1)).alias("reports"), F.countDistinct(F.when(F.col("review_status").isin(*OPEN), F.col("verified_id"))).alias("events"))
    return out.orderBy(F.desc("reports"), "publisher").limit(50)


@query(cte("reports") + "SELECT reporter, count(*) AS reports, count(*) FILTER (WHERE coalesce(flags_csv, '') <> '') AS flagged FROM reports GROUP BY 1 ORDER BY reports DESC, reporter LIMIT 20")
def agg11_reporter_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy("reporter").agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.size("flags") > 0).alias("flagged")).orderBy(F.desc("reports"), "reporter").limit(20)


@query(cte("verified") + "SELECT state AS operator, count(*) AS decisions, count(*) FILTER (WHERE review_status = 'HUMAN_APPROVED') AS approved, count(*) FILTER (WHERE review_status = 'REJECTED') AS rejected, max(verified_s) AS last_s FROM verified GROUP BY 1")
def agg12_operator_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("review_status")
    return verified(spark, sf_dir).groupBy(F.col("state").alias("operator")).agg(F.count(F.lit(1)).alias("decisions"), F.count_if(s == "HUMAN_APPROVED").alias("approved"), F.count_if(s == "REJECTED").alias("rejected"), F.max("verified_s").alias("last_s"))


@query(
    cte("reports")
    + """SELECT count(*) AS total, count(*) FILTER (WHERE verified_id IS NOT NULL) AS fused, count(*) FILTER (WHERE verified_id IS NULL AND duplicate_of IS NULL) AS unfused, count(*) FILTER (WHERE duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (WHERE coalesce(flags_csv, '') <> '') AS flagged FROM reports"""
)
def agg13_pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused, duplicate = F.col("verified_id").isNotNull(), F.col("duplicate_of").isNotNull()
    return reports(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(fused).alias("fused"), F.count_if(~fused & ~duplicate).alias("unfused"), F.count_if(duplicate).alias("duplicates"), F.count_if(F.size("flags") > 0).alias("flagged"))


@query(
    cte("verified")
    + """SELECT id, concat(upper(substr(event_type, 1, 3)), '-', strftime(to_timestamp(verified_s) AT TIME ZONE 'UTC', '%Y%m%d'), '-', lpad(CAST(row_number() OVER (PARTITION BY event_type, verified_s // 86400 ORDER BY id) AS VARCHAR), 3, '0')) AS day_code FROM verified"""
)
def agg21_day_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("verified_s") / DAY)
    n = F.row_number().over(Window.partitionBy("event_type", day).orderBy("id"))
    return verified(spark, sf_dir).select("id", F.concat_ws("-", F.upper(F.substring("event_type", 1, 3)), F.date_format(F.timestamp_seconds("verified_s"), "yyyyMMdd"), F.lpad(n.cast("string"), 3, "0")).alias("day_code"))


@query(
    cte("verified")
    + "SELECT review_status AS status, severity, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.7) AS active, CAST(grouping(severity) AS BIGINT) + 2 * CAST(grouping(review_status) AS BIGINT) AS level FROM verified GROUP BY ROLLUP (review_status, severity)"
)
def agg22_alert_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and severity, by status, and in all. The subtotals are an extension."""
    out = verified(spark, sf_dir).withColumnRenamed("review_status", "status").rollup("status", "severity")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("active"), F.grouping_id().alias("level"))


@query(
    cte("verified")
    + "SELECT event_type, "
    + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MODERATE", "LOW"))
    + " FROM verified WHERE review_status <> 'REJECTED' GROUP BY 1"
)
def agg23_hazard_severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["CRITICAL", "HIGH", "MODERATE", "LOW"]
    out = verified(spark, sf_dir).where("review_status <> 'REJECTED'").groupBy("event_type").pivot("severity", names).count()
    return out.select("event_type", *(F.coalesce(s, F.lit(0)).alias(s.lower()) for s in names))


@query(
    cte("verified")
    + """, g AS (SELECT state, count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MODERATE') AS moderate FROM verified WHERE review_status <> 'REJECTED' GROUP BY 1)
SELECT state, total, critical, high, moderate, CAST(floor((3 * critical + 2 * high + moderate) * 100.0 / (3 * total) + 0.5) AS BIGINT) AS risk FROM g"""
)
def agg24_state_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    g = verified(spark, sf_dir).where("review_status <> 'REJECTED'").groupBy("state").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(s == x.upper()).alias(x) for x in ("critical", "high", "moderate")))
    return g.withColumn("risk", F.floor((3 * F.col("critical") + 2 * F.col("high") + F.col("moderate")) * 100.0 / (3 * F.col("total")) + 0.5))


@query(cte("reports") + "SELECT district, min(observed_s) AS first_s, count(*) AS n FROM reports WHERE observed_s IS NOT NULL GROUP BY 1 HAVING min(observed_s) <= 1704153600")
def agg26_having_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "reports").where("observed_s is not null").groupBy("district").agg(F.min("observed_s").alias("first_s"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("first_s") <= 1_704_153_600)


@query(cte("reports") + f"SELECT count(*) AS backlog, coalesce({AS_OF} - min(at_s), 0) AS oldest_age_s FROM reports WHERE verified_id IS NULL")
def agg27_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "reports").where(F.col("verified_id").isNull())
    return rows.agg(F.count(F.lit(1)).alias("backlog"), F.coalesce(F.lit(AS_OF) - F.min("at_s"), F.lit(0)).alias("oldest_age_s"))


@query(
    cte("reports")
    + """, x AS (SELECT coalesce(hazard, 'none') AS gold, CASE WHEN id % 10 < 8 THEN coalesce(hazard, 'none') WHEN id % 10 = 8 THEN 'RAINFALL' ELSE 'FOG' END AS guess FROM reports),
c AS (SELECT k AS label, count(*) FILTER (WHERE gold = k AND guess = k) AS tp, count(*) FILTER (WHERE gold <> k AND guess = k) AS fp, count(*) FILTER (WHERE gold = k AND guess <> k) AS fn FROM x, (SELECT DISTINCT gold AS k FROM x UNION SELECT DISTINCT guess FROM x) GROUP BY 1)
SELECT label, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END, 6) AS precision_, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c"""
)
def agg29_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each label; every row counts once for its true and once for its guessed label."""
    gold = F.coalesce("hazard", F.lit("none"))
    x = frame(spark, sf_dir, "reports").select(gold.alias("gold"), F.when(F.col("id") % 10 < 8, gold).when(F.col("id") % 10 == 8, "RAINFALL").otherwise("FOG").alias("guess"))
    each = x.select(F.explode(F.array_distinct(F.array("gold", "guess"))).alias("label"), "gold", "guess")
    g, p = F.col("gold") == F.col("label"), F.col("guess") == F.col("label")
    c = each.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    return c.select("label", "tp", "fp", "fn", share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(
    cte("reports", "verified")
    + f"""SELECT id, code, severity, confidence FROM verified v WHERE review_status IN ('AUTO_PUBLISHED', 'QUARANTINED') AND severity IN ('HIGH', 'CRITICAL') AND lower(state) = 'state 3' AND confidence >= 0.25
 AND verified_s >= {day_bound("1997-01-01", False)[0]} AND verified_s < {day_bound("1997-12-31", True)[0]} AND lng > 70 AND lng < 95 AND lat > 9 AND lat < 35 AND (contains(lower(code), 'ev-') OR contains(lower(district), 'ev-'))"""
)
def flt01_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = EventFilter(statuses=("AUTO_PUBLISHED", "QUARANTINED"), severities=("HIGH", "CRITICAL"), state=" State 3 ", least_confidence=0.25, start="1997-01-01", end="1997-12-31", box=(70, 9, 95, 35), text="ev-")
    return wanted.apply(verified(spark, sf_dir)).select("id", "code", "severity", "confidence")


@query(cte("reports") + f"SELECT id, {STATUS_SQL} AS status, coalesce(observed_s, at_s) AS when_s FROM reports WHERE {STATUS_SQL} IN ('held', 'stale', 'unfused') AND credibility >= 0.5 AND lower(state) = 'state 2'")
def flt02_report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).withColumn("status", report_status()).where(F.col("status").isin("held", "stale", "unfused") & (F.col("credibility") >= 0.5) & (F.lower("state") == "state 2"))
    return rows.select("id", "status", F.coalesce("observed_s", "at_s").alias("when_s"))


@query(cte("reports") + f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM reports GROUP BY 1")
def flt03_report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy(report_status().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(cte("reports") + "SELECT id FROM reports WHERE list_has_any(string_split(coalesce(flags_csv, ''), ','), ['promotional', 'bot_account']) AND NOT list_contains(string_split(coalesce(flags_csv, ''), ','), 'new_account')")
def flt04_array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("promotional"), F.lit("bot_account"))
    return reports(spark, sf_dir).where(F.arrays_overlap("flags", wanted) & ~F.array_contains("flags", "new_account")).select("id")


@query(r"SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a_1') OR contains(lower(p_name), '%') OR contains(lower(p_name), 'a')")
def flt05_literal_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(contains(name, "a_1") | contains(name, "%") | contains(name, "A")).select("p_partkey", "p_name")


@query(cte("reports", "verified") + "SELECT r.id, v.id AS verified FROM reports r JOIN verified v ON v.id = r.verified_id AND r.district IS NOT DISTINCT FROM v.district")
def flt06_null_safe_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verified(spark, sf_dir).select(F.col("id").alias("verified"), F.col("district").alias("d"))
    r = frame(spark, sf_dir, "reports")
    return r.join(v, (r.verified_id == v.verified) & r.district.eqNullSafe(v.d)).select("id", "verified")


@query(cte("reports") + f"SELECT id, at_s FROM reports WHERE at_s >= {day_bound('2024-01-10', False)[0]} AND at_s < {day_bound('2024-01-11', True)[0]}")
def flt07_ist_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").where((F.col("at_s") >= day_bound("2024-01-10", False)[0]) & (F.col("at_s") < day_bound("2024-01-11", True)[0])).select("id", "at_s")


@query(cte("warnings") + f"SELECT identifier, severity FROM warnings WHERE status = 'actual' AND msg_type IN ('alert', 'update') AND coalesce(effective_s, sent_s) <= {AS_OF} AND expires_s >= {AS_OF}")
def flt08_warnings_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "warnings").where(in_force(AS_OF)).select("identifier", "severity")


@query(
    cte("verified", "reports")
    + """SELECT 'pending' AS tab, count(*) AS n FROM verified WHERE review_status = 'PENDING_HUMAN_REVIEW' UNION ALL SELECT 'quarantined', count(*) FROM verified WHERE review_status = 'QUARANTINED'
UNION ALL SELECT 'contradicted', count(*) FROM verified WHERE verdict = 'CONTRADICTED' AND review_status IN ('PENDING_HUMAN_REVIEW', 'QUARANTINED') UNION ALL SELECT 'flagged', count(*) FROM verified v WHERE EXISTS (SELECT 1 FROM reports r WHERE r.verified_id = v.id AND coalesce(r.flags_csv, '') <> '')
UNION ALL SELECT 'published', count(*) FROM verified WHERE review_status = 'AUTO_PUBLISHED' UNION ALL SELECT 'rejected', count(*) FROM verified WHERE review_status = 'REJECTED'"""
)
def flt09_review_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = reports(spark, sf_dir).where((F.size("flags") > 0) & F.col("verified_id").isNotNull()).select(F.col("verified_id").alias("id")).distinct().withColumn("flagged", F.lit(True))
    s, waiting = F.col("review_status"), F.col("review_status").isin("PENDING_HUMAN_REVIEW", "QUARANTINED")
    tabs = {"pending": s == "PENDING_HUMAN_REVIEW", "quarantined": s == "QUARANTINED", "contradicted": (F.col("verdict") == "CONTRADICTED") & waiting, "flagged": F.col("flagged").isNotNull(), "published": s == "AUTO_PUBLISHED", "rejected": s == "REJECTED"}
    one = verified(spark, sf_dir).join(flagged, "id", "left").agg(*(F.count_if(c).alias(k) for k, c in tabs.items()))
    return one.unpivot([], list(tabs), "tab", "n")


@query(
    cte("reports")
    + f"""SELECT id FROM reports WHERE verified_id IS NULL AND duplicate_of IS NULL AND coalesce(place_precision, 'gps') IN ('gps', 'district') AND NOT stale AND at_s BETWEEN {AS_OF - 30 * DAY} AND {AS_OF + 900}
 AND (source_type NOT IN ('SOCIAL_MEDIA', 'NEWS_MEDIA') OR NOT list_contains(string_split(coalesce(flags_csv, ''), ','), 'not_an_observation'))"""
)
def flt10_clusterable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).where(clusterable(AS_OF, 720)).select("id")


@query(
    cte("reports")
    + """, p AS (SELECT id, CASE WHEN id % 4 = 0 THEN lng ELSE lat END AS la, CASE WHEN id % 4 = 0 THEN lat ELSE lng END AS ln FROM reports)
SELECT id, CASE WHEN la BETWEEN 6 AND 38 AND ln BETWEEN 68 AND 98 THEN 'ok' WHEN ln BETWEEN 6 AND 38 AND la BETWEEN 68 AND 98 THEN 'swapped' ELSE 'rejected' END AS outcome FROM p"""
)
def flt11_bounds_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside the country's box stay, those inside it once swapped are repaired, others are rejected."""
    swap = F.col("id") % 4 == 0
    p = frame(spark, sf_dir, "reports").select("id", F.when(swap, F.col("lng")).otherwise(F.col("lat")).alias("la"), F.when(swap, F.col("lat")).otherwise(F.col("lng")).alias("ln"))
    inside = lambda a, b: F.col(a).between(6, 38) & F.col(b).between(68, 98)
    return p.select("id", F.when(inside("la", "ln"), "ok").when(inside("ln", "la"), "swapped").otherwise("rejected").alias("outcome"))


@query(cte("reports") + f"SELECT id, credibility FROM reports WHERE at_s >= {AS_OF - 72 * HOUR} AND verified_id IS NULL AND coalesce(place_precision, 'gps') = 'gps'")
def flt14_recent_unfused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").where((F.col("at_s") >= AS_OF - 72 * HOUR) & F.col("verified_id").isNull() & (F.coalesce("place_precision", F.lit("gps")) == "gps")).select("id", "credibility")


@query(cte("reports", "verified") + f"SELECT r.id, {STATUS_SQL} AS status, v.code, v.severity FROM reports r LEFT JOIN verified v ON v.id = r.verified_id")
def jon01_report_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of no event are not shuffled to be joined; the others meet the events that reports name, by pairs of key and salt, so that
    one event's reports fill many tasks."""
    v = verified(spark, sf_dir).select(F.col("id").alias("verified_id"), "code", "severity")
    r = reports(spark, sf_dir).select("id", "verified_id", report_status().alias("status"))
    events = named_only(v, r)
    salted = events.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = r.where("verified_id is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    none = F.lit(None).cast("string")
    alone = r.where("verified_id is null").select("id", "status", none.alias("code"), none.alias("severity"))
    return some.join(salted, ["verified_id", "salt"], "left").select("id", "status", "code", "severity").unionByName(alone)


@query(cte("reports", "verified") + "SELECT r.source_type, count(DISTINCT r.verified_id) AS events FROM reports r JOIN verified v ON v.id = r.verified_id WHERE v.review_status <> 'REJECTED' GROUP BY 1")
def jon02_sources_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verified(spark, sf_dir).where("review_status <> 'REJECTED'").select(F.col("id").alias("verified_id"))
    return frame(spark, sf_dir, "reports").join(v, "verified_id").groupBy("source_type").agg(F.countDistinct("verified_id").alias("events"))


@query(cte("reports", "verified") + "SELECT v.id FROM verified v WHERE v.review_status <> 'REJECTED' AND EXISTS (SELECT 1 FROM reports r WHERE r.verified_id = v.id AND r.source_type IN ('NEWS_MEDIA', 'CWC_GAUGE'))")
def jon04_semi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EventFilter(sources=("NEWS_MEDIA", "CWC_GAUGE")).apply(verified(spark, sf_dir), frame(spark, sf_dir, "reports")).select("id")


@query(cte("reports", "verified") + "SELECT v.id FROM verified v WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.verified_id = v.id)")
def jon05_anti_unreported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).join(frame(spark, sf_dir, "reports").select(F.col("verified_id").alias("id")), "id", "left_anti").select("id")


@query(
    cte("reports", "verified")
    + "SELECT v.id, (SELECT count(*) FROM reports r WHERE r.verified_id = v.id) AS reports, (SELECT count(*) FROM reports r WHERE r.verified_id = v.id AND coalesce(r.flags_csv, '') <> '') AS flagged FROM verified v WHERE v.review_status = 'PENDING_HUMAN_REVIEW'"
)
def jon06_counts_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts, as an aggregate before the join."""
    c = reports(spark, sf_dir).where("verified_id is not null").groupBy(F.col("verified_id").alias("id")).agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.size("flags") > 0).alias("flagged"))
    out = verified(spark, sf_dir).where("review_status = 'PENDING_HUMAN_REVIEW'").select("id").join(c, "id", "left")
    return out.select("id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("reports", "flagged")))


@query(
    cte("reports")
    + """, d AS (SELECT unnest(generate_series(19723, 19754)) AS day), c AS (SELECT (at_s + 19800) // 86400 AS day, count(*) AS n FROM reports GROUP BY 1) SELECT d.day, coalesce(c.n, 0) AS n FROM d LEFT JOIN c USING (day)"""
)
def jon16_date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per IST day; days without any are 0. day counts from 1970."""
    spine = spark.range(19_723, 19_755).withColumnRenamed("id", "day")
    counts = frame(spark, sf_dir, "reports").groupBy(F.floor((F.col("at_s") + 19_800) / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    cte("reports")
    + f"""SELECT coalesce(hazard, 'none') AS hazard, count(*) FILTER (WHERE at_s >= {AS_OF - 2 * DAY}) AS two_days, count(*) FILTER (WHERE at_s >= {AS_OF - 7 * DAY}) AS week, count(*) AS month FROM reports GROUP BY 1"""
)
def jon17_window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three time windows side by side by hazard: one conditional aggregate in place of a full outer join."""
    at = F.col("at_s")
    return frame(spark, sf_dir, "reports").groupBy(F.coalesce("hazard", F.lit("none")).alias("hazard")).agg(F.count_if(at >= AS_OF - 2 * DAY).alias("two_days"), F.count_if(at >= AS_OF - 7 * DAY).alias("week"), F.count(F.lit(1)).alias("month"))


@query(
    cte("warnings", "verified")
    + """, w AS (SELECT substr(area, 1, 7) AS state, count(*) AS warnings FROM warnings GROUP BY 1), e AS (SELECT state, count(*) AS events FROM verified WHERE severity = 'CRITICAL' AND state <> 'State 5' GROUP BY 1)
SELECT coalesce(w.state, e.state) AS state, coalesce(warnings, 0) AS warnings, coalesce(events, 0) AS events FROM w FULL JOIN e ON w.state = e.state ORDER BY coalesce(warnings, 0) + coalesce(events, 0) DESC, 1 LIMIT 12"""
)
def jon17_warning_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frame(spark, sf_dir, "warnings").groupBy(F.substring("area", 1, 7).alias("state")).agg(F.count(F.lit(1)).alias("warnings"))
    e = verified(spark, sf_dir).where("severity = 'CRITICAL' and state <> 'State 5'").groupBy("state").agg(F.count(F.lit(1)).alias("events"))
    out = w.join(e, "state", "full_outer").select("state", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("warnings", "events")))
    return out.orderBy(F.desc(F.col("warnings") + F.col("events")), "state").limit(12)


@query("SELECT b.doc_id, min(a.doc_id) AS original FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id < b.doc_id GROUP BY 1")
def jon14_same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest document with the same bytes: one aggregate by digest instead of a self-join of all copies."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "original")
    return d.join(first, "sha").where("doc_id > original").select("doc_id", "original")


@query("SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM pages q WHERE q.page_id < p.page_id AND split_part(regexp_replace(q.url, '^https?://', ''), '/', 1) = split_part(regexp_replace(p.url, '^https?://', ''), '/', 1))")
def jon20_same_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.split(F.regexp_replace("url", "^https?://", ""), "/")[0].alias("key"))
    first = p.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return p.join(first, "key").where("page_id > first").select("page_id")


@query(cte("readings") + "SELECT station, max(recorded_s) AS recorded_s, arg_max(rainfall_mm, (recorded_s, order_id, line)) AS rainfall_mm FROM readings WHERE rainfall_mm IS NOT NULL GROUP BY 1")
def win01_latest_per_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "readings").where("rainfall_mm is not null")
    return rows.groupBy("station").agg(F.max("recorded_s").alias("recorded_s"), F.max_by("rainfall_mm", F.struct("recorded_s", "order_id", "line")).alias("rainfall_mm"))


@query(cte("readings") + "SELECT station, recorded_s, rainfall_mm FROM (SELECT *, row_number() OVER (PARTITION BY station, recorded_s ORDER BY order_id, line) AS n FROM readings) WHERE n = 1")
def win02_one_per_station_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("station", "recorded_s").orderBy("order_id", "line")
    return frame(spark, sf_dir, "readings").withColumn("n", F.row_number().over(w)).where("n = 1").select("station", "recorded_s", "rainfall_mm")


@query(cte("readings") + "SELECT station, count(*) AS n, array_to_string(list(concat(recorded_s, ':', CAST(rainfall_mm AS INTEGER)) ORDER BY recorded_s, order_id, line), ' ') AS series FROM readings WHERE rainfall_mm IS NOT NULL GROUP BY 1")
def win03_station_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "readings").where("rainfall_mm is not null")
    points = F.sort_array(F.collect_list(F.struct("recorded_s", "order_id", "line", F.col("rainfall_mm").cast("int").alias("mm"))))
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(points, lambda x: F.concat_ws(":", x["recorded_s"].cast("string"), x["mm"].cast("string"))), " ").alias("series"))


@query(
    cte("verified", "reports")
    + "SELECT 'event' AS kind, id, verified_s AS at_s FROM verified WHERE severity = 'CRITICAL' UNION ALL SELECT 'report', id, at_s FROM reports WHERE stale UNION ALL SELECT 'warning', c_custkey, NULL FROM customer"
)
def set01_union_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = verified(spark, sf_dir).where("severity = 'CRITICAL'").select(F.lit("event").alias("kind"), "id", F.col("verified_s").alias("at_s"))
    r = frame(spark, sf_dir, "reports").where("stale").select(F.lit("report").alias("kind"), "id", "at_s")
    w = frame(spark, sf_dir, "warnings").select(F.lit("warning").alias("kind"), F.col("identifier").alias("id"))
    return e.unionByName(r).unionByName(w, allowMissingColumns=True)


@query(
    cte("reports")
    + """SELECT id, array_to_string(list_sort(list_filter(string_split(coalesce(flags_csv, ''), ','), lambda x: x <> '' AND x <> 'shouting')), ',') AS without, CAST(len(list_filter(string_split(coalesce(flags_csv, ''), ','), lambda x: x IN ('shouting', 'bot_account'))) AS BIGINT) AS shared FROM reports"""
)
def set02_flag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda *xs: F.array(*(F.lit(x) for x in xs))
    return reports(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_except("flags", lit("shouting"))), ",").alias("without"), F.size(F.array_intersect("flags", lit("shouting", "bot_account"))).cast("bigint").alias("shared"))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 ELSE 3 END"


@query(cte("verified") + f"SELECT id, severity FROM verified WHERE review_status <> 'REJECTED' ORDER BY {_RANK}, id LIMIT 100")
def srt01_severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).where("review_status <> 'REJECTED'").orderBy(F.expr(_RANK), "id").limit(100).select("id", "severity")


@query(cte("reports") + "SELECT id, observed_s FROM reports ORDER BY observed_s DESC NULLS LAST, id LIMIT 200")
def srt02_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").orderBy(F.desc_nulls_last("observed_s"), "id").limit(200).select("id", "observed_s")


@query(cte("verified") + f"SELECT id FROM verified WHERE review_status = 'PENDING_HUMAN_REVIEW' ORDER BY {_RANK}, CASE verdict WHEN 'CONTRADICTED' THEN 0 WHEN 'UNCONFIRMED' THEN 1 ELSE 2 END, verified_s, id LIMIT 150")
def srt03_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("verdict") == "CONTRADICTED", 0).when(F.col("verdict") == "UNCONFIRMED", 1).otherwise(2)
    return verified(spark, sf_dir).where("review_status = 'PENDING_HUMAN_REVIEW'").orderBy(F.expr(_RANK), verdict, "verified_s", "id").limit(150).select("id")


@query(cte("verified") + "SELECT id, (SELECT count(*) FROM verified WHERE review_status <> 'REJECTED') AS total FROM verified WHERE review_status <> 'REJECTED' ORDER BY verified_s DESC, id LIMIT 50 OFFSET 100")
def srt04_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verified(spark, sf_dir).where("review_status <> 'REJECTED'")
    page = rows.orderBy(F.desc("verified_s"), "id").offset(100).limit(50).select("id")
    return page.join(rows.agg(F.count(F.lit(1)).alias("total")))  # one row


@query(
    cte("verified", "reports")
    + "SELECT * FROM (SELECT 'event' AS kind, id, verified_s + 820000000 - 730000000 AS at_s FROM verified UNION ALL SELECT 'report', id, at_s FROM reports) ORDER BY at_s DESC, kind, id LIMIT 40"
)
def srt05_recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = verified(spark, sf_dir).select(F.lit("event").alias("kind"), "id", (F.col("verified_s") + 90_000_000).alias("at_s"))
    r = frame(spark, sf_dir, "reports").select(F.lit("report").alias("kind"), "id", "at_s")
    return e.unionByName(r).orderBy(F.desc("at_s"), "kind", "id").limit(40)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY (s_nationkey = 3) DESC, s_name, s_suppkey LIMIT 60")
def srt06_boolean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy((F.col("s_nationkey") == 3).desc(), "s_name", "s_suppkey").limit(60).select("s_suppkey", "s_name")


@query("SELECT n_name, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def jon03_left_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.countDistinct("c_mktsegment").alias("segments"))


@query(cte("readings") + f"SELECT station, recorded_s FROM readings WHERE recorded_s >= {EVENTS_AS_OF - 240 * HOUR} AND recorded_s <= {EVENTS_AS_OF}")
def flt12_fresh_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "readings").where(F.col("recorded_s").between(EVENTS_AS_OF - 240 * HOUR, EVENTS_AS_OF)).select("station", "recorded_s")


def warnings_matching(rows: DataFrame, severity: str | None = None, area: str | None = None, expired: bool = False, as_of: int = AS_OF) -> DataFrame:
    """Warnings by optional conditions: one that is not given is no condition at all."""
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    if area is not None:
        rows = rows.where(contains(F.col("area"), area))
    return rows if expired else rows.where(F.col("expires_s").isNull() | (F.col("expires_s") > as_of))


@query(cte("warnings") + f"SELECT identifier, 'a' AS q FROM warnings WHERE severity = 'Severe' AND (expires_s IS NULL OR expires_s > {AS_OF}) UNION ALL SELECT identifier, 'b' FROM warnings WHERE contains(lower(area), 'district 1')")
def flt13_optional_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frame(spark, sf_dir, "warnings")
    return warnings_matching(w, severity="Severe").select("identifier", F.lit("a").alias("q")).union(warnings_matching(w, area="District 1", expired=True).select("identifier", F.lit("b").alias("q")))


# Label, family and colour rank of each hazard.
TAXONOMY = [
    ("CLOUDBURST", "water", 1), ("CYCLONE_INUNDATION", "water", 1), ("URBAN_FLOOD", "water", 1), ("RIVER_BREACH", "water", 2), ("LANDSLIDE", "water", 3), ("RAINFALL", "water", 9),
    ("CYCLONE", "convective", 3), ("DUST_STORM", "convective", 4), ("LIGHTNING", "convective", 5), ("HAILSTORM", "convective", 5), ("THUNDERSTORM", "convective", 5), ("STRONG_WIND", "convective", 6),
    ("HEATWAVE", "thermal", 7), ("COLD_WAVE", "thermal", 7), ("FOG", "visibility", 8), ("UNCLASSIFIED", None, 99),
]


def taxonomy(spark: SparkSession) -> DataFrame:
    """The 16 hazards: a dimension of fixed size."""
    rows = spark.createDataFrame(TAXONOMY, "event_type string, family string, precedence int")
    return rows.withColumn("label", F.initcap(F.lower(F.regexp_replace("event_type", "_", " "))))


_FAMILY = "CASE WHEN event_type IN ('CLOUDBURST', 'CYCLONE_INUNDATION', 'URBAN_FLOOD', 'RIVER_BREACH', 'LANDSLIDE', 'RAINFALL') THEN 'water' WHEN event_type IN ('HEATWAVE', 'COLD_WAVE') THEN 'thermal' WHEN event_type = 'FOG' THEN 'visibility' WHEN event_type <> 'UNCLASSIFIED' THEN 'convective' END"


@query(cte("verified") + f"SELECT id, {_FAMILY} AS family, lower(replace(event_type, '_', ' ')) AS label FROM verified")
def prj01_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).join(F.broadcast(taxonomy(spark)), "event_type", "left").select("id", "family", F.lower("label").alias("label"))


@query("SELECT doc_id, substr(text, 1, 500) AS excerpt FROM documents")
def prj03_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 characters, which is what the list shows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 500).alias("excerpt"))


_DOCKET = "CASE WHEN stale THEN 'withdrawn' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN verified_id IS NULL THEN CASE WHEN credibility < 0.2 THEN 'held' ELSE 'received' END WHEN review_status = 'REJECTED' THEN 'rejected' WHEN review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED') THEN 'verified' ELSE 'under_review' END"


@query(cte("reports", "verified") + f"SELECT r.id, {_DOCKET} AS docket FROM reports r LEFT JOIN verified v ON v.id = verified_id")
def prj04_docket_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven states of a report as its sender sees them: the first that holds."""
    v = verified(spark, sf_dir).select(F.col("id").alias("verified_id"), "review_status")
    s = F.col("review_status")
    state = (
        F.when(F.col("stale"), "withdrawn")
        .when(F.col("duplicate_of").isNotNull(), "duplicate")
        .when(F.col("verified_id").isNull(), F.when(F.col("credibility") < 0.2, "held").otherwise("received"))
        .when(s == "REJECTED", "rejected")
        .when(s.isin(*OPEN), "verified")
        .otherwise("under_review")
    )
    return frame(spark, sf_dir, "reports").join(v, "verified_id", "left").select("id", state.alias("docket"))


@query(cte("reports") + "SELECT b.id, min(a.id) AS earlier FROM reports a JOIN reports b ON a.district = b.district AND a.hazard = b.hazard AND a.at_s >= b.at_s - 86400 AND (a.at_s < b.at_s OR (a.at_s = b.at_s AND a.id < b.id)) GROUP BY 1")
def jon10_time_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least id of the earlier reports of one district and hazard within a day: equal keys and two day slots, not a whole group."""
    r = frame(spark, sf_dir, "reports").where("district is not null and hazard is not null").select("id", "at_s", "district", "hazard")
    slot = F.floor(F.col("at_s") / DAY)
    b = r.withColumn("slot", F.explode(F.array(slot, slot - 1)))
    a = r.select("district", "hazard", F.col("id").alias("a_id"), F.col("at_s").alias("a_s"), slot.alias("slot"))
    earlier = (F.col("a_s") < F.col("at_s")) | ((F.col("a_s") == F.col("at_s")) & (F.col("a_id") < F.col("id")))
    return b.join(a, ["district", "hazard", "slot"]).where((F.col("a_s") >= F.col("at_s") - DAY) & earlier).groupBy("id").agg(F.min("a_id").alias("earlier"))


@query(cte("reports") + "SELECT verified_id AS id, array_to_string(list(hazard ORDER BY at_s, id) FILTER (WHERE hazard IS NOT NULL), ',') AS hazards FROM reports WHERE verified_id IS NOT NULL GROUP BY 1")
def srt07_ordered_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "reports").where("verified_id is not null")
    items = F.sort_array(F.collect_list(F.when(F.col("hazard").isNotNull(), F.struct("at_s", "id", "hazard"))))
    text = F.array_join(F.transform(items, lambda x: x["hazard"]), ",")
    return rows.groupBy(F.col("verified_id").alias("id")).agg(F.when(F.count("hazard") > 0, text).alias("hazards"))


@query(cte("verified", "reports") + "SELECT v.id, count(r.id) AS n, coalesce(max(r.at_s), v.verified_s) AS last_s FROM verified v LEFT JOIN reports r ON r.verified_id = v.id WHERE v.review_status IN ('AUTO_PUBLISHED', 'PENDING_HUMAN_REVIEW', 'QUARANTINED') GROUP BY v.id, v.verified_s")
def dom22_processed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open events with how many reports they hold and when they last changed."""
    r = frame(spark, sf_dir, "reports").where("verified_id is not null").groupBy(F.col("verified_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("at_s").alias("at_s"))
    v = verified(spark, sf_dir).where(F.col("review_status").isin("AUTO_PUBLISHED", "PENDING_HUMAN_REVIEW", "QUARANTINED")).select("id", "verified_s")
    return v.join(r, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("at_s", "verified_s").alias("last_s"))


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: all subtotals of two dimensions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    return o.cube("a", "b").agg(F.count(F.lit(1)).alias("n"))
