"""Ledgers, transitions, timelines and re-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import GENESIS, breaks, chain
from ..sources.bindings import cte, frame
from .evidence import _RECEIPT_SQL, scored
from .registry import query


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger per customer: its orders by key, with the status as content."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return chain(o.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("seq"), F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("body")), "book", "seq", "body")


@query(
    f"""SELECT o_custkey AS book, count(*) AS rows, list_reduce(list_prepend('{GENESIS}', list(concat(o_orderkey, ':', o_orderstatus) ORDER BY o_orderkey)), lambda a, x: sha256(concat(a, '|', x))) AS head FROM orders GROUP BY 1"""
)
def win07_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("book").agg(F.count(F.lit(1)).alias("rows"), F.max_by("hash", "seq").alias("head"))


@query("""SELECT o_custkey AS book, min(o_orderkey) FILTER (WHERE o_orderkey % 97 = 0) IS NULL AS valid, coalesce(min(n) FILTER (WHERE o_orderkey % 97 = 0), count(*)) AS checked, min(o_orderkey) FILTER (WHERE o_orderkey % 97 = 0) AS broken_at
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def win06_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers in which the content of some rows (keys divisible by 97) was changed afterwards: the check finds the first."""
    changed = ledger(spark, sf_dir).withColumn("body", F.when(F.col("seq") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return breaks(changed, "book", "seq", "body")


@query(f"""WITH h AS (SELECT o_custkey AS book, list_reduce(list_prepend('{GENESIS}', list(concat(o_orderkey, ':', o_orderstatus) ORDER BY o_orderkey)), lambda a, x: sha256(concat(a, '|', x))) AS head, min(o_orderkey) FILTER (WHERE o_orderkey % 97 = 0) IS NULL AS valid FROM orders GROUP BY 1)
SELECT o_custkey AS book, o_orderkey AS seq, n = 1 AS newest, valid, CASE WHEN n = 1 THEN head END AS head FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) JOIN h ON book = o_custkey WHERE n <= 3""")
def srt08_newest_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest rows of each ledger, the newest first, beside whether its whole chain holds."""
    whole = ledger(spark, sf_dir)
    changed = whole.withColumn("body", F.when(F.col("seq") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    w = Window.partitionBy("book").orderBy(F.desc("seq"))
    newest = whole.withColumn("n", F.row_number().over(w)).where("n <= 3")
    held = breaks(changed, "book", "seq", "body").select("book", "valid")
    return newest.join(held, "book").select("book", "seq", (F.col("n") == 1).alias("newest"), "valid", F.when(F.col("n") == 1, F.col("hash")).alias("head"))


@query(
    cte("verified", "reports")
    + "SELECT id, kind, at_s FROM (SELECT verified_id AS id, 'snapshot' AS kind, 0 AS rank, max(at_s) AS at_s FROM reports WHERE verified_id IS NOT NULL GROUP BY 1 UNION ALL SELECT id, 'ledger', 1, verified_s FROM verified)"
)
def win08_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots and ledger rows of events in one order, snapshots first at equal times."""
    s = frame(spark, sf_dir, "reports").where("verified_id is not null").groupBy(F.col("verified_id").alias("id")).agg(F.max("at_s").alias("at_s")).select("id", F.lit("snapshot").alias("kind"), "at_s", F.lit(0).alias("rank"))
    v = frame(spark, sf_dir, "verified").select("id", F.lit("ledger").alias("kind"), F.col("verified_s").alias("at_s"), F.lit(1).alias("rank"))
    return s.unionByName(v).orderBy("id", "at_s", "rank").drop("rank")


# From which states each decision is allowed, and where it leads.
def transition(state, action):
    """The state after a decision: approval only from waiting states, rejection from any but REJECTED, overrides change no state."""
    waiting = (state == "QUARANTINED") | (state == "PENDING_HUMAN_REVIEW")
    return F.when((action == "approve") & waiting, "HUMAN_APPROVED").when(action == "reject", "REJECTED").otherwise(state)


_ACTION = "CASE l_linenumber % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'override' WHEN 2 THEN 'approve' ELSE 'override' END"


@query(
    cte("verified")
    + f""", d AS (SELECT l_orderkey AS id, list({_ACTION} ORDER BY l_linenumber) AS actions FROM lineitem GROUP BY 1)
SELECT id, list_reduce(list_prepend(review_status, actions), lambda s, a: CASE WHEN a = 'approve' AND s IN ('QUARANTINED', 'PENDING_HUMAN_REVIEW') THEN 'HUMAN_APPROVED' WHEN a = 'reject' THEN 'REJECTED' ELSE s END) AS final FROM verified JOIN d USING (id)"""
)
def dom23_review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each event after its decisions, in order."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr(_ACTION).alias("a")))).alias("actions"))
    v = frame(spark, sf_dir, "verified").select("id", "review_status")
    return v.join(d, "id").select("id", F.aggregate("actions", F.col("review_status"), lambda s, x: transition(s, x["a"])).alias("final"))


_SCORED = _RECEIPT_SQL[: _RECEIPT_SQL.index("SELECT id, mean,")]


@query(
    cte("verified", "reports", "readings", "warnings")
    + _SCORED
    + """, z AS (SELECT u.id, v.confidence AS stored, v.review_status, round(u.total / online + 1e-9, 4) AS confidence, u.verdict, CASE WHEN round(u.total / online + 1e-9, 4) >= 0.9 AND contradicted = 0 AND NOT posts AND u.event_type <> 'UNCLASSIFIED' THEN 'AUTO_PUBLISHED' WHEN round(u.total / online + 1e-9, 4) >= 0.6 OR u.severity IN ('HIGH', 'CRITICAL') THEN 'PENDING_HUMAN_REVIEW' ELSE 'QUARANTINED' END AS routed FROM u JOIN verified v USING (id))
SELECT id, stored, confidence, verdict, routed FROM z WHERE review_status NOT IN ('HUMAN_APPROVED', 'REJECTED') AND (confidence <> stored OR routed <> review_status)"""
)
def dom21_rescore_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose new score, verdict or routing differs from what is stored; human decisions stay."""
    rows = scored(spark, sf_dir).where(~F.col("review_status").isin("HUMAN_APPROVED", "REJECTED"))
    differs = ~(F.col("confidence").eqNullSafe(F.col("stored")) & F.col("routed").eqNullSafe(F.col("review_status")))
    return rows.where(differs).select("id", "stored", "confidence", "verdict", "routed")


@query(cte("reports") + "SELECT verified_id AS id, count(*) AS reports, array_to_string(list(id ORDER BY at_s, id), ',') AS report_ids FROM reports WHERE verified_id IS NOT NULL GROUP BY 1")
def dom24_event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "reports").where("verified_id is not null")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("at_s", "id"))), lambda x: x["id"].cast("string"))
    return rows.groupBy(F.col("verified_id").alias("id")).agg(F.count(F.lit(1)).alias("reports"), F.array_join(ids, ",").alias("report_ids"))


@query(cte("reports") + "SELECT id, CASE WHEN stale THEN NULL ELSE lat END AS lat, CASE WHEN stale THEN NULL ELSE props END AS props FROM reports")
def snk08_withdrawal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withdrawn rows lose place and content but stay rows."""
    keep = lambda c: F.when(~F.col("stale"), c)
    return frame(spark, sf_dir, "reports").select("id", keep(F.col("lat")).alias("lat"), keep(F.col("props")).alias("props"))


@query(cte("reports") + "SELECT id, n FROM (SELECT id, count(*) OVER () AS n, row_number() OVER (ORDER BY id) AS r FROM reports WHERE verified_id IS NULL AND duplicate_of IS NULL) WHERE r <= 200")
def snk04_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 oldest unpublished messages, and how many wait."""
    rows = frame(spark, sf_dir, "reports").where("verified_id is null and duplicate_of is null")
    return rows.orderBy("id").limit(200).select("id").join(rows.agg(F.count(F.lit(1)).alias("n")))  # one row


@query(cte("reports") + "SELECT source_type, to_timestamp(at_s) AT TIME ZONE 'UTC' >= TIMESTAMP '2024-01-15' AS kept, count(*) AS n FROM reports GROUP BY 1, 2")
def snk07_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").groupBy("source_type", (F.col("at_s") >= 1_705_276_800).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query(cte("verified") + "SELECT count(*) AS features, round(sum(lat), 3) AS lat_sum, round(sum(lng), 3) AS lng_sum FROM verified WHERE severity = 'CRITICAL'")
def snk02_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical events as GeoJSON features, read back: the count and the sums of their coordinates."""
    v = frame(spark, sf_dir, "verified").where("severity = 'CRITICAL'")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct("id", "code").alias("properties")))
    back = v.select(F.from_json(feature, "type string, geometry struct<type: string, coordinates: array<double>>").alias("f"))
    at = lambda i: F.round(F.sum(F.col("f.geometry.coordinates")[i]), 3)
    return back.agg(F.count(F.lit(1)).alias("features"), at(1).alias("lat_sum"), at(0).alias("lng_sum"))


@query(cte("verified") + "SELECT state, id FROM (SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY confidence DESC, id) AS n FROM verified) WHERE n <= 3")
def srt_top_per_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("state").orderBy(F.desc("confidence"), "id")
    return frame(spark, sf_dir, "verified").withColumn("n", F.row_number().over(w)).where("n <= 3").select("state", "id")
