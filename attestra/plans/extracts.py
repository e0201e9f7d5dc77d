"""Extracts to files and back, warning rings, map pins and the evidence of an event in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pins import WORLD, leaders
from ..sources.bindings import cte, frame
from ..sources.parsers import cap_ring, wkt
from ..sources.tables import saved, shared_path
from .intake import FAMILY_OF
from .registry import query

#: Degrees that a map pin covers at the zoom of the overview.
PIN_DEGREES = 2.0
# Zoom of the whole country and pixels within which its pins merge.
ZOOM, PIN_PIXELS = 5, 36.0


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def src16_reference_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference list kept as CSV, read under a stated schema and joined; the 25 rows are left to Spark's own size check."""
    path = shared_path(spark, "reference-csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.csv(path, header=True)
    names = spark.read.csv(path, schema="n_nationkey int, n_name string", header=True, mode="FAILFAST")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    return suppliers.join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query(cte("verified") + "SELECT id, code, district, lat, lng FROM verified")
def snk06_table_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written twice, as CSV and as a GeoJSON feature a line, and read back from both."""
    rows = frame(spark, sf_dir, "verified").select("id", "code", "district", "lat", "lng")
    table, features = shared_path(spark, "extract-csv"), shared_path(spark, "extract-geojson")
    rows.select("id", "code", "district").write.csv(table, header=True)
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("id").alias("properties"))).alias("value")).write.text(features)
    csv = spark.read.csv(table, schema="id bigint, code string, district string", header=True, mode="FAILFAST")
    json = spark.read.json(features, schema="geometry struct<coordinates: array<double>>, properties struct<id: bigint>")
    at = F.col("geometry.coordinates")
    return csv.join(json.select(F.col("properties.id").alias("id"), at[1].alias("lat"), at[0].alias("lng")), "id").select("id", "code", "district", "lat", "lng")


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 4 END AS INTEGER) AS vertices, s_suppkey % 5 <> 4 AS closed, s_suppkey % 5 <> 4 AS has_wkt FROM supplier")
def src06_warning_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings out of warning text: bad vertices go, an open ring is closed, and what keeps fewer than three vertices is no ring."""
    text = F.when(F.col("s_suppkey") % 5 == 4, "10,70 bad 10,71").otherwise(F.concat(F.lit("10,70 10,"), F.lit(71) + F.col("s_suppkey") % 5, F.lit(" x,y 12,72")))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", cap_ring(text).alias("ring"))
    closed = F.coalesce(F.col("ring")[0] == F.element_at("ring", -1), F.lit(False))
    return rows.select("s_suppkey", F.coalesce(F.size("ring"), F.lit(0)).alias("vertices"), closed.alias("closed"), wkt(F.col("ring")).isNotNull().alias("has_wkt"))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END"


@query(
    cte("verified")
    + f""", p AS (SELECT CAST(floor(lat / {PIN_DEGREES}) AS BIGINT) AS y, CAST(floor(lng / {PIN_DEGREES}) AS BIGINT) AS x, CAST(round(lat * 1000) AS BIGINT) AS lat, CAST(round(lng * 1000) AS BIGINT) AS lng, district, event_type, {_RANK} AS rank FROM verified),
d AS (SELECT y, x, arg_min(district, (-n, district)) AS district FROM (SELECT y, x, district, count(*) AS n FROM p WHERE district IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (SELECT y, x, arg_min(event_type, (-n, event_type)) AS hazard FROM (SELECT y, x, event_type, count(*) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT y, x, count(*) AS pins, CAST(sum(lat) AS DOUBLE) / (1000.0 * count(*)) AS lat, CAST(sum(lng) AS DOUBLE) / (1000.0 * count(*)) AS lng, max(rank) AS rank, any_value(d.district) AS district, any_value(h.hazard) AS hazard FROM p LEFT JOIN d USING (y, x) LEFT JOIN h USING (y, x) GROUP BY 1, 2"""
)
def agg28_map_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins that share a cell of the overview: count, centre, worst severity, commonest district and hazard (ties to the first by name).

    Counts by cell, district and hazard come first, with sums that make the rest, so one shuffle carries counts and not events.
    """
    thousandths = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(f"{c}_k")  # noqa: E731  whole numbers, so that a sum does not depend on the order
    v = frame(spark, sf_dir, "verified").select("lat", "lng", thousandths("lat"), thousandths("lng"), "district", "event_type", F.expr(_RANK).alias("rank"))
    cell = [F.floor(F.col("lat") / PIN_DEGREES).alias("y"), F.floor(F.col("lng") / PIN_DEGREES).alias("x")]
    fine = v.groupBy(*cell, "district", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("lat_k").alias("lat_k"), F.sum("lng_k").alias("lng_k"), F.max("rank").alias("rank"))

    def by(column: str) -> DataFrame:
        return fine.where(F.col(column).isNotNull()).groupBy("y", "x", column).agg(F.sum("n").alias("n")).groupBy("y", "x").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))

    mean = lambda c: F.sum(c).cast("double") / (F.lit(1000.0) * F.sum("n"))
    pins = fine.groupBy("y", "x").agg(F.sum("n").alias("pins"), mean("lat_k").alias("lat"), mean("lng_k").alias("lng"), F.max("rank").alias("rank"))
    return pins.join(by("district"), ["y", "x"], "left").join(by("event_type").withColumnRenamed("event_type", "hazard"), ["y", "x"], "left").select("y", "x", "pins", "lat", "lng", "rank", "district", "hazard")


_SIZE = WORLD * 2**ZOOM


@query(
    cte("verified").replace("WITH", "WITH RECURSIVE", 1)
    + f""", m AS (SELECT *, (lng + 180) / 360 * {_SIZE} AS x, (0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * {_SIZE} AS y FROM verified),
loose AS (SELECT 0 AS step, x, y, min(id) AS id FROM m GROUP BY x, y UNION ALL SELECT step + 1, x, y, id FROM (SELECT *, first_value(x) OVER w AS lx, first_value(y) OVER w AS ly FROM loose WINDOW w AS (ORDER BY id)) WHERE (x - lx) * (x - lx) + (y - ly) * (y - ly) >= {PIN_PIXELS * PIN_PIXELS}),
led AS (SELECT step, min(id) AS leader FROM loose GROUP BY 1), spot AS (SELECT x, y, max(step) AS step FROM loose GROUP BY 1, 2),
p AS (SELECT leader, CAST(round(lat * 1000) AS BIGINT) AS lat, CAST(round(lng * 1000) AS BIGINT) AS lng, district, event_type, {_RANK} AS rank FROM m JOIN spot USING (x, y) JOIN led USING (step)),
d AS (SELECT leader, arg_min(district, (-n, district)) AS district FROM (SELECT leader, district, count(*) AS n FROM p WHERE district IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT leader, arg_min(event_type, (-n, event_type)) AS hazard FROM (SELECT leader, event_type, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT leader, count(*) AS pins, CAST(sum(lat) AS DOUBLE) / (1000.0 * count(*)) AS lat, CAST(sum(lng) AS DOUBLE) / (1000.0 * count(*)) AS lng, max(rank) AS rank, any_value(d.district) AS district, any_value(h.hazard) AS hazard FROM p LEFT JOIN d USING (leader) LEFT JOIN h USING (leader) GROUP BY 1"""
)
def agg28_screen_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins merged by their distance on the screen, in order of id: each goes to the first pin before it that leads within PIN_PIXELS.

    For each leader: count, centre, worst severity, commonest district and hazard (ties to the first by name).
    """
    v = frame(spark, sf_dir, "verified").select("id", "lat", "lng", "district", "event_type", F.expr(_RANK).alias("rank"))
    thousandths = lambda c: F.sum(F.round(F.col(c) * 1000).cast("bigint")).alias(c)
    led = v.join(leaders(v, ZOOM, PIN_PIXELS), "id")
    fine = saved(led.groupBy("leader", "district", "event_type").agg(F.count(F.lit(1)).alias("n"), thousandths("lat"), thousandths("lng"), F.max("rank").alias("rank")), "pin-counts")

    def by(column: str) -> DataFrame:
        counts = fine.where(F.col(column).isNotNull()).groupBy("leader", column).agg(F.sum("n").alias("n"))
        return counts.groupBy("leader").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))

    mean = lambda c: F.sum(c).cast("double") / (F.lit(1000.0) * F.sum("n"))
    pins = fine.groupBy("leader").agg(F.sum("n").alias("pins"), mean("lat").alias("lat"), mean("lng").alias("lng"), F.max("rank").alias("rank"))
    return pins.join(by("district"), "leader", "left").join(by("event_type").withColumnRenamed("event_type", "hazard"), "leader", "left").select("leader", "pins", "lat", "lng", "rank", "district", "hazard")


@query(
    cte("verified", "readings", "warnings", "reports")
    + f""", s AS (SELECT order_id AS id, max(rainfall_mm) AS rain_mm, max(gust_kmh) AS gust_kmh, min(visibility_m) AS visibility_m FROM readings GROUP BY 1),
w AS (SELECT split_part(area, ' - ', 2) AS district, family, count(*) AS n FROM warnings WHERE status = 'actual' AND msg_type <> 'cancel' GROUP BY 1, 2),
n AS (SELECT verified_id AS id, count(*) AS reports, count(DISTINCT reporter) FILTER (WHERE source_type = 'NEWS_MEDIA') AS outlets FROM reports WHERE verified_id IS NOT NULL AND duplicate_of IS NULL GROUP BY 1)
SELECT v.id, rain_mm, gust_kmh, visibility_m, coalesce(w.n, 0) AS warnings, coalesce(reports, 0) AS reports, coalesce(outlets, 0) AS outlets,
  CAST(CASE WHEN s.id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN w.n IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN outlets > 0 THEN 1 ELSE 0 END AS INTEGER) AS kinds
FROM verified v LEFT JOIN s ON s.id = v.id LEFT JOIN w ON w.district = v.district AND w.family = {FAMILY_OF.format(c='v.event_type')} LEFT JOIN n ON n.id = v.id"""
)
def dom08_evidence_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations, official warnings of the event's own family and news beside each event; each kind is summed to one row a key before it is joined."""
    v = frame(spark, sf_dir, "verified").select("id", "district", F.expr(FAMILY_OF.format(c="event_type")).alias("family"))
    s = frame(spark, sf_dir, "readings").groupBy(F.col("order_id").alias("id")).agg(F.max("rainfall_mm").alias("rain_mm"), F.max("gust_kmh").alias("gust_kmh"), F.min("visibility_m").alias("visibility_m"), F.lit(1).alias("measured"))
    live = frame(spark, sf_dir, "warnings").where("status = 'actual' and msg_type <> 'cancel'")
    w = live.groupBy(F.split_part("area", F.lit(" - "), F.lit(2)).alias("district"), "family").agg(F.count(F.lit(1)).alias("warned"))
    told = frame(spark, sf_dir, "reports").where("verified_id is not null and duplicate_of is null")
    n = told.groupBy(F.col("verified_id").alias("id")).agg(F.count(F.lit(1)).alias("reports"), F.count_distinct(F.when(F.col("source_type") == "NEWS_MEDIA", F.col("reporter"))).alias("outlets"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    kinds = F.coalesce("measured", F.lit(0)) + F.when(F.col("warned").isNotNull(), 1).otherwise(0) + F.when(F.col("outlets") > 0, 1).otherwise(0)
    return (
        v.join(s, "id", "left").join(w, ["district", "family"], "left").join(n, "id", "left")
        .select("id", "rain_mm", "gust_kmh", "visibility_m", zero("warned").alias("warnings"), zero("reports").alias("reports"), zero("outlets").alias("outlets"), kinds.alias("kinds"))
    )
