"""Spatial joins, clusters and the heat map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH, quad_key
from ..operators.shapes import widest
from ..operators.spatial import dbscan, nearest, outreaching, radius_join
from ..sources.bindings import DAY, cte, frame
from ..sources.tables import saved
from .registry import query


def km_sql(a: str, b: str, radius: float = EARTH) -> str:
    return f"(2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))))"


@query(cte("verified", "stations") + f"SELECT v.id, s.station, round({km_sql('v', 's')}, 5) AS km FROM verified v JOIN stations s ON {km_sql('v', 's')} <= 50 WHERE v.severity = 'CRITICAL'")
def jon07_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical events with every station within 50 km."""
    v = frame(spark, sf_dir, "verified").where("severity = 'CRITICAL'").select("id", "lat", "lng")
    return radius_join(v, frame(spark, sf_dir, "stations").select("station", "lat", "lng"), 50, 40).select("id", F.col("r_station").alias("station"), F.round("km", 5).alias("km"))


@query(
    cte("reports", "verified")
    + f""", p AS (SELECT r.id, v.id AS event, {km_sql('r', 'v')} AS km, v.radius_km + 5 AS reach FROM reports r JOIN verified v ON v.lat BETWEEN r.lat - 0.2 AND r.lat + 0.2 AND v.lng BETWEEN r.lng - 0.3 AND r.lng + 0.3 AND v.severity IN ('CRITICAL', 'HIGH'))
SELECT id, arg_min(event, (km, event)) AS event, round(min(km), 5) AS km FROM p WHERE km <= reach GROUP BY 1"""
)
def jon08_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each report the nearest serious event that reaches it: within the event's own radius and 5 km more (13.4 at most)."""
    r = frame(spark, sf_dir, "reports").select("id", "lat", "lng")
    v = frame(spark, sf_dir, "verified").where("severity in ('CRITICAL', 'HIGH')").select(F.col("id").alias("event"), "lat", "lng", "radius_km")
    return nearest(r, outreaching(v, "event", "radius_km"), "id", 13.4, F.col("km") <= F.col("r_radius_km") + 5, 40, spread_right=True).select("id", F.col("r_event").alias("event"), F.round("km", 5).alias("km"))


@query(
    cte("verified", "stations", "readings")
    + f""", n AS (SELECT v.id, v.verified_s, s.station FROM verified v JOIN stations s ON {km_sql('v', 's')} <= 50 WHERE v.severity = 'CRITICAL' AND v.verified_s >= 880000000)
SELECT n.id, arg_max(r.station, (r.recorded_s, r.order_id, r.line)) AS station, max(r.recorded_s) AS recorded_s FROM n JOIN readings r ON r.station = n.station AND r.recorded_s <= n.verified_s AND r.recorded_s >= n.verified_s - 172800 GROUP BY 1"""
)
def jon11_as_of_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest reading of the two days before each recent critical event, of the stations within 50 km.

    Readings take their station's place and meet events by cell and slot of two days, an event in nine cells and two slots however
    many stations are near. Pairs are not shuffled: of a cell's, the newest goes on.
    """
    v = frame(spark, sf_dir, "verified").where("severity = 'CRITICAL' and verified_s >= 880000000").select("id", "lat", "lng", "verified_s")
    slot = F.floor(F.col("verified_s") / (2 * DAY))
    readings = frame(spark, sf_dir, "readings").where(F.col("recorded_s") >= 880000000 - 2 * DAY).select("station", "recorded_s", "order_id", "line")
    placed = readings.join(frame(spark, sf_dir, "stations").select("station", "lat", "lng"), "station").withColumn("slot", F.floor(F.col("recorded_s") / (2 * DAY)))
    seen = radius_join(v.withColumn("slot", F.explode(F.array(slot - 1, slot))), placed, 50, 40, same=("slot",)).where("r_recorded_s <= verified_s and r_recorded_s >= verified_s - 172800")
    newest = F.max(F.struct(F.col("r_recorded_s").alias("recorded_s"), F.col("r_order_id").alias("order_id"), F.col("r_line").alias("line"), F.col("r_station").alias("station")))
    return seen.groupBy("id").agg(newest.alias("m")).select("id", "m.station", "m.recorded_s")


@query(
    cte("reports")
    + f""", c AS (SELECT lat, lng, id FROM reports), p AS (SELECT a.id, b.id AS other, {km_sql('a', 'b')} AS km FROM c a JOIN c b ON b.lat BETWEEN a.lat - 0.1 AND a.lat + 0.1 AND b.lng BETWEEN a.lng - 0.1 AND a.lng + 0.1 AND a.id < b.id)
SELECT id, other, round(km, 5) AS km FROM p WHERE km <= 5"""
)
def jon12_pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = frame(spark, sf_dir, "reports").select("id", "lat", "lng")
    return radius_join(r, r, 5, 40).where("id < r_id").select("id", F.col("r_id").alias("other"), F.round("km", 5).alias("km"))


@query(
    cte("reports", "verified")
    + """, d AS (SELECT district, min(lat) AS lo_lat, max(lat) AS hi_lat, min(lng) AS lo_lng, max(lng) AS hi_lng FROM reports WHERE district IS NOT NULL GROUP BY 1)
SELECT v.id, min(d.district) AS district, count(*) AS boxes FROM verified v JOIN d ON v.lat BETWEEN lo_lat AND hi_lat AND v.lng BETWEEN lo_lng AND hi_lng GROUP BY 1"""
)
def jon18_district_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts whose box holds each event. There are 40 districts, a bounded dimension, met by grid cells of a degree."""
    d = frame(spark, sf_dir, "reports").where("district is not null").groupBy("district").agg(F.min("lat").alias("lo_lat"), F.max("lat").alias("hi_lat"), F.min("lng").alias("lo_lng"), F.max("lng").alias("hi_lng"))
    cells = d.withColumn("y", F.explode(F.sequence(F.floor("lo_lat"), F.floor("hi_lat")))).withColumn("x", F.explode(F.sequence(F.floor("lo_lng"), F.floor("hi_lng"))))
    v = frame(spark, sf_dir, "verified").select("id", "lat", "lng", F.floor("lat").alias("y"), F.floor("lng").alias("x"))
    inside = v.join(cells, ["y", "x"]).where("lat between lo_lat and hi_lat and lng between lo_lng and hi_lng")
    return inside.groupBy("id").agg(F.min("district").alias("district"), F.count(F.lit(1)).alias("boxes"))


@query(cte("reports") + ", c AS (SELECT floor((lat + 90) / 180 * 256) AS y, floor((lng + 180) / 360 * 256) AS x, verified_id FROM reports) SELECT count(*) AS cells, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total, CAST(sum(linked) AS BIGINT) AS linked FROM (SELECT y, x, count(*) AS n, count(verified_id) AS linked FROM c GROUP BY 1, 2)")
def agg08_heatmap_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of level 12 rolled up to level 8 by prefix: totals are kept at each level."""
    fine = frame(spark, sf_dir, "reports").groupBy(quad_key(F.col("lat"), F.col("lng"), 12).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count("verified_id").alias("linked"))
    coarse = fine.groupBy(F.substring("cell", 1, 8).alias("cell")).agg(F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    return coarse.agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("most"), F.sum("n").alias("total"), F.sum("linked").alias("linked"))


@query(
    cte("reports")
    + """, c AS (SELECT CAST(floor((lat + 90) / 180 * 1024) AS BIGINT) AS y, CAST(floor((lng + 180) / 360 * 1024) AS BIGINT) AS x, verified_id FROM reports)
SELECT array_to_string(list_transform(range(9, -1, -1), lambda i: CAST(((y >> CAST(i AS INTEGER)) & 1) * 2 + ((x >> CAST(i AS INTEGER)) & 1) AS VARCHAR)), '') AS cell, count(*) AS n, count(verified_id) AS linked FROM c GROUP BY 1"""
)
def agg08_heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and linked count of each level-10 cell, the fullest first."""
    cell = quad_key(F.col("lat"), F.col("lng"), 10).alias("cell")
    return frame(spark, sf_dir, "reports").groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.count("verified_id").alias("linked")).orderBy(F.desc("n"), "cell")


_GRAPH = f""", p AS (SELECT id, lat, lng FROM reports WHERE verified_id IS NULL AND duplicate_of IS NULL), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.lat BETWEEN a.lat - 0.06 AND a.lat + 0.06 AND {km_sql("a", "b")} <= 5),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a), c AS (SELECT a AS id, min(b) AS cluster FROM t GROUP BY 1 HAVING count(*) > 1) """


def unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lng of the reports that belong to no event and repeat none."""
    return frame(spark, sf_dir, "reports").where("verified_id is null and duplicate_of is null").select("id", "lat", "lng")


@query(cte("reports").replace("WITH", "WITH RECURSIVE", 1) + _GRAPH + "SELECT id, cluster FROM c")
def dom06_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of all unassigned reports, eps 5 km, two points: with two, the components of the eps graph."""
    return dbscan(unassigned(spark, sf_dir), 5, 2, 40)


@query(
    cte("reports").replace("WITH", "WITH RECURSIVE", 1)
    + _GRAPH
    + f""", m AS (SELECT c.id, cluster, lat, lng FROM c JOIN p USING (id)), w AS (SELECT a.cluster, max({km_sql("a", "b")}) AS widest FROM m a JOIN m b USING (cluster) GROUP BY 1)
SELECT cluster, count(*) AS n, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng, round(any_value(widest), 5) AS widest_km FROM m JOIN w USING (cluster) GROUP BY 1"""
)
def agg14_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, planar centroid and greatest distance within each cluster; only corners of its hull are compared in pairs."""
    p = unassigned(spark, sf_dir)
    m = saved(p.join(dbscan(p, 5, 2, 40), "id"), "clustered")
    wide = widest(m, "cluster")
    mean = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lng"), 9).alias("lng"))
    return mean.join(wide, "cluster").select("cluster", "n", "lat", "lng", F.round("widest", 5).alias("widest_km"))


@query(
    cte("stations", "readings")
    + """SELECT station, recorded_s, order_id, line, n FROM (SELECT r.*, row_number() OVER (PARTITION BY station ORDER BY recorded_s DESC, order_id, line) AS n FROM readings r) WHERE n <= 24"""
)
def ml09_last_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("station").orderBy(F.desc("recorded_s"), "order_id", "line")
    return frame(spark, sf_dir, "readings").select("station", "recorded_s", "order_id", "line").withColumn("n", F.row_number().over(w)).where("n <= 24")
