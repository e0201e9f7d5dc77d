"""Intake of posts and headlines, places in text, station evidence, merges, sweeps and replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.geo import distance_factor, gust_score, rain_score
from ..functions.text import headline_key, text_key
from ..operators.alerting import expired
from ..operators.automaton import names_in
from ..operators.filters import report_status
from ..operators.spatial import clusters_by_family, nearest, outreaching, radius_join
from ..sources.bindings import AS_OF, DAY, HOUR, cte, flags, frame
from ..sources.cursor import Timelines
from ..sources.tables import shared_path
from ..streaming.runner import collected
from .geography import km_sql
from .registry import query
from .relational import EVENTS_AS_OF, STATUS_SQL, taxonomy


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN turn - 1 ELSE turn END AS original, sha256(concat('key', role)) AS author FROM conversations")
def src13_social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as JSON, every third a boost of the one before: a boost stands for its original, authors are keyed hashes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    inner = F.when(F.col("turn") % 3 == 1, F.struct((F.col("turn") - 1).alias("id")))
    body = F.to_json(F.struct(F.col("turn").alias("id"), inner.alias("reblog"), F.col("role").alias("account")))
    p = c.select("conv_id", "turn", F.from_json(body, "id bigint, reblog struct<id: bigint>, account string").alias("p"))
    return p.select("conv_id", "turn", F.coalesce("p.reblog.id", "p.id").alias("original"), F.sha2(F.concat(F.lit("key"), "p.account"), 256).alias("author"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(concat(p_name, ' - ', p_brand), '\s+[-|]\s+[^-|]+$', '')), '[!-/:-@\[-`{-~\s]+', ' ', 'g')) AS key_, p_size > 48 AS stale FROM part""")
def src14_news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with their publisher stripped; over 48 hours old is stale."""
    age_s = F.col("p_size") * HOUR
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", headline_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("key_"), (age_s > 48 * HOUR).alias("stale"))


@query("SELECT concat('i', user_id % 3) AS instance, event_type AS tag, event_id AS id, concat('u', user_id) AS account FROM events")
def src15_cursor_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of three instances polled by tag, in two runs from one checkpoint: what appeared by the first, and what was added since."""
    spark.dataSource.register(Timelines)
    posts, place = shared_path(spark, "timelines"), shared_path(spark, "polled")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.concat(F.lit("i"), F.col("user_id") % 3).alias("instance"), F.col("event_type").alias("tag"), F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("account"))
    half = e.agg((F.max("event_id") / 2).cast("bigint").alias("h")).first()["h"] or 0
    for lot in (F.col("id") <= half, F.col("id") > half):
        rows.where(lot).write.mode("append").partitionBy("instance", "tag").parquet(posts)
        polled = collected(spark.readStream.format("timelines").option("path", posts).load(), place=place)
    return polled


@query(cte("warnings", "reports") + "SELECT w.identifier, d.district FROM warnings w JOIN (SELECT DISTINCT district FROM reports WHERE district IS NOT NULL) d ON lower(w.area) LIKE concat('% ', lower(d.district))")
def jon19_places_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District names in warning areas, all looked up in one pass over a text."""
    names = frame(spark, sf_dir, "reports").where("district is not null").select("district").distinct().withColumn("k", text_key(F.col("district")))
    return names_in(frame(spark, sf_dir, "warnings"), "identifier", "area", names).join(names, "k").select("identifier", "district")


@F.pandas_udf(DoubleType())
def indel_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 - (insertions + deletions) / total length: twice the longest common subsequence over it; 1 for two empty texts.

    The subsequence is found a row of bits at a time.
    """

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if not a or not b:
            return 0.0 if a or b else 1.0
        masks: dict[str, int] = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        full = open_ = (1 << len(a)) - 1  # a bit is cleared for each character that the common subsequence gains
        for y in b:
            hit = open_ & masks.get(y, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & full
        return 2 * (len(a) - open_.bit_count()) / (len(a) + len(b))

    for a, b in parts:
        yield pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@query()
def str07_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.round(indel_ratio("p_name", "p_type"), 6).alias("ratio"))


@query(r"""WITH t AS (SELECT doc_id, text, string_split(trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g')), ' ') AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, round(1 - len(list_distinct(w)) * 1.0 / len(w), 6) AS repetition, round(length(regexp_replace(text, '[^!?]', '', 'g')) * 1.0 / greatest(length(text), 1), 6) AS marks FROM t""")
def str19_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, share of repeated tokens, and share of exclamation and question marks."""
    split = F.split(text_key(F.col("text")), " ")
    both = F.transform(F.array(split), lambda w: F.struct(F.size(w).cast("bigint").alias("tokens"), (1 - F.size(F.array_distinct(w)) / F.size(w)).alias("repetition")))[0]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", both.alias("f"), (F.regexp_count("text", F.lit("[!?]")) / F.greatest(F.length("text"), F.lit(1))).alias("marks"))
    return d.select("doc_id", "f.tokens", F.round("f.repetition", 6).alias("repetition"), F.round("marks", 6).alias("marks"))


@query(
    cte("verified", "stations", "readings")
    + f""", o AS (SELECT station, max(gust_kmh) AS gust, sum(rainfall_mm) AS rain FROM readings WHERE recorded_s BETWEEN 857000000 AND 857100000 GROUP BY 1),
n AS (SELECT v.id, s.station, {km_sql('v', 's')} AS km FROM verified v JOIN stations s ON {km_sql('v', 's')} <= 50 WHERE v.event_type IN ('STRONG_WIND', 'RAINFALL')),
x AS (SELECT n.id, n.station, km, CASE WHEN gust >= 89 THEN 1.0 WHEN gust >= 62 THEN 0.8 WHEN gust >= 50 THEN 0.6 WHEN gust >= 39 THEN 0.4 ELSE 0.0 END * CASE WHEN km <= 25 THEN 1.0 ELSE 0.8 END AS score FROM n JOIN o USING (station) WHERE gust IS NOT NULL)
SELECT id, arg_min(station, (km, station)) AS nearest, round(max(score), 5) AS strongest FROM x GROUP BY 1"""
)
def dom10_station_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stations within 50 km: the nearest, and the strongest gust score weakened by distance."""
    o = frame(spark, sf_dir, "readings").where("recorded_s between 857000000 and 857100000").groupBy("station").agg(F.max("gust_kmh").alias("gust")).where("gust is not null")
    s = frame(spark, sf_dir, "stations").select("station", "lat", "lng").join(o, "station")
    v = frame(spark, sf_dir, "verified").where("event_type in ('STRONG_WIND', 'RAINFALL')").select("id", "lat", "lng")
    x = radius_join(v, s, 50, 40).withColumn("score", gust_score(F.col("r_gust")) * distance_factor(F.col("km")))
    return x.groupBy("id").agg(F.min_by("r_station", F.struct("km", "r_station")).alias("nearest"), F.round(F.max("score"), 5).alias("strongest"))


def combined(kind: Column, model: Column, station: Column) -> Column:
    """One score of two: rain trusts the model, scalars the station, phenomena the stronger; what is missing gives way."""
    return F.when(kind.isin("RAINFALL", "URBAN_FLOOD"), F.coalesce(model, station)).when(kind.isin("HEATWAVE", "COLD_WAVE", "FOG"), F.coalesce(station, model)).otherwise(F.greatest(model, station))


_M, _S = "CASE WHEN rain IS NULL THEN NULL WHEN rain <= 0 THEN 0.0 WHEN rain <= 2.5 THEN rain / 2.5 * 0.1 WHEN rain <= 15.6 THEN 0.1 + (rain - 2.5) / (15.6 - 2.5) * 0.25 WHEN rain <= 64.5 THEN 0.35 + (rain - 15.6) / (64.5 - 15.6) * 0.35 WHEN rain <= 115.6 THEN 0.7 + (rain - 64.5) / (115.6 - 64.5) * 0.2 WHEN rain <= 204.5 THEN 0.9 + (rain - 115.6) / (204.5 - 115.6) * 0.1 ELSE 1.0 END", "CASE WHEN gust >= 89 THEN 1.0 WHEN gust >= 62 THEN 0.8 WHEN gust >= 50 THEN 0.6 WHEN gust >= 39 THEN 0.4 WHEN gust IS NOT NULL THEN 0.0 END"


@query(
    cte("verified", "readings")
    + f", o AS (SELECT order_id AS id, sum(rainfall_mm) AS rain, max(gust_kmh) AS gust FROM readings GROUP BY 1), x AS (SELECT v.id, event_type, {_M} AS m, {_S} AS s FROM verified v JOIN o USING (id)) SELECT id, round(CASE WHEN event_type IN ('RAINFALL', 'URBAN_FLOOD') THEN coalesce(m, s) WHEN event_type IN ('HEATWAVE', 'COLD_WAVE', 'FOG') THEN coalesce(s, m) ELSE greatest(m, s) END, 5) AS score, coalesce(abs(m - s) >= 0.4, false) AS disagree FROM x"
)
def dom11_combined_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frame(spark, sf_dir, "readings").groupBy(F.col("order_id").alias("id")).agg(rain_score(F.sum("rainfall_mm")).alias("m"), gust_score(F.max("gust_kmh")).alias("s"))
    v = frame(spark, sf_dir, "verified").select("id", "event_type").join(o, "id")
    return v.select("id", F.round(combined(F.col("event_type"), F.col("m"), F.col("s")), 5).alias("score"), F.coalesce(F.abs(F.col("m") - F.col("s")) >= 0.4, F.lit(False)).alias("disagree"))


FAMILY_OF = "CASE {c} WHEN 'HEATWAVE' THEN 'thermal' WHEN 'COLD_WAVE' THEN 'thermal' WHEN 'FOG' THEN 'visibility' WHEN 'UNCLASSIFIED' THEN NULL WHEN 'CLOUDBURST' THEN 'water' WHEN 'CYCLONE_INUNDATION' THEN 'water' WHEN 'URBAN_FLOOD' THEN 'water' WHEN 'RIVER_BREACH' THEN 'water' WHEN 'LANDSLIDE' THEN 'water' WHEN 'RAINFALL' THEN 'water' ELSE 'convective' END"


@query(
    cte("reports", "verified")
    + f""", r AS (SELECT *, {FAMILY_OF.format(c="coalesce(hazard, 'UNCLASSIFIED')")} AS family FROM reports WHERE verified_id IS NULL AND duplicate_of IS NULL), v AS (SELECT *, {FAMILY_OF.format(c='event_type')} AS family FROM verified WHERE review_status <> 'REJECTED' AND severity = 'CRITICAL'),
p AS (SELECT r.id, v.id AS event, {km_sql('r', 'v')} AS km, v.radius_km + 5 AS reach FROM r JOIN v ON v.lat BETWEEN r.lat - 0.2 AND r.lat + 0.2 AND v.lng BETWEEN r.lng - 0.3 AND r.lng + 0.3 AND (r.family = v.family OR r.family IS NULL OR v.family IS NULL)) SELECT id, arg_min(event, (km, event)) AS event FROM p WHERE km <= reach GROUP BY 1"""
)
def dom07_merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each unassigned report the nearest open serious event of its family that reaches it; untagged ones fit any."""
    families = taxonomy(spark).select(F.col("event_type").alias("hazard"), "family")
    r = frame(spark, sf_dir, "reports").where("verified_id is null and duplicate_of is null").select("id", "lat", "lng", "hazard").join(families, "hazard", "left").drop("hazard")
    v = frame(spark, sf_dir, "verified").where("review_status <> 'REJECTED' and severity = 'CRITICAL'").select(F.col("id").alias("event"), "lat", "lng", "radius_km", F.col("event_type").alias("hazard")).join(families, "hazard", "left").drop("hazard")
    fits = (F.col("km") <= F.col("r_radius_km") + 5) & (F.col("family").isNull() | F.col("r_family").isNull() | (F.col("family") == F.col("r_family")))
    return nearest(r, outreaching(v, "event", "radius_km", ("family",)), "id", 13.4, fits, 40, spread_right=True).select("id", F.col("r_event").alias("event"))


@query(cte("reports") + f"SELECT id, {STATUS_SQL} AS status FROM reports WHERE {STATUS_SQL} IS DISTINCT FROM CASE WHEN id % 2 = 0 THEN 'unfused' ELSE 'fused' END")
def dom25_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose derived status differs from what is stored; only those would be written."""
    rows = frame(spark, sf_dir, "reports").withColumn("flags", flags()).withColumn("stored", F.when(F.col("id") % 2 == 0, "unfused").otherwise("fused")).withColumn("status", report_status())
    return rows.where(~F.col("status").eqNullSafe(F.col("stored"))).select("id", "status")


@query(cte("verified") + f"SELECT id, CASE WHEN verified_s + 3600 <= {EVENTS_AS_OF - 200 * DAY} THEN 'EXPIRED' ELSE 'ACTIVE' END AS state FROM verified WHERE review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED')")
def alr05_expiry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "verified").where(F.col("review_status").isin("AUTO_PUBLISHED", "HUMAN_APPROVED"))
    return v.select("id", F.when(expired(F.col("verified_s"), EVENTS_AS_OF - 200 * DAY), "EXPIRED").otherwise("ACTIVE").alias("state"))


@query(
    cte("reports")
    + "SELECT source_type, count(*) FILTER (WHERE n > last_ok) AS consecutive_failures, max(at_s) FILTER (WHERE ok) AS last_success_s FROM (SELECT *, coalesce(max(n) FILTER (WHERE ok) OVER (PARTITION BY source_type), 0) AS last_ok FROM (SELECT source_type, at_s, id % 7 <> 0 AS ok, row_number() OVER (PARTITION BY source_type ORDER BY at_s, id) AS n FROM reports)) GROUP BY 1"
)
def stm09_feed_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each feed since its last success, from aggregates alone: those later than the newest success."""
    r = frame(spark, sf_dir, "reports").select("source_type", "at_s", "id", (F.col("id") % 7 != 0).alias("ok"))
    last = r.groupBy("source_type").agg(F.max(F.when(F.col("ok"), F.struct("at_s", "id"))).alias("last"))
    later = F.col("last").isNull() | (F.struct("at_s", "id") > F.col("last"))
    return r.join(last, "source_type").groupBy("source_type").agg(F.count_if(later).alias("consecutive_failures"), F.max("last.at_s").alias("last_success_s"))


@query(cte("verified") + f"SELECT a.id AS a, b.id AS b FROM verified a JOIN verified b ON a.id < b.id AND a.event_type = b.event_type AND a.state = b.state AND abs(a.verified_s - b.verified_s) <= {2 * DAY} AND {km_sql('a', 'b')} <= 5 AND b.lat BETWEEN a.lat - 0.1 AND a.lat + 0.1")
def ml03_event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events of one type and state within 5 km and two days: candidates to merge."""
    v = frame(spark, sf_dir, "verified").select("id", "lat", "lng", "event_type", "state", "verified_s")
    p = radius_join(v, v, 5, 40)
    return p.where((F.col("id") < F.col("r_id")) & (F.col("event_type") == F.col("r_event_type")) & (F.col("state") == F.col("r_state")) & (F.abs(F.col("verified_s") - F.col("r_verified_s")) <= 2 * DAY)).select(F.col("id").alias("a"), F.col("r_id").alias("b"))


@query(cte("reports") + f"SELECT reporter, date_bin AS hour_s, n FROM (SELECT reporter, at_s // 3600 * 3600 AS date_bin, count(*) OVER (PARTITION BY reporter ORDER BY at_s // 3600 RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS n, row_number() OVER (PARTITION BY reporter, at_s // 3600 ORDER BY id) AS k FROM reports WHERE at_s < {AS_OF}) WHERE k = 1")
def stm06_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each reporter in the 24 hours up to each hour with one: counted by hour first, then over a range of hours."""
    hour = F.floor(F.col("at_s") / HOUR).cast("bigint")
    h = frame(spark, sf_dir, "reports").where(F.col("at_s") < AS_OF).groupBy("reporter", hour.alias("h")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("reporter").orderBy("h").rangeBetween(-23, 0)
    return h.select("reporter", (F.col("h") * HOUR).alias("hour_s"), F.sum("m").over(w).alias("n"))


@query("SELECT concat('VI', chr(CAST(65 + s_suppkey % 26 AS INTEGER)), chr(CAST(65 + s_suppkey % 7 AS INTEGER))) AS icao, count(*) AS n FROM supplier WHERE s_suppkey % 4 < 2 GROUP BY 1")
def src08_bulk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzipped CSV of reports from many countries, written and read back: only Indian stations, by the first two letters, count."""
    folder = shared_path(spark, "bulk")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    land = F.element_at(F.array(F.lit("VI"), F.lit("VI"), F.lit("OP"), F.lit("VG")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    code = F.concat(land, F.char(65 + F.col("s_suppkey") % 26), F.char(65 + F.col("s_suppkey") % 7))
    s.select(code.alias("station_id"), F.col("s_name").alias("raw_text")).write.option("header", True).option("compression", "gzip").csv(folder)
    rows = spark.read.option("header", True).schema("station_id string, raw_text string").csv(folder)
    return rows.where(F.substring("station_id", 1, 2).isin("VI", "VO", "VA", "VE")).groupBy(F.col("station_id").alias("icao")).agg(F.count(F.lit(1)).alias("n"))


# Eps in km and look-back in hours of each hazard family.
FAMILY_GATES = {"water": (5.0, 6), "convective": (10.0, 3), "thermal": (25.0, 24), "visibility": (15.0, 12)}
_EPS = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in FAMILY_GATES.items())
_BACK = " ".join(f"WHEN '{k}' THEN {v[1] * HOUR}" for k, v in FAMILY_GATES.items())


@query(
    cte("reports").replace("WITH", "WITH RECURSIVE", 1)
    + f""", f AS (SELECT *, {FAMILY_OF.format(c="coalesce(hazard, 'UNCLASSIFIED')")} AS own FROM reports), p AS (SELECT k AS family, id, lat, lng FROM f, (SELECT unnest(['water', 'convective', 'thermal', 'visibility']) AS k) WHERE (own IS NULL OR own = k) AND at_s >= {AS_OF - 12 * HOUR} - CASE k {_BACK} END),
e AS (SELECT a.family, a.id AS a, b.id AS b FROM p a JOIN p b ON a.family = b.family AND abs(a.lat - b.lat) < 0.3 AND {km_sql("a", "b")} <= CASE a.family {_EPS} END),
t(family, a, b) AS (SELECT family, a, b FROM e UNION SELECT t.family, t.a, e.b FROM t JOIN e ON t.family = e.family AND t.b = e.a) SELECT family, a AS id, min(b) AS cluster FROM t GROUP BY 1, 2 HAVING count(*) > 1"""
)
def dom05_family_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters within each of the four families, by its own radius and look-back; untagged reports may join any family."""
    families = taxonomy(spark).select(F.col("event_type").alias("hazard"), "family")
    r = frame(spark, sf_dir, "reports").select("id", "lat", "lng", "at_s", "hazard").join(families, "hazard", "left")
    own = F.array(*(F.when((F.col("family").isNull() | (F.col("family") == k)) & (F.col("at_s") >= AS_OF - (12 + hours) * HOUR), k) for k, (_, hours) in FAMILY_GATES.items()))
    p = r.select(F.explode(F.array_compact(own)).alias("family"), "id", "lat", "lng")
    return clusters_by_family(p, {k: eps for k, (eps, _) in FAMILY_GATES.items()}, 40)


def kept_back() -> Column:
    """Whether a document's label is not learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query()
def ml06_text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality predicted from texts by logistic regression over hashed TF-IDF terms, fitted on the labelled documents but for every fifth, which tests hold it against.

    Terms are a text's words, its runs of two marks or more, and one term for each word in capitals.
    """
    t = F.coalesce("text", F.lit(""))
    shouts = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\p{L})(\p{Lu}{2,})(?!\p{L})"), 1), lambda x: F.lit("^capitals"))
    words = F.concat(F.array_remove(F.split(text_key(t), " "), ""), F.regexp_extract_all(t, F.lit(r"([^\p{L}\p{N}\s]{2,})"), 1), shouts)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("words"))
    known = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality").isNotNull() & ~kept_back()).select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    steps = [HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 12), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)]
    return Pipeline(stages=steps).fit(known).transform(d).select("doc_id", F.col("prediction").cast("int").alias("quality"))
