"""Independence, evidence, contradiction, receipt and routing of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import coherence, density, fog_score, gust_score, rain_score
from ..functions.text import FLAG_FACTORS, FLAG_FLOOR
from ..operators import fusion
from ..operators.campaigns import LEAST_TEXT, REPORTERS, WITHIN_S, coordinated, halved
from ..operators.filters import in_force
from ..sources.bindings import AS_OF, cte, frame
from .registry import query

_PRIOR = "CASE source_type WHEN 'OFFICIAL_DISPATCH' THEN 1.0 WHEN 'CWC_GAUGE' THEN 0.95 WHEN 'AWS_SENSOR' THEN 0.9 WHEN 'CITIZEN_APP' THEN 0.6 WHEN 'NEWS_MEDIA' THEN 0.55 WHEN 'SOCIAL_MEDIA' THEN 0.5 END"


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").where("verified_id is not null")


@query(cte("reports") + f"SELECT verified_id AS id, max({_PRIOR}) AS reliability FROM reports WHERE verified_id IS NOT NULL GROUP BY 1")
def dom15_source_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest prior among an event's sources: strong evidence is not diluted by weak."""
    return linked(spark, sf_dir).groupBy(F.col("verified_id").alias("id")).agg(F.max(fusion.lookup(fusion.PRIORS, F.col("source_type"))).alias("reliability"))


@query(cte("reports") + "SELECT verified_id AS id, CASE WHEN count(DISTINCT reporter) FILTER (WHERE source_type = 'NEWS_MEDIA') >= 2 THEN 0.75 WHEN count(DISTINCT reporter) FILTER (WHERE source_type = 'NEWS_MEDIA') = 1 THEN 0.55 END AS news FROM reports WHERE verified_id IS NOT NULL GROUP BY 1")
def agg16_news_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.countDistinct(F.when(F.col("source_type") == "NEWS_MEDIA", F.col("reporter")))
    return linked(spark, sf_dir).groupBy(F.col("verified_id").alias("id")).agg(F.when(n >= 2, 0.75).when(n == 1, 0.55).alias("news"))


@query(
    cte("reports")
    + ", g AS (SELECT verified_id AS id, reporter, max(least(1.0, credibility / 0.6)) AS w, bool_or(contains(coalesce(flags_csv, ''), 'bot_account')) AS bot FROM reports WHERE verified_id IS NOT NULL GROUP BY 1, 2) SELECT id, round(sum(CASE WHEN bot THEN least(w, 0.5) ELSE w END), 6) AS effective, count(*) AS reporters FROM g GROUP BY 1"
)
def agg15_effective_reporters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reporter counts once, by the best report, up to 1; bots up to a half."""
    bot = F.coalesce(F.bool_or(F.col("flags_csv").contains("bot_account")), F.lit(False))
    g = linked(spark, sf_dir).groupBy(F.col("verified_id").alias("id"), "reporter").agg(F.max(F.least(F.lit(1.0), F.col("credibility") / 0.6)).alias("w"), bot.alias("bot"))
    return g.groupBy("id").agg(F.round(F.sum(F.when(F.col("bot"), F.least("w", F.lit(0.5))).otherwise(F.col("w"))), 6).alias("effective"), F.count(F.lit(1)).alias("reporters"))


# Precedence of hazards, the smaller wins a tie.
PRECEDENCE = {"URBAN_FLOOD": 1, "THUNDERSTORM": 5, "HEATWAVE": 7, "RAINFALL": 9}


@query(
    cte("reports")
    + ", v AS (SELECT verified_id AS id, hazard, count(*) AS n, any_value(CASE hazard WHEN 'URBAN_FLOOD' THEN 1 WHEN 'THUNDERSTORM' THEN 5 WHEN 'HEATWAVE' THEN 7 ELSE 9 END) AS p FROM reports WHERE verified_id IS NOT NULL AND hazard IS NOT NULL GROUP BY 1, 2), t AS (SELECT DISTINCT verified_id AS id FROM reports WHERE verified_id IS NOT NULL) SELECT t.id, coalesce((SELECT hazard FROM v WHERE v.id = t.id ORDER BY n DESC, p LIMIT 1), 'UNCLASSIFIED') AS event_type FROM t"
)
def agg17_majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hazard of most reports, ties by precedence; untagged reports have no vote."""
    votes = linked(spark, sf_dir).groupBy(F.col("verified_id").alias("id"), "hazard").agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("hazard").isNotNull(), F.struct("n", (-fusion.lookup(PRECEDENCE, F.col("hazard"))).alias("p")))
    return votes.groupBy("id").agg(F.coalesce(F.max_by("hazard", rank), F.lit("UNCLASSIFIED")).alias("event_type"))


@query(
    cte("readings")
    + "SELECT station, max(gust_kmh) AS gust, arg_max(recorded_s, (gust_kmh, -recorded_s)) FILTER (WHERE gust_kmh IS NOT NULL) AS gust_s, min(visibility_m) AS visibility, max(temperature_c) AS hottest, min(temperature_c) AS coldest, array_to_string(list_sort(list(DISTINCT code) FILTER (WHERE code IS NOT NULL)), ',') AS codes FROM readings WHERE recorded_s BETWEEN 850000000 AND 860000000 GROUP BY 1"
)
def agg18_station_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of each station in a window, the earliest hour of the strongest gust, and the weather codes seen."""
    rows = frame(spark, sf_dir, "readings").where("recorded_s between 850000000 and 860000000")
    gust = F.when(F.col("gust_kmh").isNotNull(), F.struct("gust_kmh", (-F.col("recorded_s")).alias("early")))
    return rows.groupBy("station").agg(
        F.max("gust_kmh").alias("gust"), F.max_by("recorded_s", gust).alias("gust_s"), F.min("visibility_m").alias("visibility"), F.max("temperature_c").alias("hottest"), F.min("temperature_c").alias("coldest"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes")
    )


_FORCE = f"status = 'actual' AND msg_type IN ('alert', 'update') AND coalesce(effective_s, sent_s) <= {AS_OF} AND expires_s >= {AS_OF}"
_WSCORE = "CASE severity WHEN 'Extreme' THEN 1.0 WHEN 'Severe' THEN 0.85 WHEN 'Moderate' THEN 0.6 ELSE 0.3 END"


@query(
    cte("verified", "warnings")
    + f", w AS (SELECT area, max({_WSCORE}) AS score FROM warnings WHERE {_FORCE} GROUP BY 1) SELECT v.id, coalesce(max(w.score), 0.0) AS official FROM verified v LEFT JOIN w ON w.area = concat(v.state, ' - ', v.district) GROUP BY 1"
)
def dom13_official_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most severe warning in force for each event's district; a fresh feed without one scores 0, which is a value."""
    w = frame(spark, sf_dir, "warnings").where(in_force(AS_OF)).groupBy("area").agg(F.max(fusion.lookup(fusion.WARNING_SCORES, F.col("severity"))).alias("score"))
    v = frame(spark, sf_dir, "verified").select("id", F.concat_ws("", "state", F.lit(" - "), "district").alias("area"), "district")
    return v.join(w, "area", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("official"))


_RAIN = "CASE WHEN rain <= 0 THEN 0.0 WHEN rain <= 2.5 THEN rain / 2.5 * 0.1 WHEN rain <= 15.6 THEN 0.1 + (rain - 2.5) / (15.6 - 2.5) * 0.25 WHEN rain <= 64.5 THEN 0.35 + (rain - 15.6) / (64.5 - 15.6) * 0.35 WHEN rain <= 115.6 THEN 0.7 + (rain - 64.5) / (115.6 - 64.5) * 0.2 WHEN rain <= 204.5 THEN 0.9 + (rain - 115.6) / (204.5 - 115.6) * 0.1 ELSE 1.0 END"
_FOG = "CASE WHEN fog < 50 THEN 1.0 WHEN fog < 200 THEN 0.85 WHEN fog < 500 THEN 0.6 WHEN fog < 1000 THEN 0.4 WHEN fog IS NOT NULL THEN 0.0 END"
_GUST = "CASE WHEN gust >= 89 THEN 1.0 WHEN gust >= 62 THEN 0.8 WHEN gust >= 50 THEN 0.6 WHEN gust >= 39 THEN 0.4 WHEN gust IS NOT NULL THEN 0.0 END"
_TYPE = "CASE WHEN event_type IN ('RAINFALL', 'URBAN_FLOOD', 'RIVER_BREACH', 'LANDSLIDE') THEN {rain} WHEN event_type = 'FOG' THEN {fog} WHEN event_type IN ('STRONG_WIND', 'CYCLONE', 'DUST_STORM') THEN {gust} END"


@query(
    cte("verified", "readings")
    + f", o AS (SELECT order_id AS id, sum(rainfall_mm) AS rain, min(visibility_m) AS fog, max(gust_kmh) AS gust FROM readings GROUP BY 1) SELECT v.id, round({_TYPE.format(rain=f'CASE WHEN rain IS NOT NULL THEN {_RAIN} END', fog=_FOG, gust=_GUST)}, 5) AS weather FROM verified v LEFT JOIN o USING (id)"
)
def dom09_weather_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather score of each event by the scale of its hazard; null where nothing was measured or no scale applies."""
    return weather(spark, sf_dir).select("id", F.round("weather", 5).alias("weather"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frame(spark, sf_dir, "readings").groupBy(F.col("order_id").alias("id")).agg(F.sum("rainfall_mm").alias("rain"), F.min("visibility_m").alias("fog"), F.max("gust_kmh").alias("gust"), F.max("temperature_c").alias("hottest"))
    return frame(spark, sf_dir, "verified").join(o, "id", "left").withColumn("weather", weather_score(F.col("event_type")))


def weather_score(kind: Column) -> Column:
    """What was measured (rain, fog, gust) by the scale of the hazard; null where no scale applies or nothing was measured."""
    return F.when(kind.isin("RAINFALL", "URBAN_FLOOD", "RIVER_BREACH", "LANDSLIDE"), rain_score(F.col("rain"))).when(kind == "FOG", fog_score(F.col("fog"))).when(kind.isin("STRONG_WIND", "CYCLONE", "DUST_STORM"), gust_score(F.col("gust")))


_CONTRA = "CASE WHEN event_type = 'FOG' AND fog > 5000 THEN 1 WHEN event_type = 'STRONG_WIND' AND gust < 20 THEN 1 WHEN event_type = 'HEATWAVE' AND hottest < 35 THEN 1 WHEN event_type IN ('RAINFALL', 'URBAN_FLOOD', 'CLOUDBURST') AND rain = 0 THEN 1 ELSE 0 END"


@query(cte("verified", "readings") + f", o AS (SELECT order_id AS id, sum(rainfall_mm) AS rain, min(visibility_m) AS fog, max(gust_kmh) AS gust, max(temperature_c) AS hottest FROM readings GROUP BY 1) SELECT id, {_CONTRA} AS contradicted FROM verified LEFT JOIN o USING (id)")
def dom12_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 where a measurement says the opposite of the claim; missing data never contradicts."""
    return weather(spark, sf_dir).select("id", contradicted().cast("int").alias("contradicted"))


def contradicted():
    kind = F.col("event_type")
    rule = ((kind == "FOG") & (F.col("fog") > 5000)) | ((kind == "STRONG_WIND") & (F.col("gust") < 20)) | ((kind == "HEATWAVE") & (F.col("hottest") < 35)) | (kind.isin("RAINFALL", "URBAN_FLOOD", "CLOUDBURST") & (F.col("rain") == 0))
    return F.coalesce(rule, F.lit(False))


_RECEIPT_SQL = f""", o AS (SELECT order_id AS id, sum(rainfall_mm) AS rain, min(visibility_m) AS fog, max(gust_kmh) AS gust, max(temperature_c) AS hottest FROM readings GROUP BY 1),
r AS (SELECT verified_id AS id, count(*) AS n, max({_PRIOR}) AS reliability, bool_and(source_type IN ('NEWS_MEDIA', 'SOCIAL_MEDIA')) AS posts FROM reports WHERE verified_id IS NOT NULL GROUP BY 1),
w AS (SELECT area, max({_WSCORE}) AS score FROM warnings WHERE {_FORCE} GROUP BY 1),
s AS (SELECT v.id, v.severity, v.event_type, r.posts, r.reliability, {_CONTRA} AS contradicted, CASE WHEN {_CONTRA} = 1 THEN 0.0 ELSE {_TYPE.format(rain=f'CASE WHEN rain IS NOT NULL THEN {_RAIN} END', fog=_FOG, gust=_GUST)} END AS weather, coalesce(w.score, 0.0) AS official,
 greatest(0.0, least(1.0, (1 - exp(-n / 6.5)) / (1 - exp(-25 / 6.5)))) AS density, CASE WHEN radius_km >= 10 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * radius_km / 10)) END AS coherence
 FROM verified v JOIN r USING (id) LEFT JOIN o USING (id) LEFT JOIN w ON w.area = concat(v.state, ' - ', v.district)),
t AS (SELECT *, CASE WHEN weather IS NULL THEN 0.0 ELSE 0.2 END + 0.1 + 0.2 + 0.15 + 0.15 AS online, coalesce(round(0.2 * weather, 4), 0.0) + round(0.1 * official, 4) + round(0.2 * density, 4) + round(0.15 * coherence, 4) + round(0.15 * reliability, 4) AS total FROM s),
u AS (SELECT *, round(total / online, 6) AS mean, CASE WHEN contradicted = 1 THEN 'CONTRADICTED' WHEN official >= 0.6 OR coalesce(weather, 0.0) >= 0.6 THEN 'CORROBORATED' ELSE 'UNCONFIRMED' END AS verdict FROM t)
SELECT id, mean, round(online, 2) AS coverage, verdict, CASE WHEN round(total / online + 1e-9, 4) >= 0.9 AND contradicted = 0 AND NOT posts AND event_type <> 'UNCLASSIFIED' THEN 'AUTO_PUBLISHED' WHEN round(total / online + 1e-9, 4) >= 0.6 OR severity IN ('HIGH', 'CRITICAL') THEN 'PENDING_HUMAN_REVIEW' ELSE 'QUARANTINED' END AS routed FROM u"""


@query(cte("verified", "reports", "readings", "warnings") + _RECEIPT_SQL)
def dom19_event_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with reports: receipt, verdict and routing, from counts, sources, weather, warnings and coherence."""
    return scored(spark, sf_dir).select("id", F.round("mean", 6).alias("mean"), "coverage", "verdict", "routed")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt of each event that has reports; vision and anomaly are offline."""
    posts = F.bool_and(F.col("source_type").isin("NEWS_MEDIA", "SOCIAL_MEDIA"))
    r = linked(spark, sf_dir).groupBy(F.col("verified_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(fusion.lookup(fusion.PRIORS, F.col("source_type"))).alias("reliability"), posts.alias("posts"))
    w = frame(spark, sf_dir, "warnings").where(in_force(AS_OF)).groupBy("area").agg(F.max(fusion.lookup(fusion.WARNING_SCORES, F.col("severity"))).alias("score"))
    rows = weather(spark, sf_dir).join(r, "id").withColumn("area", F.concat("state", F.lit(" - "), "district")).join(w, "area", "left").withColumn("against", contradicted())
    rows = rows.withColumn("weather", F.when(F.col("against"), 0.0).otherwise(F.col("weather"))).withColumn("official", F.coalesce("score", F.lit(0.0)))
    scores = {"weather": F.col("weather"), "official": F.col("official"), "density": density(F.col("n")), "coherence": coherence(F.col("radius_km"), F.lit(5.0)), "reliability": F.col("reliability")}
    rows = rows.withColumnRenamed("confidence", "stored").withColumn("receipt", fusion.receipt(scores)).select("*", "receipt.*")
    capped = F.col("against") | (F.col("event_type") == "UNCLASSIFIED") | F.col("posts")
    return rows.withColumn("verdict", fusion.verdict(F.col("against").cast("int"), F.col("official"), F.col("weather"))).withColumn("routed", fusion.review_status(F.col("confidence"), F.col("severity"), capped))


@query(
    cte("verified")
    + """SELECT id, CASE WHEN confidence >= 0.9 AND event_type <> 'UNCLASSIFIED' AND verdict IS DISTINCT FROM 'CONTRADICTED' THEN 'AUTO_PUBLISHED' WHEN confidence >= 0.6 OR severity IN ('HIGH', 'CRITICAL') THEN 'PENDING_HUMAN_REVIEW' ELSE 'QUARANTINED' END AS routed,
 CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN CASE WHEN review_status = 'HUMAN_APPROVED' OR confidence >= 0.9 THEN 'CRITICAL_VERIFIED' ELSE 'UNVERIFIED_THREAT' END ELSE CASE WHEN review_status = 'HUMAN_APPROVED' OR confidence >= 0.6 THEN 'CONFIRMED_MINOR' ELSE 'NOISE' END END AS quadrant FROM verified"""
)
def dom17_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = (F.col("event_type") == "UNCLASSIFIED") | F.coalesce(F.col("verdict") == "CONTRADICTED", F.lit(False))
    c, s = F.col("confidence"), F.col("severity")
    return frame(spark, sf_dir, "verified").select("id", fusion.review_status(c, s, capped).alias("routed"), fusion.quadrant(c, s, F.col("review_status") == "HUMAN_APPROVED").alias("quadrant"))


@query(
    cte("readings")
    + """, m AS (SELECT order_id AS id, sum(rainfall_mm) AS rain, max(gust_kmh) AS gust, min(visibility_m) AS fog, count(*) AS n FROM readings GROUP BY 1)
SELECT id, greatest(CASE WHEN rain >= 204.5 THEN 3 WHEN rain >= 115.6 THEN 2 WHEN rain >= 64.5 THEN 1 ELSE 0 END, CASE WHEN gust >= 89 THEN 3 WHEN gust >= 62 THEN 2 WHEN gust >= 39 THEN 1 ELSE 0 END, CASE WHEN fog <= 50 THEN 3 WHEN fog <= 200 THEN 2 WHEN fog <= 500 THEN 1 ELSE 0 END, CASE WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END) AS severity FROM m"""
)
def dom18_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of the measured axes and of the number of reports, which alone never makes CRITICAL (3)."""
    m = frame(spark, sf_dir, "readings").groupBy(F.col("order_id").alias("id")).agg(F.sum("rainfall_mm").alias("rain"), F.max("gust_kmh").alias("gust"), F.min("visibility_m").alias("fog"), F.count(F.lit(1)).alias("n"))
    count = F.when(F.col("n") >= 10, 2).when(F.col("n") >= 5, 1).otherwise(0)
    return m.select("id", F.greatest(fusion.ordinal(F.col("rain"), (64.5, 115.6, 204.5)), fusion.ordinal(F.col("gust"), (39, 62, 89)), fusion.ordinal(F.col("fog"), (500, 200, 50), True), count).alias("severity"))


#: A message that many send, and one in eight words it on its own; every ninth sender is not known.
_MESSAGE = "concat('Water on the road near the OLD market!  Please share: ', event_type, CASE WHEN event_id % 8 = 0 THEN concat(' ', event_id) ELSE '' END)"
_SENDER = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('u', user_id) END"
_KEY = r"trim(regexp_replace(lower(raw_text), '[!-/:-@\[-`{-~\s]+', ' ', 'g'))"
_COPIES = f"""WITH r AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, {_SENDER} AS reporter, {_MESSAGE} AS raw_text, (event_id * 31 % 96 + 5) / 1e2 AS credibility, event_id % 50 = 3 AS already FROM events),
t AS (SELECT *, coalesce(concat('r', reporter), concat('i', id)) AS who, {_KEY} AS k FROM r),
m AS (SELECT b.id, b.k, b.at_s, count(DISTINCT a.who) AS reporters FROM t b JOIN t a ON a.k = b.k AND a.at_s BETWEEN b.at_s - {WITHIN_S} AND b.at_s WHERE length(b.k) >= {LEAST_TEXT} GROUP BY 1, 2, 3 HAVING count(DISTINCT a.who) >= {REPORTERS})"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "unix_timestamp(cast(ts AS timestamp)) AS at_s", f"{_SENDER} AS reporter", f"{_MESSAGE} AS raw_text", "(event_id * 31 % 96 + 5) / 1e2 AS credibility", "event_id % 50 = 3 AS already")


@query(f"{_COPIES} SELECT id, round(CASE WHEN already THEN credibility ELSE greatest({FLAG_FLOOR}, round(credibility * {FLAG_FACTORS['coordinated']} + 1e-9, 4)) END, 6) AS credibility FROM r WHERE id IN (SELECT a.id FROM t a JOIN m ON a.k = m.k AND a.at_s BETWEEN m.at_s - {WITHIN_S} AND m.at_s)")
def dom03_coordinated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a message that three reporters or more sent within ten minutes, and what their credibility is then: halved once, and not
    again for those that were marked before."""
    r = messages(spark, sf_dir)
    return coordinated(r).join(r, "id").select("id", F.round(halved(F.col("credibility"), F.col("already")), 6).alias("credibility"))


@query(f"{_COPIES} SELECT id FROM t WHERE id IN (SELECT a.id FROM t a JOIN m ON a.k = m.k AND a.at_s BETWEEN m.at_s - {WITHIN_S} AND m.at_s)")
def win11_coordinated_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one normalised text by three reporters or more within ten minutes: a sliding count of senders over each text's reports in order of time."""
    return coordinated(messages(spark, sf_dir))


@query("WITH g AS (SELECT text, count(*) AS n, min(doc_id) AS keep FROM documents GROUP BY 1) SELECT d.doc_id, CASE WHEN g.keep % 10 < 8 THEN 'train' WHEN g.keep % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM documents d JOIN g USING (text)")
def ml08_leakage_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts fall into one split."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("k"))
    g = d.groupBy("k").agg((F.min("doc_id") % 10).alias("m"))
    return d.join(g, "k").select("doc_id", F.when(F.col("m") < 8, "train").when(F.col("m") == 8, "validation").otherwise("test").alias("split"))
