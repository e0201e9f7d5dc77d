"""The whole way of a report: intake, derived fields, duplicates, clusters, receipt and routing, for all reports at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import coherence, density
from ..functions.text import FLAG_FACTORS, credibility, text_flags
from ..operators import fusion
from ..operators.campaigns import LEAST_TEXT as LEAST_TEXT_C
from ..operators.campaigns import REPORTERS, WITHIN_S, coordinated
from ..operators.dedup import CANDIDATES, CITIZEN_KM, CITIZEN_S, LINK_H, SIMILAR, TEXT_H, citizen_parents, feed_parents, resolved
from ..operators.shapes import widest
from ..operators.filters import in_force
from ..operators.spatial import connected
from ..operators.tiles import links
from ..sources.bindings import AS_OF, HOUR, cte, frame
from ..sources.tables import saved, shared_path
from ..streaming.events import open_events
from ..streaming.runner import drain, read_stream
from ..streaming.state import rocksdb
from .evidence import _CONTRA, _FOG, _FORCE, _GUST, _RAIN, _TYPE, _WSCORE, PRECEDENCE, contradicted, weather_score
from .geography import km_sql
from .intake import FAMILY_GATES, FAMILY_OF
from .registry import query

FEEDS = ("NEWS_MEDIA", "SOCIAL_MEDIA")
_EPS = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in FAMILY_GATES.items())
_BACK = " ".join(f"WHEN '{k}' THEN {v[1] * HOUR}" for k, v in FAMILY_GATES.items())


def _bare(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '(?i)^\s*((urgent|breaking|alert|fwd|fw|forwarded|rt|update|attention|please share)\s*[:\-!]+\s*)+', ''), '\s+', ' ', 'g'))"


def _alike(a: str, b: str) -> str:
    return f"1 - levenshtein({a}, {b}) * 1.0 / greatest(length({a}), length({b})) >= {SIMILAR}"


_CITIZEN = f"""c AS (SELECT id, at_s, lat, lng, raw_text AS x, {_bare('raw_text')} AS y FROM {{rows}} WHERE source_type = 'CITIZEN_APP' AND coalesce(place_precision, 'gps') = 'gps'),
cp AS (SELECT b.id, arg_min(a.id, (a.at_s, a.id)) AS parent FROM c b JOIN c a ON a.at_s > b.at_s - {CITIZEN_S} AND (a.at_s < b.at_s OR (a.at_s = b.at_s AND a.id < b.id)) AND abs(a.lat - b.lat) < 0.02 AND {km_sql('a', 'b', 6371.0)} <= {CITIZEN_KM} AND (a.y = b.y OR {_alike('a.y', 'b.y')}) GROUP BY 1)"""
_FEED = f"""f AS (SELECT id, at_s, coalesce(observed_s, at_s) AS seen_s, district, state, link, headline_key, raw_text FROM {{rows}} WHERE source_type IN ('NEWS_MEDIA', 'SOCIAL_MEDIA')),
f1 AS (SELECT b.id, arg_min(a.id, (a.at_s, a.id)) AS parent FROM f b JOIN f a ON a.link = b.link AND a.at_s > b.at_s - {LINK_H * HOUR} AND (a.at_s < b.at_s OR (a.at_s = b.at_s AND a.id < b.id)) GROUP BY 1),
fk AS (SELECT b.id, a.id AS o, a.at_s AS o_s, a.headline_key = b.headline_key AS head, {_alike('a.raw_text', 'b.raw_text')} AS alike, row_number() OVER (PARTITION BY b.id ORDER BY a.at_s DESC, a.id DESC) AS n FROM f b JOIN f a ON a.district IS NOT DISTINCT FROM b.district AND a.state IS NOT DISTINCT FROM b.state AND abs(a.seen_s - b.seen_s) <= {TEXT_H * HOUR} AND (a.at_s < b.at_s OR (a.at_s = b.at_s AND a.id < b.id))),
f2 AS (SELECT id, arg_min(o, (CASE WHEN head THEN 2 ELSE 3 END, o_s, o)) AS parent, min(CASE WHEN head THEN 2 ELSE 3 END) AS rule FROM fk WHERE n <= {CANDIDATES} AND (coalesce(head, false) OR alike) GROUP BY 1),
fp AS (SELECT f.id, coalesce(f1.parent, f2.parent) AS parent, CASE WHEN f1.parent IS NOT NULL THEN 1 ELSE f2.rule END AS rule FROM f LEFT JOIN f1 USING (id) LEFT JOIN f2 USING (id) WHERE coalesce(f1.parent, f2.parent) IS NOT NULL)"""


def _roots(name: str, parents: str) -> str:
    return f"""{name}_w(id, top) AS (SELECT id, parent FROM {parents} UNION ALL SELECT w.id, p.parent FROM {name}_w w JOIN {parents} p ON w.top = p.id), {name} AS (SELECT id, w.top AS original FROM {name}_w w WHERE w.top NOT IN (SELECT id FROM {parents}))"""


@query(cte("reports").replace("WITH", "WITH RECURSIVE", 1) + ", " + _CITIZEN.format(rows="reports") + ", " + _roots("cr", "cp") + " SELECT id, original FROM cr")
def dom01_citizen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citizen reports that say the same as an earlier one within 1 km and 15 minutes, and the original that chains lead to."""
    return resolved(citizen_parents(frame(spark, sf_dir, "reports")))


def feed_posts(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("source_type").isin(*FEEDS)).withColumn("seen_s", F.coalesce("observed_s", "at_s"))


@query(cte("reports").replace("WITH", "WITH RECURSIVE", 1) + ", " + _FEED.format(rows="reports") + ", " + _roots("fr", "fp") + " SELECT id, original, rule FROM fr JOIN fp USING (id)")
def dom02_feed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and headlines that repeat an earlier one: by link, headline key, or text at one place; and the original."""
    parents = saved(feed_parents(feed_posts(frame(spark, sf_dir, "reports"))), "feed-parents")
    return resolved(parents).join(parents.select("id", "rule"), "id")


def family_components(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """id, event: reports (id, at_s, lat, lng, family) that others of their family join within its radius and time, and the least id of each such group.

    Each report looks back over its family's hours, so time gates slide with the reports and are not tumbling. Tiles link their own
    reports as stars; only those links are joined up over all.
    """
    return connected(spark, links(reports, FAMILY_GATES)).select(F.col("node").alias("id"), F.col("root").alias("event"))


def evidence(members: DataFrame, readings: DataFrame, warnings: DataFrame) -> DataFrame:
    """event, kind, weather, official, against of events by their members (event, family, hazard, district, state).

    The hazard of most members, ties by precedence, says which scale the readings that belong to the event are held against; the
    warnings are those in force of the family for a member's district. No reading of a scale's kind is a null weather score, no
    warning a score of 0. A measurement that says the opposite of the claim makes the weather score 0.
    """
    votes = members.groupBy("event", "hazard").agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("hazard").isNotNull(), F.struct("n", (-fusion.lookup(PRECEDENCE, F.col("hazard"))).alias("p")))
    kind = votes.groupBy("event").agg(F.coalesce(F.max_by("hazard", rank), F.lit("UNCLASSIFIED")).alias("event_type"))
    seen = readings.groupBy(F.col("order_id").alias("event")).agg(F.sum("rainfall_mm").alias("rain"), F.min("visibility_m").alias("fog"), F.max("gust_kmh").alias("gust"), F.max("temperature_c").alias("hottest"))
    live = warnings.where(in_force(AS_OF)).groupBy("area", "family").agg(F.max(fusion.lookup(fusion.WARNING_SCORES, F.col("severity"))).alias("score"))
    places = members.select("event", "family", F.concat("state", F.lit(" - "), "district").alias("area")).distinct()
    official = places.join(live, ["area", "family"]).groupBy("event").agg(F.max("score").alias("official"))
    rows = kind.join(seen, "event", "left").join(official, "event", "left").withColumn("against", contradicted())
    weather = F.when(F.col("against"), 0.0).otherwise(weather_score(F.col("event_type")))
    return rows.select("event", F.col("event_type").alias("kind"), weather.alias("weather"), F.coalesce("official", F.lit(0.0)).alias("official"), "against")


def verify(spark: SparkSession, reports: DataFrame, readings: DataFrame, warnings: DataFrame) -> DataFrame:
    """id, outcome, original, event, kind, n, coverage, confidence, verdict, routed of every report.

    In order: reports already linked or marked stay as they are; posts and headlines, then precise citizen reports, that repeat an
    earlier one are duplicates of its original; those without a point, then those without a hazard, are stored only; the rest
    cluster within their hazard's family, and each cluster becomes an event with a receipt over all seven factors: weather,
    official warnings, independent reporters, coherence, vision, the best source (credibility halved for campaigns) and anomaly.
    Vision and anomaly have no source here and are offline, as is weather where nothing was measured. Posts alone, contradicted
    and unclassified events never publish.
    """
    old = F.when(F.col("verified_id").isNotNull(), "linked").when(F.col("duplicate_of").isNotNull(), "known_duplicate")
    rows = reports.withColumn("family", F.expr(FAMILY_OF.format(c="coalesce(hazard, 'UNCLASSIFIED')"))).withColumn("old", old)
    fresh = rows.where("old is null")
    repeats = resolved(feed_parents(feed_posts(fresh)).select("id", "parent").unionByName(citizen_parents(fresh)))
    left = saved(fresh.join(repeats, "id", "left_anti").select("id", "at_s", "lat", "lng", "family", "hazard", "district", "state", "reporter", "source_type", "place_precision", "raw_text"), "left")
    placed = left.where(~F.coalesce(F.col("place_precision").isin("none", "state"), F.lit(False)) & F.col("family").isNotNull())
    members = saved(placed.join(family_components(spark, placed), "id"), "members")
    copied = coordinated(left).withColumn("copied", F.lit(True))
    prior = fusion.lookup(fusion.PRIORS, F.col("source_type")) * F.when(F.col("copied"), FLAG_FACTORS["coordinated"]).otherwise(1.0)
    stats = members.join(copied, "id", "left").groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("reporter").alias("witnesses"), F.max(prior).alias("reliability"), F.bool_and(F.col("source_type").isin(*FEEDS)).alias("posts"), F.min("family").alias("family")
    )
    eps = F.create_map(*(F.lit(x) for k, v in FAMILY_GATES.items() for x in (k, v[0])))
    events = stats.join(widest(members, "event"), "event").join(evidence(members, readings, warnings), "event")
    offline = F.lit(None).cast("double")
    scores = {"weather": F.col("weather"), "official": F.col("official"), "density": density(F.col("witnesses")), "coherence": coherence(F.col("widest"), F.element_at(eps, F.col("family"))), "vision": offline, "reliability": F.col("reliability"), "anomaly": offline}
    severity = F.when(F.col("n") >= 10, "HIGH").when(F.col("n") >= 5, "MODERATE").otherwise("LOW")
    capped = F.col("posts") | F.col("against") | (F.col("kind") == "UNCLASSIFIED")
    scored = events.withColumn("receipt", fusion.receipt(scores)).select(
        "event", "kind", "n", F.col("receipt.coverage").alias("coverage"), F.round("receipt.mean", 6).alias("confidence"),
        fusion.verdict(F.col("against").cast("int"), F.col("official"), F.col("weather")).alias("verdict"), fusion.review_status(F.col("receipt.confidence"), severity, capped).alias("routed"),
    )
    fate = members.select("id", "event").join(scored, "event")
    out = rows.select("id", "old", "place_precision", "family").join(repeats, "id", "left").join(fate, "id", "left")
    pointless = F.col("place_precision").isin("none", "state")
    outcome = F.coalesce("old", F.when(F.col("original").isNotNull(), "duplicate").when(pointless, "no_point").when(F.col("family").isNull(), "untagged").when(F.col("event").isNull(), "alone").otherwise("event"))
    return out.select("id", outcome.alias("outcome"), "original", "event", "kind", "n", "coverage", "confidence", "verdict", "routed")


#: Which reports are one text's copies: in SQL, over rows (id, at_s, reporter, raw_text).
_CAMPAIGN = f"""kt AS (SELECT id, at_s, coalesce(concat('r', reporter), concat('i', id)) AS who, trim(regexp_replace(lower(raw_text), '[!-/:-@\\[-`{{{{-~\\s]+', ' ', 'g')) AS t FROM {{rows}}),
km AS (SELECT b.id, b.t, b.at_s FROM kt b JOIN kt a ON a.t = b.t AND a.at_s BETWEEN b.at_s - {WITHIN_S} AND b.at_s WHERE length(b.t) >= {LEAST_TEXT_C} GROUP BY 1, 2, 3 HAVING count(DISTINCT a.who) >= {REPORTERS}), k AS (SELECT DISTINCT a.id FROM kt a JOIN km b ON a.t = b.t AND a.at_s BETWEEN b.at_s - {WITHIN_S} AND b.at_s)"""
_RANK = "CASE hazard " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRECEDENCE.items()) + " END"
_PRIOR = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fusion.PRIORS.items()) + " END"


@query(
    cte("reports", "readings", "warnings").replace("WITH", "WITH RECURSIVE", 1)
    + f""", b AS (SELECT *, {FAMILY_OF.format(c="coalesce(hazard, 'UNCLASSIFIED')")} AS family FROM reports), fresh AS (SELECT * FROM b WHERE verified_id IS NULL AND duplicate_of IS NULL), """
    + _CITIZEN.format(rows="fresh")
    + ", "
    + _FEED.format(rows="fresh")
    + ", pp AS (SELECT id, parent FROM cp UNION ALL SELECT id, parent FROM fp), "
    + _roots("rr", "pp")
    + f""", rest AS (SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM rr)), pl AS (SELECT * FROM rest WHERE NOT coalesce(place_precision IN ('none', 'state'), false) AND family IS NOT NULL),
e AS (SELECT a.id AS a, b.id AS b FROM pl a JOIN pl b ON a.family = b.family AND a.id <> b.id AND abs(a.at_s - b.at_s) <= CASE a.family {_BACK} END AND abs(a.lat - b.lat) < 0.3 AND {km_sql('a', 'b')} <= CASE a.family {_EPS} END),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a), ev AS (SELECT a AS id, min(b) AS event FROM t GROUP BY 1),
m AS (SELECT pl.*, ev.event FROM pl JOIN ev USING (id)), {_CAMPAIGN.format(rows='rest')},
w AS (SELECT a.event, max({km_sql('a', 'b')}) AS wide FROM m a JOIN m b USING (event) GROUP BY 1),
vt AS (SELECT event, hazard, count(*) AS n, {_RANK} AS p FROM m GROUP BY event, hazard), ty AS (SELECT event, coalesce(arg_max(hazard, (n, -p)) FILTER (WHERE hazard IS NOT NULL), 'UNCLASSIFIED') AS event_type FROM vt GROUP BY 1),
ob AS (SELECT order_id AS event, sum(rainfall_mm) AS rain, min(visibility_m) AS fog, max(gust_kmh) AS gust, max(temperature_c) AS hottest FROM readings GROUP BY 1),
wa AS (SELECT area, family, max({_WSCORE}) AS score FROM warnings WHERE {_FORCE} GROUP BY 1, 2), ow AS (SELECT m.event, max(score) AS official FROM m JOIN wa ON wa.area = concat(m.state, ' - ', m.district) AND m.state IS NOT NULL AND m.district IS NOT NULL AND wa.family = m.family GROUP BY 1),
ev7 AS (SELECT event, event_type AS kind, coalesce(official, 0.0) AS official, coalesce({_CONTRA}, 0) = 1 AS against, CASE WHEN {_CONTRA} = 1 THEN 0.0 ELSE {_TYPE.format(rain=f'CASE WHEN rain IS NOT NULL THEN {_RAIN} END', fog=_FOG, gust=_GUST)} END AS weather FROM ty LEFT JOIN ob USING (event) LEFT JOIN ow USING (event)),
s AS (SELECT event, count(*) AS n, count(DISTINCT reporter) AS wit, max({_PRIOR} * CASE WHEN id IN (SELECT id FROM k) THEN {FLAG_FACTORS['coordinated']} ELSE 1.0 END) AS rel, bool_and(source_type IN ('NEWS_MEDIA', 'SOCIAL_MEDIA')) AS posts, CASE min(family) {_EPS} END AS eps FROM m GROUP BY 1),
x AS (SELECT event, kind, n, posts, against, weather, official, CASE WHEN weather IS NULL THEN 0.0 ELSE 0.2 END + 0.1 + 0.2 + 0.15 + 0.15 AS online, coalesce(round(0.2 * weather, 4), 0.0) + round(0.1 * official, 4) + round(0.2 * greatest(0.0, least(1.0, (1 - exp(-wit / 6.5)) / (1 - exp(-25 / 6.5)))), 4) + round(0.15 * CASE WHEN wide >= 2 * eps THEN 0.0 ELSE 0.5 * (1 + cos(pi() * wide / (2 * eps))) END, 4) + round(0.15 * rel, 4) AS total FROM s JOIN w USING (event) JOIN ev7 USING (event)),
y AS (SELECT event, kind, n, round(online, 2) AS coverage, round(total / online, 6) AS confidence, CASE WHEN against THEN 'CONTRADICTED' WHEN official >= 0.6 OR coalesce(weather, 0.0) >= 0.6 THEN 'CORROBORATED' ELSE 'UNCONFIRMED' END AS verdict, CASE WHEN round(total / online + 1e-9, 4) >= 0.9 AND NOT posts AND NOT against AND kind <> 'UNCLASSIFIED' THEN 'AUTO_PUBLISHED' WHEN round(total / online + 1e-9, 4) >= 0.6 OR n >= 10 THEN 'PENDING_HUMAN_REVIEW' ELSE 'QUARANTINED' END AS routed FROM x)
SELECT b.id, CASE WHEN verified_id IS NOT NULL THEN 'linked' WHEN duplicate_of IS NOT NULL THEN 'known_duplicate' WHEN rr.original IS NOT NULL THEN 'duplicate' WHEN place_precision IN ('none', 'state') THEN 'no_point' WHEN family IS NULL THEN 'untagged' WHEN m.event IS NULL THEN 'alone' ELSE 'event' END AS outcome, rr.original, m.event, y.kind, y.n, y.coverage, y.confidence, y.verdict, y.routed
FROM b LEFT JOIN rr ON rr.id = b.id LEFT JOIN (SELECT id, event FROM m) m ON m.id = b.id LEFT JOIN y ON y.event = m.event"""
)
def dom20_verify_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report through the whole chain."""
    return verify(spark, *(frame(spark, sf_dir, name) for name in ("reports", "readings", "warnings")))


#: How late a report may come, and into how many lots the replay below deals them.
LATE_S, LOTS = 40 * 86_400, 4


def shuffled_stream(spark: SparkSession, reports: DataFrame, lots: int = LOTS) -> DataFrame:
    """Reports dealt by hash to as many files, read as a stream of one file a batch: they arrive out of order."""
    folder = shared_path(spark, "arrivals")
    lot = F.pmod(F.xxhash64("id"), F.lit(lots))
    reports.withColumn("ts", F.timestamp_seconds("at_s")).withColumn("lot", lot).repartition(lots, "lot").write.partitionBy("lot").parquet(folder)
    back = spark.read.parquet(folder).drop("lot")
    return spark.readStream.schema(back.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/lot=*")


@query(
    cte("reports").replace("WITH", "WITH RECURSIVE", 1)
    + f""", pl AS (SELECT * FROM (SELECT *, {FAMILY_OF.format(c="coalesce(hazard, 'UNCLASSIFIED')")} AS family FROM reports) WHERE family IS NOT NULL AND NOT coalesce(place_precision IN ('none', 'state'), false)),
e AS (SELECT a.id AS a, b.id AS b FROM pl a JOIN pl b ON a.family = b.family AND a.id <> b.id AND abs(a.at_s - b.at_s) <= CASE a.family {_BACK} END AND abs(a.lat - b.lat) < 0.3 AND {km_sql('a', 'b')} <= CASE a.family {_EPS} END),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a AS id, min(b) AS event FROM t GROUP BY 1"""
)
def dom07_open_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a stream of reports, in shuffled order and several batches, extends, makes and merges: id and event of each member."""
    rows = frame(spark, sf_dir, "reports").withColumn("family", F.expr(FAMILY_OF.format(c="coalesce(hazard, 'UNCLASSIFIED')")))
    placed = rows.where(F.col("family").isNotNull() & ~F.coalesce(F.col("place_precision").isin("none", "state"), F.lit(False))).select("id", "at_s", "lat", "lng", "family")
    with rocksdb(spark):
        return open_events(shuffled_stream(spark, placed), FAMILY_GATES, shared_path(spark, "events"), LATE_S).members()


def derived(rows: DataFrame) -> DataFrame:
    """Reports (raw_text, source_type) with what is derived from their text: flags and credibility; a person's text is weighed by its length."""
    flags = text_flags(F.coalesce("raw_text", F.lit("")))
    human = F.col("source_type").isin("CITIZEN_APP", "SOCIAL_MEDIA")
    prior = fusion.lookup(fusion.PRIORS, F.col("source_type"))
    return rows.withColumn("flags", flags).withColumn("credibility", F.round(credibility(prior, F.coalesce("raw_text", F.lit("")), F.col("flags"), human), 6))


#: A submission's text has so many characters.
LEAST_TEXT, MOST_TEXT = 5, 2000
_TEXT = "concat(CASE WHEN user_id % 9 = 0 THEN 'Fwd: share this with everyone ' ELSE '' END, repeat(concat(event_type, ' '), CAST(event_id % 30 AS INTEGER)))"
_QUALITY = "CASE WHEN source_type = 'CITIZEN_APP' THEN 0.5 + 0.5 * least(1.0, length(trim(raw_text)) / 6e1) ELSE 1.0 END"


@query(
    f"""WITH r AS (SELECT event_id, concat('p', user_id % 3) AS platform, concat(event_type, event_id - event_id % 2) AS external_id, CASE user_id % 2 WHEN 0 THEN 'CITIZEN_APP' ELSE 'NEWS_MEDIA' END AS source_type, {_TEXT} AS raw_text FROM events),
v AS (SELECT * FROM r WHERE length(trim(raw_text)) BETWEEN {LEAST_TEXT} AND {MOST_TEXT}), u AS (SELECT platform, external_id, any_value(source_type) AS source_type, any_value(raw_text) AS raw_text, count(*) AS sent FROM v GROUP BY 1, 2 HAVING count(DISTINCT raw_text) = 1 AND count(DISTINCT source_type) = 1),
z AS (SELECT *, starts_with(raw_text, 'Fwd') AS fwd FROM u)
SELECT platform, external_id, CASE WHEN fwd THEN 'forward_marker' ELSE '' END AS flags, round(greatest(0.05, CASE source_type WHEN 'CITIZEN_APP' THEN 0.6 ELSE 0.55 END * {_QUALITY} * CASE WHEN fwd THEN 0.6 ELSE 1.0 END), 6) AS credibility FROM z"""
)
def src01_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake stream: validated, one row a (platform, external_id), text fields derived, reports and outbox messages written by batch.

    Shown are the keys that were sent with one content, since of several contents of a key the first to arrive stays.
    """
    out = shared_path(spark, "reports")
    text = _TEXT
    e = read_stream(spark, sf_dir, "events", "ts").withWatermark("ts", "40 days")
    r = e.select("ts", F.concat(F.lit("p"), F.col("user_id") % 3).alias("platform"), F.expr("concat(event_type, event_id - event_id % 2)").alias("external_id"), F.when(F.col("user_id") % 2 == 0, "CITIZEN_APP").otherwise("NEWS_MEDIA").alias("source_type"), F.expr(text).alias("raw_text"))
    valid = r.where(F.length(F.trim("raw_text")).between(LEAST_TEXT, MOST_TEXT))
    once = derived(valid.dropDuplicatesWithinWatermark(["platform", "external_id"])).drop("ts")

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("message", F.to_json(F.struct("platform", "external_id")))  # the row and its outbox message are one file
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    drain(once, write)
    schema = once.withColumn("message", F.lit("")).schema
    stored = spark.read.schema(schema).parquet(f"{out}/batch=*")
    sent = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("platform"), F.expr("concat(event_type, event_id - event_id % 2)").alias("external_id"), F.expr(text).alias("raw_text"), (F.col("user_id") % 2).alias("kind"))
    single = sent.where(F.length(F.trim("raw_text")).between(LEAST_TEXT, MOST_TEXT)).groupBy("platform", "external_id").agg(F.countDistinct("raw_text").alias("texts"), F.countDistinct("kind").alias("kinds")).where("texts = 1 and kinds = 1").select("platform", "external_id")
    return stored.join(single, ["platform", "external_id"]).select("platform", "external_id", F.array_join("flags", ",").alias("flags"), "credibility")
