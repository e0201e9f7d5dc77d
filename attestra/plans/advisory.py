"""Media rules, tagging, matching, grouping and the plans that join polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.tagging import tags
from ..functions.text import FEW_FOLLOWERS, FLAG_FACTORS, NEW_ACCOUNT_DAYS, account_flags, collapse, text_key
from ..operators.dedup import LINK_H, by_link
from ..operators.footprints import footprints
from ..operators.media import FUTURE_S, MISMATCH_KM, OLD_S, RECYCLED_S, EDITORS, copied, file_flags, recycled
from ..operators.matching import GATE_MIN, complete_link, matched_pairs
from ..operators.shapes import intersecting
from ..operators.spatial import connected, dbscan
from ..operators.splits import contaminated, grouped_split
from ..operators.tiles import links
from ..sources.bindings import AS_OF, DAY, HOUR, cte, flags, frame
from ..sources.tables import saved, shared_path
from .geography import km_sql, unassigned
from .registry import query
from .scalars import HASHES, media_hashes

@query(
    cte("reports")
    + f""", m AS (SELECT id, CASE WHEN id % 5 <> 0 THEN at_s + (id % 200 - 100) * 3600 END AS taken, observed_s, at_s, lat, lng, CASE WHEN id % 3 = 0 THEN lat + (id % 7) / 1e1 END AS e_lat, lng AS e_lng FROM reports), x AS (SELECT *, e_lat AS lat2 FROM m)
SELECT id, concat_ws(',', CASE WHEN id % 50 = 0 THEN 'duplicate_media' END, CASE WHEN taken < coalesce(observed_s, at_s) - {OLD_S} THEN 'old_capture' END, CASE WHEN NOT coalesce(taken < coalesce(observed_s, at_s) - {OLD_S}, false) AND taken > at_s + {FUTURE_S} THEN 'future_capture' END,
 CASE WHEN {km_sql('a', 'b')} > {MISMATCH_KM} THEN 'location_mismatch' END, CASE WHEN id % 5 = 0 THEN 'no_metadata' END) AS flags FROM (SELECT id, taken, observed_s, at_s, struct_pack(lat := lat, lng := lng) AS a, struct_pack(lat := e_lat, lng := e_lng) AS b FROM m)"""
)
def arr06_media_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    r = frame(spark, sf_dir, "reports").withColumn("taken", F.when(i % 5 != 0, F.col("at_s") + (i % 200 - 100) * HOUR)).withColumn("e_lat", F.when(i % 3 == 0, F.col("lat") + (i % 7) / F.lit(10.0)))
    km = haversine(F.col("lat"), F.col("lng"), F.col("e_lat"), F.col("lng"))
    return r.select("id", F.array_join(file_flags(F.col("taken"), F.col("observed_s"), F.col("at_s"), km, i % 50 == 0, i % 5 != 0), ",").alias("flags"))


_FILES = f"""page_id AS media, page_id - page_id % 2 AS report, CASE WHEN page_id div 2 % 7 <> 0 THEN page_id div 2 % 40 END AS reporter, {AS_OF} - page_id * 37 % 1000 * 3600 AS at_s, CASE WHEN page_id % 9 <> 0 THEN {AS_OF} - page_id * 37 % 1000 * 3600 - page_id % 17 * 60 END AS observed_s,
 CASE WHEN page_id % 5 <> 0 THEN {AS_OF} - page_id * 37 % 1000 * 3600 + (page_id % 200 - 100) * 3600 END AS taken, (8000 + page_id * 7919 % 28000) / 1e3 AS lat, 77e0 AS lng, CASE WHEN page_id % 3 = 0 AND page_id % 10 > 2 THEN (8000 + page_id * 7919 % 28000) / 1e3 + (page_id % 7) / 1e1 END AS e_lat, page_id % 5 <> 0 AS has_metadata,
 CASE page_id % 8 WHEN 0 THEN 'Adobe Photoshop 25.1' WHEN 1 THEN 'HDR+ 1.0' WHEN 2 THEN 'Snapseed 2' END AS software"""


@query(
    f"""WITH h AS ({HASHES}), m AS (SELECT {_FILES.replace(" div ", " // ")}, CASE WHEN page_id % 6 = 0 THEN page_id % 90 WHEN html IS NOT NULL THEN page_id END AS sha FROM pages),
g AS (SELECT *, coalesce('by ' || reporter, 'report ' || report) AS who, coalesce(observed_s, at_s) AS seen, struct_pack(lat := lat, lng := lng) AS a, struct_pack(lat := e_lat, lng := lng) AS b FROM m),
near AS (SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM h x JOIN h y ON x.page_id <> y.page_id AND bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)) <= 8),
old AS (SELECT near.a AS media, min(o.at_s) AS first_seen FROM near JOIN g o ON o.media = near.b JOIN g i ON i.media = near.a WHERE o.at_s < i.seen - {RECYCLED_S} GROUP BY 1),
dup AS (SELECT DISTINCT i.media FROM g i JOIN g o ON i.sha = o.sha AND i.who <> o.who AND (o.at_s < i.at_s OR o.at_s = i.at_s AND o.media < i.media))
SELECT g.media, first_seen, concat_ws(',', CASE WHEN dup.media IS NOT NULL THEN 'duplicate_media' END, CASE WHEN first_seen IS NOT NULL THEN 'recycled_suspect' END, CASE WHEN taken < seen - {OLD_S} THEN 'old_capture' WHEN taken > at_s + {FUTURE_S} THEN 'future_capture' END, CASE WHEN {km_sql('a', 'b')} > {MISMATCH_KM} THEN 'location_mismatch' END,
 CASE WHEN NOT has_metadata THEN 'no_metadata' WHEN {" OR ".join(f"contains(lower(software), '{x}')" for x in EDITORS)} THEN 'edited' END) AS flags FROM g LEFT JOIN old USING (media) LEFT JOIN dup USING (media)"""
)
def arr06_media_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven flags of each file: those of its own data, and those that earlier media give (same file from others, near-identical pictures)."""
    sha = F.expr("CASE WHEN page_id % 6 = 0 THEN page_id % 90 WHEN html IS NOT NULL THEN page_id END").alias("sha")
    m = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr(f"struct({_FILES})").alias("m"), sha).select("m.*", "sha")
    old = recycled(m.select("media", F.col("at_s").alias("seen_s"), F.coalesce("observed_s", "at_s").alias("observed_s")), media_hashes(spark, sf_dir).withColumnRenamed("page_id", "media"))
    both = m.join(old, "media", "left").join(copied(m).withColumn("dup", F.lit(True)), "media", "left")
    km = haversine(F.col("lat"), F.col("lng"), F.col("e_lat"), F.col("lng"))
    found = file_flags(F.col("taken"), F.col("observed_s"), F.col("at_s"), km, F.col("dup"), F.col("has_metadata"), F.col("first_seen").isNotNull(), F.col("software"))
    return both.select("media", "first_seen", F.array_join(found, ",").alias("flags"))


@query(f"SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 20 < {NEW_ACCOUNT_DAYS} THEN 'new_account' END, CASE WHEN c_custkey % 11 < {FEW_FOLLOWERS} THEN 'few_followers' END, CASE WHEN c_custkey % 6 = 0 THEN 'bot_account' END) AS flags FROM customer")
def arr07_account_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts under seven days, with fewer than five followers, or marked as bots."""
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(account_flags(c % 20, c % 11, c % 6 == 0), ",").alias("flags"))


_TEXT = "CASE p_partkey % 6 WHEN 0 THEN 'Knee deep water, flood in market right now' WHEN 1 THEN 'No flood here, all clear' WHEN 2 THEN 'Heavy rain forecast for tomorrow' WHEN 3 THEN concat('Wind of ', p_size + 20, ' kmph and hail') WHEN 4 THEN 'Fog, visibility only 80 m' ELSE p_name END"


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'URBAN_FLOOD' WHEN 2 THEN 'RAINFALL' WHEN 3 THEN CASE WHEN p_size + 20 >= 39 THEN 'HAILSTORM,STRONG_WIND' ELSE 'HAILSTORM' END WHEN 4 THEN 'FOG' ELSE '' END AS hazards, CASE WHEN p_partkey % 6 = 2 THEN 'forecast' ELSE 'now' END AS tense, CASE WHEN p_partkey % 6 = 0 THEN 50.0 END AS depth_cm FROM part"
)
def str14_hazard_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made from parts, tagged: cues, negation, tense, depths and measured values."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tags(F.expr(_TEXT)).alias("t"))
    return rows.select("p_partkey", F.array_join("t.hazards", ",").alias("hazards"), "t.tense", "t.depth_cm")


@query()
def ml01_duplicate_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one conversation as reports of one place, scored pairwise by the five signals; a turn comes every three minutes."""
    return matched_turns(spark, sf_dir).select("a", "b", F.round("text_score", 6).alias("text_score"), F.round("combined", 6).alias("combined"), "duplicate")


def matched_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "conv_id", "turn", "text").dropDuplicates(["id"])
    width = int(GATE_MIN / 3)  # turns within the gate: each looks into its own slot of so many turns and the next
    slot = F.floor(F.col("turn") / width)
    other = t.select("conv_id", F.col("id").alias("b"), F.col("turn").alias("u"), slot.alias("slot"))
    minutes = 3.0 * F.abs(F.col("u") - F.col("turn"))
    own = t.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    near = own.join(other, ["conv_id", "slot"]).where((F.col("id") < F.col("b")) & (minutes <= GATE_MIN)).select(F.col("id").alias("a"), "b", F.lit(0.0).alias("km"), minutes.alias("minutes"))
    return matched_pairs(near, t.select("id", "text"))


@query()
def ml08_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher's pairs dealt to train, validation and test by whole components, with the hardest negatives of each conversation."""
    key = F.col("key")  # a digest stands for the whole text, before anything is shuffled
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), text_key(F.col("text")).alias("key"))
    t = t.select("id", F.when(key != "", F.md5(key)).otherwise(key).alias("key")).dropDuplicates(["id"])
    pairs = matched_turns(spark, sf_dir).withColumn("block", F.floor(F.col("a") / 10_000))
    return grouped_split(pairs, t).select("a", "b", "duplicate", "grp", "split", "hard")


@query(
    r"""WITH d AS (SELECT md5(trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g'))) AS key, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM documents WHERE trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g')) <> '')
SELECT key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS records FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1"""
)
def ml08_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a split by document number alone leaves in more than one split."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.array(text_key(F.col("text")))).alias("text")).where("text <> ''")
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    return contaminated(d.select(F.md5("text").alias("key"), split.alias("split")))


@query()
def ml02_complete_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-link groups of the reports of each district."""
    return complete_link(saved(blocked(frame(spark, sf_dir, "reports").where("district is not null")), "blocks"))


def blocked(reports: DataFrame, km: float = 5.0, minutes: float = 180.0) -> DataFrame:
    """id, at_s, lat, lng, kind, block: the block is the part in one district of a component of reports near in space and time.

    Members of a group are compatible in pairs, so no group reaches beyond a block. A report that is near no other has a null block.
    """
    r = reports.select("id", "at_s", "lat", "lng", F.col("hazard").alias("kind"), "district")
    roots = connected(reports.sparkSession, links(r.withColumn("family", F.col("district")), None, default=(km, minutes / 60)))
    return r.join(roots, r.id == roots.node, "left").select("id", "at_s", "lat", "lng", "kind", F.col("root").alias("block"))


@query()
def geo11_cluster_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The footprint of each cluster of unassigned reports: the concave hull of its points, widened by 250 m."""
    p = unassigned(spark, sf_dir)
    return footprints(p.join(dbscan(p, 5, 2, 40), "id"), "cluster")


#: Degrees beyond any rounding of a corner.
_ROUNDING = 1e-9


@query("SELECT a.c_custkey AS id, b.s_suppkey AS other FROM customer a JOIN supplier b ON abs((8000 + a.c_custkey * 6151 % 28000) / 1e3 - (8000 + b.s_suppkey * 9973 % 28000) / 1e3) <= 0.55 AND abs((69000 + a.c_custkey * 7433 % 27000) / 1e3 - (69000 + b.s_suppkey * 7907 % 27000) / 1e3) <= 0.55")
def jon09_polygons_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warning areas (squares of 0.6 degrees) with the station areas (squares of 0.5) that they meet."""
    w, s = frame(spark, sf_dir, "warnings"), frame(spark, sf_dir, "stations")
    return squares_meet(w.select(F.col("identifier").alias("id"), "lat", "lng"), s.select(F.col("station").alias("other"), "lat", "lng"), 0.3, 0.25)


def squares_meet(left: DataFrame, right: DataFrame, a: float, b: float) -> DataFrame:
    """id, other of squares around points (id or other, lat, lng) that meet, edges included; a and b are half their sides.

    Corners are rounded, so that squares that just touch may seem apart: rings a little larger meet, and the middles decide.
    """
    square = lambda h: F.array(*(F.struct((F.col("lng") + x * h).alias("lng"), (F.col("lat") + y * h).alias("lat")) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    there = right.select("other", F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), square(F.lit(b)).alias("ring"))
    both = intersecting(left.select("id", "lat", "lng", square(F.lit(a + _ROUNDING)).alias("ring")), there)
    return both.where((F.abs(F.col("lat") - F.col("o_lat")) <= a + b) & (F.abs(F.col("lng") - F.col("o_lng")) <= a + b)).select("id", "other")


@query("WITH l AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 500 AS link FROM lineitem) SELECT b.id, min(a.id) AS original FROM l a JOIN l b ON a.link = b.link AND a.id < b.id AND b.id - a.id <= 720 GROUP BY 1")
def jon15_shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest earlier item of a window of keys that shares a link: an exploded equi-join by link and slot."""
    width = 720
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 500).alias("link")).distinct()
    slot = F.floor(F.col("id") / width)
    look = x.withColumn("slot", F.explode(F.array(slot, slot - 1)))
    first = x.select(F.col("id").alias("original"), "link", slot.alias("slot"))
    return look.join(first, ["link", "slot"]).where("original < id and id - original <= 720").groupBy("id").agg(F.min("original").alias("original"))


_LINKS = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN '[]' ELSE concat('[\"https://n.example/', id % 150, '\",\"https://n.example/', id * 31 % 170, '\"]') END"


@query(
    cte("reports")
    + f""", p AS (SELECT id, at_s, duplicate_of, {_LINKS} AS links FROM reports WHERE source_type IN ('SOCIAL_MEDIA', 'NEWS_MEDIA')), x AS (SELECT DISTINCT id, at_s, duplicate_of, unnest(CAST(links AS JSON)::VARCHAR[]) AS link FROM p)
SELECT b.id, arg_min(a.id, (a.at_s, a.id)) AS parent, arg_min(coalesce(a.duplicate_of, a.id), (a.at_s, a.id)) AS original FROM x a JOIN x b ON a.link = b.link AND (a.at_s < b.at_s OR a.at_s = b.at_s AND a.id < b.id) AND a.at_s > b.at_s - {LINK_H * HOUR} GROUP BY 1"""
)
def jon15_links_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and news that share any link of their JSON array with an earlier one of the 72 hours before: the earliest such, and what it repeats itself."""
    p = frame(spark, sf_dir, "reports").where(F.col("source_type").isin("SOCIAL_MEDIA", "NEWS_MEDIA"))
    listed = F.array_distinct(F.from_json(F.expr(_LINKS), "array<string>"))
    found = by_link(p.select("id", "at_s", F.explode(listed).alias("link"))).select("id", "parent")
    return found.join(p.select(F.col("id").alias("parent"), F.coalesce("duplicate_of", "id").alias("original")), "parent").select("id", "parent", "original")


_MEDIA = """m AS (SELECT page_id AS media, page_id - page_id % 4 AS report, CASE WHEN page_id % 3 = 0 THEN 'video' ELSE 'image' END AS kind, page_id * 37 % 1000 AS seen_s, CASE WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 11 = 0 THEN 'pending' ELSE 'ready' END AS status, CASE page_id % 6 WHEN 0 THEN 'old_capture' WHEN 1 THEN 'recycled_suspect' WHEN 2 THEN 'location_mismatch' END AS flag FROM pages)"""


@query(
    f"""WITH {_MEDIA}, f AS (SELECT report, array_to_string(list(flag ORDER BY s, media), ',') AS flags FROM (SELECT report, flag, arg_min(media, (seen_s, media)) AS media, min(seen_s) AS s FROM m WHERE flag IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT report, count(*) AS n, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'video') AS videos, array_to_string(list(media ORDER BY seen_s, media), ',') AS ids, coalesce(any_value(f.flags), '') AS flags,
 count(*) FILTER (WHERE status = 'ready') AS ready, CASE WHEN count(*) FILTER (WHERE status = 'ready') = 0 THEN 'none_usable' WHEN any_value(f.flags) IS NULL THEN 'clean' ELSE 'flagged' END AS summary FROM m LEFT JOIN f USING (report) GROUP BY 1"""
)
def agg20_media_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of each report: counts by kind, ids and flags in the order first seen, and the summary that a receipt shows."""
    i = F.col("page_id")
    m = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        i.alias("media"), (i - i % 4).alias("report"), F.when(i % 3 == 0, "video").otherwise("image").alias("kind"), (i * 37 % 1000).alias("seen_s"),
        F.when(i % 5 == 0, "failed").when(i % 11 == 0, "pending").otherwise("ready").alias("status"), F.when(i % 6 == 0, "old_capture").when(i % 6 == 1, "recycled_suspect").when(i % 6 == 2, "location_mismatch").alias("flag"),
    )
    return media_lists(m)


def media_lists(media: DataFrame) -> DataFrame:
    """report, n, images, videos, ids, flags, ready, summary of media rows (report, media, kind, seen_s, status, flag)."""
    rows = F.sort_array(F.collect_list(F.struct("seen_s", "media", "flag")))  # a report has a few media
    lists = media.groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("status") == "ready").alias("ready"), rows.alias("m"))
    ids = F.array_join(F.transform("m", lambda x: x["media"].cast("string")), ",")
    seen = F.array_distinct(F.array_compact(F.transform("m", lambda x: x["flag"])))
    summary = F.when(F.col("ready") == 0, "none_usable").when(F.size(seen) == 0, "clean").otherwise("flagged")
    return lists.select("report", "n", "images", "videos", ids.alias("ids"), F.array_join(seen, ",").alias("flags"), "ready", summary.alias("summary"))


@query(cte("reports") + "SELECT id, coalesce(flags_csv, '') AS flags FROM reports")
def arr05_flag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags in their fixed order, whatever order they come in."""
    names = [*FLAG_FACTORS, "not_an_observation"]
    ordered = F.filter(F.array(*(F.lit(x) for x in names)), lambda x: F.array_contains(F.reverse(flags()), x))
    return frame(spark, sf_dir, "reports").select("id", F.array_join(ordered, ",").alias("flags"))


@query(
    cte("verified")
    + "SELECT * FROM (SELECT id, code, severity, confidence, CASE WHEN district IS NULL THEN '' ELSE district END AS district FROM verified ORDER BY id LIMIT 1000)"
)
def snk01_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by id, written as CSV and read back; null is the empty string. The cap is the export's feature: one row more tells that it cut."""
    cap, folder = 1000, shared_path(spark, "export")
    rows = frame(spark, sf_dir, "verified").select("id", "code", "severity", "confidence", "district").orderBy("id").limit(cap + 1)
    rows.limit(cap).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns)).write.option("header", True).csv(folder)
    back = spark.read.option("header", True).schema("id bigint, code string, severity string, confidence double, district string").csv(folder)
    return back.select("id", "code", "severity", "confidence", F.coalesce("district", F.lit("")).alias("district"))


# From where on the facts of a report are signs against it. Texts shorter than `text`; shares of repeated words, repeated
# pairs of words, marks, claims, and of copies among the reporter's recent reports; more than so many links and phone numbers; copies of
# one text; recent reports; seconds that a report may lie ahead of its clock.
RISK = {"text": 5, "words": 0.55, "pairs": 0.45, "marks": 0.20, "claims": 0.30, "share": 0.50, "urls": 2, "phones": 2, "copies": 5, "recent": 10, "ahead_s": 300}
CLAIMS = ("confirmed", "definitely", "guaranteed", "official", "urgent", "always", "never", "proof", "claim")
# Hundredths that each sign adds, as (code, points, condition on the facts), and the gates of medium and high risk.
SIGNS = (
    ("INVALID_METADATA", "least(30, 10 * bad_metadata)", "bad_metadata > 0"),
    ("INVALID_COORDINATES", 40, "NOT coordinates_valid"),
    ("CONTRADICTORY_TIMESTAMP", 35, f"delay_s < -{RISK['ahead_s']}"),
    ("GEOGRAPHIC_INCONSISTENCY", 25, "NOT place_fits"),
    ("EVENT_TYPE_INCONSISTENCY", 20, "NOT type_fits"),
    ("REPEATED_TEXT", 10, "copies > 1"),
    ("EXCESSIVE_DUPLICATE_BEHAVIOR", 15, f"copies >= {RISK['copies']}"),
    ("SOURCE_REPORT_BURST", 15, f"recent >= {RISK['recent']}"),
    ("SOURCE_DUPLICATE_PATTERN", 15, f"repeated_share >= {RISK['share']}"),
    ("UNUSUAL_TEXT_REPETITION", 15, f"repeated_words >= {RISK['words']} OR repeated_pairs >= {RISK['pairs']}"),
    ("EXCESSIVE_PUNCTUATION", 8, f"marks >= {RISK['marks']}"),
    ("EXCESSIVE_URLS", 10, f"urls > {RISK['urls']}"),
    ("EXCESSIVE_PHONE_REFERENCES", 10, f"phones > {RISK['phones']}"),
    ("VERY_SHORT_TEXT", 2, f"characters > 0 AND characters < {RISK['text']}"),
    ("HIGH_CLAIM_DENSITY", 3, f"claims >= {RISK['claims']}"),
)
MEDIUM, HIGH = 25, 55
#: How far back a reporter's reports are recent.
RECENT_S = 3 * DAY
_SIGNS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, _, test in SIGNS) + "], lambda x: x IS NOT NULL)"
_POINTS_SQL = " + ".join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for _, points, test in SIGNS)


def text_facts(text):
    """struct(characters, repeated_words, repeated_pairs, marks, claims, urls, phones) of a text, blanks collapsed and case aside; shares are null where there is nothing to share."""
    t = F.lower(collapse(F.coalesce(text, F.lit(""))))

    def of(t, w):
        n = F.size(w)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", w[i - 1], w[i])))
        claims = F.filter(w, lambda x: x.rlike(r"^\d+$") | x.isin(*CLAIMS))
        share = lambda v, of_: F.when(of_ > 0, v / of_)
        return F.struct(
            F.length(t).alias("characters"),
            share(n - F.size(F.array_distinct(w)), n).alias("repeated_words"),
            F.when(n > 1, (n - 1 - F.size(F.array_distinct(pairs))) / (n - 1)).alias("repeated_pairs"),
            share(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")), F.length(t)).alias("marks"),
            share(F.size(claims), n).alias("claims"),
            F.regexp_count(t, F.lit(r"(?:https?://|www\.)\S+")).alias("urls"),
            F.regexp_count(t, F.lit(r"\d{10}")).alias("phones"),
        )

    both = F.array(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("w")))
    return F.transform(both, lambda x: of(x["t"], x["w"]))[0]


def risk(facts: DataFrame) -> DataFrame:
    """id, score, level, reasons of reports with their facts: the signs' weights summed, 1 at most. Advisory only: no truth follows from it."""
    points = sum((F.when(F.expr(test), F.expr(str(n))).otherwise(0) for _, n, test in SIGNS), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(code)) for code, _, test in SIGNS)))
    rows = facts.select("id", F.least(points, F.lit(100)).alias("points"), reasons.alias("reasons"))
    level = F.when(F.col("points") >= HIGH, "high").when(F.col("points") >= MEDIUM, "medium").otherwise("low")
    return rows.select("id", (F.col("points") / 100).alias("score"), level.alias("level"), F.array_join("reasons", ",").alias("reasons"))


#: What the reports' rows lack, made from their keys: texts of many kinds, a clock ahead, a latitude beyond the pole, metadata that are no numbers.
_SAID = "CASE WHEN id % 53 = 0 THEN 'oh' ELSE concat(raw_text, CASE id % 9 WHEN 1 THEN repeat(' flood', 12) WHEN 2 THEN ' !!! ??? ### !!! ??? ### !!!' WHEN 3 THEN ' https://a.example www.b.example http://c.example/x' WHEN 4 THEN ' call 9000000001 9000000002 9000000003' WHEN 5 THEN ' confirmed official proof urgent 100 2 3 never' WHEN 6 THEN concat(' road ', id) ELSE '' END) END"
_SEEN = "CASE WHEN id % 41 = 0 THEN at_s + 900 ELSE observed_s END"
_LAT = "CASE WHEN id % 37 = 0 THEN lat + 90 ELSE lat END"
_META = ("CASE WHEN id % 29 = 0 THEN 'many' ELSE concat('', id % 5) END", "CASE WHEN id % 31 = 0 THEN 'old' WHEN id % 3 = 0 THEN NULL ELSE concat('', id % 90) END")


@query(
    cte("reports", "verified")
    + f""", m AS (SELECT id, reporter, at_s, lat, lng, state, hazard, verified_id, {_SAID} AS said, {_SEEN} AS seen_s, {_LAT} AS at_lat, {_META[0]} AS m1, {_META[1]} AS m2 FROM reports),
c AS (SELECT said, count(*) AS copies FROM m GROUP BY 1), x AS (SELECT m.*, copies, count(*) OVER w AS recent, sum(CASE WHEN copies > 1 THEN 1 ELSE 0 END) OVER w AS repeated FROM m JOIN c USING (said) WINDOW w AS (PARTITION BY reporter ORDER BY at_s RANGE BETWEEN {RECENT_S} PRECEDING AND CURRENT ROW)),
t AS (SELECT *, lower(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS t, regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}_]+') AS w FROM x),
f AS (SELECT t.id, copies, recent, repeated * 1.0 / recent AS repeated_share, t.at_s - seen_s AS delay_s, at_lat BETWEEN -90 AND 90 AND t.lng BETWEEN -180 AND 180 AS coordinates_valid, t.state = v.state AS place_fits, t.hazard = v.event_type AS type_fits,
 (CASE WHEN m1 IS NOT NULL AND try_cast(m1 AS DOUBLE) IS NULL THEN 1 ELSE 0 END) + (CASE WHEN m2 IS NOT NULL AND try_cast(m2 AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS bad_metadata, length(t) AS characters,
 (len(w) - len(list_distinct(w))) * 1.0 / len(w) AS repeated_words, CASE WHEN len(w) > 1 THEN (len(w) - 1 - len(list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))))) * 1.0 / (len(w) - 1) END AS repeated_pairs,
 len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s]')) * 1.0 / length(t) AS marks, len(list_filter(w, lambda y: regexp_full_match(y, '[0-9]+') OR y IN {CLAIMS})) * 1.0 / len(w) AS claims, len(regexp_extract_all(t, '(?:https?://|www\\.)\\S+')) AS urls, len(regexp_extract_all(t, '[0-9]{{10}}')) AS phones
 FROM t LEFT JOIN verified v ON v.id = verified_id)
SELECT id, least({_POINTS_SQL}, 100) / 100.0 AS score, CASE WHEN {_POINTS_SQL} >= {HIGH} THEN 'high' WHEN {_POINTS_SQL} >= {MEDIUM} THEN 'medium' ELSE 'low' END AS level, array_to_string({_SIGNS_SQL}, ',') AS reasons FROM f"""
)
def ml05_credibility_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted signs of an incredible report: its text, copies of it, its reporter's recent reports and the copies among them, its clock,
    point and metadata, and whether its event has its place and kind."""
    r = frame(spark, sf_dir, "reports").selectExpr("id", "reporter", "at_s", "lng", "state", "hazard", "verified_id", f"{_SAID} AS said", f"{_SEEN} AS seen_s", f"{_LAT} AS at_lat", f"{_META[0]} AS m1", f"{_META[1]} AS m2")
    r = r.withColumn("k", F.md5("said"))
    copies = r.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    w = Window.partitionBy("reporter").orderBy("at_s").rangeBetween(-RECENT_S, 0)
    x = r.join(copies, "k").withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("repeated_share", F.count_if(F.col("copies") > 1).over(w) / F.col("recent"))
    events = frame(spark, sf_dir, "verified").select(F.col("id").alias("verified_id"), F.col("state").alias("v_state"), "event_type")
    no_number = lambda c: (F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int")
    facts = x.join(events, "verified_id", "left").select(
        "id", "copies", "recent", "repeated_share", (F.col("at_s") - F.col("seen_s")).alias("delay_s"), (F.col("at_lat").between(-90, 90) & F.col("lng").between(-180, 180)).alias("coordinates_valid"),
        (F.col("state") == F.col("v_state")).alias("place_fits"), (F.col("hazard") == F.col("event_type")).alias("type_fits"), (no_number("m1") + no_number("m2")).alias("bad_metadata"), text_facts(F.col("said")).alias("t"),
    )
    return risk(facts.select("*", "t.*"))
