"""Scalar rules over the driver's texts, pages, keys and times."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.media import hamming_pairs
from ..sources.bindings import AS_OF, DAY, cte, flags, frame
from ..sources.tables import saved
from .registry import query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query()
def str01_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.clean(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s<>"'']+', ' ', 'g'), '(\s*#[^\s#]+)+\s*$', ''), '\s+', ' ', 'g'))) AS core FROM documents""")
def str02_core_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(text.core(F.col("text"))).alias("core"))


@query(r"""SELECT key_, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g'))) AS key_ FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def str03_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are the same but for case, punctuation and blanks."""
    keys = documents(spark, sf_dir).select("doc_id", F.md5(text.text_key(F.col("text"))).alias("key_"))
    return keys.groupBy("key_").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(concat('FWD: Urgent - ', p_name), '(?i)^\s*((urgent|breaking|alert|fwd|fw|forwarded|rt|update|attention|please share)\s*[:\-!]+\s*)+', ''), '\s+', ' ', 'g')) AS bare FROM part""")
def str04_repost_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.without_repost(F.concat(F.lit("FWD: Urgent - "), "p_name")).alias("bare"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(concat(p_name, ' in town - ', p_brand), '\s+[-|]\s+[^-|]+$', '')), '[!-/:-@\[-`{-~\s]+', ' ', 'g')) AS key_ FROM part""")
def str05_headline_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.headline_key(F.concat("p_name", F.lit(" in town - "), "p_brand")).alias("key_"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) * 1.0 / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
WHERE 1 - levenshtein(a.p_name, b.p_name) * 1.0 / greatest(length(a.p_name), length(b.p_name)) >= 0.75""")
def str06_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of one brand and type that are similar; brand and type are the block."""
    return similar_names(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type"), 0.75)


def similar_names(parts: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of parts of one block whose names are at least so similar; different names are compared once a block, then met with their parts."""
    names = parts.select("p_brand", "p_type", "p_name").distinct()
    s = text.edit_similarity(F.col("p_name"), F.col("other"))
    near = names.join(names.withColumnRenamed("p_name", "other"), ["p_brand", "p_type"]).withColumn("similarity", s).where(F.col("similarity") >= least)
    of = parts.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("other"), "p_brand", "p_type")
    pairs = parts.join(near, ["p_brand", "p_type", "p_name"]).join(of, ["p_brand", "p_type", "other"]).where(F.col("p_partkey") < F.col("b"))
    return pairs.select(F.col("p_partkey").alias("a"), "b", F.round("similarity", 6).alias("similarity"))


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(concat(url, '?utm_source=x&b=2&a=1'), '#.*$', '') AS u FROM pages), p AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]+)', 1)), '^(www\.|m\.|amp\.)+', '') AS host, regexp_replace(regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]+([^?]*)', 1), '/amp(/|$)', '\1', 'g'), '/+$', '') AS path,
 list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'ref', 'ref_src'))) AS q FROM u)
SELECT page_id, concat('https://', host, path, CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END) AS url FROM p"""
)
def str08_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.canonical_url(F.concat("url", F.lit("?utm_source=x&b=2&a=1"))).alias("url"))


@query()
def str09_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text.html_text(F.col("html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", body.alias("text"))


@query(
    r"""WITH x AS (SELECT doc_id, text, ' ' || trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g')) || ' ' AS k FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) * 1.0 / greatest(len(regexp_extract_all(text, '\p{L}')), 1) >= 0.3 THEN 'hi' WHEN contains(k, ' hai ') OR contains(k, ' nahi ') OR contains(k, ' paani ') OR contains(k, ' mein ')::INT + contains(k, ' ka ')::INT + contains(k, ' se ')::INT + contains(k, ' ko ')::INT >= 2 THEN 'hinglish' WHEN text IS NULL THEN 'en' ELSE 'en' END AS language FROM x"""
)
def str10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.language(F.col("text"), ["hai", "nahi", "paani"], ["mein", "ka", "se", "ko"]).alias("language"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, 'https?://[^\s<>"'']+')) AS BIGINT) AS urls, CAST(len(regexp_extract_all(text, '[0-9]{10}')) AS BIGINT) AS numbers FROM documents""")
def str11_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(text.URL)).cast("bigint").alias("urls"), F.regexp_count("text", F.lit("[0-9]{10}")).cast("bigint").alias("numbers"))


@query(r"""SELECT doc_id, array_to_string(list_distinct_sorted, ',') AS found FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g')), ' '), lambda t: starts_with(t, 'thand') OR starts_with(t, 'leau')))) AS list_distinct_sorted FROM documents) WHERE len(list_distinct_sorted) > 0""")
def str12_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with words of given stems, and those words."""
    tokens = F.split(text.text_key(F.col("text")), " ")
    found = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.startswith("thand") | t.startswith("leau"))))
    return documents(spark, sf_dir).select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("found"))


@query(r"""SELECT doc_id, (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 20 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) * 1.0 / greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1) > 0.6) OR contains(text, '!!!') AS shouting FROM documents""")
def str15_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_contains(text.text_flags(F.col("text")), "shouting").alias("shouting"))


@query("SELECT o_orderkey, concat('EVT-', o_orderkey) AS docket FROM orders")
def str17_docket(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.concat(F.lit("evt - "), F.translate(F.col("o_orderkey").cast("string"), "01", "oL"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.docket(typed).alias("docket"))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, t, tf: the different words of text keys (doc_id, key) and how often each stands in its key; some texts at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            terms = [Counter(w for w in (key or "").split(" ") if w) for key in part.column("key").to_pylist()]
            at = pa.array([row for row, words in enumerate(terms) for _ in words], pa.int64())
            t = pa.array([w for words in terms for w in words], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(at), "t": t, "tf": pa.array([n for words in terms for n in words.values()], pa.int64())})


@query(
    r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g')), ' ')) AS t FROM documents), f AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t <> '' GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM f), x AS (SELECT doc_id, f.t, (1 + ln(tf)) * (ln((1 + n) * 1.0 / (1 + df)) + 1) AS v FROM f JOIN df USING (t), n)
SELECT doc_id, count(*) AS terms, round(sqrt(sum(v * v)), 6) AS norm FROM x GROUP BY 1"""
)
def str18_tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and length of each TF-IDF vector: (1 + ln tf) x (ln((1 + N) / (1 + df)) + 1).

    A document's terms are counted in its own row, before anything is shuffled.
    """
    f = saved(documents(spark, sf_dir).select("doc_id", text.text_key(F.col("text")).alias("key")).mapInArrow(counted, "doc_id bigint, t string, tf bigint"), "terms")
    df = f.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = f.select("doc_id").distinct().count()
    v = (1 + F.ln("tf")) * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    return f.join(df, "t").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sqrt(F.sum(v * v)), 6).alias("norm"))


@query(cte("reports") + "SELECT id, (at_s + 19800) // 86400 AS ist_day, ((at_s + 19800) % 86400) // 3600 AS ist_hour FROM reports")
def dat01_ist(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.from_utc_timestamp(F.timestamp_seconds("at_s"), "Asia/Kolkata")
    return frame(spark, sf_dir, "reports").select("id", F.datediff(F.to_date(local), F.lit("1970-01-01")).cast("bigint").alias("ist_day"), F.hour(local).cast("bigint").alias("ist_hour"))


@query(cte("verified") + "SELECT id, (915148800 - verified_s) // 60 AS age_min, verified_s >= 915148800 - 900 AS claim_live FROM verified")
def dat02_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "verified").select("id", F.floor((915_148_800 - F.col("verified_s")) / 60).alias("age_min"), (F.col("verified_s") >= 915_148_800 - 900).alias("claim_live"))


@query(cte("reports") + "SELECT id, observed_s FROM reports WHERE observed_s BETWEEN at_s - 604800 AND at_s + 300")
def dat03_observed_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "reports").where("observed_s between at_s - 604800 and at_s + 300").select("id", "observed_s")


@query(
    cte("reports")
    + f"SELECT verified_id, min(at_s) - CASE WHEN bool_or(hazard = 'HEATWAVE') THEN 86400 WHEN bool_or(hazard IN ('RAINFALL', 'URBAN_FLOOD')) THEN 86400 ELSE 10800 END AS from_s, least(max(at_s) + 10800, {AS_OF - DAY}) AS to_s FROM reports WHERE verified_id IS NOT NULL GROUP BY 1"
)
def dat05_evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of an event's reports, widened by three hours, or a day before for rain and heat; never past the clock."""
    long = F.coalesce(F.bool_or(F.col("hazard").isin("HEATWAVE", "RAINFALL", "URBAN_FLOOD")), F.lit(False))
    return frame(spark, sf_dir, "reports").where("verified_id is not null").groupBy("verified_id").agg((F.min("at_s") - F.when(long, DAY).otherwise(10_800)).alias("from_s"), F.least(F.max("at_s") + 10_800, F.lit(AS_OF - DAY)).alias("to_s"))


@query("SELECT p_partkey, round(greatest(0.0, least(1.0, (1 - exp(-p_size / 6.5)) / (1 - exp(-25 / 6.5)))), 6) AS density, round(CASE WHEN p_size / 2.0 >= 10 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * (p_size / 2.0) / 10)) END, 6) AS coherence FROM part")
def geo02_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(geo.density(n), 6).alias("density"), F.round(geo.coherence(n / 2, F.lit(5.0)), 6).alias("coherence"))


_RAIN = "CASE WHEN rainfall_mm IS NULL THEN NULL WHEN rainfall_mm <= 0 THEN 0.0 WHEN rainfall_mm <= 2.5 THEN rainfall_mm / 2.5 * 0.1 WHEN rainfall_mm <= 15.6 THEN 0.1 + (rainfall_mm - 2.5) / (15.6 - 2.5) * 0.25 WHEN rainfall_mm <= 64.5 THEN 0.35 + (rainfall_mm - 15.6) / (64.5 - 15.6) * 0.35 ELSE 0.7 END"


@query(cte("readings") + f"SELECT order_id, line, round({_RAIN}, 5) AS rain FROM readings")
def geo04_rain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "readings").select("order_id", "line", F.round(geo.rain_score(F.col("rainfall_mm")), 5).alias("rain"))


@query(
    cte("readings", "stations")
    + f""", x AS (SELECT order_id, line, rainfall_mm, 80 + order_id % 20 AS c1, 80 + order_id // 20 % 20 AS c2, temperature_c AS t, gust_kmh AS g, visibility_m AS v, elevation_m AS e FROM readings JOIN stations USING (station))
SELECT order_id, line, CASE WHEN t + CASE WHEN e > 1000 THEN 10 ELSE 0 END >= 47 THEN 1.0 WHEN t + CASE WHEN e > 1000 THEN 10 ELSE 0 END >= 45 THEN 0.9 WHEN t + CASE WHEN e > 1000 THEN 10 ELSE 0 END >= 42 THEN 0.6 WHEN t + CASE WHEN e > 1000 THEN 10 ELSE 0 END >= 40 THEN 0.4 ELSE 0.1 END AS heat,
 CASE WHEN t <= 2 THEN 1.0 WHEN t <= 4 THEN 0.8 WHEN t <= 7 THEN 0.5 WHEN t <= 10 THEN 0.3 ELSE 0.1 END AS cold,
 CASE WHEN v IS NULL THEN NULL WHEN v < 50 THEN 1.0 WHEN v < 200 THEN 0.85 WHEN v < 500 THEN 0.6 WHEN v < 1000 THEN 0.4 ELSE 0.0 END AS fog,
 CASE WHEN g IS NULL THEN NULL WHEN g >= 89 THEN 1.0 WHEN g >= 62 THEN 0.8 WHEN g >= 50 THEN 0.6 WHEN g >= 39 THEN 0.4 ELSE 0.0 END AS gust,
 greatest(CASE WHEN t * 3 >= 100 THEN 1.0 WHEN t * 3 >= 50 THEN 0.6 WHEN t * 3 >= 20 THEN 0.3 ELSE 0.0 END, {_RAIN}) AS cloudburst,
 round(least(1.0, CASE WHEN t * 30 >= 1000 THEN 1.0 WHEN t * 30 >= 500 THEN 0.7 WHEN t * 30 >= 200 THEN 0.4 ELSE 0.0 END + CASE WHEN coalesce(g, 0) >= 40 THEN 0.1 ELSE 0.0 END), 4) AS dust,
 CASE WHEN c1 IN (95, 96, 99) OR c2 IN (95, 96, 99) THEN 1.0 WHEN (c1 IN (80, 81, 82) OR c2 IN (80, 81, 82)) AND t * 40 >= 1000 THEN 0.6 WHEN t * 40 >= 500 THEN 0.3 ELSE 0.0 END AS thunder,
 CASE WHEN c1 IN (96, 99) OR c2 IN (96, 99) THEN 1.0 WHEN c1 = 95 OR c2 = 95 THEN 0.5 ELSE 0.0 END AS hail FROM x"""
)
def geo05_step_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = frame(spark, sf_dir, "readings").join(frame(spark, sf_dir, "stations").select("station", "elevation_m"), "station")
    t, i = F.col("temperature_c"), F.col("order_id")
    codes = F.array((80 + i % 20).cast("int"), (80 + F.floor(i / 20) % 20).cast("int"))
    return r.select("order_id", "line", geo.heat_score(t, F.col("elevation_m")).alias("heat"), geo.cold_score(t).alias("cold"), geo.fog_score(F.col("visibility_m")).alias("fog"), geo.gust_score(F.col("gust_kmh")).alias("gust"), geo.cloudburst_score(t * 3, F.col("rainfall_mm")).alias("cloudburst"), F.round(geo.dust_score(t * 30, F.col("gust_kmh")), 4).alias("dust"), geo.thunder_score(codes, t * 40).alias("thunder"), geo.hail_score(codes).alias("hail"))


# Media of one group of five have hashes that a few flipped bits tell apart; a medium has two frames.
_LOW, _HIGH = "(page_id // 5 % 1000003) * 2654435761 % 4294967296", "(page_id // 5 % 1000003 * 40503 + 977) * 69069 % 4294967296"
_FLIPS = [[f"(page_id * {m} + {k * 3}) % 64" for m in (7, 13, 29)] for k in (0, 1)]


def _flipped(flips: list[str], half: int) -> str:
    one = "CASE WHEN {f} // 32 = {h} THEN 1::BIGINT << CAST({f} % 32 AS INTEGER) ELSE 0 END"
    out = (_LOW, _HIGH)[half]
    for f in flips:
        out = f"xor({out}, {one.format(f=f, h=half)})"
    return out


HASHES = " UNION ALL ".join(f"SELECT page_id, {_flipped(f, 0)} AS lo, {_flipped(f, 1)} AS hi FROM pages" for f in _FLIPS)


def media_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and h of each medium's two frames."""
    spark_of = lambda e: F.expr(e.replace("//", "div"))
    base = F.call_function("shiftleft", spark_of(_HIGH), F.lit(32)).bitwiseOR(spark_of(_LOW))
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), spark_of(e).cast("int"))
    frames = []
    for flips in _FLIPS:
        h = base
        for f in flips:
            h = h.bitwiseXOR(bit(f))
        frames.append(h)
    own, rest = frames[0], F.array(*frames[1:])
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.array_prepend(rest, own)).alias("h"))


@query(
    f"WITH h AS ({HASHES}) SELECT a.page_id AS a, b.page_id AS b, CAST(min(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi))) AS BIGINT) AS bits FROM h a JOIN h b ON a.page_id < b.page_id AND bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 8 GROUP BY 1, 2"
)
def jon13_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of which two frames have 64-bit hashes at most 8 bits apart, and the least distance."""
    return hamming_pairs(media_hashes(spark, sf_dir), "page_id")


@query(cte("reports") + "SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('{\"hazard\":', CASE WHEN hazard IS NULL THEN 'null' ELSE concat('\"', hazard, '\"') END, ',\"id\":', id, ',\"state\":\"', state, '\"}') AS canonical FROM reports")
def arr04_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with keys in order, no blanks and explicit nulls."""
    body = F.to_json(F.struct("hazard", "id", "state"), {"ignoreNullFields": "false"})
    return frame(spark, sf_dir, "reports").select("id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), body.alias("canonical"))


#: Texts with blanks at their ends, some of them nothing else.
_PADDED = "CASE WHEN id % 7 = 0 THEN '   ' ELSE concat(repeat(' ', CAST(id % 30 AS INT)), substr(raw_text, 1, CAST(id % 50 AS INT)), '  ') END"


@query(cte("reports") + f"SELECT id, round(greatest(0.05, credibility * CASE WHEN source_type = 'CITIZEN_APP' THEN 0.5 + 0.5 * least(1.0, length(trim({_PADDED})) / 6e1) ELSE 1.0 END * CASE WHEN contains(coalesce(flags_csv, ''), 'promotional') THEN 0.3 ELSE 1 END * CASE WHEN contains(coalesce(flags_csv, ''), 'shouting') THEN 0.9 ELSE 1 END * CASE WHEN contains(coalesce(flags_csv, ''), 'bot_account') THEN 0.8 ELSE 1 END), 8) AS score FROM reports")
def geo08_flagged_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior x quality by length for what a person wrote x the factors of its flags."""
    score = text.credibility(F.col("credibility"), F.expr(_PADDED), flags(), F.col("source_type") == "CITIZEN_APP")
    return frame(spark, sf_dir, "reports").select("id", F.round(score, 8).alias("score"))


@query(
    cte("reports", "verified")
    + ", d AS (SELECT reporter, count(*) AS r, count(*) FILTER (WHERE review_status IN ('AUTO_PUBLISHED', 'HUMAN_APPROVED')) AS a FROM reports JOIN verified ON verified.id = verified_id GROUP BY 1) SELECT reporter, a AS approved, r AS decided, round((a + 1) * 1.0 / (r + 2), 6) AS trust, round(least(1.0, 0.6 * (0.5 + (a + 1) * 1.0 / (r + 2))), 6) AS credibility FROM d"
)
def agg19_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions recounted per reporter, and trust (a + 1) / (a + r + 2) with r the other decisions."""
    v = frame(spark, sf_dir, "verified").select(F.col("id").alias("verified_id"), "review_status")
    d = frame(spark, sf_dir, "reports").join(v, "verified_id").groupBy("reporter").agg(F.count_if(F.col("review_status").isin("AUTO_PUBLISHED", "HUMAN_APPROVED")).alias("approved"), F.count(F.lit(1)).alias("decided"))
    trust = (F.col("approved") + 1) / (F.col("decided") + 2)
    return d.select("reporter", "approved", "decided", F.round(trust, 6).alias("trust"), F.round(F.least(F.lit(1.0), 0.6 * (0.5 + trust)), 6).alias("credibility"))
