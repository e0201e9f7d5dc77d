"""Parsers of warnings, feeds, weather reports and model series as column expressions."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A ring of more vertices is thinned evenly to at most this many.
MOST_VERTICES = 2000


#: What a warning's header and its first info block state.
_HEADER, _INFO = ("identifier", "status", "msgType", "sent"), ("event", "severity", "expires", "areaDesc", "polygon")
_STATED = StructType([StructField(name, StringType()) for name in (*_HEADER, *_INFO)])


def _stated(xml: str | None) -> dict[str, str]:
    """The first text of each of these elements in a document, in one pass; names are local, whatever their namespace.

    An element counts if it is the first of its name in its parent; those of an info block only below an info that is. A document
    that is no XML states nothing.
    """
    out: dict[str, str] = {}
    stack: list[tuple[str | None, bool, set[str]]] = [(None, False, set())]  # what is read, whether within an info, names of children
    text: list[str] = []

    def flush(*_: str) -> None:
        name, found = stack[-1][0], "".join(text)
        text.clear()
        if name and found:
            out.setdefault(name, found)

    def start(tag: str, _: dict[str, str]) -> None:
        flush()
        local = tag.rsplit(":", 1)[-1]
        _, within, seen = stack[-1]
        first = local not in seen
        seen.add(local)
        read = first and (local in _HEADER or (local in _INFO and within))
        stack.append((local if read else None, within or (first and local == "info"), set()))

    def end(_: str) -> None:
        flush()
        stack.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = flush
    try:
        parser.Parse(xml or "", True)
    except expat.ExpatError:
        return {}
    return out


@F.pandas_udf(_STATED)
def stated(xml: pd.Series) -> pd.DataFrame:
    """The texts of a warning as they stand, each document parsed once."""
    return pd.DataFrame([_stated(x) for x in xml], columns=[*_HEADER, *_INFO], dtype=object)


def cap_alerts(rows: DataFrame, xml: str, name: str) -> DataFrame:
    """rows with the CAP warning of their column xml as `name`: its header and its first info block. Of a document that is no XML all is null, its severity Unknown."""
    moment = lambda c: F.try_to_timestamp(c)

    def element(part: str) -> Column:
        text = F.trim(F.col(f"__stated.{part}"))
        return F.when(text != "", text)

    severity = element("severity")
    alert = F.struct(
        element("identifier").alias("identifier"),
        F.lower(element("status")).alias("status"),
        F.lower(element("msgType")).alias("msg_type"),
        element("event").alias("event"),
        F.when(severity.isin("Extreme", "Severe", "Moderate", "Minor"), severity).otherwise("Unknown").alias("severity"),
        severity.alias("raw_severity"),
        F.unix_timestamp(moment(element("sent"))).alias("sent_s"),
        F.unix_timestamp(moment(element("expires"))).alias("expires_s"),
        element("areaDesc").alias("area"),
        cap_ring(element("polygon")).alias("ring"),
    )
    return rows.withColumn("__stated", stated(F.col(xml))).withColumn(name, alert).drop("__stated")


def cap_ring(text: Column) -> Column:
    """"lat,lng lat,lng ..." as an array of (lng, lat), closed; vertices that are no numbers or off the globe are dropped, long rings thinned. Null under three vertices."""
    raw = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.struct(F.try_element_at(F.split(p, ","), F.lit(2)).try_cast("double").alias("lng"), F.try_element_at(F.split(p, ","), F.lit(1)).try_cast("double").alias("lat")))
    fine = F.filter(raw, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull() & (F.abs(p["lat"]) <= 90) & (F.abs(p["lng"]) <= 180))
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  what is read several times is made once
    every = lambda n: F.greatest(F.lit(1), F.ceil(n / MOST_VERTICES))
    thinned = lambda v: once(F.struct(v.alias("v"), every(F.size(v)).alias("every")), lambda x: F.filter(x["v"], lambda p, i: i % x["every"] == 0))

    def closed(thin: Column) -> Column:
        first, last = F.try_element_at(thin, F.lit(1)), F.try_element_at(thin, F.lit(-1))
        return F.when(F.size(thin) >= 3, F.when(first.eqNullSafe(last), thin).otherwise(F.concat(thin, F.array(first))))

    return once(once(fine, thinned), closed)


def wkt(ring: Column) -> Column:
    return F.when(ring.isNotNull(), F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))), ", "), F.lit("))")))


def rss_items(xml: Column) -> Column:
    """guid, title and time of each item of a feed, in order."""
    part = lambda name: F.xpath(xml, F.lit(f"//item/{name}/text()"))
    return F.transform(F.arrays_zip(part("guid").alias("guid"), part("title").alias("title"), part("pubDate").alias("at")), lambda x: F.struct(x["guid"].alias("guid"), x["title"].alias("title"), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(x["at"], r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))).alias("at_s")))


# Unit factors, groups that end a report's body, phenomena, and the metres that mean "10 km or more".
KMH = {"KT": 1.852, "MPS": 3.6, "KMH": 1.0}
MILE_M, UNLIMITED_M = 1609.34, 10_000
STOP = ("NOSIG", "BECMG", "TEMPO", "RMK")
PHENOMENA = r"^(\+|-)?(MI|BC|PR|DR|BL|SH|TS|FZ)?(DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS)*$"


def metar(raw: Column) -> Column:
    """Wind, gust, visibility, temperature, dew point, weather codes and convective cloud of a METAR; null where it states nothing.

    The first visibility group counts, and nothing after a trend or remark. Intensity belongs to the phenomenon: +TSRA is TS
    and RA+. Groups in the vicinity stay one code.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(raw, "=", " ")), r"\s+"), lambda t: ~t.isin("METAR", "SPECI", "AUTO", "COR", "NIL"))
    end = F.array_min(F.filter(F.transform(words, lambda t, i: F.when(t.isin(*STOP), i)), lambda i: i.isNotNull()))
    body = F.filter(words, lambda t, i: (i >= 2) & (end.isNull() | (i < end)))
    first = lambda pattern: F.try_element_at(F.filter(body, lambda t: t.rlike(pattern)), F.lit(1))
    wind = first(r"^(\d{3}|VRB)\d{2,3}(G\d{2,3})?(KT|MPS|KMH)$")
    unit = F.try_element_at(F.create_map(*(F.lit(x) for p in KMH.items() for x in p)), F.regexp_extract(wind, "(KT|MPS|KMH)$", 1))
    speed = F.regexp_extract(wind, r"^(?:\d{3}|VRB)(\d{2,3})", 1).try_cast("double")
    gust = F.regexp_extract(wind, r"G(\d{2,3})", 1).try_cast("double")
    seen = first(r"^(\d{4}(NDV)?|CAVOK|\d+SM|\d+/\d+SM)$")
    metres = F.regexp_extract(seen, r"^(\d{4})", 1).try_cast("int")
    miles = F.when(seen.contains("/"), F.regexp_extract(seen, r"^(\d+)/", 1).try_cast("double") / F.regexp_extract(seen, r"/(\d+)SM", 1).try_cast("double")).otherwise(F.regexp_extract(seen, r"^(\d+)SM", 1).try_cast("double"))
    visibility = F.when((seen == "CAVOK") | (metres == 9999), UNLIMITED_M).when(seen.endswith("SM"), F.round(miles * MILE_M).cast("int")).otherwise(metres)
    warm = first(r"^M?\d{2}/(M?\d{2})?$")
    degrees = lambda part: F.translate(F.try_element_at(F.split(warm, "/"), F.lit(part)), "M", "-").try_cast("int")
    near = F.filter(body, lambda t: t.rlike(r"^VC[A-Z]{2}$"))
    heavy = F.filter(body, lambda t: t.rlike(PHENOMENA) & (F.length(F.regexp_replace(t, r"^[+-]", "")) >= 2))

    def codes(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^[+-]", "")
        pairs = F.transform(F.sequence(F.lit(0), (F.length(bare) / 2).cast("int") - 1), lambda i: F.substring(bare, i * 2 + 1, F.lit(2)))
        kept = F.filter(pairs, lambda p: ~p.isin("MI", "BC", "PR", "DR", "BL", "FZ"))
        sign = F.when(t.startswith("+"), "+").when(t.startswith("-"), "-").otherwise("")
        return F.transform(kept, lambda p: F.when(p.isin("TS", "SH"), p).otherwise(F.concat(p, sign)))

    weather = F.array_distinct(F.concat(F.flatten(F.transform(heavy, codes)), near))
    return F.struct(
        F.round(speed * unit, 1).alias("wind_kmh"), F.round(gust * unit, 1).alias("gust_kmh"), visibility.alias("visibility_m"), degrees(1).alias("temperature_c"), degrees(2).alias("dewpoint_c"),
        weather.alias("weather_codes"), F.exists(body, lambda t: t.rlike(r"^(FEW|SCT|BKN|OVC)\d{3}(CB|TCU)$")).alias("convective"),
    )


def hourly(frame: DataFrame, time: str, variables: list[str]) -> DataFrame:
    """One row per time of parallel arrays; missing values stay null, shorter arrays end in nulls."""
    keys = [c for c in frame.columns if c not in (time, *variables)]
    return frame.select(*keys, F.inline_outer(F.arrays_zip(time, *variables)))


def latest_revision(warnings: DataFrame) -> DataFrame:
    """The newest fetch of each identifier (identifier, fetched_s, polygon, polygon_status and more).

    A polygon that was fetched replaces the old one, one that is absent clears it, and after a failed fetch the last known one stays.
    """
    known = F.max_by(F.when(F.col("polygon_status") == "ok", F.col("polygon")), F.when(F.col("polygon_status") != "failed", F.col("fetched_s")))
    rest = [c for c in warnings.columns if c not in ("identifier", "polygon")]
    newest = F.max_by(F.struct(*rest), F.col("fetched_s"))
    return warnings.groupBy("identifier").agg(newest.alias("n"), known.alias("polygon")).select("identifier", "n.*", "polygon")


def exif_time(moment: Column, offset: Column) -> Column:
    """Seconds of a camera's "yyyy:MM:dd HH:mm:ss" with its offset, UTC if it has none; null if it is no time."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat(moment, F.coalesce(offset, F.lit("+00:00"))), F.lit("yyyy:MM:dd HH:mm:ssXXX")))


def iso_time(moment: Column) -> Column:
    """Seconds of an ISO 8601 moment with its offset, as warnings have it."""
    return F.unix_timestamp(F.try_to_timestamp(moment, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def rfc822_time(moment: Column) -> Column:
    """Seconds of a feed's "Wed, 31 Jan 2024 06:00:00 GMT" or with a numeric offset; the day's name plays no part."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(moment), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    return F.unix_timestamp(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")))


def metar_time(group: Column, as_of: Column) -> Column:
    """Seconds of a METAR's day and time (ddHHmmZ): in the month of as_of, or in the one before if that lies over a day ahead."""
    part = lambda a: F.substring(group, a, 2).try_cast("int")
    first = F.trunc(F.timestamp_seconds(as_of).cast("date"), "month")
    at = lambda month: F.unix_timestamp(month.cast("timestamp")) + (part(1) - 1) * 86_400 + part(3) * 3600 + part(5) * 60
    return F.when(group.rlike(r"^\d{6}Z$"), F.when(at(first) > as_of + 86_400, at(F.add_months(first, -1))).otherwise(at(first)))
