"""The engine's frames, derived from the driver's tables.

The driver's tables hold no reports or coordinates, so every column is made from their keys by integer arithmetic. A frame is one
list of expressions that Spark SQL and DuckDB both read: Spark selects them, and cte() gives the same frame to an oracle query.
Times are seconds since 1970 (UTC), so that both engines agree on every bound; 1e3 and the like are doubles in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of every query: no query reads the wall clock.
AS_OF = 1_706_659_200  # 2024-01-31 00:00 UTC
DAY, HOUR = 86_400, 3_600


def _case(value: str, *choices: str | None) -> str:
    inner = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(choices) if c is not None)
    return f"CASE {value} {inner} END"


_HAZARDS = ("URBAN_FLOOD", "RAINFALL", "HEATWAVE", "THUNDERSTORM", "FOG", "STRONG_WIND", "RIVER_BREACH", "COLD_WAVE", "LANDSLIDE", "LIGHTNING", "DUST_STORM", "CLOUDBURST", "CYCLONE", "HAILSTORM", "CYCLONE_INUNDATION", "UNCLASSIFIED")

#: frame: (table, time column or None, {column: expression}); {s} is the time in seconds.
FRAMES: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "reports": (
        "events",
        "ts",
        {
            "id": "event_id",
            "at_s": "{s}",
            "observed_s": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE {s} - (event_id % 17) * 60 END",
            "reporter": "concat('u', user_id)",
            "source_type": _case("user_id % 8", "OFFICIAL_DISPATCH", "CWC_GAUGE", "AWS_SENSOR", "CITIZEN_APP", "CITIZEN_APP", "CITIZEN_APP", "NEWS_MEDIA", "SOCIAL_MEDIA"),
            "lat": "(8000 + user_id * 7919 % 28000) / 1e3 + (event_id % 97) / 4e3",
            "lng": "(69000 + user_id * 104729 % 27000) / 1e3 + (event_id % 89) / 4e3",
            "district": "CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('District ', user_id % 40) END",
            "state": "concat('State ', user_id % 8)",
            "place_precision": "CASE event_id % 10 WHEN 0 THEN 'district' WHEN 1 THEN 'state' WHEN 2 THEN 'none' WHEN 3 THEN NULL ELSE 'gps' END",
            "hazard": "CASE event_type WHEN 'click' THEN 'URBAN_FLOOD' WHEN 'view' THEN 'RAINFALL' WHEN 'purchase' THEN 'HEATWAVE' WHEN 'signup' THEN 'THUNDERSTORM' END",
            "credibility": "(event_id * 31 % 96 + 5) / 1e2",
            "verified_id": "CASE WHEN event_id % 3 = 0 THEN event_id % 400 + 1 END",
            "duplicate_of": "CASE WHEN event_id % 11 = 5 THEN event_id - 1 END",
            "stale": "event_id % 23 = 0",
            "flags_csv": "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'shouting' WHEN 2 THEN 'promotional,shouting' WHEN 3 THEN 'bot_account' WHEN 4 THEN 'not_an_observation' ELSE NULL END",
            "raw_text": "concat(CASE WHEN event_id % 12 = 0 THEN 'URGENT: ' ELSE '' END, 'Water on road ', substr(md5(concat('t', user_id % 30)), 1, 20), ' market ', event_id % 4)",
            "link": "CASE WHEN event_id % 5 = 0 THEN concat('https://n.example/', event_id - event_id % 200) END",
            "headline_key": "CASE WHEN user_id % 8 = 6 THEN concat('head ', event_id * 7 % 50) END",
            "props": "props",
            "value": "value",
        },
    ),
    "verified": (
        "orders",
        "o_orderdate",
        {
            "id": "o_orderkey",
            "code": "concat('EV-', o_orderkey)",
            "event_type": _case("o_custkey % 16", *_HAZARDS),
            "severity": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MODERATE' ELSE 'LOW' END",
            "confidence": "(o_orderkey * 37 % 1001) / 1e3",
            "review_status": "CASE WHEN o_orderstatus = 'F' THEN 'AUTO_PUBLISHED' WHEN o_orderstatus = 'P' THEN 'REJECTED' WHEN o_custkey % 3 = 0 THEN 'PENDING_HUMAN_REVIEW' WHEN o_custkey % 3 = 1 THEN 'QUARANTINED' ELSE 'HUMAN_APPROVED' END",
            "verdict": "CASE o_orderkey % 4 WHEN 0 THEN 'CORROBORATED' WHEN 1 THEN 'UNCONFIRMED' WHEN 2 THEN 'CONTRADICTED' END",
            "district": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE concat('District ', o_custkey % 40) END",
            "state": "concat('State ', o_custkey % 8)",
            "verified_s": "{s}",
            "lat": "(8000 + o_custkey * 7919 % 28000) / 1e3",
            "lng": "(69000 + o_custkey * 104729 % 27000) / 1e3",
            "radius_km": "5e-1 + (o_orderkey % 80) / 1e1",
            "total": "o_totalprice",
        },
    ),
    "warnings": (
        "customer",
        None,
        {
            "identifier": "c_custkey",
            "status": "CASE WHEN c_custkey % 19 = 0 THEN 'test' ELSE 'actual' END",
            "msg_type": "CASE c_custkey % 5 WHEN 0 THEN 'update' WHEN 1 THEN 'cancel' ELSE 'alert' END",
            "severity": "CASE c_custkey % 5 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Minor' ELSE 'Unknown' END",
            "family": "CASE c_custkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'convective' WHEN 2 THEN 'thermal' ELSE 'visibility' END",
            "sent_s": f"{AS_OF} - (c_custkey * 13 % 96) * 3600",
            "effective_s": f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {AS_OF} - (c_custkey * 13 % 72) * 3600 + 7200 END",
            "expires_s": f"CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {AS_OF} + (c_custkey * 29 % 96 - 24) * 3600 END",
            "area": "concat('State ', c_custkey % 8, ' - District ', c_custkey % 40)",
            "lat": "(8000 + c_custkey * 6151 % 28000) / 1e3",
            "lng": "(69000 + c_custkey * 7433 % 27000) / 1e3",
        },
    ),
    "readings": (
        "lineitem",
        "l_shipdate",
        {
            "station": "l_suppkey",
            "recorded_s": "{s} + l_linenumber * 3600",
            "order_id": "l_orderkey",
            "line": "l_linenumber",
            "rainfall_mm": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END",
            "temperature_c": "l_quantity - 35e-1",
            "gust_kmh": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity * 2e0 END",
            "visibility_m": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 200 * 60 END",
            "code": "CASE l_linenumber WHEN 1 THEN 'TS' WHEN 2 THEN 'RA' WHEN 3 THEN 'FG' WHEN 4 THEN 'GR' WHEN 5 THEN 'RA+' WHEN 6 THEN 'VCTS' END",
        },
    ),
    "stations": (
        "supplier",
        None,
        {"station": "s_suppkey", "name": "s_name", "lat": "(8000 + s_suppkey * 9973 % 28000) / 1e3", "lng": "(69000 + s_suppkey * 7907 % 27000) / 1e3", "elevation_m": "s_suppkey * 97 % 2400"},
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame by name; columns that a query does not use are pruned down to the scan."""
    table, time, columns = FRAMES[name]
    seconds = f"unix_timestamp(cast({time} AS timestamp))" if time else ""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e.replace('{s}', seconds)} AS {c}" for c, e in columns.items()))


def cte(*names: str) -> str:
    """The same frames as the head of a DuckDB query."""
    out = []
    for name in names:
        table, time, columns = FRAMES[name]
        seconds = f"CAST(floor(epoch({time})) AS BIGINT)" if time else ""
        out.append(f"{name} AS (SELECT {', '.join(f'{e.replace("{s}", seconds)} AS {c}' for c, e in columns.items())} FROM {table})")
    return "WITH " + ", ".join(out) + " "


def flags(csv: str = "flags_csv"):
    """The flags of a report as an array; none for null or empty."""
    return F.filter(F.split(F.coalesce(F.col(csv), F.lit("")), ","), lambda x: x != "")
