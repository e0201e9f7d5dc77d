"""Pinned values and edge cases of the scalar rules."""

import math

import pytest
from pyspark.sql import functions as F

from attestra.functions import geo, text
from attestra.operators import fusion
from attestra.operators.filters import EventFilter, day_bound, in_force
from attestra.operators.ledger import breaks, chain
from attestra.operators.spatial import connected, dbscan, radius_join
from attestra.sources.parsers import cap_ring, latest_revision, metar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("double")


def test_receipt_golden(spark):
    scores = {"weather": lit(None), "official": lit(0.0), "density": geo.density(lit(5)), "coherence": geo.coherence(lit(1.9), lit(5.0)), "reliability": lit(0.6), "vision": lit(None), "anomaly": lit(None)}
    r = one(spark, fusion.receipt(scores | {"weather": lit(0.35)}))
    assert r["coverage"] == 0.8
    r = one(spark, fusion.receipt({k: lit(None) for k in fusion.WEIGHTS}))
    assert (r["confidence"], r["coverage"]) == (0.0, 0.0)
    online = one(spark, fusion.receipt({"weather": lit(0.0), "density": lit(1.0)}))
    offline = one(spark, fusion.receipt({"weather": lit(None), "density": lit(1.0)}))
    assert online["confidence"] == 0.5 and offline["confidence"] == 1.0


@pytest.mark.parametrize(("n", "low", "high"), [(1, 0, 0.2), (3, 0.25, 0.45), (10, 0.75, 0.85), (25, 1, 1), (100, 1, 1)])
def test_density(spark, n, low, high):
    assert low <= round(one(spark, geo.density(lit(n))), 9) <= high


def test_density_and_coherence_pins(spark):
    assert round(one(spark, geo.density(lit(5))), 4) == 0.5483
    assert round(one(spark, geo.coherence(lit(1.9), lit(5.0))), 4) == 0.9135
    assert one(spark, geo.coherence(lit(10), lit(5.0))) == 0


def test_step_scales(spark):
    assert one(spark, geo.heat_score(lit(37), lit(1500))) == 1.0
    assert one(spark, geo.heat_score(lit(None), lit(0))) is None
    assert one(spark, geo.cold_score(lit(4))) == 0.8
    assert one(spark, geo.fog_score(lit(50))) == 0.85
    assert one(spark, geo.gust_score(lit(39))) == 0.4
    assert math.isclose(one(spark, geo.rain_score(lit(15.6))), 0.35)
    assert one(spark, geo.rain_score(lit(300))) == 1.0
    assert one(spark, geo.cloudburst_score(lit(None), lit(64.5))) == pytest.approx(0.7)
    assert one(spark, geo.dust_score(lit(1000), lit(50))) == 1.0


def test_verdict_and_routing(spark):
    assert one(spark, fusion.verdict(F.lit(1), lit(1.0), lit(1.0))) == "CONTRADICTED"
    assert one(spark, fusion.verdict(F.lit(0), lit(None), lit(0.6))) == "CORROBORATED"
    assert one(spark, fusion.verdict(F.lit(0), lit(0.59), lit(None))) == "UNCONFIRMED"
    route = lambda c, s, capped=False: one(spark, fusion.review_status(lit(c), F.lit(s), F.lit(capped)))
    assert route(0.9, "LOW") == "AUTO_PUBLISHED"
    assert route(0.95, "LOW", True) == "PENDING_HUMAN_REVIEW"
    assert route(0.1, "HIGH") == "PENDING_HUMAN_REVIEW"
    assert route(0.59, "MODERATE") == "QUARANTINED"
    assert one(spark, fusion.quadrant(lit(0.1), F.lit(None).cast("string"), F.lit(False))) == "UNVERIFIED_THREAT"


def test_text_rules(spark):
    assert one(spark, text.clean(F.lit("ﬁre​ at  https://x.y/z now"))) == "fire at <URL> now"
    assert one(spark, text.core(F.lit("Flood http://a.b #rain #city"))) == "Flood"
    assert one(spark, text.text_key(F.lit("  Hello, WORLD!! "))) == "hello world"
    assert one(spark, text.without_repost(F.lit("FWD: urgent!! water"))) == "water"
    assert one(spark, text.headline_key(F.lit("Rain hits town - Daily News"))) == "rain hits town"
    assert one(spark, text.canonical_url(F.lit("http://www.Ex.com/a/amp/?utm_x=1&b=2&a=1#f"))) == "https://ex.com/a?a=1&b=2"
    assert one(spark, text.edit_similarity(F.lit("abcd"), F.lit("abcx"))) == 0.75
    assert one(spark, text.language(F.lit("पानी भर गया"), ["hai"], ["ka"])) == "hi"
    assert one(spark, text.language(F.lit("paani aaya hai"), ["hai"], ["ka"])) == "hinglish"
    assert one(spark, text.text_flags(F.lit("BIG FLOOD EVERYWHERE NOW!!!"))) == ["shouting"]
    assert one(spark, text.docket(F.lit("evt-l2o"))) == "EVT-120"
    assert one(spark, text.credibility(lit(0.6), F.lit("x" * 60), F.array(F.lit("shouting"), F.lit("shouting")), F.lit(True))) == pytest.approx(0.54)
    assert one(spark, text.html_text(F.lit("<p>a<script>b</script></p><p>c &amp; d</p>"))) == "a\nc & d"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("METAR VIDP 221530Z 35004KT 4000 HZ NSC 30/24 Q1008 NOSIG", {"wind_kmh": 7.4, "visibility_m": 4000, "temperature_c": 30, "dewpoint_c": 24, "weather_codes": ["HZ"], "convective": False, "gust_kmh": None}),
        ("METAR VIDP 101130Z 29015G35KT 1500 DS NSC M01/M08 Q1002=", {"gust_kmh": 64.8, "temperature_c": -1, "weather_codes": ["DS"]}),
        ("VABB 101130Z 29005MPS CAVOK 31/20", {"wind_kmh": 18.0, "visibility_m": 10000, "weather_codes": []}),
        ("VABB 101130Z VRB02KT 1/2SM -SHRA OVC010TCU 31/", {"visibility_m": 805, "weather_codes": ["SH", "RA-"], "convective": True, "dewpoint_c": None}),
        ("", {"wind_kmh": None, "visibility_m": None, "weather_codes": []}),
    ],
)
def test_metar(spark, raw, want):
    got = one(spark, metar(F.lit(raw))).asDict()
    assert {k: got[k] for k in want} == want


def test_cap_ring(spark):
    ring = one(spark, cap_ring(F.lit("1,2 3,4 bad 5,6 99,0")))
    assert [(p["lng"], p["lat"]) for p in ring] == [(2, 1), (4, 3), (6, 5), (2, 1)]
    assert one(spark, cap_ring(F.lit("1,2 3,4"))) is None
    assert one(spark, cap_ring(F.lit(None).cast("string"))) is None


def test_latest_revision(spark):
    rows = [("a", 1, "P", "ok"), ("a", 2, None, "failed"), ("b", 1, "P", "ok"), ("b", 2, None, "absent")]
    got = {r.identifier: r.polygon for r in latest_revision(spark.createDataFrame(rows, "identifier string, fetched_s long, polygon string, polygon_status string")).collect()}
    assert got == {"a": "P", "b": None}


def test_bounds():
    assert day_bound("2024-01-01", False) == (1704047400, False)
    assert day_bound("2024-01-01", True) == (1704133800, True)
    assert day_bound("2024-01-01T00:00:00", True) == (1704067200, False)
    with pytest.raises(ValueError):
        EventFilter(start="2024-01-02", end="2024-01-01").apply(None)


def test_in_force_needs_an_end(spark):
    rows = [("actual", "alert", 0, None, 10), ("actual", "alert", 0, None, None), ("actual", "cancel", 0, None, 10), ("actual", "update", 9, 5, 5)]
    df = spark.createDataFrame(rows, "status string, msg_type string, sent_s long, effective_s long, expires_s long")
    assert df.where(in_force(5)).count() == 2


def test_dbscan_chain_noise_and_crowd(spark):
    step = 4 / 111.195
    points = [(i, 20 + i * step, 75.0) for i in range(4)] + [(10, 30.0, 75.0), (11, None, None)] + [(20 + i, 25.0, 80.0) for i in range(50)]
    got = {r.id: r.cluster for r in dbscan(spark.createDataFrame(points, "id long, lat double, lng double"), 5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0} | {20 + i: 20 for i in range(50)}
    three = {r.id: r.cluster for r in dbscan(spark.createDataFrame(points[:4], "id long, lat double, lng double"), 5, 3).collect()}
    assert three == {0: 1, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("lat", [0.0, 20.0, 55.0])
def test_radius_join_reaches_its_radius(spark, lat):
    east = 9.99 / (111.195 * math.cos(math.radians(lat)))
    a = spark.createDataFrame([(1, lat, 75.0)], "id long, lat double, lng double")
    b = spark.createDataFrame([(2, lat, 75.0 + east), (3, lat + 10.1 / 111.195, 75.0)], "id long, lat double, lng double")
    assert [r.r_id for r in radius_join(a, b, 10).collect()] == [2]


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.root for r in connected(spark, edges).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_ledger(spark):
    rows = spark.createDataFrame([(1, i, f"b{i}") for i in range(5)] + [(2, 0, "x")], "book long, seq long, body string")
    made = chain(rows, "book", "seq", "body")
    assert all(r.valid for r in breaks(made, "book", "seq", "body").collect())
    bad = made.withColumn("body", F.when(F.col("seq") == 2, "changed").otherwise(F.col("body")))
    got = {r.book: (r.valid, r.checked, r.broken_at) for r in breaks(bad, "book", "seq", "body").collect()}
    assert got == {1: (False, 3, 2), 2: (True, 1, None)}
