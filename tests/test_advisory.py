"""Tagging, shapes, matching and grouping."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions.tagging import depth_cm, tag, tense
from attestra.operators.matching import complete_link, matched_pairs
from attestra.operators.shapes import hull, inside, intersecting, outline, rings_meet
from attestra.operators.media import copied, file_flags, recycled


@pytest.mark.parametrize(
    ("text", "hazards", "negated", "when"),
    [
        ("Severe waterlogging near station, right now", ["URBAN_FLOOD"], [], "now"),
        ("There is no flood in our street", [], ["URBAN_FLOOD"], "now"),
        ("Last year the cyclone hit us", ["CYCLONE"], [], "past"),
        ("Cyclone warning, landfall expected", ["CYCLONE"], [], "forecast"),
        ("Hailstorm struck, more expected", ["HAILSTORM"], [], "now"),
        ("42 degrees C outside", ["HEATWAVE"], [], "now"),
        ("#fog visibility 90 m", ["FOG"], [], "now"),
        ("wind 95 kmph", ["STRONG_WIND"], [], "now"),
        ("", [], [], "now"),
        (None, [], [], "now"),
    ],
)
def test_tags(text, hazards, negated, when):
    got = tag(text)
    assert (got["hazards"], got["negated"], got["tense"]) == (hazards, negated, when)


def test_values():
    assert depth_cm("2 feet water on the road") == pytest.approx(60.96)
    assert depth_cm("waist deep water, 40 cm water near the shop") == 100
    assert depth_cm("nothing") is None
    assert tag("wind 900 kmph")["implausible"] == ["wind_kmh"] and tag("wind 900 kmph")["hazards"] == []
    assert tense("it will rain, currently dry") == "now"


def test_hull_and_rings():
    rng = np.random.default_rng(0)
    p = rng.random((200, 2))
    h = hull(p)
    assert inside(p[:, 0] * 0.999 + 0.0005, p[:, 1] * 0.999 + 0.0005, h).mean() > 0.97
    wide = outline(np.array([[75.0, 20.0]]))
    assert len(wide) > 8 and np.allclose(np.hypot((wide[:, 0] - 75) * math.cos(math.radians(20)), wide[:, 1] - 20) * 111195, 250, rtol=0.01)
    square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    assert rings_meet(square(0, 0, 4), square(1, 1, 1)) and rings_meet(square(1, 1, 1), square(0, 0, 4))
    assert rings_meet(square(0, 0, 2), square(1, 1, 2)) and not rings_meet(square(0, 0, 1), square(3, 3, 1))
    assert rings_meet(np.array([[0, 1], [4, 1], [4, 2], [0, 2]], float), np.array([[1, 0], [2, 0], [2, 4], [1, 4]], float))


def test_intersecting(spark):
    ring = lambda x, y: [{"lng": x + a, "lat": y + b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    schema = "array<struct<lng: double, lat: double>>"
    left = spark.createDataFrame([(1, ring(0.2, 0.2)), (2, ring(50.0, 5.0))], f"id long, ring {schema}")
    right = spark.createDataFrame([(7, ring(0.9, 0.9)), (8, ring(2.5, 2.5))], f"other long, ring {schema}")
    assert [tuple(r) for r in intersecting(left, right).collect()] == [(1, 7)]


def test_complete_link_breaks_bridges(spark):
    step = 4 / 111.195
    rows = [(1, 0, 20.0, 75.0, "A", "x"), (2, 60, 20.0 + step, 75.0, None, "x"), (3, 120, 20.0 + 2 * step, 75.0, "A", "x"), (4, 180, 20.0, 75.0, "B", "x"), (9, 0, 20.0, 75.0, "A", "y")]
    got = {r.id: r.group for r in complete_link(spark.createDataFrame(rows, "id long, at_s long, lat double, lng double, kind string, block string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 9: 9}


def test_matcher(spark):
    texts = [(1, "Heavy flood on the main road near the bridge"), (2, "heavy FLOOD on the main road near the bridge!"), (3, "Strong wind broke trees in the park"), (4, ""), (5, "")]
    pairs = [(1, 2, 0.1, 1.0), (1, 3, 0.1, 1.0), (1, 2, 5.0, 1.0), (4, 5, 0.0, 0.0)]
    got = {(r.a, r.b): r for r in matched_pairs(spark.createDataFrame(pairs, "a long, b long, km double, minutes double"), spark.createDataFrame(texts, "id long, text string")).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 5)}
    assert got[1, 2].duplicate and got[1, 2].text_score == pytest.approx(1.0)
    assert not got[1, 3].duplicate and not got[4, 5].duplicate


def test_media_flags(spark):
    rows = [(0, 300_000, 300_000, 1.0, False, True), (400_000, None, 300_000, 26.0, True, False), (None, None, 300_000, None, None, True)]
    df = spark.createDataFrame(rows, "taken long, observed long, received long, km double, same boolean, meta boolean")
    got = [r.f for r in df.select(file_flags(F.col("taken"), F.col("observed"), F.col("received"), F.col("km"), F.col("same"), F.col("meta")).alias("f")).collect()]
    assert got == [["old_capture"], ["duplicate_media", "future_capture", "location_mismatch", "no_metadata"], []]


def test_media_flags_of_history_and_program(spark):
    rows = [(True, True, "HDR+ 1.0"), (True, True, "Adobe PHOTOSHOP 25"), (False, None, "snapseed"), (None, True, None)]
    df = spark.createDataFrame(rows, "recycled boolean, meta boolean, software string")
    none = F.lit(None).cast("long")
    got = [r.f for r in df.select(file_flags(none, none, none, none, F.lit(False), F.col("meta"), F.col("recycled"), F.col("software")).alias("f")).collect()]
    assert got == [["recycled_suspect"], ["recycled_suspect", "edited"], [], []]


def test_copied_needs_another_reporter_before(spark):
    rows = [
        (1, 10, "a", 100, "x"), (2, 11, "a", 200, "x"), (3, 12, "b", 300, "x"), (4, 13, "a", 400, "x"),  # 2 repeats its own, 3 and 4 another's
        (5, 20, None, 100, "y"), (6, 20, None, 150, "y"), (7, 21, None, 200, "y"),  # no reporter: a report stands for itself
        (8, 30, "a", 100, "z"), (9, 31, "b", 100, "z"),  # ties go by media
        (10, 40, "a", 1, None), (11, 41, "b", 2, None), (12, 50, "a", None, "x"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "media long, report long, reporter string, at_s long, sha string, who int")
    assert sorted(r.media for r in copied(df).collect()) == [3, 4, 7, 9]
    assert copied(df.where("false")).count() == 0


def test_recycled_is_near_and_two_days_old(spark):
    day = 86_400
    media = [(1, 0, 0), (2, 2 * day, 2 * day), (3, 2 * day + 1, 2 * day + 1), (4, 9 * day, 9 * day), (5, day, 9 * day), (6, 9 * day, None)]
    hashes = [(1, 0b1111), (1, 7 << 40), (2, 0b1110), (3, 0b1100), (4, (1 << 20) - 1), (5, 7 << 40), (6, 0b1111)]
    got = {r.media: r.first_seen for r in recycled(spark.createDataFrame(media, "media long, seen_s long, observed_s long"), spark.createDataFrame(hashes, "media long, h long")).collect()}
    # 2 is 48 hours old to the second; 4 has no near picture; 6 has no time
    assert got == {3: 0, 5: 0}


def test_rate_limit_ignores_rejected(spark):
    from attestra.plans import series

    random.seed(0)
    assert series.ROLLING == 12
    got = series.stm06_rate_limit(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("concat('u', user_id) AS reporter", "unix_timestamp(cast(ts as timestamp)) AS s", "event_id").orderBy("s", "event_id").collect()
    live, want = {}, {}
    for r in rows:
        kept = [t for t in live.get(r.reporter, []) if t > r.s - 86_400]
        ok = len(kept) < 2
        live[r.reporter] = [*kept, r.s] if ok else kept
        a, b = want.get(r.reporter, (0, 0))
        want[r.reporter] = (a + ok, b + (not ok))
    assert {r.reporter: (r.accepted, r.rejected) for r in got} == want


def test_splits_keep_components_whole_and_shares_even(spark):
    from attestra.operators.splits import contaminated, dealt, grouped_split

    rng = random.Random(8)
    groups = [(i, rng.choice([1, 1, 2, 5, 9]), i % 3 == 0) for i in range(4000)] + [(9000 + i, 700, i % 2 == 0) for i in range(5)]
    got = {r.grp: r.split for r in dealt(spark.createDataFrame(groups, "grp long, n long, positive boolean")).collect()}
    assert len(got) == len(groups)
    for kind in (True, False):
        total = sum(n for _, n, p in groups if p == kind)
        for split, share in (("train", 0.6), ("validation", 0.2), ("test", 0.2)):
            assert abs(sum(n for g, n, p in groups if p == kind and got[g] == split) / total - share) < 0.02
    pairs = [(a, a + 1, a % 10 == 0, rng.random(), a // 100) for a in range(0, 3000, 2)] + [(a, a + 3, False, rng.random(), a // 100) for a in range(0, 3000, 40)]
    texts = [(i, f"text {i // 500}" if i % 250 == 0 else "" if i % 7 == 0 else f"own {i}") for i in range(3004)]
    df, t = spark.createDataFrame(pairs, "a long, b long, duplicate boolean, text_score double, block long"), spark.createDataFrame(texts, "id long, key string")
    rows = grouped_split(df, t).collect()
    assert len(rows) == len(pairs)
    split = {}
    for r in rows:
        for i in (r.a, r.b):
            assert split.setdefault(i, r.split) == r.split
    assert contaminated(spark.createDataFrame([(k, split[i]) for i, k in texts if i in split], "key string, split string")).count() == 0
    for block in {p[4] for p in pairs}:
        scores = sorted((p[3] for p in pairs if p[4] == block and not p[2]), reverse=True)
        assert sorted((r.text_score for r in rows if r.block == block and r.hard), reverse=True) == scores[:3]
    assert {r.key: (r.splits, r.records) for r in contaminated(spark.createDataFrame([("x", "train"), ("x", "test"), ("x", "test"), ("y", "test"), ("", "train"), ("", "test"), (None, "train")], "key string, split string")).collect()} == {"x": ("test,train", 3)}
    assert grouped_split(df.where("false"), t).count() == 0


def test_islands_are_runs_of_a_station(spark):
    from attestra.plans.series import islands

    row = lambda t, x, z=0.0: ("s", t, t, x, z)
    rows = [row(0, 1.0), row(10, None), row(20, None), row(30, None), row(40, 9.0, 3.5), row(50, 9.0, 8.0), row(60, 9.0, 4.0), row(70, 1.0, 3.4), row(80, 9.0, 5.0), row(90, 9.0, 5.0), row(100, None), row(110, 9.0, 5.0), row(200, 1.0)]
    got = {(r.kind, r.from_s, r.to_s, r.points) for r in islands(spark.createDataFrame(rows, "station string, recorded_s long, tie long, x double, z double")).collect()}
    assert got == {("missing", 10, 30, 3), ("persistent", 40, 60, 3), ("irregular", 200, 200, 1)}


def test_one_automaton_finds_what_each_pattern_finds(spark):
    import re

    from attestra.functions.tagging import CUES, cued
    from attestra.operators.automaton import names_in

    rng = random.Random(3)
    words = [c for cues in CUES.values() for c in cues] + ["no", "rainy", "the", "mole", "holes", "o'hail", "overflowing", "dam", "burst", "heat", "wave"]
    for _ in range(400):
        joined = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        starts = [m.start() for m in re.finditer(r"\S+", joined)]
        number = lambda at: sum(s <= at for s in starts) - 1
        want = {h: {number(m.start()) for c in cues for m in re.finditer(rf"\b{re.escape(c)}", joined)} for h, cues in CUES.items()}
        assert {h: set(p) for h, p in cued(joined, starts).items()} == want
    names = ["goa", "north goa", "goa north", "a b", "b c", "a b c d", "x" * 40, "new delhi"]
    texts = [(i, rng.choice(["", " ", "In "]) + ", ".join(rng.choice([*names, "goan", "delhi", "NEW-Delhi", "a"]) for _ in range(rng.randint(0, 5)))) for i in range(120)] + [(500, None), (501, "")]
    t, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(k,) for k in [*names, "goa", "", None]], "k string")
    key = lambda s: " " + " ".join(re.sub(r"[^\w]+", " ", (s or "").lower()).split()) + " "
    want = sorted((i, k) for i, s in texts for k in names if f" {k} " in key(s))
    assert sorted(map(tuple, names_in(t, "id", "t", n).collect())) == want
    assert sorted(map(tuple, names_in(t, "id", "t", n, most=3).collect())) == want
    assert names_in(t, "id", "t", n.where("false")).count() == 0


def test_matcher_by_groups_is_that_of_all_pairs(spark, monkeypatch):
    """groups of few pairs, texts in several groups, missing, empty and long ones: scores as a plain version says; no table of a row a term is made."""
    import random

    from attestra.functions.text import text_key
    from attestra.operators import matching

    rng = random.Random(4)
    words = ["flood", "road", "bridge", "water", "पानी", "rain", "x" * 70, "😀", "is", "of"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(60)] + [(60, None), (61, "!!"), (62, "ab")]
    pairs = [(i, j, 0.5, 3.0) for i in range(63) for j in rng.sample(range(66), 6)] + [(0, j, 0.0, 0.0) for j in range(1, 60)] + [(None, 1, 0.0, 0.0), (70, 1, 0.0, 0.0)]
    rows, saved = {}, matching.saved
    monkeypatch.setattr(matching, "TOGETHER", 20, raising=False)
    monkeypatch.setattr(matching, "saved", lambda df, name: rows.setdefault(name, (t := saved(df, name)), ) and t)
    t = spark.createDataFrame(texts, "id long, text string")
    got = matching.matched_pairs(spark.createDataFrame(pairs, "a long, b long, km double, minutes double"), t).collect()
    key = {r.id: r.k or "" for r in t.select("id", text_key(F.col("text")).alias("k")).collect()}
    assert max(df.count() for df in rows.values()) <= 4 * len(pairs)
    grams = lambda k: [k[i : i + 3] for i in range(len(k) - 2)]
    vectors = []
    for of in (grams, lambda k: [w for w in k.split(" ") if w]):
        df = {}
        for k in key.values():
            for g in set(of(k)):
                df[g] = df.get(g, 0) + 1
        raw = {i: {g: (1 + math.log(of(k).count(g))) * (math.log((1 + len(key)) / (1 + df[g])) + 1) for g in set(of(k))} for i, k in key.items()}
        vectors.append({i: {g: w / math.sqrt(sum(x * x for x in v.values())) for g, w in v.items()} for i, v in raw.items()})
    known = [p for p in pairs if p[0] in key and p[1] in key]
    want = sorted((a, b, round((0.35 * sum(w * vectors[0][b].get(g, 0) for g, w in vectors[0][a].items()) + 0.30 * sum(w * vectors[1][b].get(g, 0) for g, w in vectors[1][a].items()) + 0.15 * (1 - matching.edits(key[a], key[b]) / max(len(key[a]), len(key[b]), 1))) / 0.8, 6)) for a, b, _, _ in known)
    found = sorted((r.a, r.b, round(r.text_score, 6)) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(found, want, strict=True))
