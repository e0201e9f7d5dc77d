"""Duplicates, chains, names and hashes against brute force."""

import random

from pyspark.sql import functions as F

from attestra.operators.dedup import citizen_parents, feed_parents, resolved
from attestra.operators.ledger import GENESIS, chain, link
from attestra.operators.names import best_similar, longest_prefix, similar
from attestra.plans.places import district_of, place_of_text
from attestra.plans.scalars import hamming_pairs
from attestra.plans.series import rate_limited
from attestra.plans.verification import family_components

HOUR = 3600


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_chains_lead_to_their_first_report(spark):
    parents = [(i + 1, i) for i in range(40)] + [(100, 5), (101, 100), (200, 199)]
    got = {r.id: r.original for r in resolved(spark.createDataFrame(parents, "id long, parent long")).collect()}
    assert got == {**{i + 1: 0 for i in range(40)}, 100: 0, 101: 0, 200: 199}
    assert resolved(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_citizen_duplicates_need_place_time_and_text(spark):
    far = 1.2 / 111.195
    rows = [
        (1, 1000, 20.0, 75.0, "Water on the main road", "CITIZEN_APP", "gps"),
        (2, 1500, 20.0, 75.0, "URGENT: Water on the main road", "CITIZEN_APP", None),
        (3, 1899, 20.0 + far, 75.0, "Water on the main road", "CITIZEN_APP", "gps"),
        (4, 1900, 20.0, 75.0, "Water on the main road!", "CITIZEN_APP", "gps"),
        (5, 1600, 20.0, 75.0, "A tree fell on a car", "CITIZEN_APP", "gps"),
        (6, 1600, 20.0, 75.0, "Water on the main road", "CITIZEN_APP", "district"),
        (7, 1600, 20.0, 75.0, "Water on the main road", "NEWS_MEDIA", "gps"),
        (8, 1600, None, None, "Water on the main road", "CITIZEN_APP", "gps"),
        (9, 1600, 20.0, 75.0, None, "CITIZEN_APP", "gps"),
    ]
    df = spark.createDataFrame(rows, "id long, at_s long, lat double, lng double, raw_text string, source_type string, place_precision string")
    assert sorted(tuple(r) for r in citizen_parents(df).collect()) == [(2, 1), (4, 2)]  # 900 s after the first is too late


def test_feed_rules_in_their_order(spark):
    rows = [
        (1, 0, "d", "s", "L1", None, "river rises in the old town today"),
        (2, 71 * HOUR, "e", "s", "L1", None, "quite another text"),
        (3, 72 * HOUR, "f", "s", "L1", None, "and a third of them, unlike"),
        (4, 100 * HOUR, "d", None, None, "key", "first words"),
        (5, 110 * HOUR, "d", None, None, "key", "other story altogether"),
        (6, 120 * HOUR, "d", None, None, None, "Other story altogether!"),
        (7, 130 * HOUR, "g", None, None, "key", "other story altogether"),
        (8, 120 * HOUR, "d", None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "id long, at_s long, district string, state string, link string, headline_key string, raw_text string").withColumn("seen_s", F.col("at_s"))
    got = {r.id: (r.parent, r.rule) for r in feed_parents(df).collect()}
    assert got == {2: (1, 1), 3: (2, 1), 5: (4, 2), 6: (5, 3)}


def test_windows_slide_with_the_reports(spark):
    rows = [(1, 0, 20.0, 75.0, "water"), (2, 6 * HOUR, 20.0, 75.0, "water"), (3, 12 * HOUR + 1, 20.0, 75.0, "water"), (4, 12 * HOUR, 20.0, 75.0, "convective"), (5, 15 * HOUR, 20.05, 75.0, "convective")]
    got = {r.id: r.event for r in family_components(spark, spark.createDataFrame(rows, "id long, at_s long, lat double, lng double, family string")).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4}


def test_long_chains_hash_every_row(spark):
    rows = [(1, i, None if i % 7 == 0 else f"b{i}") for i in range(30_000)] + [(2, 5, "x"), (2, 3, "y")]
    df = spark.createDataFrame(rows, "book long, seq long, body string").repartition(5)
    got = chain(df, "book", "seq", "body")
    assert got.count() == len(rows)
    again = got.where(~F.col("hash").eqNullSafe(link(F.col("prev_hash"), F.col("body")))).count()
    two = {r.seq: r for r in got.where("book = 2").collect()}
    assert again == 0 and two[3].prev_hash == GENESIS and two[5].prev_hash == two[3].hash


def test_rate_limit_of_a_hot_reporter(spark):
    rows = [("a", i * 100, i) for i in range(25_000)] + [("b", 5, 1), (None, 5, 2)]
    got = {r.reporter: (r.accepted, r.rejected) for r in rate_limited(spark.createDataFrame(rows, "reporter string, at_s long, id long").repartition(4), 1000, 3).collect()}
    assert got == {"a": (7500, 17500), "b": (1, 0)}


def test_similar_names_match_brute_force(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abcd ", k=rng.randint(3, 30))).strip() or "x" for _ in range(150)})
    names = sorted({" ".join(n.split()) for n in names})
    texts = []
    for i in range(150):
        t = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "q"])
        texts.append((i, " ".join("".join(t).split())))
    got = {(r.id, r.name) for r in similar(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(n, n) for n in names], "name string, k string"), 0.8).collect()}
    want = {(i, n) for i, t in texts for n in names if t and 1 - distance(t, n) / max(len(t), len(n)) >= 0.8}
    assert got == want and len(want) > 100


def test_prefixes_and_best_names(spark):
    names = spark.createDataFrame([(n, n) for n in ("north", "north goa", "south goa")], "name string, k string")
    texts = spark.createDataFrame([(1, "North Goa and nearby"), (2, "north side"), (3, "the north"), (4, None), (5, "Suth Goa")], "id long, t string")
    assert {r.id: r.name for r in longest_prefix(texts, "id", "t", names).collect()} == {1: "north goa", 2: "north"}
    assert {r.id: r.name for r in best_similar(texts, "id", "t", names, 0.88).collect()} == {5: "south goa"}


def test_hashes_of_frames_match_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for k in range(120):
        for _ in range(2):
            h = rng.choice(base)
            for _ in range(rng.randint(0, 7)):
                h ^= 1 << rng.randrange(64)
            rows.append((k, h - (1 << 64) if h >> 63 else h))
    got = {(r.a, r.b): r.bits for r in hamming_pairs(spark.createDataFrame(rows, "k long, h long"), "k").collect()}
    want = {}
    for a, x in rows:
        for b, y in rows:
            n = ((x ^ y) & ((1 << 64) - 1)).bit_count()
            if a < b and n <= 8:
                want[a, b] = min(n, want.get((a, b), 99))
    assert got == want and max(want.values()) == 8


def test_districts_in_two_passes(spark):
    dims = spark.createDataFrame([("A", 20.0, 75.0, 19.5, 20.5, 74.5, 75.5), ("B", 20.3, 75.3, 20.0, 20.6, 75.0, 75.6)], "district string, lat double, lng double, lo_lat double, hi_lat double, lo_lng double, hi_lng double")
    points = spark.createDataFrame([(1, 20.1, 75.1), (2, 20.25, 75.3), (3, 20.3, 75.8), (4, 20.3, 75.65), (5, 25.0, 75.0), (6, None, None)], "id long, lat double, lng double")
    got = {r.id: (r.district, r.how) for r in district_of(points, dims).collect()}
    assert got == {1: ("A", "box"), 2: ("B", "box"), 3: ("B", "far"), 4: ("B", "far")}


def test_places_named_by_texts(spark):
    names = spark.createDataFrame([("goa", "goa", "S1", 15.0, 74.0), ("panjim", "panjim", "S1", 15.2, 74.0), ("pune", "pune", "S2", 18.5, 73.8), ("nashik", "nashik", "S2", 20.0, 73.8)], "name string, k string, state string, lat double, lng double")
    texts = spark.createDataFrame([(1, "Flood in Pune!"), (2, "Goa, Panjim under water"), (3, "Pune and Nashik"), (4, "goa to pune"), (5, "nowhere"), (6, None)], "id long, t string")
    got = {r.id: (r.place, r.precision) for r in place_of_text(texts, names).collect()}
    assert got == {1: ("pune", "district"), 2: ("goa", "district"), 3: ("S2", "state"), 4: (None, "none"), 5: (None, "none"), 6: (None, "none")}


def test_hamming_pairs_meet_few_strangers(spark):
    """Bits that differ may lie anywhere; hashes that have nothing in common seldom share a key."""
    import random

    rng, rows = random.Random(3), []
    for i in range(0, 3000, 3):
        h = rng.getrandbits(64)
        for k, far in enumerate((0, 8, 9)):
            g = h
            for bit in rng.sample(range(64), far):
                g ^= 1 << bit
            rows.append((i + k, g - (1 << 64) if g >> 63 else g))
    got = hamming_pairs(spark.createDataFrame(rows, "k long, h long"), "k").collect()
    ones = lambda a, b: ((rows[a][1] ^ rows[b][1]) & (2**64 - 1)).bit_count()
    want = {(a, b): ones(a, b) for i in range(0, 3000, 3) for a in range(i, i + 3) for b in range(a + 1, i + 3) if ones(a, b) <= 8}
    assert {(r.a, r.b): r.bits for r in got} == want
    assert len(want) >= 1000


def test_similar_names_compare_names_not_parts(spark):
    """Copies of a name multiply pairs of parts, not comparisons; nulls and other blocks meet nobody."""
    from attestra.plans.scalars import similar_names

    rows = [(i, "red ring" if i % 2 else "red rinse", "B", "T") for i in range(20)] + [(20, None, "B", "T"), (21, "red ring", "C", "T"), (22, "", "B", "T"), (23, "", "B", "T")]
    found = similar_names(spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string"), 0.75)
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    assert got == {**{(a, b): 1.0 if (a - b) % 2 == 0 else 0.777778 for a in range(20) for b in range(a + 1, 20)}, (22, 23): 1.0}
    assert found._jdf.queryExecution().analyzed().toString().count("Deduplicate") + found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [p_brand") >= 2
