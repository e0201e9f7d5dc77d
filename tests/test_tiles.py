"""Tiles, campaigns and latest candidates against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from attestra.operators import campaigns, tiles
from attestra.operators.spatial import connected
from attestra.operators.tiles import components

GATES = {"water": (5.0, 6), "thermal": (25.0, 24)}


def plain(rows, gates):
    """Components by all pairs: {id: least id} of those that have company."""
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lat, lng = (np.array([r[k] for r in rows], float) for k in (2, 3))
    for i in range(n):
        for j in range(i):
            if rows[i][4] == rows[j][4] and rows[i][4] in gates:
                eps, hours = gates[rows[i][4]]
                if abs(rows[i][1] - rows[j][1]) <= hours * 3600 and tiles.haversine(lat, lng, np.array([i]), np.array([j]))[0] <= eps:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {m: min(g) for g in groups.values() if len(g) > 1 for m in g}


def crowd(n, seed, spread=0.6):
    rng = random.Random(seed)
    spots = [(rng.uniform(8, 36), rng.uniform(69, 96)) for _ in range(4)] + [(0.0, 0.0), (-33.0, -70.0)]
    out = []
    for i in range(n):
        y, x = rng.choice(spots)
        out.append((i * 7 % 1009, rng.randrange(0, 400_000), y + rng.gauss(0, spread), x + rng.gauss(0, spread), rng.choice(["water", "thermal", "other", None])))
    return out + [(2000 + i, 1000 + i, 20.0, 80.0, "water") for i in range(40)]


def test_links_join_up_to_the_components(spark):
    rows = crowd(500, 1)
    odd = [(3000, None, 20.0, 80.0, "water"), (3001, 5, None, 80.0, "water")]
    df = spark.createDataFrame(rows + odd, "id long, at_s long, lat double, lng double, family string")
    stars = tiles.links(df, GATES).cache()
    got = {r.node: r.root for r in connected(spark, stars).collect()}
    want = plain(rows, GATES)
    assert got == want and len(want) > 50
    assert stars.count() < 4 * len(rows)
    assert tiles.links(df.where("false"), GATES).count() == 0


def test_components_of_a_dense_tile():
    rng = np.random.default_rng(3)
    for n, spread in ((300, 0.05), (800, 0.01), (50, 1.0), (2, 0.001), (1, 1)):
        at, lat, lng = rng.integers(0, 100_000, n), 30 + spread * rng.normal(size=n), 75 + spread * rng.normal(size=n)
        i, j = np.triu_indices(n, 1)
        near = (tiles.haversine(lat, lng, i, j) <= 5) & (np.abs(at[i] - at[j]) <= 3600)
        want = tiles.united(np.arange(n), i[near], j[near])
        got = components(at, lat, lng, np.array([0, n]), np.array([5.0]), np.array([3600]))
        same = lambda r: [tuple(np.flatnonzero(r == v)) for v in sorted(set(r.tolist()))]
        assert sorted(same(got)) == sorted(same(want))


def test_components_of_many_groups_at_once():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 30, 200)
    starts = np.append(0, np.cumsum(sizes))
    n = starts[-1]
    middle = np.repeat(np.stack([rng.uniform(-40, 40, 200), rng.uniform(-100, 100, 200)]), sizes, axis=1)
    at, lat, lng = rng.integers(0, 50_000, n) + np.repeat(rng.integers(0, 10**9, 200), sizes), middle[0] + 0.05 * rng.normal(size=n), middle[1] + 0.05 * rng.normal(size=n)
    eps, seconds = rng.choice([2.0, 8.0], 200), rng.choice([3600, 20_000], 200)
    got = components(at, lat, lng, starts, eps, seconds)
    for g, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        i, j = np.triu_indices(b - a, 1)
        near = (tiles.haversine(lat[a:b], lng[a:b], i, j) <= eps[g]) & (np.abs(at[a + i] - at[a + j]) <= seconds[g])
        want = tiles.united(np.arange(b - a), i[near], j[near])
        assert len(np.unique(got[a:b])) == len(np.unique(want)) == len(set(zip(got[a:b].tolist(), want.tolist(), strict=True)))


def test_campaigns_match_brute_force(spark):
    rng = random.Random(2)
    texts = ["Water is rising near the old market, leave now!", "water IS rising near the old market leave now", "short text", None, "Another message that goes round the town today"]
    rows = [(i, rng.randrange(0, 100_000), rng.choice(["a", "b", "c", "d", None]), rng.choice(texts)) for i in range(900)] + [(1000 + i, 50_000 + 300 * i, f"r{i}", texts[4] + " again") for i in range(3)] + [(2000, None, "a", texts[0])]
    rows += [(3000 + i, 7_000_000 + 601 * i, f"r{i}", texts[0]) for i in range(5)] + [(4000 + i, 9_000_000, f"r{i}", texts[0]) for i in range(3)]
    got = sorted(r.id for r in campaigns.coordinated(spark.createDataFrame(rows, "id long, at_s long, reporter string, raw_text string")).collect())
    key = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = set()
    fine = [r for r in rows if r[1] is not None and len(key(r[3])) >= 30]
    for m in fine:
        span = [r for r in fine if key(r[3]) == key(m[3]) and m[1] - 600 <= r[1] <= m[1]]
        if len({r[2] or f"\0{r[0]}" for r in span}) >= 3:
            want |= {r[0] for r in span}
    assert got == sorted(want) and {1000, 4002} <= want and 3000 not in want


def test_a_copy_is_reduced_once(spark):
    got = spark.createDataFrame([(0.6, False), (0.6, True), (0.06, False), (0.33335, False)], "c double, already boolean").select(F.round(campaigns.halved(F.col("c"), F.col("already")), 6).alias("x")).collect()
    assert [r.x for r in got] == [0.3, 0.6, 0.05, 0.1667]


def test_connected_goes_on_with_fewer_edges(spark, monkeypatch):
    """Long chains, loops and stars give least members; edges whose ends have met are not read again."""
    import random

    from attestra.operators import spatial

    kept = []

    def noted(df, name):
        out = spatial_saved(df, name)
        if name == "edges":
            kept.append(out.count())
        return out

    spatial_saved = spatial.saved
    monkeypatch.setattr(spatial, "saved", noted)
    rng = random.Random(5)
    names = rng.sample(range(10**6), 400)
    chain = list(zip(names, names[1:], strict=False))
    pairs = [*chain, (2_000_000, 2_000_000), (3_000_002, 3_000_001), (3_000_001, 3_000_002)]
    got = {r.node: r.root for r in spatial.connected(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(names, min(names)), 2_000_000: 2_000_000, 3_000_001: 3_000_001, 3_000_002: 3_000_001}
    assert kept[-1] == 0 and all(after <= before / 2 for before, after in zip(kept, kept[1:], strict=False))
