"""Triangulation, concave hull and widening against brute force and known areas."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import footprints as fp
from attestra.operators.shapes import corners, inside

M = fp.DEGREE_M


def _area(ring):
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _metres2(ring):
    return _area(ring * [M * math.cos(math.radians(float(ring[:, 1].min() + ring[:, 1].max()) / 2)), M])


def _to_edge(p, ring):
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    t = np.clip(((p - a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return np.linalg.norm(a + t[:, None] * d - p, axis=1).min()


def _corners(third):
    """Each triangle once, from the edge that starts at its least corner."""
    return [(s, e, t) for (s, e), t in third.items() if s < e and s < t]


@pytest.mark.parametrize("points", [
    np.random.default_rng(1).integers(0, 1000, (40, 2)),
    np.array(list(itertools.product(range(5), range(4)))),
    np.array([(0, 0), (10, 0), (20, 0), (30, 0), (15, 7)]),
    np.random.default_rng(2).integers(0, 6, (60, 2)),
    np.array([(0, 0), (0, 1), (0, 2), (0, 3), (5, 1), (5, 2), (9, -4)]),
])
def test_triangles_have_empty_circles_and_cover_the_hull(points):
    p = [(x, y) for x, y in np.unique(points, axis=0).tolist()]
    tri = _corners(fp.triangles(p))
    twice = [fp._turn(*(p[i] for i in t)) for t in tri]
    assert min(twice) > 0
    grid = np.array(p, float)
    assert sum(twice) == round(2 * _area(grid[corners(grid)]))
    assert not any(fp._in_circle(*(p[i] for i in t), q) for q in p for t in tri)


def test_points_on_a_line_have_no_triangles():
    assert len(fp.triangles([(0, 0), (1, 1), (2, 2)])) == 0
    line = np.array([[75.0, 20.0], [75.2, 20.0], [75.1, 20.0]])
    assert sorted(fp.concave(line).tolist()) == [0, 1]


def _shape(cells):
    return np.array([(75 + x * 0.01, 20 + y * 0.01) for x, y in cells])


L = [(x, y) for x in range(12) for y in range(12) if x < 3 or y < 3]
U = [(x, y) for x in range(12) for y in range(12) if x < 3 or x > 8 or y < 3]


@pytest.mark.parametrize("cells", [L, U])
def test_concave_follows_the_shape(cells):
    p = _shape(cells)
    ring = p[fp.concave(p, 0.1)]
    assert 0 < _area(ring) < 0.85 * _area(p[corners(p)])
    assert all(inside(p[i : i + 1, 0], p[i : i + 1, 1], ring)[0] or _to_edge(p[i], ring) < 1e-9 for i in range(len(p)))
    assert not inside(np.array([75.07]), np.array([20.07]), ring)[0]


def test_concave_is_what_the_rule_says_on_random_points():
    """Against a plain version: while any outer edge is over the limit, drop the longest whose triangle has its third corner inside."""
    for seed in range(20):
        p = np.random.default_rng(seed).integers(0, 40, (30, 2)) / 1000 + [75, 20]
        got = p[fp.concave(p, 0.3)]
        grid = np.unique(np.round(p * fp.STEPS).astype(np.int64), axis=0)
        left = {tuple(sorted(t)) for t in _corners(fp.triangles([(x, y) for x, y in grid.tolist()]))}
        size = lambda e: math.dist(grid[e[0]], grid[e[1]])  # noqa: B023, E731
        edges = {e for t in left for e in itertools.combinations(t, 2)}
        limit = min(map(size, edges)) + 0.3 * (max(map(size, edges)) - min(map(size, edges)))
        while True:
            outer = [e for e in edges if sum(set(e) <= set(t) for t in left) == 1]
            on = {v for e in outer for v in e}
            loose = [(size(e), t) for e in outer for t in left if set(e) <= set(t) and not (set(t) - set(e)) & on and size(e) > limit]
            if not loose:
                break
            left.discard(max(loose)[1])
        area = sum(abs(fp._turn(*grid[list(t)].tolist())) for t in left) / 2 / fp.STEPS**2
        # points on one circle may be triangulated in two ways, and equal edges may go in either order: a triangle more or less
        assert _area(got) == pytest.approx(area, rel=0.05), seed


def test_known_areas():
    one = fp.footprint(np.array([[85.1, 25.6]]))
    assert _metres2(one) == pytest.approx(math.pi * 250**2, rel=0.03)
    two = fp.footprint(np.array([[85.1, 25.6], [85.1, 25.6 + 1000 / M]]))
    assert _metres2(two) == pytest.approx(2 * 250 * 1000 + math.pi * 250**2, rel=0.03)
    same = fp.footprint(np.array([[85.1, 25.6]] * 4))
    assert _metres2(same) == pytest.approx(_metres2(one), rel=1e-6)


@pytest.mark.parametrize("cells", [L, U])
def test_a_widened_shape_holds_its_points_and_keeps_its_distance(cells):
    p = _shape(cells)
    core = p[fp.concave(p, 0.1)]
    scale = np.array([M * math.cos(math.radians(float(core[:, 1].min() + core[:, 1].max()) / 2)), M])
    ring = fp.footprint(p, of=lambda x: fp.concave(x, 0.1))
    assert inside(p[:, 0], p[:, 1], ring).all()
    far = [_to_edge(q, core * scale) for q in ring * scale]
    assert 245 < min(far) and max(far) < 250.1
    assert _metres2(ring) > _metres2(core)


def test_a_narrow_bay_closes_over_to_one_ring():
    """A U whose arms stand 300 m apart: widened by 250 m they meet, and the outer ring has no trace of the bay's inside."""
    gap = 300 / M
    u = np.array([(0, 0), (3, 0), (3, 10), (2, 10), (2, 1), (1, 1), (1, 10), (0, 10)], float) * gap + [75, 0]
    ring = fp.footprint(u, of=lambda x: np.arange(len(x)))
    assert _metres2(ring) == pytest.approx((900 + 500) * (3000 + 500) - (4 - math.pi) * 250**2 - 2e3, rel=0.02)
    assert inside(u[:, 0], u[:, 1], ring).all()


def test_footprints_of_keys(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = {1: rng.normal([80, 20], 0.01, (80, 2)), 2: np.array([[75.0, 20.0]] * 5), 3: _shape(L), 4: np.array([[70.0, 9.0], [70.01, 9.0]])}
    rows = [(k, float(x), float(y), "x") for k, ps in sets.items() for x, y in ps] + [(None, 1.0, 1.0, "x"), (1, None, 2.0, "x")]
    df = spark.createDataFrame(rows, "cluster bigint, lng double, lat double, ring string").repartition(5)
    got = {r.cluster: (r.concave, np.array([(q.lng, q.lat) for q in r.ring])) for r in fp.footprints(df, "cluster").collect()}
    assert set(got) == set(sets)
    for k, ps in sets.items():
        ps = np.unique(ps, axis=0)
        assert got[k][0] and np.allclose(got[k][1], fp.footprint(ps)), k
        assert inside(ps[:, 0], ps[:, 1], got[k][1]).all()
    monkeypatch.setattr(fp, "MOST", 50)
    over = {r.cluster: r.concave for r in fp.footprints(df, "cluster").collect()}
    assert over == {1: False, 2: True, 3: len(L) <= 50, 4: True}
    assert fp.footprints(df.where("false"), "cluster").count() == 0


def test_a_large_group_gets_the_same_hull_by_tiles(spark, monkeypatch):
    """The hull does not hang on the number of positions: by tiles it is, corner by corner, that of the whole; circles through many points included."""
    rng = np.random.default_rng(6)
    spread = rng.normal([80, 20], 0.05, (2500, 2))
    town = np.concatenate([rng.normal([75, 15], 0.002, (1500, 2)), rng.uniform([74, 14], [76, 16], (300, 2))])
    arm = np.array([(70 + x / 4000, 10 + y / 4000) for x in range(60) for y in range(60) if x < 12 or y < 12])
    line = np.array([(85 + i / 1000, 25.0) for i in range(400)])
    road = np.concatenate([line + [1, 0], [[86.2, 25.4], [86.1, 24.9]]])
    sets = {k: np.unique(np.round(ps * fp.STEPS), axis=0) / fp.STEPS for k, ps in enumerate((spread, town, arm, line, road, _shape(U)))}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ps in sets.items() for x, y in ps], "cluster bigint, lng double, lat double").repartition(7)
    monkeypatch.setattr(fp, "WHOLE", 100)
    got = {r.cluster: (r.concave, np.array([(q.lng, q.lat) for q in r.ring])) for r in fp.footprints(df, "cluster").collect()}
    for ratio in (0.8, 0.1):
        positions = df.select("cluster", *((F.rint(F.col(c) * fp.STEPS)).cast("bigint").alias(n) for c, n in (("lng", "x"), ("lat", "y"))))
        corners_of = {}
        for r in fp.concave_by_tiles(positions, "cluster", ratio).orderBy("cluster", "place").collect():
            corners_of.setdefault(r.cluster, []).append((r.x, r.y))
        for k, ps in sets.items():
            assert corners_of[k] == [tuple(q) for q in np.round(ps[fp.concave(ps, ratio)] * fp.STEPS).astype(int).tolist()], (ratio, k)
    for k, ps in sets.items():
        assert got[k][0] and np.allclose(got[k][1], fp.footprint(ps), rtol=0, atol=1e-9), k


def test_over_four_thousand_positions_are_no_convex_hull(spark):
    arm = np.array([(70 + x / 1000, 10 + y / 1000) for x in range(150) for y in range(150) if x < 16 or y < 16])
    assert len(arm) > 4096
    (r,) = fp.footprints(spark.createDataFrame([(1, float(x), float(y)) for x, y in arm], "cluster bigint, lng double, lat double"), "cluster").collect()
    ring = np.array([(q.lng, q.lat) for q in r.ring])
    assert r.concave and np.allclose(ring, fp.footprint(np.round(arm * fp.STEPS) / fp.STEPS), rtol=0, atol=1e-9)
