"""The hull reduction against all points and all pairs."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attestra.functions.geo import EARTH
from attestra.operators import shapes


def _brute(points):
    v = shapes.vectors(np.array(points, float))
    return 2 * EARTH * np.arcsin(min(1.0, max(np.linalg.norm(a - b) for a in v for b in v) / 2))


def _sets():
    rng = np.random.default_rng(7)
    near = (np.round(rng.normal([80, 20], [0.3, 0.2], (400, 2)), 3)).tolist()
    line = [[75.0, float(x)] for x in np.linspace(10, 11, 30)]
    wide = np.stack([rng.uniform(-180, 180, 60), rng.uniform(-80, 80, 60)], axis=1).tolist()
    return {1: near + near[:50], 2: line, 3: wide, 4: [[70.0, 9.0]] * 5, 5: [[70.0, 9.0], [70.5, 9.5]], 6: [[179.9, 1.0], [-179.9, 1.2], [179.5, -1.0], [-179.7, 0.3], [180.0, 0.1]]}


def _frame(spark, sets):
    rows = [(k, float(x), float(y), i) for k, points in sets.items() for i, (x, y) in enumerate(points)]
    rows += [(None, 1.0, 1.0, 0), (1, None, 2.0, 0), (2, 3.0, None, 0)]
    return spark.createDataFrame(rows, "cluster bigint, lng double, lat double, more int").repartition(7)


def test_widest_matches_all_pairs(spark):
    sets = _sets()
    got = {r.cluster: r.widest for r in shapes.widest(_frame(spark, sets), "cluster").collect()}
    assert set(got) == set(sets)
    for k, points in sets.items():
        assert abs(got[k] - _brute(points)) < 1e-4, k


def test_outlines_are_those_of_all_points(spark):
    sets = {k: v for k, v in _sets().items() if k in (1, 2, 4, 5)}
    got = {r.cluster: [(p.lng, p.lat) for p in r.ring] for r in shapes.outlines(_frame(spark, sets), "cluster").collect()}
    for k, points in sets.items():
        assert np.allclose(got[k], shapes.outline(np.array(points, float))), k


def test_no_rows(spark):
    empty = _frame(spark, {1: []}).where("false")
    assert shapes.widest(empty, "cluster").count() == 0
    assert shapes.outlines(empty, "cluster").count() == 0


def test_squares_that_touch_meet(spark):
    """Middles 0.55 degrees apart as doubles: they meet where the difference as a double says so, whatever the corners are rounded to."""
    from attestra.plans.advisory import squares_meet

    at = [(8000 + k * 37) / 1e3 for k in range(700)]
    left = [(i, y, 70.0) for i, y in enumerate(at)]
    right = [(i, (8000 + i * 37 + d) / 1e3, 70.25) for i, d in zip(range(700), (550, -550) * 350, strict=True)]
    got = squares_meet(spark.createDataFrame(left, "id long, lat double, lng double"), spark.createDataFrame(right, "other long, lat double, lng double"), 0.3, 0.25)
    assert {(r.id, r.other) for r in got.where("id = other").collect()} == {(i, i) for i in range(700) if abs(left[i][1] - right[i][1]) <= 0.55}


def test_boxes_meet_without_python_and_other_rings_by_the_exact_test(spark, monkeypatch):
    """rings that are boxes are decided by their bounds, whatever cells they share; other rings, and such with boxes, as rings_meet says. A pair comes once, with the other columns."""
    rng = random.Random(3)
    ring = lambda points: [{"lng": float(x), "lat": float(y)} for x, y in points]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    spin = lambda x, y, r, n: [(x + r * math.cos(0.3 + 2 * math.pi * i / n), y + r * math.sin(0.3 + 2 * math.pi * i / n)) for i in range(n)]
    some = lambda n: [box(rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0.1, 3), rng.uniform(0.1, 3)) if i % 2 else spin(rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0.1, 1.5), 3 + i % 4) for i in range(n)]
    left, right = some(60), some(50)
    kind = "ring array<struct<lng: double, lat: double>>"
    a = spark.createDataFrame([(i, f"l{i}", ring(p)) for i, p in enumerate(left)] + [(900, "", None), (901, "", ring([(1, 1), (2, 2)]))], f"id long, said string, {kind}")
    b = spark.createDataFrame([(i, i + 0.5, ring(p)) for i, p in enumerate(right)], f"other long, more double, {kind}")
    want = sorted((i, f"l{i}", j, j + 0.5) for i, p in enumerate(left) for j, q in enumerate(right) if shapes.rings_meet(np.array(p), np.array(q)))
    got = shapes.intersecting(a, b)
    assert sorted(tuple(r) for r in got.select("id", "said", "other", "more").collect()) == want and len(want) > 200

    @F.pandas_udf("boolean")
    def refused(x: pd.Series, y: pd.Series) -> pd.Series:
        raise AssertionError("boxes were sent to Python")

    monkeypatch.setattr(shapes, "meet", refused)
    odd = "id % 2 = 1 and id < 900"
    assert shapes.intersecting(a.where(odd), b.where("other % 2 = 1")).count() == sum(1 for i, _, j, _ in want if i % 2 and j % 2)
