"""Pins merged in rounds against one pass in order."""

import math

import numpy as np
import pytest

from attestra.operators.pins import MOST_LAT, WORLD, leaders


def _brute(rows, zoom, radius):
    size = WORLD * 2**zoom
    at = {}
    for i, lat, lng in rows:
        if lat is not None and lng is not None and not math.isnan(lat):
            a = math.radians(max(-MOST_LAT, min(MOST_LAT, lat)))
            at[i] = ((lng + 180) / 360 * size, (0.5 - math.log(math.tan(math.pi / 4 + a / 2)) / (2 * math.pi)) * size)
    leads, out = [], {}
    for i in sorted(r[0] for r in rows):
        if i not in at:
            out[i] = i
            continue
        x, y = at[i]
        out[i] = next((k for k in leads if (at[k][0] - x) ** 2 + (at[k][1] - y) ** 2 < radius * radius), i)
        if out[i] == i:
            leads.append(i)
    return out


@pytest.mark.parametrize("zoom, radius, spread", [(3.0, 44.0, 12.0), (6.2, 28.0, 0.5)])
def test_rounds_equal_one_pass(spark, zoom, radius, spread):
    rng = np.random.default_rng(int(zoom * 10))
    spots = rng.normal([22, 80], spread, (250, 2)).round(3).tolist()
    spots += spots[:60]  # equal places
    rows = [(int(i), *p) for i, p in zip(rng.permutation(len(spots)), spots, strict=True)]
    rows += [(1000, None, 80.0), (1001, 20.0, None), (1002, 89.9, 80.0), (1003, float("nan"), 80.0)]
    df = spark.createDataFrame([(*r, "a") for r in rows], "id bigint, lat double, lng double, leader string").repartition(6)
    got = {r.id: r.leader for r in leaders(df, zoom, radius).collect()}
    assert got == _brute(rows, zoom, radius)


def test_a_chain_in_order_takes_a_round_for_each_leader(spark):
    rows = [(i, 20.0, 70.0 + i * 0.6) for i in range(14)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lng double")
    got = {r.id: r.leader for r in leaders(df, 5.0, 36.0).collect()}
    want = _brute(rows, 5.0, 36.0)
    assert got == want and len(set(want.values())) < 14


def test_no_pins(spark):
    assert leaders(spark.createDataFrame([], "id bigint, lat double, lng double"), 5.0, 36.0).count() == 0
