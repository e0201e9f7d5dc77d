"""Reports linked in space and time by tiles: each tile's own components as stars, which join up through the reports that tiles share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH
from .spatial import DEGREE

#: A tile is so many radii wide and its slot so many look-backs long; a report stands in its own and in those it is near the edge of.
RADII, LOOKS = 8, 4
#: Pairs whose distance is taken at once.
PAIRS = 1 << 20


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """work(rows, starts) over whole groups, some at a time; starts has each group's first row and the end. Keys have no nulls; a group is held in memory."""

    def starts_of(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for key in keys:
            column = rows[key]
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.append(np.flatnonzero(new), rows.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[-1] for k in keys]
            if kept and [kept[0].column(k)[0] for k in keys] == last:
                kept.append(batch)  # still the one group that all of it belongs to
                continue
            rows = pa.Table.from_batches([*kept, batch]).combine_chunks()
            starts = starts_of(rows)
            if len(starts) > 2:
                yield from work(rows.slice(0, int(starts[-2])), starts[:-1]).to_batches()
            kept = rows.slice(int(starts[-2])).combine_chunks().to_batches()
        if kept:
            rows = pa.Table.from_batches(kept).combine_chunks()
            yield from work(rows, starts_of(rows)).to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: work in Python is dearer than its bytes tell
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _near(value: Column, reach: Column, width: Column) -> Column:
    return F.array_distinct(F.array(F.floor((value - reach) / width), F.floor((value + reach) / width)))


def tiled(points: DataFrame, eps: Column, hours: Column, most_lat: float = 40.0, least_km: float = 0.0, least_hours: float = 0.0) -> DataFrame:
    """Points (at_s, lat, lng) with ty, tx, slot: the tiles in which all are that lie within eps km and hours of them. Points without a place go.

    Tiles are least_km wide and slots least_hours long, or more by RADII and LOOKS.
    """
    side = F.greatest(eps * RADII, F.lit(float(least_km)))
    length = F.greatest(hours * LOOKS, F.lit(float(least_hours))) * 3600
    narrow = DEGREE * max(0.01, math.cos(math.radians(most_lat)))
    out = points.where("lat is not null and lng is not null and at_s is not null")
    for name, value, reach, width in (("ty", F.col("lat"), eps / DEGREE, side / DEGREE), ("tx", F.col("lng"), eps / narrow, side / narrow), ("slot", F.col("at_s"), hours * 3600, length)):
        out = out.withColumn(name, F.explode(_near(value, reach, width)))
    return out


def haversine(lat: np.ndarray, lng: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    h = np.sin((a[i] - a[j]) / 2) ** 2 + np.cos(a[i]) * np.cos(a[j]) * np.sin((b[i] - b[j]) / 2) ** 2
    return 2 * EARTH * np.arcsin(np.sqrt(np.minimum(h, 1)))


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each set after the pairs (i, j) were joined."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def components(at: np.ndarray, lat: np.ndarray, lng: np.ndarray, starts: np.ndarray, eps: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """For each point the first point of its component, where points of a group within its eps km and seconds are linked.

    starts has each group's first row and the end, eps and seconds a value a group; all groups are handled at once. Points of a cell
    of 0.7 eps are all neighbours, so there only successive ones in time are compared; between cells a point meets those of its
    time, except where both are in one component already.
    """
    n = len(at)
    root = np.arange(n)
    if n < 2:
        return root
    size = np.diff(starts)
    group = np.repeat(np.arange(len(size)), size)
    each = lambda f, v: np.repeat(f.reduceat(v, starts[:-1]), size)
    cosine = lambda v: np.cos(np.radians(np.minimum(89.0, v)))
    widest, narrowest = cosine(each(np.minimum, np.abs(lat))), cosine(each(np.maximum, np.abs(lat)))
    eps, seconds = eps[group], seconds[group].astype(np.int64)
    tall = 0.7 * eps / DEGREE
    y, x = np.floor(lat / tall).astype(np.int64), np.floor(lng / (tall / widest)).astype(np.int64)
    t = at.astype(np.int64) - each(np.minimum, at.astype(np.int64))
    y, x = y - each(np.minimum, y), x - each(np.minimum, x)
    reach = math.ceil(1.43 * float((widest / narrowest).max()))
    stride, height, span = int(x.max()) + 2 * reach + 1, int(y.max()) + 3, int(t.max()) + 2 * int(seconds.max()) + 2
    cell = (group * height + y) * stride + x + reach
    order = np.lexsort((t, cell))
    t, c, within = t[order], cell[order], seconds[order]
    close = (c[1:] == c[:-1]) & (t[1:] - t[:-1] <= within[1:])
    i, j = order[:-1][close], order[1:][close]
    ok = haversine(lat, lng, i, j) <= eps[i]
    root = united(root, i[ok], j[ok])
    key = c * span + t + int(seconds.max())
    for dy in range(0, 3):
        for dx in range(-reach, reach + 1):
            if dy == 0 and dx <= 0:
                continue
            there = key + (dy * stride + dx) * span
            lo, hi = np.searchsorted(key, there - within, "left"), np.searchsorted(key, there + within, "right")
            many = hi - lo
            total, first = np.cumsum(many), 0
            if not total[-1]:
                continue
            while first < n:
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
                m = many[first:last]
                a = np.repeat(np.arange(first, last), m)
                b = lo[a] + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
                i, j = order[a], order[b]
                new = (root[i] != root[j]) & (group[i] == group[j])
                i, j = i[new], j[new]
                ok = haversine(lat, lng, i, j) <= eps[i]
                root = united(root, i[ok], j[ok])
                first = last
    return root


def star(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least id of its component) of every point that is not the least itself."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    top = least[root]
    apart = ids != top
    return ids[apart], top[apart]


def links(points: DataFrame, gates: dict[str, tuple[float, float]] | None, most_lat: float = 40.0, default: tuple[float, float] | None = None) -> DataFrame:
    """a, b: stars that link the reports (id, at_s, lat, lng, family) that lie within their family's gate (km, hours) of each other, directly or over others.

    Families without a gate have the default one; without a default they take no part, nor do reports without a family.
    """
    one = lambda v: F.array(F.lit(float(v[0])), F.lit(float(v[1])))
    named = F.try_element_at(F.create_map(*(c for k, v in gates.items() for c in (F.lit(k), one(v)))), F.col("family")) if gates else None
    gate = named if default is None else F.coalesce(named, one(default)) if named is not None else one(default)
    known = points.where(F.col("family").isNotNull()).select("id", "at_s", "lat", "lng", "family", gate.alias("gate")).where("gate is not null")
    of = gates or {}

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        many = np.diff(starts) > 1  # the others have no company
        keep = np.repeat(many, np.diff(starts))
        rows, starts = rows.filter(pa.array(keep)), np.append(0, np.cumsum(np.diff(starts)[many]))
        id_, at, lat, lng = (rows[c].to_numpy() for c in ("id", "at_s", "lat", "lng"))
        own = [of.get(f, default) for f in rows["family"].take(pa.array(starts[:-1])).to_pylist()]
        root = components(at, lat, lng, starts, np.array([g[0] for g in own], float), np.array([g[1] * 3600 for g in own], float))
        a, b = star(id_, root)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = tiled(known, F.col("gate")[0], F.col("gate")[1], most_lat).select("family", "ty", "tx", "slot", F.col("id").cast("bigint").alias("id"), F.col("at_s").cast("bigint").alias("at_s"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    return by_groups(dealt, ["family", "ty", "tx", "slot"], work, "a bigint, b bigint")
