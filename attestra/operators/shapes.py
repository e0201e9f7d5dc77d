"""Hulls and polygon tests. Rings are arrays of (lng, lat)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.geo import EARTH
from ..sources.tables import saved
from .tiles import by_groups

#: Metres by which an outline is widened, and corners of the circle that stands for it.
BUFFER_M, CORNERS = 250.0, 16
#: Parts into which a key's corners are dealt before they meet.
PARTS = 64
#: Points of a key that meet in one task as they are, and points that are compared in pairs without looking for corners first.
FEW, PAIRWISE = 4096, 64
#: Points whose cosine to their middle falls below this are not projected; all of them are kept then.
LEAST_COS = 0.8


def corners(points: np.ndarray) -> np.ndarray:
    """The rows of the convex hull's corners, counter-clockwise from the leftmost, without repeats."""
    p, at = np.unique(points, axis=0, return_index=True)
    if len(p) < 3:
        return at
    halves: list[int] = []
    for order in (range(len(p)), range(len(p) - 1, -1, -1)):
        out: list[int] = []
        for i in order:
            q = p[i]
            while len(out) > 1 and (p[out[-1]][0] - p[out[-2]][0]) * (q[1] - p[out[-2]][1]) - (p[out[-1]][1] - p[out[-2]][1]) * (q[0] - p[out[-2]][0]) <= 0:
                out.pop()
            out.append(i)
        halves += out[:-1]
    return at[halves]


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points, counter-clockwise from the leftmost, without repeats."""
    return points[corners(points)]


def vectors(points: np.ndarray) -> np.ndarray:
    """Unit vectors of (lng, lat) in degrees."""
    lng, lat = np.radians(points[:, 0]), np.radians(points[:, 1])
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)


def corners_on_sphere(points: np.ndarray) -> np.ndarray:
    """The rows of the corners of the hull by great circles, which the central projection about the points' middle makes straight.

    A farthest pair of a region smaller than a quarter of the sphere consists of such corners. Points spread wider are all kept.
    """
    v = vectors(points)
    middle = v.sum(axis=0)
    middle /= max(np.linalg.norm(middle), 1e-300)
    up = v @ middle
    if len(points) < 3 or up.min() < LEAST_COS:
        return np.unique(points, axis=0, return_index=True)[1]
    east = np.cross(middle, np.eye(3)[np.abs(middle).argmin()])
    east /= np.linalg.norm(east)
    return corners(np.stack([v @ east, v @ np.cross(middle, east)], axis=1) / up[:, None])


def hull_points(members: DataFrame, key: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, lng, lat of points among which are all that `of` keeps of each key's points; a few for each key, however many it has.

    Each batch keeps the corners of its own points before the shuffle, each part of a key after it, so no task holds a whole group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = [at[of(rows[["lng", "lat"]].to_numpy(float)[at])] if len(at) > 2 else at for at in rows.groupby(key, sort=False).indices.values()]
            yield rows.iloc[np.concatenate(keep)] if keep else rows

    points = members.select(key, "lng", "lat").where(F.col(key).isNotNull() & F.col("lng").isNotNull() & F.col("lat").isNotNull())
    part = F.pmod(F.xxhash64("lng", "lat"), F.lit(PARTS))
    first = points.mapInPandas(run, points.schema)
    return first.repartition(F.col(key), part).mapInPandas(run, points.schema)


def widest(members: DataFrame, key: str) -> DataFrame:
    """key and widest, the greatest great-circle distance in km between two of its points (lng, lat).

    A key with more than FEW points keeps the corners of its parts' hulls before its points meet, so that no task holds a whole
    large group; of what is left, corners are compared in pairs.
    """

    def farthest(points: np.ndarray) -> float:
        if len(points) > PAIRWISE:
            points = points[corners_on_sphere(points)]
        lng, lat = np.radians(points[:, 0]), np.radians(points[:, 1])
        most = 0.0
        for first in range(0, len(points), PAIRWISE):  # some rows at a time, so that memory stays in proportion to the corners
            y, x = lat[first : first + PAIRWISE, None], lng[first : first + PAIRWISE, None]
            a = np.sin((lat - y) / 2) ** 2 + np.cos(lat) * np.cos(y) * np.sin((lng - x) / 2) ** 2
            most = max(most, float(a.max()))
        return 2 * EARTH * np.arcsin(np.sqrt(min(1.0, most)))

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        points = np.column_stack([rows["lng"].to_numpy(), rows["lat"].to_numpy()]).astype(float)
        return pa.table({key: rows[key].take(pa.array(starts[:-1])), "widest": pa.array([farthest(points[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.float64())})

    points = members.select(key, "lng", "lat").where(F.col(key).isNotNull() & F.col("lng").isNotNull() & F.col("lat").isNotNull())
    large = saved(points.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(key), "large")
    schema = f"{key} {members.schema[key].dataType.simpleString()}, widest double"
    if large.isEmpty():
        return by_groups(points, [key], work, schema)
    few = points.join(large, key, "left_anti").unionByName(hull_points(points.join(large, key, "left_semi"), key, corners_on_sphere))
    return by_groups(few, [key], work, schema)


def outline(points: np.ndarray, metres: float = BUFFER_M) -> np.ndarray:
    """The hull widened by about `metres`: the hull of a small polygon around each corner."""
    angle = np.arange(CORNERS) * 2 * np.pi / CORNERS
    core = hull(points)
    up = metres / 111_195.0
    wide = up / np.maximum(0.01, np.cos(np.radians(core[:, 1])))
    around = np.stack([core[:, :1] + wide[:, None] * np.cos(angle), core[:, 1:] + up * np.sin(angle)], axis=2)
    return hull(around.reshape(-1, 2))


def outlines(members: DataFrame, key: str) -> DataFrame:
    """key and ring of the outline of each key's points (lng, lat), made from the corners of its parts."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ring = outline(rows[["lng", "lat"]].to_numpy(float))
        return pd.DataFrame({key: [rows[key].iloc[0]], "ring": [[{"lng": float(x), "lat": float(y)} for x, y in ring]]})

    kind = members.schema[key].dataType.simpleString()
    return hull_points(members, key, corners).groupBy(key).applyInPandas(one, f"{key} {kind}, ring array<struct<lng: double, lat: double>>")


def inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie in a ring, by counting crossings."""
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        crosses = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def rings_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two rings share a point: a corner of one in the other, or crossing edges."""
    if inside(a[:1, 0], a[:1, 1], b)[0] or inside(b[:1, 0], b[:1, 1], a)[0]:
        return True
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    p, q = a[:, None], np.roll(a, -1, axis=0)[:, None]
    r, s = b[None], np.roll(b, -1, axis=0)[None]
    return bool(((side(p, q, r) != side(p, q, s)) & (side(r, s, p) != side(r, s, q))).any())


@F.pandas_udf(BooleanType())
def meet(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """rings_meet over two ring columns; false for null or fewer than three corners."""
    flat = lambda ring: np.array([[p["lng"], p["lat"]] for p in ring], float) if ring is not None and len(ring) > 2 else None
    for x, y in parts:
        pairs = [(flat(a), flat(b)) for a, b in zip(x, y, strict=True)]
        yield pd.Series([a is not None and b is not None and rings_meet(a, b) for a, b in pairs])


def intersecting(left: DataFrame, right: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Pairs of left rows (id, ring) and right rows (other, ring) whose rings meet, with the other columns of both; their names differ.

    Both sides stand in every grid cell that their boxes touch, so only neighbours are compared; a pair is looked at in the cell of
    the lower left corner of what its boxes share, so once. Rings that are boxes themselves meet if their boxes do; for others
    the rings are fetched and tested exactly.
    """
    bounds = ("low_lat", "high_lat", "low_lng", "high_lng")

    def boxed(df: DataFrame, side: str) -> DataFrame:
        least = lambda f: F.array_min(F.transform("ring", lambda p: p[f]))
        most = lambda f: F.array_max(F.transform("ring", lambda p: p[f]))
        same = lambda f, i, j: F.get("ring", F.lit(i))[f] == F.get("ring", F.lit(j))[f]
        around = lambda f, g: same(f, 0, 1) & same(g, 1, 2) & same(f, 2, 3) & same(g, 3, 0)
        box = (F.size("ring") == 4) & (around("lat", "lng") | around("lng", "lat"))
        df = df.where(F.size("ring") > 2).withColumns({f"{side}_{name}": v for name, v in zip(bounds, (least("lat"), most("lat"), least("lng"), most("lng")), strict=True)})
        return df.withColumn(f"{side}_box", F.coalesce(box, F.lit(False)) & (F.col(f"{side}_low_lat") < F.col(f"{side}_high_lat")) & (F.col(f"{side}_low_lng") < F.col(f"{side}_high_lng")))

    def celled(df: DataFrame, side: str) -> DataFrame:
        upto = lambda f: F.explode(F.sequence(F.floor(F.col(f"{side}_low_{f}") / degrees), F.floor(F.col(f"{side}_high_{f}") / degrees)))
        return df.drop("ring").withColumn("cy", upto("lat")).withColumn("cx", upto("lng"))

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        both = celled(a, "a").join(celled(b, "b"), ["cy", "cx"])
        for f, cell in (("lat", "cy"), ("lng", "cx")):
            both = both.where((F.col(f"a_low_{f}") <= F.col(f"b_high_{f}")) & (F.col(f"b_low_{f}") <= F.col(f"a_high_{f}")) & (F.floor(F.greatest(f"a_low_{f}", f"b_low_{f}") / degrees) == F.col(cell)))
        return both

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: a small file may meet many
    a, b = boxed(left.repartition(parts), "a"), boxed(right, "b")
    columns = [*(c for c in left.columns if c != "ring"), *(c for c in right.columns if c != "ring")]
    boxes = near(a.where("a_box"), b.where("b_box")).select(columns)
    others = near(a.where("not a_box"), b).select("id", "other").unionByName(near(a.where("a_box"), b.where("not b_box")).select("id", "other")).distinct()
    both = others.join(a, "id").join(b.withColumnRenamed("ring", "ring_b"), "other").where("not (a_box and b_box)")
    return boxes.unionByName(both.where(meet("ring", "ring_b")).select(columns))
