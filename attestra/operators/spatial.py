"""Radius joins, nearest neighbours and density clusters over a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH, haversine
from ..sources.tables import saved

#: km of a degree of latitude.
DEGREE = math.pi * EARTH / 180


def _keyed(points: DataFrame, km: float, spread: bool, most_lat: float, ahead: bool = False) -> DataFrame:
    """A grid cell for each point, and all nine around it if spread; if ahead only its own and the four after it. Cells are as wide as the radius at the latitude furthest from the equator."""
    tall = km / DEGREE
    wide = tall / max(0.01, math.cos(math.radians(min(89.0, most_lat + tall))))
    y, x = F.floor(F.col("lat") / tall), F.floor(F.col("lng") / wide)
    if not spread:
        return points.withColumn("cy", y).withColumn("cx", x)
    near = F.array(*(F.struct((y + i).alias("cy"), (x + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1) if not ahead or (i, j) >= (0, 0)))
    return points.withColumn("__c", F.explode(near)).select("*", "__c.cy", "__c.cx").drop("__c")


def radius_join(left: DataFrame, right: DataFrame, km: float, most_lat: float = 60.0, how: str = "inner", radius: float = EARTH, spread_right: bool = False, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within km with equal columns of `same`: columns of left (with lat, lng) and those of right prefixed r_, and km.

    One side stands in its own cell and the other, the left one or if spread_right the right one (name the smaller), in nine, so
    Spark sees an equi-join and only neighbours are compared. Points without coordinates meet nobody. most_lat bounds the latitudes of the data.
    """
    r = _keyed(right.where("lat is not null and lng is not null"), km, spread_right, most_lat)
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.col("cy").alias("__ry"), F.col("cx").alias("__rx"))
    meet = (F.col("cy") == F.col("__ry")) & (F.col("cx") == F.col("__rx"))
    for c in same:
        meet &= F.col(c) == F.col(f"r_{c}")
    pairs = _keyed(left, km, not spread_right, most_lat).join(r, meet, how)
    out = pairs.withColumn("km", haversine(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"), radius)).where(F.col("km") <= km)
    return out.drop("cy", "cx", "__ry", "__rx")


def radius_pairs(points: DataFrame, name: str, km: float, most_lat: float = 60.0) -> DataFrame:
    """Every two points within km of each other once, in either order, and each point with itself: columns of the one, those of the other prefixed r_, and km, same (whether it is one point).

    As radius_join, but a point stands in its own cell and the four after it only; within a cell the order (name, lat, lng) decides.
    """
    known = points.where("lat is not null and lng is not null")
    own = _keyed(known, km, False, most_lat).select(*(F.col(c).alias(f"r_{c}") for c in points.columns), F.col("cy").alias("__ry"), F.col("cx").alias("__rx"))
    home = _keyed(known, km, False, most_lat).withColumnsRenamed({"cy": "__y", "cx": "__x"})
    pairs = _keyed(home, km, True, most_lat, ahead=True).join(own, (F.col("cy") == F.col("__ry")) & (F.col("cx") == F.col("__rx")))
    order = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in (name, "lat", "lng")))
    there = (F.col("cy") == F.col("__y")) & (F.col("cx") == F.col("__x"))
    out = pairs.where(~there | (order("") <= order("r_"))).withColumn("km", haversine(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))).where(F.col("km") <= km)
    return out.withColumn("same", order("") == order("r_")).drop("cy", "cx", "__ry", "__rx", "__y", "__x")


def outreaching(right: DataFrame, name: str, reach: str, same: tuple[str, ...] = ()) -> DataFrame:
    """The rows (lat, lng, name, reach and the columns of `same`) that no other at their spot and of their kind stands before: with a
    smaller name and no smaller reach. Whatever such a row reaches, the other reaches first."""
    kind = ["lat", "lng", *same]
    least = right.groupBy(*kind, reach).agg(F.min(name).alias(name))
    before = F.max(reach).over(Window.partitionBy(*kind).orderBy(name, F.desc(reach)).rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(reach) > F.col("__before"))).select(*right.columns)


#: Right rows that a cell of the first ring has on average.
FEW = 2


def rings(right: DataFrame, km: float, most_lat: float) -> list[float]:
    """Growing radii up to km: the more right rows a cell of km has, as such a row sees it, the smaller is the first."""
    n = _keyed(right.where("lat is not null and lng is not null"), km, False, most_lat).groupBy("cy", "cx").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0
    steps = math.ceil(math.log(seen / FEW, 16)) if seen > FEW else 0
    return [km / 4**step for step in range(min(steps, 8), -1, -1)]


def nearest(left: DataFrame, right: DataFrame, key: str, km: float, within: Column | None = None, most_lat: float = 60.0, spread_right: bool = False) -> DataFrame:
    """Of each left row (named by key) the nearest right row within km and `within`; ties go to the smaller r_ columns. No row without one.

    Rows look within a small radius first, and only those that found none within a larger one, so that crowds are not compared in
    pairs. The right rows of one spot all count: leave out those that can't win (outreaching).
    """
    right = saved(right, "right")
    rest = left.select(key, "lat", "lng", *[c for c in left.columns if c not in (key, "lat", "lng")]).where("lat is not null and lng is not null")
    out = None
    for ring in rings(right, km, most_lat):
        pairs = radius_join(rest, right, ring, most_lat, spread_right=spread_right)
        if within is not None:
            pairs = pairs.where(within)
        names = [c for c in pairs.columns if c.startswith("r_") and c not in left.columns]
        found = pairs.groupBy(key).agg(F.min(F.struct("km", *names)).alias("m")).select(key, "m.*")
        if ring == km:
            return found if out is None else out.unionByName(found)
        found = saved(found, "nearest")
        out = found if out is None else out.unionByName(found)
        rest = saved(rest.join(found.select(F.col(key).alias("__found")), F.col(key).eqNullSafe(F.col("__found")), "left_anti"), "unmet")
    return out


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (a, b) and the least node it is connected with.

    Each round hangs every node on its least neighbour, follows these to their ends, and goes on with the edges between different
    ends only, so that every round has half as many nodes at most and no edge is read twice. Tables are written to the shared
    folder, so that neither lineage nor a lost executor matters.
    """
    schema = edges.schema["a"].dataType
    turned = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    left = saved(edges.select("a", F.col("b").cast(schema).alias("b")), "edges")
    rounds = []
    while True:
        hung = left.select(turned).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
        ends = saved(hung, "labels")
        while True:  # where a node hangs on one that hangs on another
            above = ends.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            new = saved(ends.join(above, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "labels")
            ends = new.select("node", "root")
            if new.where("moved").isEmpty():
                break
        rounds.append(ends)
        first, second = ends.select(F.col("node").alias("a"), F.col("root").alias("x")), ends.select(F.col("node").alias("b"), F.col("root").alias("y"))
        between = left.where("a <> b").join(first, "a").join(second, "b").where("x <> y")
        left = saved(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        roots = rounds.pop().join(later, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"))
    return saved(roots.select("node", "root"), "labels")


def dbscan(points: DataFrame, eps_km: float, least: int = 2, most_lat: float = 60.0) -> DataFrame:
    """id, cluster of every clustered point (id, lat, lng): the least core id of its cluster; noise has no row.

    A core point has `least` points within eps, itself included; cores within eps share a cluster; a border point joins the
    nearest core, the smaller id on a tie. Points at one spot are counted once per spot, so that a crowd does not multiply. With
    two points whoever has company is a core, so the clusters are the components, which tiles link without making pairs.
    """
    spark = points.sparkSession
    spots = saved(points.where("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "spots")
    if least == 2:
        from .tiles import links  # it stands on this module

        stars = links(spots.withColumn("family", F.lit("")).withColumn("at_s", F.lit(0)), None, most_lat, (eps_km, 1.0))
        roots = connected(spark, stars).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
        alone = F.when(F.col("n") > 1, F.col("id"))
        named = spots.join(roots, "id", "left").select("lat", "lng", F.coalesce("cluster", alone).alias("cluster")).where("cluster is not null")
        return points.join(named, ["lat", "lng"]).select("id", "cluster")
    pairs = saved(radius_join(spots, spots.select("id", "n", "lat", "lng"), eps_km, most_lat).select("id", "r_id", "r_n", "km"), "pairs")
    core = pairs.groupBy("id").agg(F.sum("r_n").alias("near")).where(F.col("near") >= least).select("id")
    links = pairs.join(core, "id").join(core.withColumnRenamed("id", "r_id"), "r_id").select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    roots = connected(spark, links)
    border = pairs.join(core, "id", "left_anti").join(roots, F.col("r_id") == F.col("node")).groupBy("id").agg(F.min(F.struct("km", "r_id", "root")).alias("m")).select("id", F.col("m.root").alias("cluster"))
    spot = roots.select(F.col("node").alias("id"), F.col("root").alias("cluster")).unionByName(border)
    named = spots.join(spot, "id").select("lat", "lng", "cluster")
    return points.join(named, ["lat", "lng"]).select("id", "cluster")


def clusters_by_family(points: DataFrame, eps_km: dict[str, float], most_lat: float = 60.0) -> DataFrame:
    """family, id, cluster of points (family, id, lat, lng) with company, as dbscan gives with two points for each family by its own eps, all at once."""
    from .tiles import links  # it stands on this module

    names = sorted(eps_km)
    number = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("family")) - 1
    known = points.where(F.col("family").isin(*names) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    spots = saved(known.groupBy("family", "lat", "lng").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("id", F.col("least") * len(names) + number), "spots")
    stars = links(spots.withColumn("at_s", F.lit(0)), {k: (v, 1.0) for k, v in eps_km.items()}, most_lat)
    roots = connected(points.sparkSession, stars).select(F.col("node").alias("id"), F.expr(f"(root - pmod(root, {len(names)})) div {len(names)}").alias("cluster"))
    alone = F.when(F.col("n") > 1, F.col("least"))
    named = spots.join(roots, "id", "left").select("family", "lat", "lng", F.coalesce("cluster", alone).alias("cluster")).where("cluster is not null")
    return known.join(named, ["family", "lat", "lng"]).select("family", "id", "cluster")
