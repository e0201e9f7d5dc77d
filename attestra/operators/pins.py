"""Map pins merged on the screen: each pin goes to the first pin before it that leads and stands within so many pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove, saved, shared_path

#: Pixels of the world at zoom 0, and the northernmost latitude of the projection.
WORLD, MOST_LAT = 512.0, 85.051129


def screen_x(lng: Column, zoom: float) -> Column:
    return (lng + 180.0) / 360.0 * (WORLD * 2**zoom)


def screen_y(lat: Column, zoom: float) -> Column:
    """Pixels from the projection's north edge; latitudes beyond it are set to it."""
    angle = F.radians(F.greatest(F.least(lat, F.lit(MOST_LAT)), F.lit(-MOST_LAT)))
    return (F.lit(0.5) - F.log(F.tan(math.pi / 4 + angle / 2)) / (2 * math.pi)) * (WORLD * 2**zoom)


def leaders(pins: DataFrame, zoom: float, radius: float) -> DataFrame:
    """id and leader of pins (id, lat, lng): in order of id, a pin that no leader before it has within `radius` pixels leads; every other one
    goes to the first such leader. Ids are distinct and not null; a pin without a place, or with one that is no number, leads itself.

    The order is the sequential one, but rounds settle the whole map at once. Pins lie in cells so small that any two of a cell are within
    the radius, so a cell has one leader at most. The earliest open pin of a cell leads if it comes before the earliest open pins of
    all cells in reach; then all pins within the radius of a new leader are closed. A pin meets at most one leader a cell of the 25 in
    reach, whatever the crowd; equal places are one pin. Each round is written to the shared folder; there are as many as the longest chain
    of neighbouring cells with ascending ids.
    """
    spark = pins.sparkSession
    side = radius / math.sqrt(2) * (1 - 1e-9)
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e6)
    placed = pins.where(number("lat") & number("lng")).select("id", screen_x(F.col("lng"), zoom).alias("x"), screen_y(F.col("lat"), zoom).alias("y"))
    spots = placed.groupBy("x", "y").agg(F.min("id").alias("id")).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    reach = lambda df: df.withColumn("cx", F.explode(F.sequence(F.col("cx") - 2, F.col("cx") + 2))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 2, F.col("cy") + 2)))
    near = F.pow(F.col("x") - F.col("lx"), 2) + F.pow(F.col("y") - F.col("ly"), 2) < radius * radius

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    open_, path = kept(spots, "pins")
    found, paths = None, []
    while True:
        first = open_.groupBy("cx", "cy").agg(F.min_by(F.struct("id", "x", "y"), "id").alias("p")).select("cx", "cy", "p.*")
        earliest = reach(first.select("cx", "cy", F.col("id").alias("other"))).groupBy("cx", "cy").agg(F.min("other").alias("other"))
        led, led_path = kept(first.join(earliest, ["cx", "cy"]).where("id = other").select("cx", "cy", F.col("id").alias("leader"), F.col("x").alias("lx"), F.col("y").alias("ly")), "leaders")
        paths.append(led_path)
        if led.isEmpty():
            break
        found = led if found is None else found.unionByName(led)
        near_new = reach(led).withColumnsRenamed({"cx": "kx", "cy": "ky"})
        rest, rest_path = kept(open_.join(near_new, (F.col("cx") == F.col("kx")) & (F.col("cy") == F.col("ky")) & near, "left_anti"), "pins")
        remove(spark, path)
        open_, path = rest, rest_path
    remove(spark, path)
    all_ = pins.select("id", "lat", "lng")
    alone = all_.where(~F.coalesce(number("lat") & number("lng"), F.lit(False))).select("id", F.col("id").alias("leader"))
    if found is None:
        out = alone
    else:
        of_spot = spots.join(reach(found), ["cx", "cy"]).where(near).groupBy("x", "y").agg(F.min("leader").alias("leader"))
        out = placed.join(of_spot, ["x", "y"]).select("id", "leader").unionByName(alone)
    out = saved(out, "pins-led")
    for p in paths:
        remove(spark, p)
    return out
