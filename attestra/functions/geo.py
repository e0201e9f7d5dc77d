"""Geography and scoring curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in km: of clustering, media and events, and of the duplicate gate.
EARTH, EARTH_DEDUP = 6371.0088, 6371.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def density(n: Column) -> Column:
    """How much a number of independent reports says, saturating at 25."""
    return clamp((1 - F.exp(-n / 6.5)) / (1 - F.exp(F.lit(-25 / 6.5))))


def coherence(km: Column, eps: Column) -> Column:
    """1 for reports at one place, 0 from twice eps on."""
    return F.when(km >= 2 * eps, 0.0).otherwise(0.5 * (1 + F.cos(F.pi() * km / (2 * eps))))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, constant beyond them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, p), (b, q) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, p + (x - a) / (b - a) * (q - p))
    return out.otherwise(F.lit(points[-1][1])) if points else F.lit(None)


def steps(x: Column, cuts: list[tuple[float, float]], other: float, how: str = ">=") -> Column:
    """The value of the first cut that holds; null for null."""
    test = {">=": lambda c: x >= c, "<=": lambda c: x <= c, "<": lambda c: x < c}[how]
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for cut, value in cuts:
        out = out.when(test(cut), F.lit(value))
    return out.otherwise(F.lit(other))


# The evidence scales, as (cut, score) with the first match winning.
RAIN_24H = [(0, 0.0), (2.5, 0.1), (15.6, 0.35), (64.5, 0.7), (115.6, 0.9), (204.5, 1.0)]
HEAT_C = [(47, 1.0), (45, 0.9), (42, 0.6), (40, 0.4)]
COLD_C = [(2, 1.0), (4, 0.8), (7, 0.5), (10, 0.3)]
FOG_M = [(50, 1.0), (200, 0.85), (500, 0.6), (1000, 0.4)]
GUST_KMH = [(89, 1.0), (62, 0.8), (50, 0.6), (39, 0.4)]
CLOUDBURST_MM_H = [(100, 1.0), (50, 0.6), (20, 0.3)]
DUST_UG_M3 = [(1000, 1.0), (500, 0.7), (200, 0.4)]


def rain_score(mm: Column) -> Column:
    return F.when(mm.isNotNull(), piecewise(mm, RAIN_24H))


def heat_score(c: Column, elevation_m: Column) -> Column:
    """In the hills, above 1000 m, the scale lies 10 degrees lower."""
    return steps(c + F.when(elevation_m > 1000, 10.0).otherwise(0.0), HEAT_C, 0.1)


def cold_score(c: Column) -> Column:
    return steps(c, COLD_C, 0.1, "<=")


def fog_score(m: Column) -> Column:
    return steps(m, FOG_M, 0.0, "<")


def gust_score(kmh: Column) -> Column:
    return steps(kmh, GUST_KMH, 0.0)


def cloudburst_score(mm_h: Column, mm_24h: Column) -> Column:
    return F.greatest(steps(mm_h, CLOUDBURST_MM_H, 0.0), rain_score(mm_24h))


def dust_score(ug: Column, gust: Column) -> Column:
    return F.least(F.lit(1.0), steps(ug, DUST_UG_M3, 0.0) + F.when(gust >= 40, 0.1).otherwise(0.0))


# Weather codes of thunder, hail and showers, and what the air must hold for a lower score.
THUNDER, HAIL, SHOWERS = (95, 96, 99), (96, 99), (80, 81, 82)
CAPE_SHOWERS, CAPE_ALONE = 1000.0, 500.0


def thunder_score(codes: Column, cape: Column) -> Column:
    """1 for a thunder code, 0.6 for showers in unstable air, 0.3 for less unstable air alone."""
    any_of = lambda xs: F.arrays_overlap(codes, F.array(*(F.lit(x) for x in xs)))
    return F.when(any_of(THUNDER), 1.0).when(any_of(SHOWERS) & (cape >= CAPE_SHOWERS), 0.6).when(cape >= CAPE_ALONE, 0.3).otherwise(0.0)


def hail_score(codes: Column) -> Column:
    """1 for a hail code, 0.5 for a thunderstorm without one."""
    return F.when(F.arrays_overlap(codes, F.array(*(F.lit(x) for x in HAIL))), 1.0).when(F.array_contains(codes, 95), 0.5).otherwise(0.0)


def distance_factor(km: Column) -> Column:
    return F.when(km <= 25, 1.0).when(km <= 50, 0.8).otherwise(0.0)


def quad_key(lat: Column, lng: Column, level: int) -> Column:
    """A hierarchical cell name of one digit a level: the parent is the prefix, so that counts roll up exactly."""
    y, x = F.floor((lat + 90) / 180 * (1 << level)).cast("bigint"), F.floor((lng + 180) / 360 * (1 << level)).cast("bigint")
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    return F.concat(*((bit(y, k) * 2 + bit(x, k)).cast("string") for k in range(level - 1, -1, -1)))


def quad_centre(cell: Column) -> Column:
    """struct(lat, lng) of the centre of a cell, from its name."""
    digits = F.split(cell, "")
    number = lambda of: F.aggregate(digits, F.lit(0).cast("bigint"), lambda v, d: F.when(d == "", v).otherwise(v * 2 + of(d.cast("int"))))
    size = F.pow(F.lit(2.0), F.length(cell))
    y, x = number(lambda d: F.floor(d / 2)), number(lambda d: d % 2)
    return F.struct(((y + 0.5) / size * 180 - 90).alias("lat"), ((x + 0.5) / size * 360 - 180).alias("lng"))
