"""Planar projection, distances and geometry as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEGREE = math.pi / 180 * 6371


def projected(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """x, y in km, centred on the mean latitude of each set named by `keys`, and kx, km per degree of longitude there; one small aggregate joined back."""
    keys = keys or []
    mean = points.groupBy(*keys).agg(F.avg("lat").alias("_lat0"))
    out = points.join(mean, keys) if keys else points.crossJoin(F.broadcast(mean))  # one row
    out = out.withColumn("kx", KM_PER_DEGREE * F.cos(F.radians("_lat0")))
    return out.withColumn("x", F.col("lon") * KM_PER_DEGREE * F.cos(F.radians("_lat0"))).withColumn("y", F.col("lat") * KM_PER_DEGREE).drop("_lat0")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle km on a sphere of 6371 km."""
    s = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = s(lat1, lat2) * s(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lon1, lon2) * s(lon1, lon2)
    return 2 * 6371 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def spread_bits(v: Column) -> Column:
    """The low 16 bits of v with a zero after each."""
    v = v.cast("long").bitwiseAND(0xFFFF)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def morton(points: DataFrame) -> DataFrame:
    """The points with zkey: longitude and latitude at 16 bits each, interleaved."""
    box = points.agg(F.min("lon").alias("o0"), F.max("lon").alias("o1"), F.min("lat").alias("a0"), F.max("lat").alias("a1"))
    step = lambda c, k: F.floor((F.col(c) - F.col(f"{k}0")) * (65535.0 / F.greatest(F.lit(1e-9), F.col(f"{k}1") - F.col(f"{k}0"))) + 0.5)
    out = points.crossJoin(F.broadcast(box))  # one row
    return out.withColumn("zkey", spread_bits(step("lon", "o")).bitwiseOR(F.shiftleft(spread_bits(step("lat", "a")), 1))).drop("o0", "o1", "a0", "a1")


def hull(points: Column) -> Column:
    """Convex hull of an array of (lon, lat) structs, counter-clockwise from the least point; collinear points are left out."""
    by = F.array_sort(F.array_distinct(points))
    cross = lambda o, a, b: (a["lon"] - o["lon"]) * (b["lat"] - o["lat"]) - (a["lat"] - o["lat"]) * (b["lon"] - o["lon"])

    def chain(pts: Column) -> Column:
        # keep a stack: drop its top while it does not turn left; one reduce finds how much of the stack stays
        def push(stack: Column, p: Column) -> Column:
            n = F.size(stack)
            stay = F.aggregate(F.reverse(F.sequence(F.lit(2), n)), n, lambda k, i: F.when((k == i) & (cross(stack[i - 2], stack[i - 1], p) <= 0), i - 1).otherwise(k))
            return F.concat(F.slice(stack, 1, F.when(n < 2, n).otherwise(stay)), F.array(p))

        return F.aggregate(F.slice(pts, 2, F.greatest(F.size(pts), F.lit(1))), F.slice(pts, 1, 1), push)

    half = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.when(F.size(by) < 3, by).otherwise(F.concat(half(chain(by)), half(chain(F.reverse(by)))))
