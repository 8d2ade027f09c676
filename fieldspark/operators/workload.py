"""Monthly workload: visits, travel model, loads and sizing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, projected
from ..plans.params import Params
from ..sources.shared import written
from .knn import knn

SUBSET = ["area_id", "land_id"]


def with_visit_load(points: DataFrame) -> DataFrame:
    """v visits and m minutes a month with their defaults, and visit_load = v * m."""
    points = points.withColumn("v", F.when(F.col("visits") > 0, F.col("visits")).otherwise(1.0))
    points = points.withColumn("m", F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(60.0 / F.col("v")))
    return points.withColumn("visit_load", F.col("v") * F.col("m"))


def min_per_km(p: Params) -> Column:
    return F.lit(float(p.detour)) / F.coalesce("speed_kmh", F.lit(float(p.speed_kmh))) * 60


def with_travel(points: DataFrame, p: Params = Params(), keys: list[str] = SUBSET) -> DataFrame:
    """hop minutes between visits and tpk, trip minutes per km, from the 3 and 30 nearest clients of the same keys; id names the row.

    Areas and landmasses are modelled apart: each has its own mean latitude and neighbours. A client alone in its set has no hop
    and makes one visit a trip.
    """
    points = points.withColumn("_set", F.to_json(F.struct(*keys)))  # a null key is a set of its own
    pts = written(projected(with_visit_load(points), ["_set"]).withColumn("mpk", min_per_km(p)), "travel-points")
    near = written(knn(pts.select("_set", "id", "x", "y"), 30, ["_set"]).select("id", "other", "rank", "d2"), "travel-near")
    hop = near.filter("rank <= 3").groupBy("id").agg(F.avg(F.sqrt("d2")).alias("hop_km"))
    pts = written(pts.join(hop, "id", "left").withColumn("hop", F.coalesce("hop_km", F.lit(0.0)) * F.col("mpk")), "travel-hops")
    of = pts.select(F.col("id").alias("other"), "v", (F.col("v") * (F.col("m") + F.col("hop"))).alias("w"))
    cost = near.select("id", "other").join(of, "other").groupBy("id").agg(F.sum("v").alias("nv"), F.sum("w").alias("nw"))
    day = p.capacity_hours * 60 / p.work_days
    out = pts.join(cost, "id", "left")
    per_day = F.greatest(F.lit(1.0), F.lit(float(day)) / F.greatest((F.col("v") * (F.col("m") + F.col("hop")) + F.col("nw")) / (F.col("v") + F.col("nv")), F.lit(1e-6)))
    return out.withColumn("per_day", F.when(F.col("hop_km").isNull(), 1.0).otherwise(per_day)).withColumn("tpk", 2 * F.col("mpk") / F.col("per_day")).drop("hop_km", "nv", "nw", "_set")


def weight() -> Column:
    """Of a client in its group's centre."""
    return F.col("v") * (F.col("m") + F.col("hop")) + 1e-9


def centres(points: DataFrame, territory: str) -> DataFrame:
    """territory, base_lat, base_lon: load-weighted centres of rows with travel."""
    mean = lambda c: F.sum(F.col(c) * weight()) / F.sum(weight())
    return points.filter(F.col(territory).isNotNull()).groupBy(territory).agg(mean("lat").alias("base_lat"), mean("lon").alias("base_lon"))


def with_load(points: DataFrame, territory: str, bases: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """dist_km to the territory's base (territory, base_lat, base_lon), and load; without a territory the load is that of the visits alone."""
    out = points.join(bases, territory, "left")
    dx, dy = (F.col(lon) - F.col("base_lon")) * F.col("kx"), (F.col(lat) - F.col("base_lat")) * KM_PER_DEGREE
    out = out.withColumn("dist_km", F.sqrt(dx * dx + dy * dy))
    trip = F.col("v") * (F.col("m") + F.col("hop") + F.col("dist_km") * F.col("tpk"))
    return out.withColumn("load", F.when(F.col(territory).isNull(), F.col("visit_load")).otherwise(trip))


def postal_starts(points: DataFrame, p: Params, keys: list[str] = SUBSET) -> DataFrame:
    """The rows with from_lat, from_lon, where trips are measured from when codes stay whole: the code's load-weighted centre; for a client without
    a code, or of a code of several clients above three quarters of a capacity, the client's place."""
    mean = lambda c: (F.sum(F.col(c) * weight()) / F.sum(weight())).alias(f"_{c}")
    units = points.filter(F.col("postal") != "").groupBy(*keys, "postal").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("v") * (F.col("m") + F.col("hop"))).alias("_w"), mean("lat"), mean("lon"))
    whole = units.filter((F.col("_n") == 1) | (F.col("_w") <= 0.75 * 60 * p.capacity_hours)).drop("_n", "_w")
    out = points.join(whole, [*keys, "postal"], "left")
    return out.withColumn("from_lat", F.coalesce("_lat", "lat")).withColumn("from_lon", F.coalesce("_lon", "lon")).drop("_lat", "_lon")


def territory_stats(points: DataFrame, territory: str, capacity_hours: float) -> DataFrame:
    """territory, n, hours, visit_hours and deviation_pct from the capacity, of rows with load."""
    out = points.filter(F.col(territory).isNotNull()).groupBy(territory).agg(F.count(F.lit(1)).alias("n"), (F.sum("load") / 60).alias("hours"), (F.sum("visit_load") / 60).alias("visit_hours"))
    return out.withColumn("deviation_pct", (F.col("hours") - capacity_hours) / capacity_hours * 100)


def area_sizing(points: DataFrame, capacity_hours: float) -> DataFrame:
    """area, hours, territories and salespeople needed of rows (area, territory, load); the total has a null area."""
    per = points.filter(F.col("territory").isNotNull()).groupBy("area", "territory").agg(F.sum("load").alias("s"))
    out = per.rollup("area").agg((F.sum("s") / 60).alias("hours"), F.count(F.lit(1)).alias("territories"))
    return out.withColumn("salespeople", F.col("hours") / capacity_hours)
