"""Regions: rings, which land they lie on, and which share a land border. Input tables; a synthetic geography stands for them in queries.

region_rings: ring_id, state_id, land_id, ring (array of lon, lat). region_adjacency: state_a, state_b, symmetric.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.knn import knn
from .shared import written

RINGS_SQL = """
SELECT CAST(n_nationkey AS INT) AS state_id, n_name AS name,
  CAST(CASE WHEN n_nationkey < 20 THEN 0 WHEN n_nationkey % 5 < 3 THEN 1 ELSE 2 END AS INT) AS land_id,
  CAST(-6 AS DOUBLE) + CAST((n_nationkey - n_nationkey % 5) AS DOUBLE) / CAST(5 AS DOUBLE) * CAST(1.9 AS DOUBLE) AS lon,
  CAST(37 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(1.6 AS DOUBLE) AS lat,
  CAST(CASE WHEN n_nationkey < 20 THEN 0.95 ELSE 0.7 END AS DOUBLE) AS half, CAST(0.8 AS DOUBLE) AS high
FROM {nation}
"""


def demo_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per nation; the last column is two islands behind a strait."""
    rows = spark.sql(RINGS_SQL, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    corner = lambda i, j: F.struct((F.col("lon") + i * F.col("half")).alias("lon"), (F.col("lat") + j * F.col("high")).alias("lat"))
    return rows.select(F.col("state_id").alias("ring_id"), "state_id", "name", "land_id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))


def demo_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side neighbours on the same land."""
    s = demo_rings(spark, sf_dir).select("state_id", "land_id")
    step = s.select(F.col("state_id").alias("state_a"), "land_id", F.explode(F.array(F.lit(-5), F.lit(5), F.lit(-1), F.lit(1))).alias("d"))
    step = step.withColumn("state_b", F.col("state_a") + F.col("d")).filter("abs(d) = 5 or floor(state_a / 5) = floor(state_b / 5)")
    return step.join(s.withColumnRenamed("state_id", "state_b"), ["state_b", "land_id"]).select("state_a", "state_b")


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting: an odd number of edges lies east of the point."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = ring[F.pmod(i + n - 1, n)]
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < p["lon"] + (lat - p["lat"]) * (q["lon"] - p["lon"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)))

    return F.size(F.filter(F.transform(ring, crosses), lambda c: c)) % 2 == 1


def in_rings(points: DataFrame, rings: DataFrame) -> DataFrame:
    """id, state_id, land_id of points (id, lat, lon) in a ring; of several the one of least ring_id.

    A ring goes to every whole-degree cell its box meets, a point to its own cell: an equi-join, then the box, then the ray."""
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = rings.select("ring_id", "state_id", "land_id", "ring", *[edge(f, c).alias(f"{n}_{c}") for n, f in (("min", F.array_min), ("max", F.array_max)) for c in ("lon", "lat")])
    cells = lambda c: F.explode(F.sequence(F.floor(f"min_{c}").cast("int"), F.floor(f"max_{c}").cast("int")))
    boxed = boxed.withColumn("cx", cells("lon")).withColumn("cy", cells("lat"))
    at = points.select("id", "lat", "lon", F.floor("lon").cast("int").alias("cx"), F.floor("lat").cast("int").alias("cy"))
    met = at.join(boxed, ["cx", "cy"]).filter("lon between min_lon and max_lon and lat between min_lat and max_lat").filter(inside(F.col("lon"), F.col("lat"), F.col("ring")))
    return met.groupBy("id").agg(F.min(F.struct("ring_id", "state_id", "land_id")).alias("r")).select("id", "r.state_id", "r.land_id")


def with_regions(points: DataFrame, rings: DataFrame) -> DataFrame:
    """The points with state_id and land_id; those in no ring take both from the nearest point in one, -1 where there is none.

    Nearness is in degrees, longitude scaled by the cosine of the middle latitude."""
    found = points.join(in_rings(points, rings), "id", "left")
    found = written(found, "regions-found")
    lost = written(found.filter("state_id is null").select("id", "lat", "lon"), "regions-lost")
    if lost.isEmpty():
        return found
    mid = found.agg(F.cos(F.radians((F.min("lat") + F.max("lat")) / 2)).alias("k")).first()["k"]
    plane = lambda df: df.select("id", (F.col("lon") * mid).alias("x"), F.col("lat").alias("y"))
    near = knn(plane(found.filter("state_id is not null")), 1, seekers=plane(lost)).select("id", "other")
    take = near.join(found.select(F.col("id").alias("other"), F.col("state_id").alias("s2"), F.col("land_id").alias("l2")), "other").select("id", "s2", "l2")
    out = found.join(take, "id", "left")
    return out.withColumn("state_id", F.coalesce("state_id", "s2", F.lit(-1))).withColumn("land_id", F.coalesce("land_id", "l2", F.lit(-1))).drop("s2", "l2")


def land_groups(states: DataFrame, adjacency: DataFrame) -> DataFrame:
    """state_id, group_id (least state of its component over land borders)."""
    label = components(adjacency.select(F.col("state_a").cast("long").alias("a"), F.col("state_b").cast("long").alias("b")))
    out = states.select("state_id").distinct().join(label.select(F.col("a").alias("state_id"), F.col("class").alias("group_id")), "state_id", "left")
    return out.withColumn("group_id", F.coalesce("group_id", F.col("state_id").cast("long")))


def touching(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """The rows (s, t, ...) with `touch`: equal, unknown (-1) or neighbours by land."""
    known = adjacency.distinct().select(F.col("state_a").alias("s"), F.col("state_b").alias("t"), F.lit(True).alias("_land"))
    return pairs.join(known, ["s", "t"], "left").withColumn("touch", (F.col("s") == F.col("t")) | (F.col("s") < 0) | (F.col("t") < 0) | F.coalesce("_land", F.lit(False))).drop("_land")
