"""Units of areas: towns, postal codes, and how geographic a code is."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import components
from .knn import knn

LINK_KM, WIDE_KM, CELL_KM = 2.0, 25.0, 5.0
LEAST_CLIENTS, LEAST_COHERENCE = 20, 0.5
FEW = 10_000  # pairs of clients that two cells make


def coherence(points: DataFrame, code: str = "postal") -> DataFrame:
    """One row: clients (of codes of two and more), coherence (share whose nearest other spot has the same code; null below 20 clients), ignored.

    A spot counts once, by its least id: clients of one spot are no neighbours of one another."""
    label = F.coalesce(F.col(code), F.lit(""))
    pts = written(points.select("id", "x", "y", label.alias("code")), "coherence-points")
    many = pts.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("code")
    spots = pts.groupBy("x", "y").agg(F.min(F.struct("id", "code")).alias("s")).select("x", "y", "s.id", "s.code")
    near = knn(spots, 1).select("id", "other")
    both = near.join(spots.join(many, "code").select("id", "code"), "id").join(spots.select(F.col("id").alias("other"), F.col("code").alias("code2")), "other")
    out = both.agg(F.count(F.lit(1)).alias("clients"), F.avg((F.col("code") == F.col("code2")).cast("double")).alias("c"))
    out = out.withColumn("coherence", F.when(F.col("clients") >= LEAST_CLIENTS, F.col("c"))).drop("c")
    return out.withColumn("ignored", F.coalesce(F.col("coherence") < LEAST_COHERENCE, F.lit(False)))


def extents(points: DataFrame, by: list[str]) -> DataFrame:
    """by, n, extent: diagonal of the group's box in km."""
    d = lambda c: (F.max(c) - F.min(c)) * (F.max(c) - F.min(c))
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(d("x") + d("y")).alias("extent"))


def towns(points: DataFrame) -> DataFrame:
    """id, town (least id of those that a chain of steps of at most LINK_KM reaches).

    Cells are so small that all in one are linked, by way of its least id; the nearest neighbours link most cells. Then only clients of
    neighbouring cells that are still of different towns are compared, so that dense towns make no pairs."""
    side = LINK_KM / 2**0.5 * 0.999
    pts = written(points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")), "town-points")
    first = pts.groupBy("cx", "cy").agg(F.min("id").alias("a"))
    star = pts.join(first, ["cx", "cy"]).select("a", F.col("id").alias("b"))
    near = knn(pts, 4).filter(F.sqrt("d2") <= LINK_KM).select(F.col("id").alias("a"), F.col("other").alias("b"))
    edges = written(star.unionByName(near), "town-edges")
    label = components(edges).withColumnRenamed("a", "id")
    pts = written(pts.join(label, "id"), "town-labels")
    # all clients of a cell are of one town: cells whose towns differ are paired before any clients meet
    steps = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    cells = written(pts.groupBy("cx", "cy", "class").agg(F.count(F.lit(1)).alias("n")), "town-cells")
    around = cells.withColumn("i", steps).withColumn("j", steps).select("cx", "cy", F.col("class").alias("a"), "n", (F.col("cx") + F.col("i")).alias("nx"), (F.col("cy") + F.col("j")).alias("ny"))
    pairs = around.join(cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("class").alias("b"), F.col("n").alias("m")), ["nx", "ny"]).filter("a < b")
    pairs = written(pairs.withColumn("pair", F.concat_ws(":", "cx", "cy", "nx", "ny")), "town-pairs")
    more = written(_near_towns(pts, pairs), "town-more")
    known = label.select(F.col("class").alias("a"), F.col("id").alias("b"))
    return components(known.unionByName(more)).select(F.col("a").alias("id"), F.col("class").alias("town"))


def _near_towns(pts: DataFrame, pairs: DataFrame, few: int = FEW) -> DataFrame:
    """a, b of the pairs of cells (pair, cx, cy, a, n; nx, ny, b, m) of which a client of one is at most LINK_KM from a client of the other.

    All clients of two cells meet where they make at most `few` pairs; where they make more, the nearest of the other cell is looked up for each client of one."""
    left = lambda p: pts.select("id", "x", "y", "cx", "cy").join(p.select("pair", "cx", "cy"), ["cx", "cy"]).select("pair", "id", "x", "y")
    right = lambda p: pts.select("id", "x", "y", F.col("cx").alias("nx"), F.col("cy").alias("ny")).join(p.select("pair", "nx", "ny"), ["nx", "ny"]).select("pair", "id", "x", "y")
    small, large = pairs.filter(F.col("n") * F.col("m") <= few), pairs.filter(F.col("n") * F.col("m") > few)
    far = F.sqrt(F.expr("(x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)"))
    met = left(small).select("pair", F.col("x").alias("x1"), F.col("y").alias("y1")).join(right(small), "pair").filter(far <= LINK_KM).select("pair")
    if not large.isEmpty():
        met = met.unionByName(knn(right(large), 1, ["pair"], seekers=left(large)).filter(F.sqrt("d2") <= LINK_KM).select("pair"))
    return pairs.select("pair", "a", "b").join(met.distinct(), "pair").select("a", "b").distinct()


def town_keys(points: DataFrame) -> DataFrame:
    """The points (id, x, y, ...) with town and town_key: towns wider than WIDE_KM fall into cells of CELL_KM."""
    pts = points.join(towns(points), "id")
    wide = extents(pts, ["town"]).filter(F.col("extent") > WIDE_KM).select("town", F.lit(True).alias("_wide"))
    cell = lambda c: F.floor(F.col(c) / CELL_KM).cast("string")
    return pts.join(wide, "town", "left").withColumn("town_key", F.when(F.col("_wide"), F.concat_ws(":", F.col("town").cast("string"), cell("x"), cell("y"))).otherwise(F.col("town").cast("string"))).drop("_wide")


def unit_keys(points: DataFrame, code: str | Column | None = "postal") -> DataFrame:
    """The points with unit: the code (a column or any expression), split by towns where it spans more than WIDE_KM; without a code the town."""
    pts = town_keys(points)
    if code is None:
        return pts.withColumn("unit", F.col("town_key"))
    pts = pts.withColumn("_code", F.col(code) if isinstance(code, str) else code)
    wide = extents(pts.filter("_code <> ''"), ["_code"]).filter(F.col("extent") > WIDE_KM).select("_code", F.lit(True).alias("_wide"))
    pts = pts.join(wide, "_code", "left")
    return pts.withColumn("unit", F.when(F.coalesce("_code", F.lit("")) == "", F.col("town_key")).when(F.col("_wide"), F.concat_ws("|", "_code", "town_key")).otherwise(F.col("_code"))).drop("_code", "_wide")


def rollup_units(points: DataFrame, by: list[str]) -> DataFrame:
    """by, n, weight and weighted centre of rows (x, y, w)."""
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), mean("x"), mean("y"))


def majority(points: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, label: the label with most weight; ties go to the least."""
    total = points.groupBy(*by, label).agg(F.round(F.sum("w"), 6).alias("w"))
    return total.groupBy(*by).agg(F.min(F.struct((-F.col("w")).alias("w"), label)).alias("m")).select(*by, f"m.{label}")
