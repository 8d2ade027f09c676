"""Focus: which rows of other tables an area or a territory selects, and which area a selection means."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .knn import knn


def in_focus(assigned: DataFrame, kind: str, value) -> DataFrame:
    """Rows of the territory or of the area; clients without a territory are in neither."""
    return assigned.filter(F.col("territory").isNotNull() & (F.col("territory" if kind == "territory" else "area") == value))


def exact_codes(assigned: DataFrame) -> bool:
    """Whether every code lies in one area."""
    return assigned.filter("postal <> ''").groupBy("postal").agg(F.countDistinct("area").alias("k")).filter("k > 1").isEmpty()


def focus_keys(assigned: DataFrame, area, has_field: bool) -> tuple[str, DataFrame]:
    """The column to filter by and its values: the area field, else codes where each lies in one area, else customer ids."""
    rows = in_focus(assigned, "area", area)
    if has_field and area != "(no area)":
        return "area", rows.select("area").distinct()
    column = "postal" if exact_codes(assigned) and not assigned.filter("postal <> ''").isEmpty() else "customer_id"
    return column, rows.filter(F.col(column) != "").select(column).distinct()


def apply_focus(other: DataFrame, keys: tuple[str, DataFrame]) -> DataFrame:
    """The rows of another table that the focus selects."""
    return other.join(keys[1], keys[0], "left_semi")


def area_of_values(assigned: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """One row (area, n): the area with most assigned clients among those values of a column; ties go to the first by name."""
    hit = assigned.filter("territory is not null").join(values.select(column).distinct(), column, "left_semi")
    return hit.groupBy("area").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "area").limit(1)


def focus_of_selection(assigned: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (kind, value): the territory, if all selected clients are of one, else the area with most of them."""
    hit = assigned.filter("territory is not null").join(ids.select("customer_id").distinct(), "customer_id", "left_semi")
    per = hit.groupBy("territory", "area").agg(F.count(F.lit(1)).alias("n"))
    area = per.groupBy("area").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("territory").alias("t"))
    all_ = area.agg(F.sum("k").alias("k"), F.min("t").alias("t"), F.min(F.struct((-F.col("n")).alias("n"), "area")).alias("top"))
    one = F.col("k") == 1
    return all_.filter("k is not null").select(F.when(one, "territory").otherwise("area").alias("kind"), F.when(one, F.col("t").cast("string")).otherwise(F.col("top.area")).alias("value"))


def hover(points: DataFrame, probes: DataFrame, pixels: float = 8.0, first: int = 2) -> DataFrame:
    """probe, id of the nearest client (whose ids are not negative) within so many pixels of a probe (probe, plat, plon, zoom), ties by id, none where there is none.

    A probe looks up its nearest clients, whatever its radius, so that dense cells make no pairs. Unlike squares may have one root: a probe whose
    nearest are all as far away as the first looks up four times as many."""
    box = points.agg(F.cos(F.radians((F.min("lat") + F.max("lat")) / 2)).alias("k"))
    plane = lambda df, i, lon, lat: df.crossJoin(F.broadcast(box)).select(F.col(i).alias("id"), (F.col(lon) * F.col("k")).alias("x"), F.col(lat).alias("y"))  # one row
    at = written(plane(points, "id", "lon", "lat"), "hover-points")
    asked = written(probes.withColumn("_seek", -1 - F.monotonically_increasing_id()), "hover-probes")
    todo, k, out = written(plane(asked, "_seek", "plon", "plat"), "hover-seekers"), first, None
    while not todo.isEmpty():
        near = knn(at, k, seekers=todo).withColumn("d", F.sqrt("d2"))
        near = near.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m"), F.max("d").alias("far"), F.count(F.lit(1)).alias("n"))
        near = written(near.withColumn("open", (F.col("n") == k) & (F.col("far") <= F.col("m.d"))), "hover-near")
        out = near if out is None else out.filter("not open").unionByName(near)
        todo, k = written(todo.join(near.filter("open").select("id"), "id", "left_semi"), "hover-seekers"), k * 4
    if out is None:
        return probes.select("probe", F.lit(None).cast(points.schema["id"].dataType).alias("id")).limit(0)
    r = F.lit(pixels) * 360 / (256 * F.pow(F.lit(2.0), F.col("zoom")))
    met = asked.join(out.select(F.col("id").alias("_seek"), "m"), "_seek").filter(F.col("m.d") < r)
    return met.groupBy("probe").agg(F.min("m").alias("m")).select("probe", F.col("m.other").alias("id"))
