"""Result tables for users: assignment, client detail, shapes, diagnostics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import hull


def quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def assignment(points: DataFrame) -> DataFrame:
    """customer_id, area, territory, load_hours_month, postal_code as text; numbers of territories count from 1."""
    has = F.col("territory").isNotNull()
    return points.select(
        "customer_id", F.when(has, F.col("area")).otherwise("").alias("area"),
        F.when(has, (F.col("territory") + 1).cast("string")).when(F.col("is_outlier"), "outlier").otherwise("unassigned").alias("territory"),
        F.format_string("%.2f", F.col("load") / 60).alias("load_hours_month"), F.coalesce("postal", F.lit("")).alias("postal_code"))


def assignment_lines(points: DataFrame) -> DataFrame:
    """line: the assignment as CSV, one row per client; the header is the columns' names joined."""
    out = assignment(points)
    return out.select(F.concat_ws(",", *[quoted(F.col(c)) for c in out.columns]).alias("line"))


def write_assignment(points: DataFrame, path: str) -> None:
    """CSV with a header, quoted only where needed, a file per task."""
    lines = assignment_lines(points)
    header = ",".join(assignment(points).columns)
    lines.sparkSession.createDataFrame([(header,)], "line string").write.mode("overwrite").text(f"{path}/header")
    lines.write.mode("overwrite").text(f"{path}/rows")


def client_detail(points: DataFrame) -> DataFrame:
    """Per client: load, visits and travel in hours, territory (from 1), area, code."""
    return points.select(
        "customer_id", "area", (F.col("territory") + 1).alias("territory"), "postal", (F.col("load") / 60).alias("load_hours"),
        (F.col("visit_load") / 60).alias("visit_hours"), F.greatest(F.lit(0.0), (F.col("load") - F.col("visit_load")) / 60).alias("travel_hours"))


HULL_ROWS = 2000


def territory_shapes(points: DataFrame, colours: int = 15) -> DataFrame:
    """territory, clients, hours, colour (a place in the palette) and hull.

    Clients are dealt in heaps of about HULL_ROWS, each heap's hull is taken, and the hulls' corners make the hull of all."""
    has = points.filter("territory is not null")
    out = has.groupBy("territory").agg(F.count(F.lit(1)).alias("clients"), (F.sum("load") / 60).alias("hours"))
    heaps = has.select("territory", "lon", "lat").join(out.select("territory", F.ceil(F.col("clients") / HULL_ROWS).alias("_heaps")), "territory")
    heaps = heaps.groupBy("territory", F.pmod(F.xxhash64("lon", "lat"), F.col("_heaps")).alias("_heap")).agg(hull(F.collect_set(F.struct("lon", "lat"))).alias("p"))
    corners = heaps.groupBy("territory").agg(F.flatten(F.collect_list("p")).alias("p"))
    out = out.join(corners, "territory")
    return out.select("territory", "clients", "hours", F.pmod("territory", F.lit(colours)).cast("int").alias("colour"), hull(F.col("p")).alias("hull"))


def diagnostics(rows: DataFrame, points: DataFrame, coherence: DataFrame, postal_split: DataFrame) -> DataFrame:
    """One row: input rows, those dropped for their coordinates, outliers, coherence of codes and whether they are ignored, codes split, travel share."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    got = points.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("is_outlier")).alias("n_outliers"),
        (F.sum(F.when(F.col("territory").isNotNull(), F.col("load") - F.col("visit_load"))) / F.sum(F.when(F.col("territory").isNotNull(), F.col("load")))).alias("travel_share"))
    out = got.crossJoin(n).crossJoin(coherence.select("coherence", "ignored")).crossJoin(postal_split.agg(F.count(F.lit(1)).alias("postal_split")))  # one row each
    return out.withColumn("n_dropped", F.col("n_rows") - F.col("n_points"))
