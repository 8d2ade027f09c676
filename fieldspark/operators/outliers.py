"""Isolated clients: the third nearest neighbour is missing or too far."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn


def with_outliers(points: DataFrame, outlier_km: float) -> DataFrame:
    if outlier_km <= 0:
        return points.withColumn("is_outlier", F.lit(False))
    third = knn(points.select("id", "x", "y"), 3).filter("rank = 3").select("id", F.sqrt("d2").alias("third_km"))
    out = points.join(third, "id", "left")
    return out.withColumn("is_outlier", F.coalesce(F.col("third_km") > outlier_km, F.lit(True))).drop("third_km")
