"""Client points: role coercion and the demo points derived from the order tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("orders", "customer", "nation", "region")
DEMO_SQL = """
WITH o AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey),
b AS (SELECT c.c_custkey AS k, c.c_name AS customer_id, CAST(c.c_nationkey AS BIGINT) AS nk, r.r_name AS area, c.c_mktsegment AS seg, o.n AS n_orders,
  2*CAST((c.c_custkey*7919)%1009 AS DOUBLE)/CAST(1009 AS DOUBLE)-1 AS a, 2*CAST((c.c_custkey*104729)%1013 AS DOUBLE)/CAST(1013 AS DOUBLE)-1 AS b
  FROM {customer} c JOIN {nation} n ON c.c_nationkey=n.n_nationkey JOIN {region} r ON n.n_regionkey=r.r_regionkey LEFT JOIN o ON o.o_custkey=c.c_custkey),
g AS (SELECT *, CAST(37 AS DOUBLE)+CAST(nk%5 AS DOUBLE)*CAST(1.6 AS DOUBLE)+a*a*a*CAST(0.6 AS DOUBLE) AS lat,
  CAST(-6 AS DOUBLE)+CAST((nk-nk%5) AS DOUBLE)/CAST(5 AS DOUBLE)*CAST(1.9 AS DOUBLE)+b*b*b*CAST(0.8 AS DOUBLE) AS lon FROM b)
SELECT k, customer_id, nk, lat, lon,
  CASE WHEN k%37=0 THEN NULL ELSE CAST(n_orders AS DOUBLE)/CAST(4 AS DOUBLE) END AS visits,
  CASE WHEN k%41=0 THEN NULL ELSE CAST(20+(k%5)*10 AS DOUBLE) END AS minutes,
  CASE WHEN seg='BUILDING' THEN CAST(25 AS DOUBLE) WHEN seg='MACHINERY' THEN CAST(70 AS DOUBLE) END AS speed_kmh,
  concat('P', CAST(CAST(floor(lat*5) AS BIGINT) AS STRING), '_', CAST(CAST(floor(lon*5) AS BIGINT) AS STRING)) AS postal,
  CASE WHEN k%97=0 THEN NULL ELSE area END AS area
FROM g
"""


def demo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DEMO_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def valid(points: DataFrame) -> DataFrame:
    """Finite coordinates in range; visits, minutes and speed positive or null."""
    number = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.col(c))
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return points.filter(ok).withColumns({c: number(c) for c in ("visits", "minutes", "speed_kmh")})
