"""Small helpers shared by the corpus operators."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, of this application beside the warehouse's tables, which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.mode("overwrite").parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove tables made by `written` that no plan reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleaned(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished steps now: it does so when the driver's garbage is collected, which may come long after the disk is full."""
    spark.sparkContext._jvm.System.gc()


BATCH = 512


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Steps that are written inside hand Python at most so many rows at a time: a batch of texts is held several times over, in the JVM and the worker, by every running task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`; higher-order functions would else repeat it per element."""
    return F.transform(F.array(value), body)[0]


SALTS = 64


def salt_of(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salts_used() -> Column:
    """Aggregate: a bit per salt that the group's rows use."""
    return F.bit_or(F.expr("shiftleft(1L, salt)"))


def dealt(per_key: DataFrame) -> DataFrame:
    """One copy of a key's row per salt in use: joins on (key, salt) spread hot keys and multiply nothing."""
    cols = [c for c in per_key.columns if c != "salts"]
    return per_key.select(*cols, F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftrightunsigned(salts, s) & 1L = 1L)")).alias("salt"))
