"""The folder that the cluster shares: cutting lineage, and results kept by content."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[str] = []  # folders of tables written by this application and not removed yet


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this application beside the warehouse's tables, unless that is a folder of one machine and the cluster has several."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local" and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
    return f"{warehouse}/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again. The folder goes when it is forgotten, when the kept result that it is part of is complete, or with the application."""
    spark = df.sparkSession
    path = f"{base_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables made by `written` that no plan reads any more."""
    _remove(tables[0].sparkSession, [t.kept_at for t in tables])


def release(spark: SparkSession) -> None:
    """Remove all tables made by `written` so far: for when the results that read them have been used."""
    _remove(spark, list(_made))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path, fs = _path(spark, name)
        fs.delete(path, True)
        if name in _made:
            _made.remove(name)


def fingerprint(df: DataFrame) -> str:
    """Content of a table, whatever the order of its rows: count, and exclusive or and sum of row hashes."""
    row = F.xxhash64(*df.columns)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(2**31 - 1))).alias("s")).first()
    return "-".join(str(v if v is not None else 0) for v in got)


def _code() -> str:
    """Of the library's own files, so that a change of any operator makes new results."""
    top = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for f in sorted(p for d in ("functions", "operators", "plans", "sources") for p in (top / d).glob("*.py")):
        digest.update(f.read_bytes())
    return digest.hexdigest()


CODE = _code()


def kept(sources: DataFrame | list[DataFrame], label: str, params, build: Callable[..., DataFrame]) -> DataFrame:
    """build(*sources), kept in the shared folder by the content and columns of all its sources, the parameters and the code, and read from there the next time.

    `build` must read no other table. The result is written under another name and moved when complete; of two applications the first wins."""
    sources = sources if isinstance(sources, list) else [sources]
    spark = sources[0].sparkSession
    mark = repr((CODE, params, [(t.columns, fingerprint(t)) for t in sources]))
    at = f"{base_dir(spark)}/kept-{label}-{hashlib.sha256(mark.encode()).hexdigest()[:32]}"
    to, fs = _path(spark, at)
    if not fs.exists(to):
        before = len(_made)
        fresh, _ = _path(spark, f"{base_dir(spark)}/new-{uuid.uuid4().hex}")
        build(*sources).write.parquet(fresh.toString())
        if fs.exists(to) or not fs.rename(fresh, to):
            fs.delete(fresh, True)
        _remove(spark, _made[before:])
    return spark.read.parquet(at)
