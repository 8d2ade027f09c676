"""Exact deduplication by a stateful stream (operator 2; DataFrame functions only).

Digests of the normalised texts go through Structured Streaming into an aggregation whose RocksDB state never
expires: per digest the best row (most code points, then smallest doc_id), the group's size and the salts its rows use.
Every hit is then compared with the full text of the row that stays.

Null text counts as empty; null doc_id sorts last; rows that repeat doc_id and text share one decision; an empty table
gives an empty result; texts of any length are compared whole; extra columns are ignored by `exact_dedup` and kept by `drop_exact`, but for names that
start with `_exact_`, which are taken.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, text_or_empty, written

BLANKS = " \t\n\x0b\x0c\r"
SALTS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "spark.sql.streaming.stateStore.rocksdb"
# Else every state store reserves some MB of disk for its manifest, whatever it holds, and its own memory; an executor may hold many.
SETTINGS = {
    KEY: PROVIDER, f"{ROCKS}.allowFAllocate": "false", f"{ROCKS}.boundedMemoryUsage": "true", f"{ROCKS}.maxMemoryUsageMB": "256",
    f"{ROCKS}.writeBufferSizeMB": "4"}


def _rows(docs: DataFrame) -> DataFrame:
    norm = F.translate(text_or_empty(), BLANKS, "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.length(text_or_empty()).cast("long").alias("n"),
        F.sha2(norm, 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))


def stream_state(digests: DataFrame) -> DataFrame:
    """Run the digest table through the keyed state; one row per digest."""
    spark = digests.sparkSession
    source, out, check = (shared_dir(spark, f"dedup-{x}") for x in ("in", "state", "stream"))
    digests.write.parquet(source)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(digests.schema).parquet(source).groupBy("digest").agg(
                F.max(F.struct("n", (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("neg"), F.col("doc_id").alias("locator"))).alias("best"),
                F.count(F.lit(1)).alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")))
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True)
            .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, best struct<n:long,neg:long,locator:long>, group_size long, salts long, batch int"
    return (
        spark.read.schema(schema).option("basePath", out).parquet(out)
        if not digests.isEmpty() else spark.createDataFrame([], schema))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = _rows(docs)
    state = stream_state(rows.select("doc_id", "n", "digest", "salt"))
    state = state.groupBy("digest").agg(F.max_by(F.struct("best", "group_size", "salts"), "batch").alias("s")).select("digest", "s.*")
    # a state row goes only to the salts its rows use, so that a hot digest is spread and nothing multiplies
    dealt = state.select(
        "digest", F.col("best.locator").alias("keep_id"), "group_size", "salts",
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftrightunsigned(salts, s) & 1L = 1L)")).alias("salt"))
    joined = rows.join(dealt, ["digest", "salt"]).withColumn("norm", F.when(F.col("group_size") > 1, F.col("norm")))
    joined = written(joined, "dedup-rows")
    hits, single = joined.filter("group_size > 1"), joined.filter("group_size = 1")
    keepers = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "salts").agg(F.min("norm").alias("keep_norm"))
    keepers = keepers.select("digest", "keep_norm", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftrightunsigned(salts, s) & 1L = 1L)")).alias("salt"))
    same = F.when(F.col("norm") == F.col("keep_norm"), True).otherwise(F.raise_error(F.lit("different texts share a digest")).cast("boolean"))
    hits = hits.join(keepers, ["digest", "salt"], "left").filter(same)
    out = lambda df: df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    return out(single).unionByName(out(hits))


def one_per(docs: DataFrame, key: str) -> DataFrame:
    """Of rows with equal doc_id and key the one with the longest text stays, then the greatest digest of the text."""
    row = F.struct(*docs.columns)
    order = F.struct(F.length(text_or_empty()).alias("n"), (F.col("text").isNotNull()).alias("is_text"), F.sha2(text_or_empty(), 256).alias("sha"))
    best = docs.groupBy(F.col("doc_id").alias("_exact_id"), F.col(key).alias("_exact_key")).agg(F.max_by(row, order).alias("_exact_row"))
    return best.select("_exact_row.*")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows that stay, columns as given; of rows that repeat doc_id and normalised text one stays, different texts under one doc_id all do."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_exact_keep"), F.col("text_sha256").alias("_exact_sha")).distinct()
    rows = one_per(docs.withColumn("_exact_digest", F.sha2(F.translate(text_or_empty(), BLANKS, ""), 256)), "_exact_digest")
    return rows.join(kept, (F.col("_exact_digest") == F.col("_exact_sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_exact_keep")), "left_semi").drop("_exact_digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text,'')) AS n, sha256(regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
