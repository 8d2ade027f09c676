"""Length buckets by dynamic programming, then token-budget batches (operator 7).

Lengths are tokens as operator 5 counts them (at least 1) unless a length column is named. The histogram has every length that
occurs, so the driver sees as many rows as there are different lengths, never more than the longest row has tokens.
Inside a bucket, rows are dealt to shards of about SHARD rows and batches form per shard: as many rows as the budget holds when each is
padded to the bucket's bound.

A row longer than the budget is a batch of its own, beyond it. Null and empty texts have length 1; null and repeated doc_ids and
repeated rows are packed one by one like all others; very long texts are taken whole; an empty table gives an empty result; extra columns
stay, but for `n_tokens`, `bucket`, `batch_id` and `padding`, which are overwritten, and names that start with `_pack`, which are taken.
"""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table, written
from .token_counts import count_tokens

BUCKETS, BUDGET, SHARD = 16, 65536, 20000


def boundaries(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """Upper bounds of at most k buckets that minimise sum(count * (bound - length)), for rising lengths and positive counts.

    A round adds a bucket: new[j] = min over i < j of best[i] + x[j] * (c[j] - c[i]), lines in x[j] whose slopes fall, so their
    lower envelope is kept as it grows and each round is linear.
    """
    n, c = len(lengths), [0, *accumulate(counts)]
    best, back = [0] + [None] * n, []
    for _ in range(min(k, n)):
        new, arg, hull, at = [0] + [None] * n, [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i, x = j - 1, lengths[j - 1]
            if best[i] is not None:
                while len(hull) - at > 1:  # the last line is nowhere least between its neighbours
                    p, q = hull[-2], hull[-1]
                    if (best[i] - best[p]) * (c[q] - c[p]) > (best[q] - best[p]) * (c[i] - c[p]):
                        break
                    hull.pop()
                hull.append(i)
            cost = lambda h: best[h] + x * (c[j] - c[h])
            while len(hull) - at > 1 and cost(hull[at + 1]) <= cost(hull[at]):
                at += 1
            new[j], arg[j] = cost(hull[at]), hull[at]
        best = new
        back.append(arg)
    out, j = [], n
    for arg in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = arg[j]
    return sorted(out)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs with n_tokens, bucket (its upper bound), batch_id and padding."""
    if length is None:
        docs, length = count_tokens(docs), F.greatest("n_tokens", F.lit(1))
    names = [c for c in docs.columns if c not in ("n_tokens", "bucket", "batch_id", "padding")]
    rows = docs.withColumn("_pack_n", length.cast("long")).withColumn("_pack_row", F.monotonically_increasing_id())
    rows = written(rows.select(*names, "_pack_n", "_pack_row"), "packing-lengths")
    hist = rows.groupBy(F.col("_pack_n").alias("c")).count().orderBy("c").collect()  # bounded by the longest length
    bounds = boundaries([r["c"] for r in hist], [r["count"] for r in hist], buckets) or [1]
    sizes = [max(1, sum(r["count"] for r in hist if a < r["c"] <= b)) for a, b in zip([0, *bounds], bounds)]
    array = lambda v: F.array(*[F.lit(int(i)).cast("long") for i in v])
    rows = rows.withColumn("_pack_b", F.size(F.filter(array(bounds), lambda x: x < F.col("_pack_n"))))
    rows = rows.withColumn("bucket", F.element_at(array(bounds), F.col("_pack_b") + 1))
    shards = F.element_at(array([-(-s // SHARD) for s in sizes]), F.col("_pack_b") + 1)
    rows = rows.withColumn("_pack_shard", F.pmod(F.xxhash64("_pack_row"), shards))
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("_pack_b", "_pack_shard").orderBy("_pack_row"))
    return rows.withColumn("_pack_slot", F.floor((rank - 1) / per)).select(
        *names, F.col("_pack_n").alias("n_tokens"), "bucket", F.concat_ws("-", "_pack_b", "_pack_shard", "_pack_slot").alias("batch_id"), (F.col("bucket") - F.col("_pack_n")).alias("padding"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(counted.select("doc_id", "n_tokens"), F.greatest("n_tokens", F.lit(1)))
