"""Colours of territories in rounds: no two near each other share one (Jones-Plassmann)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .knn import knn

NEAREST = 6


def conflicts(centres: DataFrame, keys: list[str], nearest: int = NEAREST) -> DataFrame:
    """a, b in both directions: one of the two is among the other's nearest of the same keys. Rows (keys, name, x, y)."""
    at = written(centres.withColumn("id", F.monotonically_increasing_id()), "colour-centres")
    near = knn(at, nearest, keys).select("id", "other")
    named = near.join(at.select("id", F.col("name").alias("a")), "id").join(at.select(F.col("id").alias("other"), F.col("name").alias("b")), "other").select("a", "b")
    return named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def coloured(names: DataFrame, pairs: DataFrame, order: Column | None = None) -> DataFrame:
    """name, colour (from 0): every one takes the least colour that none of its neighbours before it in the order has.

    In a round all take theirs whose neighbours before them have one. The order is by hash, so that few rounds are needed; a neighbourhood's colours fit in a
    row, for near territories have few near each other."""
    rank = F.md5(F.col("name").cast("string")) if order is None else order
    todo = written(names.select("name", rank.alias("rank")), "colour-todo")
    before = pairs.join(todo.select(F.col("name").alias("a"), F.col("rank").alias("ra")), "a").join(todo.select(F.col("name").alias("b"), F.col("rank").alias("rb")), "b")
    before = written(before.filter(F.struct("rb", "b") < F.struct("ra", "a")).select(F.col("a").alias("name"), F.col("b").alias("first")), "colour-before")
    done = written(todo.select("name", F.lit(0).alias("colour")).limit(0), "colour-done")
    while not todo.isEmpty():
        of = before.join(todo.select("name"), "name").join(done.withColumnRenamed("name", "first"), "first", "left")
        per = of.groupBy("name").agg(F.count_if(F.col("colour").isNull()).alias("waits"), F.collect_set("colour").alias("taken"))
        ready = todo.join(per, "name", "left").filter(F.coalesce("waits", F.lit(0)) == 0)
        taken = F.coalesce("taken", F.array().cast("array<int>"))
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))
        new = written(done.unionByName(ready.select("name", least.alias("colour"))), "colour-done")
        rest = written(todo.join(new.select("name"), "name", "left_anti"), "colour-todo")
        forget(done, todo)
        done, todo = new, rest
    return done
