"""Connected components by contraction: every node goes to the one of its neighbours and itself that comes first in a random order, until few edges are left.

The order is another hash in each round, so that the nodes fall by a constant share whatever the graph's shape (a long path too), and rounds are few.
HELD edges and fewer are finished in one task. Then the names go back round by round, each over that round's nodes alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written

HELD = 200_000


def least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of the nodes 0 to n - 1 the least that the edges (a, b) reach: roots hang themselves on the least root beside them, then all ways are cut short."""
    top = np.arange(n)
    while True:
        new = top.copy()
        np.minimum.at(new, top[a], top[b])
        np.minimum.at(new, top[b], top[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            return top
        top = new


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, c): the least node of its component for every node of the edges (a, b)."""
    e = pd.concat(batches, ignore_index=True)
    codes, names = pd.factorize(pd.concat([e["a"], e["b"]], ignore_index=True), sort=True)
    top = least(codes[:len(e)], codes[len(e):], len(names))
    yield pd.DataFrame({"a": names, "c": names[top]})


def components(edges: DataFrame, held: int | None = None) -> DataFrame:
    """a, class (the least node of a's component) for every node of the edges (a, b)."""
    held = HELD if held is None else held
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna().distinct(), "graph-edges")
    kind, rounds, names = both.schema["a"].dataType.simpleString(), [], None
    while (left := both.count()) or not rounds:
        if left <= held:
            to = both.coalesce(1).mapInPandas(_finished, f"a {kind}, c {kind}") if left else both.select("a", F.col("a").alias("c"))
        else:
            first = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("c"))
            to = both.groupBy("a").agg(F.least(F.min(first("b")), first("a")).alias("m")).select("a", "m.c")
        # of every node that goes on the least node that it stands for
        to = to if names is None else to.join(names.withColumnRenamed("c", "a"), "a")
        to = written(to.withColumn("least", F.col("a")) if names is None else to, "graph-round")
        names = to.groupBy("c").agg(F.min("least").alias("least"))
        rounds.append(to)
        if left <= held:
            break
        at = lambda c, n: to.select(F.col("a").alias(c), F.col("c").alias(n))
        fewer = written(both.join(at("a", "p"), "a").join(at("b", "q"), "b").filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "graph-edges")
        forget(both)
        both = fewer
    label = None
    for to in reversed(rounds):
        own = to.groupBy("c").agg(F.min("least").alias("own"))
        known = own if label is None else own.join(label.select(F.col("a").alias("c"), "class"), "c", "left")
        known = known.select("c", (F.col("own") if label is None else F.coalesce("class", "own")).alias("class"))
        after = written(to.select("a", "c").join(known, "c").select("a", "class"), "graph-label")
        if label is not None:
            forget(label)
        label = after
    forget(both, *rounds)
    return label
