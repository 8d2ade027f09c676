"""Exact nearest neighbours, per set of keys, by blocks along a space-filling curve.

Points of one spot are folded to the k + 1 least ids, for no one has more neighbours there. Points and seekers are sorted by ranges of set, Morton code and id
into blocks of about BLOCK rows. In a first pass every seeker finds the k nearest points of its own block. Where the block of another part of its set comes
as near as the k-th of them, it looks there too, within that distance; the nearest of all blocks are merged. The driver holds one box per block of sets
that have several.

Inside a block, points and seekers lie in leaves of at most LEAF, halved along the longer side; a leaf of seekers reads the leaves of points whose box
is near enough.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

LEAF, BLOCK, DEPTH = 64, 4000, 26
NEAR = 1 + 1e-9  # boxes are compared with a margin for rounding


def nearest(seek: np.ndarray, have: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, d2, id) of the k nearest of `have` to each of `seek`, ties by id; `ids` rise, `own` is never one's neighbour."""
    d2 = (seek[:, :1] - have[None, :, 0]) ** 2 + (seek[:, 1:] - have[None, :, 1]) ** 2
    d2[own[:, None] == ids[None, :]] = np.inf
    limit = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(seek), np.inf)
    row, col = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
    order = np.lexsort((col, d2[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[rank < k], col[rank < k]
    return row, d2[row, col], ids[col]


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Places of x in groups of at most LEAF, halved at the median of the longer side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        side = x[at, int(np.argmax(np.ptp(x[at], axis=0)))]
        order = np.argpartition(side, len(at) // 2)
        todo += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
    return [at for at in out if len(at)]


def gaps(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of the boxes (lo, hi) from the box or point (a, b)."""
    return (np.maximum(0, np.maximum(lo - b, a - hi)) ** 2).sum(axis=-1)


def search(seek: np.ndarray, own: np.ndarray, have: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `nearest`, for any number of rows, whose ids need no order."""
    rise = np.argsort(ids, kind="stable")
    have, ids = have[rise], ids[rise]
    if not len(have):
        return np.zeros(0, int), np.zeros(0), ids
    cells = leaves(have)
    lo, hi = (np.array([f(have[c], axis=0) for c in cells]) for f in (np.min, np.max))
    count, out = np.array([len(c) for c in cells]), []
    for g in leaves(seek):
        gap = gaps(lo, hi, seek[g].min(axis=0), seek[g].max(axis=0))
        order = np.argsort(gap, kind="stable")
        few = order[:int(np.searchsorted(np.cumsum(count[order]), k + 1)) + 1]
        some = np.concatenate([cells[c] for c in few])
        d2 = (seek[g][:, :1] - have[some, 0]) ** 2 + (seek[g][:, 1:] - have[some, 1]) ** 2
        reach = np.partition(d2, k, axis=1)[:, k].max() if len(some) > k else np.inf  # the seeker itself may be one of them
        some = np.sort(np.concatenate([cells[c] for c in np.flatnonzero(gap <= reach * NEAR)]))
        row, far, other = nearest(seek[g], have[some], ids[some], own[g], k)
        out.append((g[row], far, other))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), ids[:0])


def _lists(rows: pd.DataFrame, names: list[str], found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    """The rows' columns `names` with d2 and other as lists."""
    row, d2, other = found
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(len(rows) + 1))
    cut = lambda v: [v[order[a:b]] for a, b in zip(ends, ends[1:])]
    return pd.DataFrame({**{c: rows[c].to_numpy() for c in names}, "d2": cut(d2), "other": cut(other)})


def knn(points: DataFrame, k: int, keys: list[str] | None = None, seekers: DataFrame | None = None) -> DataFrame:
    """(keys, id, other, rank, d2) of the k nearest others of the same keys in the plane, ties by id, for rows (keys, id, x, y). A null key is a set of its own.

    With `seekers`, rows like points whose ids are apart from theirs, the nearest points of each seeker."""
    keys = keys or []
    one = F.to_json(F.struct(*keys)) if keys else F.lit("")
    spot = Window.partitionBy("_of", "x", "y").orderBy("id")
    right = points.select(*keys, "id", "x", "y", one.alias("_of"))
    folded = right.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") <= k + 1).drop("_r")
    left = right if seekers is None else seekers.select(*keys, "id", "x", "y", one.alias("_of"))
    both = folded.withColumn("seeks", F.lit(False)).unionByName(left.withColumn("seeks", F.lit(True)))
    size = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9))
    boxes = both.groupBy("_of").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), size.alias("extent"))
    both = both.join(boxes, "_of") if keys else both.crossJoin(F.broadcast(boxes.drop("_of")))  # one row
    step = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / F.col("extent") * (2**DEPTH - 1)).cast("long")
    both = both.withColumn("_z", morton_code(step("x"), step("y"))).drop("x0", "y0", "extent")
    both = written(both, "knn-rows")
    n = max(1, math.ceil(both.count() / BLOCK))
    if n > 1:
        both = written(both.repartitionByRange(n, "_of", "_z", "id").withColumn("block", F.spark_partition_id()), "knn-blocks")
        per = both.groupBy("_of", "block").agg(F.count_if(~F.col("seeks")).alias("n"), *[f(F.when(~F.col("seeks"), F.col(c))).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))])
        per = per.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("_of"))).filter("m > 1 and n > 0")
        per = per.toPandas()  # at most two boxes per block
    else:
        both = both.withColumn("block", F.lit(0))
        per = pd.DataFrame({c: [] for c in ("_of", "block", "n", "x0", "x1", "y0", "y1")})
    around = {s: (b["block"].to_numpy(), b["n"].to_numpy(), b[["x0", "y0"]].to_numpy(), b[["x1", "y1"]].to_numpy()) for s, b in per.groupby("_of")}

    def first(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, b in g.groupby("_of", sort=False):
            who, have = b[b["seeks"]].reset_index(drop=True), b[~b["seeks"]]
            if not len(who):
                continue
            at = who[["x", "y"]].to_numpy()
            got = _lists(who, [*keys, "id", "x", "y", "_of"], search(at, who["id"].to_numpy(), have[["x", "y"]].to_numpy(), have["id"].to_numpy(), k))
            more = [[]] * len(who)
            if s in around:
                block, count, lo, hi = around[s]
                reach = np.array([d[-1] if len(d) == k else np.inf for d in got["d2"]])
                if np.isinf(reach).any():  # all points of the nearest boxes that hold k + 1 lie within their farthest corners
                    a, z = at.min(axis=0), at.max(axis=0)
                    corner = (np.maximum(np.abs(hi - a), np.abs(z - lo)).clip(0) ** 2).sum(axis=1)
                    order = np.argsort(corner)
                    enough = np.flatnonzero(np.cumsum(count[order]) > k)
                    reach = np.minimum(reach, corner[order[enough[0]]] if len(enough) else np.inf)
                close = np.flatnonzero((gaps(lo, hi, at.min(axis=0), at.max(axis=0)) <= reach.max() * NEAR) & (block != b["block"].iloc[0]))
                near = gaps(lo[close][None], hi[close][None], at[:, None], at[:, None]) <= reach[:, None] * NEAR
                more = [block[close[m]] for m in near]
            out.append(got.assign(more=more))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (*keys, "id", "x", "y", "_of", "d2", "other", "more")}, dtype=object)

    def second(g: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        sets = dict(list(have.groupby("_of")))
        for s, who in g.groupby("_of", sort=False):
            if s in sets:
                who, b = who.reset_index(drop=True), sets[s]
                out.append(_lists(who, [*keys, "id"], search(who[["x", "y"]].to_numpy(), who["id"].to_numpy(), b[["x", "y"]].to_numpy(), b["id"].to_numpy(), k)))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (*keys, "id", "d2", "other")}, dtype=object)

    types = {f.name: f.dataType.simpleString() for f in both.schema}
    columns = lambda *names: ", ".join(f"`{c}` {types[c]}" for c in names)
    lists = f"d2 array<double>, other array<{types['id']}>"
    found = both.groupBy("block").applyInPandas(first, f"{columns(*keys, 'id', 'x', 'y', '_of')}, {lists}, more array<int>")
    pair = F.arrays_zip("d2", "other").alias("near")
    if around:
        found = written(found, "knn-found")
        ask = found.filter(F.size("more") > 0).select(*keys, "id", "x", "y", "_of", F.explode("more").alias("block"))
        there = ask.groupBy("block").cogroup(both.filter("not seeks").select("id", "x", "y", "_of", "block").groupBy("block")).applyInPandas(second, f"{columns(*keys, 'id')}, {lists}")
        all_ = found.filter(F.size("more") > 0).select(*keys, "id", pair).unionByName(there.select(*keys, "id", pair))
        merged = all_.groupBy(*keys, "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        near = found.filter(F.size("more") == 0).select(*keys, "id", pair).unionByName(merged)
    else:
        near = found.select(*keys, "id", pair)
    return near.select(*keys, "id", F.posexplode("near").alias("p", "e")).select(*keys, "id", "e.other", (F.col("p") + 1).alias("rank"), "e.d2")


def morton_code(x, y):
    """The low DEPTH bits of two whole numbers, interleaved."""
    def spread(v):
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))
