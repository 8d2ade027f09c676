"""Commercial areas: by a field, or made from units by weighted k-means, with islands apart, repaired to one piece each.

Units are rows (unit, n, weight, x, y, state_id, group_id).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.regions import touching
from ..sources.shared import forget, written
from .components import components
from .proximity import gabriel, nearest_where

RESTARTS, STEPS, SAMPLE, ROUNDS, PASSES = 24, 50, 4096, 30, 5
SMALL_UNIT, VOTERS, SHARE, NEAR_KM, CLOSE_KM = 30, 10, 0.6, 120.0, 10.0


def field_areas(points: DataFrame, label: str = "area") -> DataFrame:
    """The points with area (empty as "(no area)") and area_id, numbered by the raw labels in order; labels are few, so their window is small."""
    raw = points.withColumn("_raw", F.coalesce(F.col(label), F.lit("")))
    ids = raw.select("_raw").distinct().withColumn("area_id", (F.dense_rank().over(Window.orderBy("_raw")) - 1).cast("int"))
    return raw.join(ids, "_raw").withColumn("area", F.when(F.col("_raw") == "", "(no area)").otherwise(F.col("_raw"))).drop("_raw")


def main_group(units: DataFrame) -> DataFrame:
    """group_id, load, is_main: the land group with most load (ties to the least) is the mainland; unknown groups (-1) are part of none."""
    per = units.filter("group_id >= 0").groupBy("group_id").agg(F.round(F.sum("weight"), 6).alias("load"))
    best = per.agg(F.min(F.struct((-F.col("load")).alias("l"), "group_id")).alias("m")).select(F.col("m.group_id").alias("main"))
    return per.crossJoin(F.broadcast(best)).withColumn("is_main", F.col("group_id") == F.col("main")).drop("main")  # one row


def islands(units: DataFrame, names: DataFrame) -> DataFrame:
    """group_id, island (from 0, by group), name of every group off the mainland: its state with most load, and +N for N more."""
    off = units.join(main_group(units).filter("not is_main").select("group_id"), "group_id")
    per = off.groupBy("group_id", "state_id").agg(F.round(F.sum("weight"), 6).alias("w"))
    per = per.groupBy("group_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "state_id")).alias("m"), F.count(F.lit(1)).alias("k"))
    out = per.select("group_id", "k", F.col("m.state_id").alias("state_id")).join(names.select("state_id", "name"), "state_id", "left")
    more = F.when(F.col("k") > 1, F.concat(F.lit(" +"), (F.col("k") - 1).cast("string"))).otherwise("")
    return out.select("group_id", (F.row_number().over(Window.orderBy("group_id")) - 1).alias("island"), F.concat("name", more).alias("name"))  # a row per island


def _seeds(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k places, each drawn by weight times the squared distance from those before."""
    r = np.random.default_rng(seed)
    out = [x[r.choice(len(x), p=w / w.sum())]]
    far = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < k:
        p = far * w
        out.append(x[r.choice(len(x), p=p / p.sum() if p.sum() > 0 else None)])
        far = np.minimum(far, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def kmeans(units: DataFrame, k: int) -> DataFrame:
    """unit, area (0 to k - 1): weighted k-means, the best of RESTARTS starts, which all advance in the same jobs.

    Starts are drawn from at most SAMPLE units, taken by hash; every step runs over all. The driver holds RESTARTS * k centres."""
    some = units.orderBy(F.xxhash64("unit")).limit(SAMPLE).select("x", "y", "weight").toPandas()
    if not len(some):
        return units.select("unit", F.lit(0).alias("area"))
    k = min(k, len(some))
    centres = np.stack([_seeds(some[["x", "y"]].to_numpy(), np.maximum(some["weight"].to_numpy(), 1e-9), k, i) for i in range(RESTARTS)])

    def step(at: np.ndarray) -> pd.DataFrame:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((RESTARTS, k, 4))
            for b in batches:
                x, w = b[["x", "y"]].to_numpy(), b["weight"].to_numpy()
                for i in range(RESTARTS):
                    d = ((x[:, None, :] - at[i][None, :, :]) ** 2).sum(axis=2)
                    c = d.argmin(axis=1)
                    for j, v in enumerate((w, w * x[:, 0], w * x[:, 1], w * d.min(axis=1))):
                        sums[i, :, j] += np.bincount(c, v, k)
            i, c = np.divmod(np.arange(RESTARTS * k), k)
            yield pd.DataFrame({"i": i, "c": c, **{n: sums.reshape(-1, 4)[:, j] for j, n in enumerate(("w", "x", "y", "cost"))}})

        sums = units.select("x", "y", "weight").mapInPandas(partial, "i int, c int, w double, x double, y double, cost double")
        return sums.groupBy("i", "c").agg(*[F.sum(n).alias(n) for n in ("w", "x", "y", "cost")]).toPandas().sort_values(["i", "c"])

    for _ in range(STEPS):
        got = step(centres)
        w = got["w"].to_numpy().reshape(RESTARTS, k, 1)
        new = np.where(w > 0, got[["x", "y"]].to_numpy().reshape(RESTARTS, k, 2) / np.maximum(w, 1e-300), centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-6:
            break
    cost = step(centres).groupby("i")["cost"].sum().round(6)
    best = centres[int(cost.idxmin())]
    d = [F.struct(((F.col("x") - float(a)) * (F.col("x") - float(a)) + (F.col("y") - float(b)) * (F.col("y") - float(b))).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(best)]
    return units.select("unit", F.array_min(F.array(*d))["i"].alias("area"))


def unit_edges(points: DataFrame, units: DataFrame, adjacency: DataFrame) -> DataFrame:
    """u, v (u < v), km: units with clients that are neighbours in the Gabriel graph, where the units' states touch, with their clients' least distance."""
    of = lambda i, u: points.select(F.col("id").alias(i), F.col("unit").alias(u))
    pairs = gabriel(points).join(of("id", "p"), "id").join(of("other", "q"), "other").filter("p <> q")
    pairs = pairs.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.sqrt(F.min("d2")).alias("km"))
    state = lambda u, s: units.select(F.col("unit").alias(u), F.col("state_id").cast("int").alias(s))
    return touching(pairs.join(state("u", "s"), "u").join(state("v", "t"), "v"), adjacency).filter("touch").select("u", "v", "km")


def pieces(units: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, area, weight, piece: the least unit that units of the same area reach over edges."""
    of = lambda u, a: units.select(F.col("unit").alias(u), F.col("area").alias(a))
    inner = edges.join(of("u", "au"), "u").join(of("v", "av"), "v").filter("au = av").select(F.col("u").alias("a"), F.col("v").alias("b"))
    label = components(inner).select(F.col("a").alias("unit"), F.col("class").alias("piece"))
    return units.select("unit", "area", "weight").join(label, "unit", "left").withColumn("piece", F.coalesce("piece", "unit"))


def cut_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """area, other, edges: how many edges cross between two areas."""
    of = lambda u, a: units.select(F.col("unit").alias(u), F.col("area").alias(a))
    both = edges.join(of("u", "au"), "u").join(of("v", "av"), "v").filter("au <> av")
    return both.groupBy(F.least("au", "av").alias("area"), F.greatest("au", "av").alias("other")).agg(F.count(F.lit(1)).alias("edges"))


def homes_of(lost: DataFrame, at: DataFrame, places: DataFrame, adjacency: DataFrame) -> DataFrame:
    """piece, area, to: for pieces (unit, area, piece) without a border the area of the nearest unit outside whose state is the same or touches, else of one of the same land.

    Units of islands and of the mainland do not mix, and a unit of no known state seeks none. `at` has every unit's area and piece, `places` their x, y, state_id, group_id, is_island."""
    all_ = written(places.join(at.select("unit", "area", "piece"), "unit").withColumn("id", F.monotonically_increasing_id()), "homes-units")
    seek = lost.join(all_.drop("area", "piece"), "unit").filter("state_id >= 0").withColumn("id", -1 - F.col("id"))
    seek = written(seek, "homes-seekers")
    own = seek.select("id", F.col("piece").alias("_piece"), F.col("is_island").alias("_island"), F.col("group_id").alias("_group"), F.col("state_id").cast("int").alias("s"))
    theirs = all_.select(F.col("id").alias("other"), "piece", "is_island", "group_id", F.col("state_id").cast("int").alias("t"), F.col("area").alias("to"))
    outside = lambda near: near.join(own, "id").join(theirs, "other").filter("piece <> _piece and is_island = _island")
    by_land = lambda near: touching(outside(near), adjacency).filter("touch").select("id", "other", "d2", "to")
    by_group = lambda near: outside(near).filter("group_id = _group").select("id", "other", "d2", "to")
    found = [nearest_where(all_, 1, seek, rule).withColumn("rule", F.lit(i)) for i, rule in enumerate((by_land, by_group))]
    near = found[0].unionByName(found[1]).join(seek.select("id", "piece", "area"), "id")
    return near.groupBy("piece", "area").agg(F.min(F.struct("rule", "d2", "other", "to")).alias("m")).select("piece", "area", F.col("m.to").alias("to")).filter("to <> area")


def repair(units: DataFrame, edges: DataFrame, places: DataFrame | None = None, adjacency: DataFrame | None = None) -> DataFrame:
    """unit, area, weight with every area in one piece: loose pieces move whole to the area with most border, those without a border, where `places` is given, as `homes_of` says.

    In a round at most one piece, the least, moves between two areas, so that no two trade places; a piece without a home stays."""
    units = written(units.select("unit", "area", "weight"), "repair-units")
    for _ in range(ROUNDS):
        at = written(pieces(units, edges), "repair-pieces")
        size = at.groupBy("area", "piece").agg(F.round(F.sum("weight"), 6).alias("w"))
        heaviest = size.groupBy("area").agg(F.min(F.struct((-F.col("w")).alias("w"), "piece")).alias("m")).select("area", F.col("m.piece").alias("main"))
        loose = written(at.join(heaviest, "area").filter("piece <> main").select("unit", "area", "piece"), "repair-loose")
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        border = loose.withColumnRenamed("unit", "u").join(both, "u").join(at.select(F.col("unit").alias("v"), F.col("area").alias("to")), "v").filter("to <> area")
        count = border.groupBy("piece", "area", "to").agg(F.count(F.lit(1)).alias("n"))
        best = count.groupBy("piece", "area").agg(F.min(F.struct((-F.col("n")).alias("n"), "to")).alias("b")).select("piece", "area", F.col("b.to").alias("to"))
        best = written(best, "repair-best")
        lost = loose.join(best.select("piece"), "piece", "left_anti")
        if places is not None and not lost.isEmpty():
            best = best.unionByName(homes_of(lost, at, places, adjacency))
        moves = best.groupBy(F.least("area", "to").alias("p"), F.greatest("area", "to").alias("q")).agg(F.min(F.struct("piece", "to")).alias("m"))
        moves = written(moves.select("m.piece", F.col("m.to").alias("to")), "repair-moves")
        if moves.isEmpty():
            forget(at, moves)
            break
        new = written(at.join(moves, "piece", "left").select("unit", F.coalesce("to", "area").alias("area"), "weight"), "repair-units")
        forget(units, at, moves)
        units = new
    return units


def voters(units: DataFrame, among: DataFrame, points: DataFrame, adjacency: DataFrame) -> DataFrame:
    """unit, other_unit, km: of every small one of `units` the VOTERS nearest clients, within NEAR_KM of its centre, of other units `among` whose states touch."""
    small = written(units.filter(F.col("n") <= SMALL_UNIT).withColumn("id", -1 - F.monotonically_increasing_id()), "vote-units")
    own = small.select("id", "unit", F.col("state_id").cast("int").alias("s"))
    other = points.select(F.col("id").alias("other"), F.col("unit").alias("other_unit")).join(among.select(F.col("unit").alias("other_unit"), F.col("state_id").cast("int").alias("t")), "other_unit")
    allowed = lambda near: touching(near.join(own, "id").join(other, "other").filter("unit <> other_unit"), adjacency).filter("touch").drop("s", "t", "touch")
    near = nearest_where(points, VOTERS, small, allowed, NEAR_KM)
    return near.select("unit", "other_unit", F.sqrt("d2").alias("km"))


def vote(units: DataFrame, heard: DataFrame) -> DataFrame:
    """unit, area, vote, share: the area with most of the voters' inverse distance, 1 / (km + 0.5); ties go to the own area, then to the least."""
    at = units.select("unit", "area")
    near = heard.join(at, "unit").join(at.select(F.col("unit").alias("other_unit"), F.col("area").alias("vote")), "other_unit")
    per = near.groupBy("unit", "area", "vote").agg(F.sum(1 / (F.col("km") + 0.5)).alias("w"))
    best = per.groupBy("unit", "area").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), (F.col("vote") != F.col("area")).alias("other"), "vote")).alias("b"), F.sum("w").alias("total"))
    return best.select("unit", "area", F.col("b.vote").alias("vote"), (-F.col("b.w") / F.col("total")).alias("share"))


def stray_vote(units: DataFrame, points: DataFrame, adjacency: DataFrame) -> DataFrame:
    """unit, area, vote, share of small units."""
    return vote(units, voters(units, units, points, adjacency))


def settled(units: DataFrame, edges: DataFrame, heard: DataFrame, below: int, places: DataFrame, adjacency: DataFrame) -> DataFrame:
    """unit, area, weight after at most PASSES votes of strays, each followed by a repair. A unit moves to an area under `below` with more than SHARE of its voters; voters within CLOSE_KM count as neighbours."""
    close = heard.filter(F.col("km") <= CLOSE_KM).select(F.least("unit", "other_unit").alias("u"), F.greatest("unit", "other_unit").alias("v"), "km")
    edges = written(edges.unionByName(close).groupBy("u", "v").agg(F.min("km").alias("km")), "area-edges")
    for _ in range(PASSES):
        strays = written(vote(units, heard).filter((F.col("share") > SHARE) & (F.col("vote") != F.col("area")) & (F.col("vote") < below)), "area-strays")
        if strays.isEmpty():
            break
        moved = units.join(strays.select("unit", "vote"), "unit", "left").withColumn("area", F.coalesce("vote", "area")).drop("vote")
        units = repair(moved, edges, places, adjacency)
    return units


def automatic(units: DataFrame, points: DataFrame, adjacency: DataFrame, names: DataFrame, n_areas: int) -> DataFrame:
    """unit, area_id, area (name): k-means on the mainland, an area per island, one piece each, strays moved; numbered mainland first, from north to south."""
    groups = main_group(units)
    off = written(islands(units, names), "area-islands")
    land = units.join(groups.select("group_id", "is_main"), "group_id", "left").withColumn("is_island", ~F.coalesce("is_main", F.lit(True)))
    land = written(land, "area-land")
    k = max(1, min(n_areas, land.filter("not is_island").count()))
    start = kmeans(land.filter("not is_island"), k).unionByName(land.filter("is_island").join(off, "group_id").select("unit", (F.col("island") + k).cast("int").alias("area")))
    edges = written(unit_edges(points, units, adjacency), "area-edges")
    places = land.select("unit", "x", "y", "state_id", "group_id", "is_island")
    first = repair(units.join(start, "unit"), edges, places, adjacency)
    heard = written(voters(land.filter("not is_island"), units, points, adjacency), "area-voters")
    out = units.join(settled(first, edges, heard, k, places, adjacency).select("unit", "area"), "unit")
    order = out.groupBy("area").agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("north"))
    order = order.withColumn("area_id", (F.row_number().over(Window.orderBy(F.col("area") >= k, F.desc("north"), "area")) - 1).cast("int"))  # a row per area
    order = order.join(off.select((F.col("island") + k).alias("area"), "name"), "area", "left")
    number = F.count_if(F.col("name").isNull()).over(Window.orderBy("area_id"))
    named = order.select("area", "area_id", F.coalesce("name", F.concat(F.lit("Area "), number.cast("string"))).alias("area_name"))
    return out.join(named, "area").select("unit", "area_id", F.col("area_name").alias("area"))
