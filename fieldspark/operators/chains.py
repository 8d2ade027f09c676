"""Chains of clients between territories, and territories dissolved into their neighbours' room. Centres stay where they are.

Options are rows (id, c, d2, amount): what client id costs in territory c, for the few territories near it, its own among them; homes are rows (id, c).
The cheapest way out of a to b is the client whose squared distance grows least; ways out that follow one another are chains, whose costs are
min-plus products of at most STEPS factors, by joins. All clients seek in the same round, and chains that share no territory are applied together.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .matching import matching

STEPS, SWEEPS = 6, 6


def state(options: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves: id, a, b, cost, gain side negative, own and next amount; loads: c, load) of the homes."""
    at = options.join(homes, ["id", "c"]).select("id", F.col("c").alias("a"), F.col("d2").alias("_d2"), F.col("amount").alias("own"))
    loads = at.groupBy(F.col("a").alias("c")).agg(F.sum("own").alias("load"))
    moves = options.join(at, "id").filter("c <> a").select("id", "a", F.col("c").alias("b"), (F.col("d2") - F.col("_d2")).alias("cost"), "own", F.col("amount").alias("next"))
    return moves, loads


def ways_out(moves: DataFrame) -> DataFrame:
    """Of every pair of territories the move that costs least; ties go to the least id."""
    best = moves.groupBy("a", "b").agg(F.min(F.struct("cost", "id", "own", "next")).alias("m"))
    return best.select("a", "b", "m.*")


def chain_costs(ways: DataFrame, loads: DataFrame, cap: float, steps: int = STEPS) -> DataFrame:
    """Ways out with total and path (their clients): the cheapest chain of at most `steps` that begins with them and ends where there is room.

    After a way out to b comes one from b by another client whose leaving makes room for the first."""
    ways = written(ways.join(loads.select(F.col("c").alias("b"), "load"), "b"), "chain-ways")
    link = lambda w: F.array(F.struct("id", "a", "b")) if w is None else F.concat(F.array(F.struct("id", "a", "b")), w)
    best = written(ways.filter(F.col("load") + F.col("next") <= cap).withColumn("total", F.col("cost")).withColumn("path", link(None)), "chain-best")
    names = best.columns
    for _ in range(steps - 1):
        after = best.select(F.col("a").alias("b"), F.col("id").alias("_id"), F.col("own").alias("_own"), F.col("total").alias("_total"), F.col("path").alias("_path"))
        longer = ways.join(after, "b").filter((F.col("id") != F.col("_id")) & (F.col("load") - F.col("_own") + F.col("next") <= cap))
        longer = longer.withColumn("total", F.col("cost") + F.col("_total")).withColumn("path", link(F.col("_path"))).select(*names)
        rest = [c for c in names if c not in ("a", "b")]
        both = best.unionByName(longer).groupBy("a", "b").agg(F.min_by(F.struct(*rest), F.struct("total", F.size("path"), F.transform("path", lambda x: x["id"]))).alias("m"))
        best = written(both.select("a", "b", "m.*").select(*names), "chain-best")
    return best


def entries(moves: DataFrame, ways: DataFrame, loads: DataFrame, cap: float, steps: int = STEPS) -> DataFrame:
    """id, total, path: of every client that would be nearer elsewhere the cheapest change, direct or by a chain, that shortens the total and goes through no territory twice."""
    wish = written(moves.filter("cost < 0").join(loads.select(F.col("c").alias("b"), "load"), "b"), "chain-wishes")
    first = F.array(F.struct("id", "a", "b"))
    direct = wish.filter(F.col("load") + F.col("next") <= cap).select("id", "a", F.col("cost").alias("total"), first.alias("path"))
    costs = chain_costs(ways, loads, cap, steps).select(F.col("a").alias("b"), F.col("id").alias("_id"), F.col("own").alias("_own"), F.col("total").alias("_total"), F.col("path").alias("_path"))
    by_chain = wish.join(costs, "b").filter((F.col("id") != F.col("_id")) & (F.col("load") - F.col("_own") + F.col("next") <= cap))
    by_chain = by_chain.select("id", "a", (F.col("cost") + F.col("_total")).alias("total"), F.concat(first, "_path").alias("path")).filter("total < -1e-9")
    through = F.concat(F.array("a"), F.transform("path", lambda x: x["b"]))
    simple = direct.unionByName(by_chain).withColumn("through", through).filter(F.size("through") == F.size(F.array_distinct("through")))
    return simple.groupBy("id").agg(F.min(F.struct("total", "path", "through")).alias("m")).select("id", "m.*")


def apart(chains: DataFrame) -> DataFrame:
    """Chains (id, total, path, through) that are best, ties by id, in each territory that they touch."""
    each = chains.select("id", "total", F.explode("through").alias("c"), F.size("through").alias("k"))
    best = each.groupBy("c").agg(F.min(F.struct("total", "id", "k")).alias("m"))
    agreed = best.groupBy("m.id", "m.k").agg(F.count(F.lit(1)).alias("n")).filter("n = k").select("id")
    return chains.join(agreed, "id", "left_semi")


def moved(homes: DataFrame, to: DataFrame) -> DataFrame:
    """Homes after the moves (id, b)."""
    return homes.join(to, "id", "left").select("id", F.coalesce("b", "c").alias("c"))


def reclaimed(options: DataFrame, homes: DataFrame, cap: float, sweeps: int | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """Homes after at most `sweeps` (SWEEPS) rounds of direct moves and chains: the sum of squared distances falls in each, and no load above the cap rises.

    Clients of `fixed` (id) stay."""
    homes = written(homes.select("id", "c"), "chain-homes")
    for _ in range(sweeps or SWEEPS):
        moves, loads = state(options, homes)
        moves = written(moves if fixed is None else moves.join(fixed.select("id"), "id", "left_anti"), "chain-moves")
        loads = written(loads, "chain-loads")
        chosen = written(apart(written(entries(moves, ways_out(moves), loads, cap), "chain-entries")), "chain-chosen")
        if chosen.isEmpty():
            break
        new = written(moved(homes, chosen.select(F.explode("path").alias("m")).select("m.id", "m.b")), "chain-homes")
        forget(homes, moves, loads)
        homes = new
    return homes


def dissolved(options: DataFrame, homes: DataFrame, cap: float, short: float) -> DataFrame:
    """Homes after territories with a load below `short` went, all members or none, to others' room.

    In a round those try whose load is least among the short ones within their members' reach; their members are matched to
    territories that do not try, nearest first. Those that could not place all stay and do not try again."""
    homes, tried = written(homes.select("id", "c"), "dissolve-homes"), None
    while True:
        moves, loads = (written(t, "dissolve-state") for t in state(options, homes))
        low = loads.filter(F.col("load") < short)
        low = written(low if tried is None else low.join(tried, "c", "left_anti"), "dissolve-low")
        if low.isEmpty():
            return homes
        reach = moves.select("a", "b").distinct()
        reach = reach.unionByName(reach.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        of = lambda c: low.select(F.col("c").alias(c), F.struct("load", "c").alias(f"l{c}"))
        beaten = reach.join(of("a"), "a").join(of("b"), "b").filter("lb < la").select(F.col("a").alias("c")).distinct()
        tries = written(low.join(beaten, "c", "left_anti").select("c"), "dissolve-tries")
        to = moves.join(tries.select(F.col("c").alias("a")), "a", "left_semi").join(tries.select(F.col("c").alias("b")), "b", "left_anti")
        dist = F.col("cost")  # of one client, so in the order of its distances
        prefs = to.select("id", F.col("b").alias("seed"), F.struct(dist, "b").alias("pos"), dist.alias("dist"), F.col("next").alias("amount"))
        room = loads.join(tries, "c", "left_anti").select(F.col("c").alias("seed"), (F.lit(float(cap)) - F.col("load")).alias("room"))
        held = written(matching(prefs, room), "dissolve-held")
        members = homes.join(tries, "c", "left_semi").join(held.select("id", F.col("seed").alias("b")), "id", "left")
        gone = members.groupBy("c").agg(F.count_if(F.col("b").isNull()).alias("left")).filter(F.col("left") == 0).select("c")
        new = written(moved(homes, members.join(gone, "c", "left_semi").select("id", "b")), "dissolve-homes")
        tried = written(tries if tried is None else tried.unionByName(tries), "dissolve-tried")
        forget(homes, moves, loads, low)
        homes = new
