"""Capacity-bounded matching in rounds: clients propose to seeds in their order, seeds hold the nearest that fit (deferred acceptance).

Preferences are rows (id, seed, pos, dist, amount): pos is the client's order, dist the seed's, amount what the client takes of the seed's room.
In a round every client that no seed holds proposes to the first seed that has not refused it. Taken by distance, ties by id, the first client
that does not fit is refused, and with it all later ones that would not fit beside those before it. A seed's earlier clients only get nearer,
so a refusal is final, and where no client is refused, none prefers a seed in which it would fit beside the nearer ones.

Rounds are jobs over whole tables while more than HELD preferences are left; the same rounds over HELD and fewer run in one task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .ranking import running

HELD = 2_000_000


def proposals(prefs: DataFrame) -> DataFrame:
    """Of every client the preference that comes first."""
    return prefs.groupBy("id").agg(F.min(F.struct("pos", "seed", "dist", "amount")).alias("p")).select("id", "p.*")


def refused(asked: DataFrame, room: DataFrame) -> DataFrame:
    """id, seed of the proposals that a seed (seed, room) cannot hold."""
    full = asked.groupBy("seed").agg(F.sum("amount").alias("asks")).join(room, "seed").filter("asks > room").select("seed", "room")
    line = running(asked.join(full, "seed"), ["seed"], ["dist", "id"], "amount")
    line = written(line.withColumn("over", F.col("before") + F.col("amount") > F.col("room")), "match-line")
    held = line.filter("over").groupBy("seed").agg(F.min_by("before", F.struct("dist", "id")).alias("held"), F.min(F.struct("dist", "id")).alias("first"))
    late = line.join(held, "seed").filter((F.struct("dist", "id") >= F.col("first")) & (F.col("amount") > F.col("room") - F.col("held")))
    return late.select("id", "seed")


def _turned_down(at: np.ndarray, seed: np.ndarray, dist: np.ndarray, amount: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of the proposals `at` (places in the other arrays, by client) those that `refused` finds."""
    order = at[np.lexsort((dist[at], seed[at]))]
    starts = np.flatnonzero(np.diff(seed[order], prepend=-1))
    out = [order[:0]]
    for i in np.flatnonzero(np.add.reduceat(amount[order], starts) > room[order[starts]]):
        line = order[starts[i]:starts[i + 1] if i + 1 < len(starts) else None]
        upto, most = np.cumsum(amount[line]), room[line[0]]
        over = np.flatnonzero(upto > most)
        if len(over):
            held = upto[over[0] - 1] if over[0] else 0.0
            late = line[over[0]:]
            out.append(late[amount[late] > most - held])
    return np.concatenate(out)


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, seed, dist, amount of the clients held in the end, of preferences (id, seed, nth, dist, amount, room)."""
    p = pd.concat(batches, ignore_index=True).sort_values(["id", "nth"], ignore_index=True)
    seed, _ = pd.factorize(p["seed"])
    dist, amount, room = (p[c].to_numpy() for c in ("dist", "amount", "room"))
    at = np.flatnonzero(~p["id"].duplicated().to_numpy())  # what each client asks for, then what the next one asks for
    client, end = np.repeat(np.arange(len(at)), np.diff(at, append=len(p))), np.append(at[1:], len(p))
    while True:
        no = _turned_down(at[at < end], seed, dist, amount, room)
        if not len(no):
            yield p.loc[at[at < end], ["id", "seed", "dist", "amount"]]
            return
        at[client[no]] += 1


def matching(prefs: DataFrame, room: DataFrame, held: int | None = None) -> DataFrame:
    """id, seed, dist, amount of the clients that a seed holds in the end; those refused by all are left out. A seed without a row in `room` has none."""
    prefs = written(prefs.join(room.select("seed"), "seed", "left_semi"), "match-prefs")
    held = HELD if held is None else held
    while (left := prefs.count()) > held:
        asked = written(proposals(prefs), "match-asked")
        no = written(refused(asked, room), "match-refused")
        if no.isEmpty():
            return asked.select("id", "seed", "dist", "amount")
        rest = written(prefs.join(no, ["id", "seed"], "left_anti"), "match-prefs")
        forget(prefs, asked, no)
        prefs = rest
    if not left:
        return prefs.select("id", "seed", "dist", "amount")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos", "seed")).alias("nth")
    rows = prefs.join(room.select("seed", "room"), "seed").select("id", "seed", nth, F.col("dist").cast("double"), F.col("amount").cast("double"), F.col("room").cast("double"))
    of = {c: rows.schema[c].dataType.simpleString() for c in ("id", "seed")}
    return rows.repartition(1).mapInPandas(_settled, f"id {of['id']}, seed {of['seed']}, dist double, amount double")
