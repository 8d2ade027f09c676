"""Steps of the territory solver against brute force, and the rules that its territories hold."""
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import chains, colouring, matching, outputs, power, ranking, territories
from fieldspark.plans import plan
from fieldspark.plans.params import Params
from fieldspark.sources import regions

CAP, SF = 8400.0, "/root/testdata/sf0.001"


def test_running_totals_of_one_large_group(spark):
    p = pd.DataFrame({"g": [0] * 500 + [1] * 3, "id": range(503), "v": [float(i % 7) for i in range(503)]}).sample(frac=1, random_state=1)
    got = ranking.running(spark.createDataFrame(p).repartition(5), ["g"], ["id"], "v").toPandas().sort_values("id")
    want = p.sort_values("id").groupby("g")["v"].cumsum() - p.sort_values("id")["v"]
    assert (got["before"].to_numpy() == want.to_numpy()).all()


def blocking(prefs, room, held):
    """Pairs of a client and a seed that it prefers, in which it fits beside the nearer ones that are held."""
    at = {i: (pos, s) for i, s, pos, _, _ in prefs if held.get(i) == s for pos in [pos]}
    out = []
    for i, s, pos, dist, amount in prefs:
        if i in at and at[i][0] <= pos:
            continue
        nearer = sum(a for j, t, _, d, a in prefs if t == s and held.get(j) == s and (d, j) < (dist, i))
        if nearer + amount <= room.get(s, 0):
            out.append((i, s))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_has_no_blocking_pair(spark, seed):
    r = random.Random(seed)
    prefs = []
    for i in range(90):
        for s in r.sample(range(7), r.randrange(1, 5)):
            d = r.choice([r.random(), 0.5])
            prefs.append((i, s, d, d, r.choice([1.0, 1.0, 2.0, 7.0])))
    room = {s: r.choice([0.0, 9.0, 14.0, 20.0]) for s in range(6)}  # seed 6 has no row
    df = spark.createDataFrame(prefs, "id long, seed long, pos double, dist double, amount double")
    got = matching.matching(df.withColumn("pos", F.struct("pos", "seed")), spark.createDataFrame(list(room.items()), "seed long, room double"))
    held = {x["id"]: x["seed"] for x in got.collect()}
    amount = {(i, s): a for i, s, _, _, a in prefs}
    assert all(sum(amount[i, s] for i, t in held.items() if t == s) <= room.get(s, 0) for s in range(7))
    keyed = [(i, s, (p, s), d, a) for i, s, p, d, a in prefs]
    assert blocking(keyed, room, held) == [] and len(held) > 20


def rows_to_fill(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) ** 3 * 10
    return pd.DataFrame({"area_id": r.integers(0, 2, n), "id": np.arange(n), "x": x[:, 0], "y": x[:, 1], "base": r.uniform(5, 400, n), "trip": r.uniform(0.1, 2, n)})


def test_both_lookups_of_prices_agree_with_all_pairs(spark):
    p = rows_to_fill(200, 4)
    rows = spark.createDataFrame(p).withColumn("set", power.set_of(["area_id"]))
    counts = spark.createDataFrame([('{"area_id":0}', 5), ('{"area_id":1}', 3)], "set string, k int")
    centres = power.first_centres(power.divided(rows, counts)).withColumn("w", F.col("c") * 3.5).cache()
    near = power.candidates(rows, centres, near=5)
    one, two = (power.priced(near, centres, held=h).toPandas().sort_values("id") for h in (100, 0))
    assert (one["c"].to_numpy() == two["c"].to_numpy()).all() and np.allclose(one["p"], two["p"])
    at = centres.toPandas()
    for t in one.itertuples():
        own = at[at["set"] == t.set]
        cost = (t.x - own["gx"]) ** 2 + (t.y - own["gy"]) ** 2 + own["w"]
        assert t.c == own.loc[cost.idxmin(), "c"]
    assert sorted(at.groupby("set")["c"].count()) == [3, 5]


def test_prices_make_the_heaviest_lighter(spark):
    p = rows_to_fill(300, 7)
    rows = spark.createDataFrame(p).withColumn("set", power.set_of(["area_id"])).cache()
    centres = power.first_centres(power.divided(rows, spark.createDataFrame([('{"area_id":0}', 4), ('{"area_id":1}', 4)], "set string, k int"))).cache()
    heavy = lambda c: power.totals(power.priced(power.candidates(rows, c), c)).agg(F.max("load")).first()[0]
    best = power.best_centres(rows, centres, steps=6)
    assert heavy(best) < heavy(centres)


def test_chain_costs_equal_all_chains(spark):
    r = random.Random(3)
    ways = [(a, b, r.uniform(-2, 6), 100 * a + b, r.uniform(1, 4), r.uniform(1, 4)) for a in range(6) for b in range(6) if a != b and r.random() < 0.6]
    load = {c: r.uniform(4, 10) for c in range(6)}
    df = spark.createDataFrame(ways, "a long, b long, cost double, id long, own double, next double")
    got = {(x["a"], x["b"]): x["total"] for x in chains.chain_costs(df, spark.createDataFrame(list(load.items()), "c long, load double"), 9.0, steps=4).collect()}

    def cheapest(w, left):
        a, b, cost, i, own, nxt = w
        found = [cost] if load[b] + nxt <= 9 else []
        if left > 1:
            found += [cost + c for v in ways if v[0] == b and v[3] != i and load[b] - v[4] + nxt <= 9 for c in [cheapest(v, left - 1)] if c is not None]
        return min(found, default=None)

    want = {(w[0], w[1]): cheapest(w, 4) for w in ways}
    assert got == pytest.approx({k: v for k, v in want.items() if v is not None})


def full_case(spark, seed, n=60, k=6):
    """Options and homes of a random case whose territories are nearly full."""
    r = np.random.default_rng(seed)
    x, g = r.uniform(0, 100, (n, 2)), r.uniform(0, 100, (k, 2))
    d2 = ((x[:, None] - g[None]) ** 2).sum(2)
    amount = r.uniform(1, 3, n)[:, None] * (1 + np.sqrt(d2) / 100)
    home = r.integers(0, k, n)
    cap = max(amount[np.arange(n), home][home == c].sum() for c in range(k)) + 1
    rows = [(i, c, float(d2[i, c]), float(amount[i, c])) for i in range(n) for c in range(k)]
    return d2, amount, home, cap, spark.createDataFrame(rows, "id long, c long, d2 double, amount double").cache(), spark.createDataFrame([(i, int(c)) for i, c in enumerate(home)], "id long, c long")


def test_reclaiming_shortens_and_keeps_the_capacity(spark):
    d2, amount, home, cap, options, homes = full_case(spark, 5)
    n = len(home)
    before = d2[np.arange(n), home].sum()
    for sweeps in (1, 3):
        got = {x["id"]: x["c"] for x in chains.reclaimed(options, homes, cap, sweeps=sweeps).collect()}
        at = np.array([got[i] for i in range(n)])
        after = d2[np.arange(n), at].sum()
        assert after < before and all(amount[np.arange(n), at][at == c].sum() <= cap + 1e-9 for c in range(6))
        before = after
    fixed = spark.createDataFrame([(i,) for i in range(0, n, 2)], "id long")
    got = {x["id"]: x["c"] for x in chains.reclaimed(options, homes, cap, sweeps=1, fixed=fixed).collect()}
    assert all(got[i] == home[i] for i in range(0, n, 2)) and any(got[i] != home[i] for i in range(1, n, 2))


def test_dissolving_is_all_or_nothing(spark):
    d2, amount, home, cap, options, homes = full_case(spark, 9)
    n = len(home)
    home = np.where(home >= 4, home % 4, home)
    home[[3, 11]], home[[20, 21, 22]] = 4, 5  # two short territories
    homes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(home)], "id long, c long")
    load = lambda at, c: amount[np.arange(n), at][at == c].sum()
    top = max(load(home, c) for c in range(4))
    for room in (40.0, 4.0, 0.0):
        got = {x["id"]: x["c"] for x in chains.dissolved(options, homes, top + room, load(home, 5) + load(home, 4)).collect()}
        at = np.array([got[i] for i in range(n)])
        assert all(load(at, c) <= top + room + 1e-9 for c in range(6))
        for c in (4, 5):
            assert set(at[home == c]) == {c} or c not in at[home == c] and not (at == c).any() or (c in at)
            stays = [i for i in range(n) if home[i] == c and at[i] == c]
            assert len(stays) in (0, int((home == c).sum()))
        if room == 40.0:
            assert not (at == 4).any()


def test_filled_territories_hold_the_rules_and_are_fewer(spark):
    p = rows_to_fill(400, 3)
    p.loc[0, "base"] = 99_999  # one client above the capacity stays alone
    df = spark.createDataFrame(p)
    got = power.solved(df, ["area_id"], CAP).toPandas()
    assert sorted(got["id"]) == list(range(400))
    for _, g in got.groupby("part"):
        assert g["area_id"].nunique() == 1 and g["gx"].nunique() == 1 and (g["load"].sum() <= CAP + 1e-6 or len(g) == 1)
    assert np.allclose(got["load"], got["base"] + got["trip"] * np.hypot(got["x"] - got["gx"], got["y"] - got["gy"]))
    old = territories.territories(df, ["area_id"], CAP).select("part").distinct().count()
    least = sum(int(np.ceil(g["load"].sum() / CAP)) for _, g in got[got["id"] != 0].groupby("area_id"))
    assert got["part"].nunique() < old and got["part"].nunique() <= 1.15 * least + 1


def test_colours_differ_where_territories_are_near(spark):
    r = np.random.default_rng(6)
    at = pd.DataFrame({"area": r.integers(0, 2, 120), "name": [f"t{i}" for i in range(120)], "x": r.normal(size=120), "y": r.normal(size=120)})
    df = spark.createDataFrame(at)
    pairs = colouring.conflicts(df, ["area"]).cache()
    got = {t["name"]: t["colour"] for t in colouring.coloured(df, pairs).collect()}
    assert len(got) == 120 and max(got.values()) < 10
    assert all(got[t["a"]] != got[t["b"]] for t in pairs.collect())
    for area, g in at.groupby("area"):
        for t in g.itertuples():
            d = (g["x"] - t.x) ** 2 + (g["y"] - t.y) ** 2
            assert all(got[n] != got[t.name] for n in g.loc[d.sort_values().index[1:7], "name"])


def user_table(spark, area="a"):
    r = np.random.default_rng(1)
    rows = [(f"c{i}", float(37 + r.normal() * 0.3), float(-6 + r.normal() * 0.3), "3", 40, f"p{i % 4}", area, f"tip{i}") for i in range(60)]
    rows += [("far", 44.0, 1.0, "2", 30, "p9", area, "x"), ("bad", 99.0, 0.0, "1", 10, "p1", area, "x")]
    return spark.createDataFrame(rows, "client string, latitude double, longitude double, calls string, minutes int, zip string, region string, note string")


ROLES = {"customer_id": "client", "lat": "latitude", "lon": "longitude", "visits": "calls", "postal": "zip", "area": "region", "tooltips": ["note"]}


def test_a_users_table_is_planned_end_to_end(spark):
    rings, adjacency = regions.demo_rings(spark, SF), regions.demo_adjacency(spark, SF)
    got = plan.planned(user_table(spark), rings, adjacency, Params(outlier_km=100), ROLES).toPandas().set_index("customer_id")
    assert len(got) == 61 and "bad" not in got.index and got.loc["far", "is_outlier"] and np.isnan(got.loc["far", "territory"])
    rest = got.drop("far")
    assert rest["territory"].notna().all() and (rest.groupby("territory")["load"].sum() <= CAP + 1e-6).all() and (rest["load"] >= rest["visit_load"]).all()
    d = np.hypot((rest["lon"] - rest["base_lon"]) * rest["kx"], (rest["lat"] - rest["base_lat"]) * 6371 * np.pi / 180)
    assert np.allclose(rest["load"], rest["v"] * (rest["m"] + rest["hop"] + d * rest["tpk"])) and rest["tooltips"].iloc[0]["note"].startswith("tip")
    lines = [t["line"] for t in outputs.assignment_lines(plan.planned(user_table(spark, ""), rings, adjacency, Params(), ROLES)).collect()]
    assert len(lines) == 61 and all(",unassigned," in x for x in lines)  # nothing is divided while the areas are missing
    with pytest.raises(ValueError, match="customer_id"):
        plan.by_role(user_table(spark))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_in_one_task_equals_rounds_of_jobs(spark, seed, monkeypatch):
    made = []
    monkeypatch.setattr(matching, "written", lambda df, label, f=matching.written: made.append(label) or f(df, label))
    r = random.Random(seed)
    prefs = [(i, s, d, d, r.choice([1.0, 2.0, 7.0])) for i in range(60) for s in r.sample(range(5), r.randrange(1, 5)) for d in [r.choice([r.random(), 0.5])]]
    df = spark.createDataFrame(prefs, "id long, seed long, pos double, dist double, amount double").withColumn("pos", F.struct("pos", "seed"))
    room = spark.createDataFrame([(s, r.choice([0.0, 9.0, 20.0])) for s in range(5)], "seed long, room double")
    got = lambda held: sorted(map(tuple, matching.matching(df, room, held).collect()))
    assert got(None) == got(df.count() - 3)
    few = len(made)
    assert got(0) == got(None) and few < 20 and matching.matching(df.limit(0), room).collect() == []


def test_a_long_line_of_refusals_makes_few_tables(spark, monkeypatch):
    """Each client drives the next one out of its first seed, so that as many rounds follow one another as there are clients."""
    made = []
    monkeypatch.setattr(matching, "written", lambda df, label, f=matching.written: made.append(label) or f(df, label))
    n = 40
    prefs = [(i, i + k, float(k), float(k == 0), 1.0) for i in range(n) for k in (0, 1)] + [(n, 0, 0.0, -1.0, 1.0)]
    df = spark.createDataFrame(prefs, "id long, seed long, pos double, dist double, amount double")
    room = spark.createDataFrame([(s, 1.0) for s in range(n + 1)], "seed long, room double")
    got = {t["id"]: t["seed"] for t in matching.matching(df, room).collect()}
    assert got == {n: 0, **{i: i + 1 for i in range(n)}} and len(made) < 10
