"""Operators against brute force, and what every division into territories and areas must hold."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.functions.geo import hull
from fieldspark.operators import areas, outputs, territories, units
from fieldspark.operators import knn as knn_module
from fieldspark.operators.components import components
from fieldspark.operators.knn import knn
from fieldspark.operators.outliers import with_outliers
from fieldspark.operators.workload import with_travel
from fieldspark.plans import registry
from fieldspark.plans.params import Params
from fieldspark.sources.points import valid
from fieldspark.sources import shared
from fieldspark.sources.shared import fingerprint, kept, written

SF = "/root/testdata/sf0.001"


def neighbours(p, k, keys):
    out = set()
    for _, g in p.groupby(keys) if keys else [(0, p)]:
        x, ids = g[["x", "y"]].to_numpy(), g["id"].to_numpy()
        for i in range(len(g)):
            d = (x[i, 0] - x[:, 0]) ** 2 + (x[i, 1] - x[:, 1]) ** 2
            out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate([j for j in np.lexsort((ids, d)) if j != i][:k])}
    return out


@pytest.mark.parametrize("block", [4000, 90])
@pytest.mark.parametrize("name", ["dense and sparse", "equal places", "fewer than k", "one"])
def test_knn_equals_brute_force(spark, monkeypatch, name, block):
    monkeypatch.setattr(knn_module, "BLOCK", block)
    r = np.random.default_rng(1)
    n, k, keys = {"dense and sparse": (900, 30, ["a", "b"]), "equal places": (700, 5, []), "fewer than k": (7, 30, ["a"]), "one": (1, 3, [])}[name]
    x = r.normal(size=(n, 2)) ** 3 * 50
    if name == "equal places":
        x[:300] = [3, 4]
        x[300:400] = np.round(x[300:400])
    p = pd.DataFrame({"id": np.arange(n), "x": x[:, 0], "y": x[:, 1], "a": r.integers(0, 3, n), "b": r.integers(0, 2, n)})
    got = {(t["id"], t["other"], t["rank"]) for t in knn(spark.createDataFrame(p), k, keys).collect()}
    assert got == neighbours(p, k, keys)


def test_seekers_far_from_all_points_and_blocks_without_points(spark, monkeypatch):
    monkeypatch.setattr(knn_module, "BLOCK", 60)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(80, 2)), r.normal(size=(80, 2)) + 500, r.normal(size=(3, 2)) - 900])
    far = np.concatenate([r.normal(size=(150, 2)) - 900, r.normal(size=(40, 2)) * 300])
    p = pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})
    s = pd.DataFrame({"id": -1 - np.arange(len(far)), "x": far[:, 0], "y": far[:, 1]})
    got = {(t["id"], t["other"], t["rank"]) for t in knn(spark.createDataFrame(p), 7, seekers=spark.createDataFrame(s)).collect()}
    want = set()
    for i, q in zip(s["id"], far):
        d = (q[0] - x[:, 0]) ** 2 + (q[1] - x[:, 1]) ** 2
        want |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((p["id"], d))[:7])}
    assert got == want


def test_knn_of_thousands_on_one_spot(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([np.zeros((5000, 2)), r.normal(size=(300, 2))])
    p = pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})
    got = knn(spark.createDataFrame(p), 10)
    assert got.count() == 53_000
    assert {t["other"] for t in got.filter("id = 4999").collect()} == set(range(10)) and {t["other"] for t in got.filter("id = 0").collect()} == set(range(1, 11))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {t["a"]: t["class"] for t in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def clients(spark, rows):
    return spark.createDataFrame([(i, f"c{i}", *r) for i, r in enumerate(rows)], "id long, customer_id string, lat double, lon double, visits double, minutes double, speed_kmh double, postal string, area string")


def test_bad_coordinates_go_and_workloads_take_defaults(spark):
    bad = [(v, 0.0, 1.0, 1.0, None, None, None) for v in (None, float("nan"), 91.0, -91.0)] + [(0.0, -181.0, 1.0, 1.0, None, None, None)]
    good = [(0.0, 0.0, v, m, None, None, None) for v, m in ((0.0, -1.0), (None, None), (2.0, float("nan")), (2.0, 15.0))]
    got = with_travel(valid(clients(spark, bad + good)), Params(), ["area"]).select("v", "m").collect()
    assert sorted((t["v"], t["m"]) for t in got) == [(1.0, 60.0), (1.0, 60.0), (2.0, 15.0), (2.0, 30.0)]


def test_a_client_alone_makes_one_visit_a_trip(spark):
    got = with_travel(clients(spark, [(40.0, 1.0, 4.0, 30.0, 60.0, None, "x"), (41.0, 1.0, 1.0, 30.0, None, None, "y"), (41.0, 1.0, 1.0, 30.0, None, None, "y")]), Params(), ["area"]).collect()
    got = {t["id"]: t for t in got}
    assert got[0]["hop"] == 0 and got[0]["tpk"] == pytest.approx(2 * 1.3 / 60 * 60)
    assert got[1]["hop"] == 0 and got[1]["per_day"] == pytest.approx(140 * 60 / 20 / 30)


def test_three_points_are_all_outliers(spark):
    pts = spark.createDataFrame([(i, 0.0, float(i)) for i in range(3)], "id long, x double, y double")
    assert [t["is_outlier"] for t in with_outliers(pts, 10).collect()] == [True] * 3
    assert [t["is_outlier"] for t in with_outliers(pts, 0).collect()] == [False] * 3


def rows_to_divide(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) ** 3 * 10
    return pd.DataFrame({"area_id": r.integers(0, 2, n), "land_id": 0, "id": np.arange(n), "x": x[:, 0], "y": x[:, 1], "base": r.uniform(5, 400, n), "trip": r.uniform(0.1, 2, n)})


def test_territories_keep_the_capacity_and_the_areas(spark):
    p = rows_to_divide(400, 3)
    p.loc[0, "base"] = 99_999  # one client above the capacity stays alone
    got = territories.territories(spark.createDataFrame(p), ["area_id", "land_id"], 8400).toPandas()
    again = territories.territories(spark.createDataFrame(p.sample(frac=1, random_state=1)).repartition(7), ["area_id", "land_id"], 8400).toPandas()
    assert sorted(got["id"]) == list(range(400))
    assert dict(zip(got["id"], got["part"])) == dict(zip(again["id"], again["part"]))
    for _, g in got.groupby("part"):
        w = g["base"] + 1e-9
        gx, gy = (g["x"] * w).sum() / w.sum(), (g["y"] * w).sum() / w.sum()
        load = (g["base"] + g["trip"] * np.hypot(g["x"] - gx, g["y"] - gy)).sum()
        assert g["area_id"].nunique() == 1 and (load <= 8400 + 1e-6 or len(g) == 1)
    assert len(got.groupby("part")) < len(territories.bisect(spark.createDataFrame(p), ["area_id", "land_id"], 8400).select("part").distinct().collect())


def test_small_codes_stay_whole_and_loads_add_up(spark):
    model = registry._model(spark, SF)
    got = territories.whole_postal(model, ["area_id", "land_id"], 140).toPandas()
    assert len(got) == 150
    size = got.assign(w=got["v"] * (got["m"] + got["hop"])).groupby(["area_id", "land_id", "postal"]).agg(w=("w", "sum"), parts=("part", "nunique"))
    assert (size[size["w"] <= 0.75 * 8400]["parts"] == 1).all()
    assert (got.groupby("part")["load"].sum() <= 8400 + 1e-6).all()


def test_solved_loads_equal_hours_of_areas(spark):
    solved = registry._solved(spark, SF)
    total = solved.agg(F.sum("load")).first()[0] / 60
    sizing = {t["area"]: t["hours"] for t in registry.area_sizing_bisect(spark, SF).collect()}
    assert sizing[None] == pytest.approx(total, abs=0.01) and sum(v for k, v in sizing.items() if k) == pytest.approx(total, abs=0.01)
    assert solved.filter("territory is null").isEmpty()
    assert solved.groupBy("territory").agg(F.countDistinct("area_id", "land_id").alias("k")).filter("k > 1").isEmpty()


def test_automatic_areas_are_in_one_piece_and_islands_apart(spark):
    pieces = registry.auto_area_repair(spark, SF).collect()
    assert pieces and all(t["pieces"] == 1 for t in pieces if t["area"] < 5)  # an island without a border to another area stays as it is
    got = registry._units(spark, SF).join(registry._auto(spark, SF), "unit").toPandas()
    assert (got.groupby("area_id")["group_id"].nunique() == 1).all()
    assert set(got[got["group_id"] > 0]["area"]).isdisjoint(set(got[got["group_id"] == 0]["area"]))


def test_kmeans_finds_clumps(spark):
    r = np.random.default_rng(5)
    at = np.repeat([[0, 0], [50, 0], [0, 70], [90, 90]], 25, axis=0)
    p = pd.DataFrame({"unit": [str(i) for i in range(100)], "x": at[:, 0] + r.normal(size=100), "y": at[:, 1] + r.normal(size=100), "weight": 1.0})
    got = areas.kmeans(spark.createDataFrame(p), 4).toPandas()
    got["clump"] = got["unit"].astype(int) // 25
    assert len(got.groupby(["clump", "area"])) == 4


def test_towns_of_a_line_and_of_one_spot(spark):
    rows = [(i, 1.9 * i, 0.0) for i in range(12)] + [(50 + i, 100.0, 100.0) for i in range(5)] + [(70, 102.1, 100.0)]
    got = {t["id"]: t["town"] for t in units.towns(spark.createDataFrame(rows, "id long, x double, y double")).collect()}
    assert got == {**{i: 0 for i in range(12)}, **{50 + i: 50 for i in range(5)}, 70: 70}


def test_hull_equals_monotone_chain(spark):
    r = np.random.default_rng(8)
    for n in (1, 2, 3, 30):
        p = [(round(float(a), 3), round(float(b), 3)) for a, b in r.normal(size=(n, 2))] + ([(0.0, 0.0)] * 2 if n > 3 else [])
        got = spark.createDataFrame([(p,)], "p array<struct<lon:double,lat:double>>").select(hull(F.col("p")).alias("h")).first()["h"]
        got = [(t["lon"], t["lat"]) for t in got]
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        assert got[0] == min(p) and set(got) <= set(p)
        if n > 2:
            ring = got + got[:2]
            assert all(turn(*ring[i:i + 3]) > 0 for i in range(len(got)))
            assert all(turn(got[i - 1], got[i], q) >= 0 for i in range(len(got)) for q in p)


def test_assignment_quotes_and_names(spark):
    rows = [('a,"b"\nc', "North, x", 4, 90.0, "1", False), ("plain", "y", None, 60.0, None, True), ("rest", "y", None, 0.3, "", False)]
    pts = spark.createDataFrame(rows, "customer_id string, area string, territory long, load double, postal string, is_outlier boolean")
    assert [t["line"] for t in outputs.assignment_lines(pts).collect()] == ['"a,""b""\nc","North, x",5,1.50,1', "plain,,outlier,1.00,", "rest,,unassigned,0.01,"]


def test_results_are_kept_by_content(spark):
    ran = []

    def build(df):
        ran.append(1)
        return df.withColumn("twice", F.col("id") * 2)

    p = spark.range(10)
    first = kept(p, "t", 1, build)
    assert kept(p.repartition(3), "t", 1, build).count() == first.count() == 10 and len(ran) == 1
    kept(p.filter("id <> 5"), "t", 1, build)
    kept(p, "t", 2, build)
    kept([p, p.filter("id <> 5")], "t", 1, lambda a, b: build(a.unionByName(written(b, "made-inside"))))
    assert len(ran) == 4 and not [x for x in shared._made if "made-inside" in x]
    kept([p, p.filter("id <> 6")], "t", 1, lambda a, b: build(a))
    assert len(ran) == 5
    ran.remove(1), ran.remove(1)
    assert len(ran) == 3 and fingerprint(p) != fingerprint(p.withColumn("id", F.col("id") + 1))
    assert math.isfinite(first.agg(F.sum("twice")).first()[0])


def test_kept_results_follow_every_table_that_they_read(spark, tmp_path):
    """Other regions for the same points: areas follow."""
    for t in ("orders", "customer", "nation", "region"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "nation":
            df = df.withColumn("n_regionkey", F.when(F.col("n_regionkey") == 0, 4).when(F.col("n_regionkey") == 4, 0).otherwise(F.col("n_regionkey")).cast(df.schema["n_regionkey"].dataType))
        if t == "region":
            df = df.withColumn("r_regionkey", F.when(F.col("r_regionkey") == 0, 4).when(F.col("r_regionkey") == 4, 0).otherwise(F.col("r_regionkey")).cast(df.schema["r_regionkey"].dataType))
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    one, two = ({t["area"]: t["hours"] for t in registry.area_sizing(spark, at).collect()} for at in (SF, str(tmp_path)))
    assert one["R0"] == two["R4"] and one["R4"] == two["R0"] and one["R0"] != one["R4"]


def test_folders_go_when_released(spark):
    table = written(spark.range(3), "release-me")
    path, fs = shared._path(spark, table.kept_at)
    assert fs.exists(path)
    shared.release(spark)
    assert not fs.exists(path) and not shared._made
