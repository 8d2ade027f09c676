"""Hover against brute force, where cells are dense and where unlike squares have one root."""
import numpy as np
import pandas as pd

from fieldspark.operators import focus


def brute(p, q):
    k, out = np.cos(np.radians((p["lat"].min() + p["lat"].max()) / 2)), {}
    for t in q.itertuples():
        d = np.sqrt((p["lon"] * k - t.plon * k) ** 2 + (p["lat"] - t.plat) ** 2)
        i = np.lexsort((p["id"], d))[0]
        if d.iloc[i] < 8 * 360 / (256 * 2.0 ** t.zoom):
            out[t.probe] = int(p["id"].iloc[i])
    return out


def both(spark, p, q, monkeypatch):
    rows = []
    monkeypatch.setattr(focus, "knn", lambda *a, f=focus.knn, **b: rows.append(f(*a, **b)) or rows[-1])
    got = {t["probe"]: t["id"] for t in focus.hover(spark.createDataFrame(p), spark.createDataFrame(q)).collect()}
    assert got == brute(p, q)
    return sum(r.count() for r in rows)


def test_a_dense_cell_makes_no_pairs(spark, monkeypatch):
    r = np.random.default_rng(1)
    p = pd.DataFrame({"id": np.arange(3000), "lat": 37 + r.normal(size=3000) ** 3 * 0.01, "lon": -6 + r.normal(size=3000) ** 3 * 0.01})
    q = pd.DataFrame({"probe": np.arange(300), "plat": 37 + r.normal(size=300) * 0.1, "plon": -6 + r.normal(size=300) * 0.1, "zoom": r.integers(6, 13, 300)})
    assert both(spark, p, q, monkeypatch) <= 4 * len(q)  # before, 900,000 pairs less those in other cells


def test_distances_with_one_root_are_ties(spark, monkeypatch):
    r = np.random.default_rng(2)
    while True:
        a, b = r.uniform(0.01, 0.02, 2)
        c = np.nextafter(a, 1)
        near, far = a * a + b * b, c * c + b * b
        if near < far and np.sqrt(near) == np.sqrt(far):
            break
    p = pd.DataFrame({"id": [9, 8, 7, 3, 1, 0], "lat": [b, -b, b, b, 1.0, -1.0], "lon": [a, a, -a, c, 0.0, 0.0]})
    q = pd.DataFrame({"probe": [0, 1], "plat": [0.0, 5.0], "plon": [0.0, 5.0], "zoom": [6, 6]})
    both(spark, p, q, monkeypatch)
    assert focus.hover(spark.createDataFrame(p), spark.createDataFrame(q).limit(0)).collect() == []
