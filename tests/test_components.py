"""Components in few rounds, and towns whose cells meet without all pairs of their clients."""
import numpy as np
import pandas as pd
import pytest

from fieldspark.operators import components, units


def brute(edges):
    top = {}

    def find(v):
        while top.setdefault(v, v) != v:
            v = top[v]
        return v

    for a, b in edges:
        p, q = find(a), find(b)
        top[max(p, q)] = min(p, q)
    return {v: find(v) for v in top}


@pytest.mark.parametrize("held", [0, 30, None])
def test_a_long_path_takes_few_rounds(spark, held, monkeypatch):
    made = []
    monkeypatch.setattr(components, "written", lambda df, label, f=components.written: made.append(label) or f(df, label))
    r = np.random.default_rng(3)
    path = r.permutation(600)
    edges = [(int(a), int(b)) for a, b in zip(path, path[1:])] + [(1000 + int(a), 1000 + int(b)) for a, b in r.integers(0, 80, (50, 2))] + [(2000, 2000), (2001, 2002)]
    got = {t["a"]: t["class"] for t in components.components(spark.createDataFrame(edges, "a long, b long"), held).collect()}
    assert got == brute(edges) and len(made) < 50  # labels that spread from neighbour to neighbour wrote a table for each of hundreds of steps


def test_components_of_names_and_of_nothing(spark):
    edges = [("é", "z"), ("b", "é"), ("a", "a"), ("c", "d")]
    df = spark.createDataFrame(edges, "a string, b string")
    for held in (0, None):
        assert {t["a"]: t["class"] for t in components.components(df, held).collect()} == brute(edges)
    assert components.components(df.limit(0)).collect() == []


@pytest.mark.parametrize("few", [0, 4, 10_000])
def test_towns_equal_brute_force_however_cells_meet(spark, few, monkeypatch):
    monkeypatch.setattr(units._near_towns, "__defaults__", (few,))
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.3, (9, 2)) for c in r.uniform(0, 14, (14, 2))])  # heaps whose nearest four are their own
    p = pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})
    got = {t["id"]: t["town"] for t in units.towns(spark.createDataFrame(p)).collect()}
    d = np.sqrt((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2)
    assert got == brute([(int(i), int(j)) for i, j in zip(*np.nonzero(d <= units.LINK_KM))])
    assert len(set(got.values())) > 1
