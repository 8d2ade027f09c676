import random

import pytest

from fieldspark.operators import contiguity


def apart(edges, without):
    """Components of what is left."""
    up = {v: v for e in edges for v in e if v != without}
    find = lambda v: v if up[v] == v else find(up[v])
    for a, b in edges:
        if without not in (a, b):
            up[find(a)] = find(b)
    return len({find(v) for v in up})


@pytest.mark.parametrize("kind", ["random", "trees and rings"])
def test_cut_vertices_equal_removal(spark, kind):
    r = random.Random(4)
    if kind == "random":
        edges = [(r.randrange(40), r.randrange(40)) for _ in range(48)] + [(3, 3)]
    else:
        edges = [(i, i + 1) for i in range(8)] + [(20 + i, 20 + (i + 1) % 7) for i in range(7)] + [(22, 40), (40, 41), (41, 42), (42, 40), (25, 50), (50, 51), (23, 26)]
    edges = [(f"u{a:02}", f"u{b:02}") for a, b in edges]
    whole = apart(edges, None)
    want = {v for v in {v for e in edges for v in e} if apart([e for e in edges if e[0] != e[1]] + [(v, v) for e in edges for v in e], v) > whole - (not any(v in e and e[0] != e[1] for e in edges))}
    assert {t["v"] for t in contiguity.cut_vertices(spark.createDataFrame(edges, "a string, b string")).collect()} == want and want
