import random

import pytest

from cairnspark.llm.components import connected_components


def brute_force(edges):
    parent = {}

    def root(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in parent if root(k) != k}


@pytest.mark.parametrize("sizes", [{}, {"one_in": 2, "least": 2, "most": 3}])
@pytest.mark.parametrize("kind", ["path", "star", "crown", "random", "empty", "loops"])
def test_least_node_of_each_component(spark, kind, sizes):
    """With small sizes nodes of a few edges count as hot."""
    rng = random.Random(5)
    n = 24
    edges = {"path": [(k, k + 1) for k in range(n)], "star": [(7, k) for k in range(n)], "crown": [(k, n) for k in range(n)] + [(k, n + 1) for k in range(0, n, 2)] + [(n + 2, n + 3)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(18)], "empty": [], "loops": [(3, 3), (4, 5), (5, 4), (4, 5)]}[kind]
    rng.shuffle(edges)
    out = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), **sizes).collect()
    assert {r["node"]: r["root"] for r in out} == {k: r for k, r in brute_force(edges).items()} and len(out) == len({r["node"] for r in out})


def test_binary_nodes(spark):
    edges = [(b"\x00", b"\xff\x00"), (b"\xff", b"\xff\x00"), (b"\x01", b"\x02")]
    out = connected_components(spark.createDataFrame(edges, "a binary, b binary"), one_in=1, least=1).collect()
    assert {bytes(r["node"]): bytes(r["root"]) for r in out} == {b"\xff\x00": b"\x00", b"\xff": b"\x00", b"\x02": b"\x01"}
