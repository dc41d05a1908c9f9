"""Leiden communities against plain modularity, Louvain and connected components."""

import numpy as np
import pytest

from lamina.operators import graph, leiden, network


def plain_modularity(edges, module, resolution=1.0):
    m2 = 2 * sum(w for *_, w in edges)
    tot, inside = {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            tot[module[x]] = tot.get(module[x], 0) + w
        inside += 2 * w * (module[a] == module[b])
    return inside / m2 - resolution * sum(v * v for v in tot.values()) / m2**2


def planted(groups=4, size=12, seed=1):
    r = np.random.default_rng(seed)
    n = groups * size
    return [(i, j, float(r.integers(1, 3))) for i in range(n) for j in range(i + 1, n) if r.random() < (0.5 if i // size == j // size else 0.03)]


@pytest.mark.parametrize("resolution", [1.0, 0.3])
def test_communities_are_connected_and_not_worse_than_louvain(spark, resolution):
    rows = planted() if resolution == 1.0 else planted(3, 6)
    edges = spark.createDataFrame(rows, "a bigint, b bigint, w double")
    got = {r["node"]: r["module"] for r in leiden.leiden(edges, resolution).collect()}
    assert set(got) == {x for a, b, _ in rows for x in (a, b)} and all(got[m] == m for m in set(got.values()))
    both = leiden.both_ways(edges)
    lab = spark.createDataFrame(list(got.items()), "node bigint, module bigint")
    q = plain_modularity(rows, got, resolution)
    assert leiden.modularity(both, lab, resolution) == pytest.approx(q)
    if resolution == 1.0:
        other = {r["node"]: r["module"] for r in network.louvain(edges, [resolution]).collect()}
        assert q >= plain_modularity(rows, other, resolution) - 1e-9
    inner = spark.createDataFrame([(a, b) for a, b, _ in rows if got[a] == got[b]], "src bigint, dst bigint")
    parts = {r["node"]: r["component"] for r in graph.components(inner).collect()}
    assert all(parts[x] == got[x] for x in parts)
    if resolution == 1.0:
        assert sorted(len({x for x in got if got[x] == m}) for m in set(got.values())) == [12] * 4


def test_a_module_in_two_parts_is_split(spark):
    edges = leiden.both_ways(spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (6, 6, 1.0)], "a bigint, b bigint, w double"))
    lab = spark.createDataFrame([(i, 9) for i in range(1, 7)], "node bigint, module bigint")
    assert sorted(map(tuple, leiden.connected(edges, lab).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)]
    assert leiden.leiden(spark.createDataFrame([], "a bigint, b bigint, w double")).count() == 0
