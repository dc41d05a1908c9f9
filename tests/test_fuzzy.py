"""Fuzzy graphs against a plain version, and communities from counts."""

import numpy as np
import pytest

from lamina import skills
from lamina.operators import fuzzy, studies


def plain(x, k):
    """Dense weights by the definition, one point after the other."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    w = np.zeros_like(d)
    order = [sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[: k - 1] for i in range(len(x))]
    overall = np.mean([d[i, j] for i, row in enumerate(order) for j in row])
    for i, row in enumerate(order):
        near = d[i, row]
        rho = near[near > 0].min() if (near > 0).any() else 0.0
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-np.maximum(near - rho, 0) / max(mid, 1e-300)).sum() > np.log2(len(row) + 1) else (mid, high)
        s = max(low, 1e-3 * (near.mean() if rho > 0 else overall))
        w[i, row] = np.where(near <= rho, 1.0, np.exp(-(near - rho) / s))
    return w + w.T - w * w.T


def rows(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "obs_id bigint, features array<double>")


@pytest.mark.parametrize("k", [2, 6, 15])
def test_weights(spark, k):
    x = np.random.default_rng(k).normal(size=(60, 4))
    got = np.zeros((60, 60))
    for r in fuzzy.fuzzy_graph(rows(spark, x), k).collect():
        assert got[r["src"], r["dst"]] == 0
        got[r["src"], r["dst"]] = r["w"]
    assert np.allclose(got, plain(x, k), atol=1e-9)
    assert np.allclose(got, got.T)


def test_equal_points_and_ties(spark):
    x = np.concatenate([np.zeros((8, 2)), np.eye(2), [[5.0, 5.0]]])
    g = {(r["src"], r["dst"]): r["w"] for r in fuzzy.fuzzy_graph(rows(spark, x), 4).collect()}
    want = plain(x, 4)
    assert len(g) == (want > 0).sum() and all(abs(w - want[e]) < 1e-9 for e, w in g.items())


def test_rows_are_sent_once_for_each_chunk(spark, monkeypatch):
    """Copies of rows go by chunks of CHUNK, not by blocks of block_rows; neighbours are exact over several chunks, slices and batches, ties by id."""
    monkeypatch.setattr(studies, "AT_ONCE", 7)
    x = np.random.default_rng(3).integers(0, 4, (120, 3)).astype(float)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, j, d[i, j], r) for i in range(120) for r, j in enumerate(sorted((j for j in range(120) if j != i), key=lambda j: (d[i, j], j))[:5], 1)}
    got = studies.feature_knn(rows(spark, x), 5, 4)
    assert {tuple(r) for r in got.select("src", "dst", "d2", "rank").collect()} == want
    sent, plain = [], type(got).repartitionById
    monkeypatch.setattr(type(got), "repartitionById", lambda t, n, c: sent.append(t.count()) or plain(t, n, c))
    studies.feature_knn(rows(spark, x), 5, 4)
    assert sent[0] <= 120 * 16  # 30 blocks on either side make 120 * 60


def test_nulls_loops_and_nothing(spark):
    e = spark.createDataFrame([(1, 1, 0.0), (1, 2, None), (2, 1, 4.0)], "src bigint, dst bigint, d2 double")
    assert [tuple(r) for r in fuzzy.memberships(e).collect()] == [(2, 1, 1.0)]
    assert fuzzy.union(fuzzy.memberships(e.limit(0))).count() == 0


def test_dense_keeps_every_point(spark):
    v = spark.createDataFrame([(1, 10, 2.0), (1, 11, 3.0), (2, 12, 1.0)], "obs_id bigint, gene_id bigint, value double")
    assert sorted(tuple(r) for r in fuzzy.dense(v, [10, 11]).collect()) == [(1, 10, 2.0), (1, 11, 3.0), (2, 10, 0.0), (2, 11, 0.0)]


def test_from_counts_to_clusters(spark, tmp_path):
    r = np.random.default_rng(5)
    mean = np.full((3, 90), 1.0)
    for g in range(3):
        mean[g, g * 30 : g * 30 + 30] = 9.0
    counts = [(i, j, float(n)) for i in range(90) for j, n in enumerate(r.poisson(mean[i % 3])) if n]
    spark.createDataFrame(counts, "obs_id bigint, gene_id bigint, count double").write.parquet(str(tmp_path / "c"))
    given = {"counts": str(tmp_path / "c"), "min_cells": 1, "min_genes": 1, "clusters": True, "n_pcs": 10, "resolution": 0.5}
    out = skills.run(spark, "core.preprocess", given, tmp_path / "runs", origin="synthetic")
    assert out["status"] == "ok"
    folder = next((tmp_path / "runs").glob("*/provenance.json")).parent
    assert {"normalized.parquet", "components.parquet", "graph.parquet", "report.json"} <= {p.name for p in folder.iterdir()}
    found = next(p for p in folder.iterdir() if p.suffix == ".parquet" and p.name not in ("normalized.parquet", "components.parquet", "graph.parquet"))
    got = spark.read.parquet(str(found)).collect()
    of = {}
    for row in got:
        of.setdefault(row["cluster"], set()).add(row["obs_id"] % 3)
    assert len(got) == 90 and all(len(kinds) == 1 for kinds in of.values()) and {k for kinds in of.values() for k in kinds} == {0, 1, 2}
