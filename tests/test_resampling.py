"""Thinning, planted effects and bootstrap intervals against plain versions and exact moments."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.distributions import p_t
from lamina.operators import resampling, stats


def plain_thin(n, p, key, seed):
    """The inverse of the distribution, by exact binomial terms, at the same random numbers."""
    q, out = min(p, 1 - p), 0
    for part in range(-(-n // resampling.TRIALS)):
        m = min(resampling.TRIALS, n - part * resampling.TRIALS)
        u = int(hashlib.md5(f"{key}|{seed}|{part}".encode()).hexdigest()[:13], 16) / 2**52
        below = 0.0
        for k in range(m):
            below += math.comb(m, k) * q**k * (1 - q) ** (m - k)
            out += below <= u
    return out if p <= 0.5 else n - out


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.8, 1.0])
def test_thinning_is_binomial(spark, p):
    n = [None, -3.0, 0.0, 1.0, 2.7, 255.0, 256.0, 257.0, 1000.0] + [20.0] * 3000
    rows = [(i, i % 7, v) for i, v in enumerate(n)]
    df = spark.createDataFrame(rows, "obs_id bigint, gene_id bigint, count double").withColumn("_m", F.lit("kept")).drop("_m")
    got = {r["obs_id"]: r["thinned"] for r in resampling.thin(df, p, ["obs_id", "gene_id"], 5).collect()}
    assert got == {r["obs_id"]: r["thinned"] for r in resampling.thin(df.repartition(7), p, ["obs_id", "gene_id"], 5).collect()}
    assert got[0] is None and got[1] is None and got[2] == 0
    if 0 < p < 1:
        assert all(got[i] == plain_thin(int(v), p, f"{i}|{g}", 5) for i, g, v in rows[3:200])
    x = np.array([got[i] for i in range(9, len(n))])
    assert abs(x.mean() - 20 * p) < 5 * math.sqrt(20 * p * (1 - p) / 3000) + 1e-9
    assert abs(x.var() - 20 * p * (1 - p)) < 0.1 * 20 * p * (1 - p) + 1e-9 and x.min() >= 0 and x.max() <= 20
    with pytest.raises(ValueError, match="probability"):
        resampling.thin(df, 1.5, ["obs_id"])


def test_tests_of_sparse_values_equal_those_of_dense_ones(spark):
    r = np.random.default_rng(3)
    n, genes = 80, 6
    x = np.where(r.random((n, genes)) < 0.4, r.integers(1, 5, (n, genes)), 0).astype(float)
    x[:, 5] = 0
    x[0, 5] = 1
    meta = spark.createDataFrame([(i, "ABC"[i % 3]) for i in range(n)], "obs_id bigint, grp string")
    rows = [(i, g, float(x[i, g])) for i in range(n) for g in range(genes)]
    values = spark.createDataFrame(rows, "obs_id bigint, gene_id bigint, value double")
    got = {r["gene_id"]: (r["p_t"], r["p_rank"]) for r in resampling.sparse_tests(values.where("value > 0"), meta, "A", "B").collect()}
    d = values.join(meta, "obs_id")
    rank = {r["gene_id"]: r["p"] for r in stats.mann_whitney_p(stats.mann_whitney(d, ["gene_id"], "grp", "A", "B")).collect()}
    wide = d.select("gene_id", "obs_id", *(F.when(F.col("grp") == g, F.col("value")).alias(c) for g, c in (("A", "va"), ("B", "vb"))))
    t = {r["gene_id"]: r["p"] for r in stats.welch_t(wide).withColumn("p", F.when(F.col("t").isNotNull(), p_t(F.col("t"), F.col("df")))).collect()}
    assert set(got) == set(range(genes))
    for g in range(genes):
        assert got[g][1] == pytest.approx(rank[g], abs=1e-9) and (got[g][0] is None if t[g] is None else got[g][0] == pytest.approx(t[g], abs=1e-9))


def test_a_planted_effect_is_found_by_units(spark):
    r = np.random.default_rng(4)
    meta, counts = [], []
    for i in range(480):
        donor, section = i % 4, i % 8
        meta.append((i, "A" if section < 4 else "B", f"s{section}", donor))
        counts += [(i, g, float(v)) for g, v in enumerate(r.poisson(6, 30)) if v]
    meta = spark.createDataFrame(meta, "obs_id bigint, grp string, section string, donor bigint")
    counts = spark.createDataFrame(counts, "obs_id bigint, gene_id bigint, count double")
    effect = spark.createDataFrame([(g,) for g in range(6)], "gene_id bigint")
    got = {r["method"]: r for r in resampling.planted_effect(counts, meta, effect).collect()}
    assert set(got) == {"observations_t", "observations_rank", "sections", "donors_paired"} and all(r["n_genes"] == 30 for r in got.values())
    assert all(r["sensitivity"] == 1.0 for r in got.values())
    none = {r["method"]: r for r in resampling.planted_effect(counts, meta, effect.limit(0)).collect()}
    assert all(r["sensitivity"] is None and r["n_called"] <= 2 for r in none.values())


def test_copies_are_poisson_and_differ_by_row_draw_and_seed():
    k = resampling.copies(np.arange(2000), 300, 1)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02
    assert np.abs(k.mean(0) - 1).max() < 0.12 and np.abs(k.mean(1) - 1).max() < 0.3
    c = np.corrcoef(k[:60])
    assert np.abs(c - np.eye(60)).max() < 0.35 and (resampling.copies(np.arange(2000), 300, 2) != k).mean() > 0.5


def test_intervals_equal_a_plain_resampler(spark):
    r = np.random.default_rng(5)
    x = r.normal(2, 1, 500)
    y = 0.6 * x + r.normal(size=500)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, 1.0, None), (None, 1.0, 1.0)], "id bigint, x double, y double").repartition(5)
    got = {r["statistic"]: tuple(r)[1:] for r in resampling.bootstrap(df, 300, seed=9).collect()}
    k = resampling.copies(np.arange(500), 300, 9)
    sample = [np.repeat(np.arange(500), k[:, d]) for d in range(300)]
    for name, f in (("mean_x", lambda s: x[s].mean()), ("mean_y", lambda s: y[s].mean()), ("correlation", lambda s: np.corrcoef(x[s], y[s])[0, 1])):
        v = [f(s) for s in sample]
        assert got[name] == pytest.approx((f(np.arange(500)), np.quantile(v, 0.025), np.quantile(v, 0.975)), rel=1e-9)
    half = 1.96 * x.std() / math.sqrt(500)
    assert got["mean_x"][1:] == pytest.approx((x.mean() - half, x.mean() + half), abs=0.03)
    assert resampling.bootstrap(df.limit(0), 10).count() == 0


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_median_intervals_equal_a_plain_resampler(spark, buckets):
    r = np.random.default_rng(6)
    x, y = r.normal(size=301), r.integers(0, 3, 301).astype(float)  # y is mostly ties
    rows = [(i, float(a), float(b), None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, float("nan"), None), (None, 5.0, 5.0, None)], "id bigint, x double, y double, none double").repartition(3)
    got = {r["statistic"]: tuple(r)[1:] for r in resampling.bootstrap_medians(df, ["x", "y", "none"], 100, seed=4, buckets=buckets).collect()}
    k = resampling.copies(np.arange(301), 100, 4)
    assert set(got) == {"median_x", "median_y"}
    for name, v in (("median_x", x), ("median_y", y)):
        m = [np.median(np.repeat(v, k[:, d])) for d in range(100)]
        assert got[name] == pytest.approx((np.median(v), np.quantile(m, 0.025), np.quantile(m, 0.975)), abs=1e-12)
    assert resampling.bootstrap_medians(df.limit(0), ["x"], 10).count() == 0
