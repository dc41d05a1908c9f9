"""Models of all folds against a plain loop over repeats and folds."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import validation
from lamina.operators.resampling import places


def table(spark, x, y, c):
    return spark.createDataFrame([(i, int(b), list(map(float, a)), float(d)) for i, (a, b, d) in enumerate(zip(x, y, c, strict=True))], "obs_id bigint, y int, features array<double>, c double")


def data(n=160, d=4, seed=0):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.35).astype(int)
    c = r.normal(size=n) + y
    x = r.normal(size=(n, d)) * [1, 3, 0.2, 10] + np.outer(c, [0.5, 0, 0.3, 2]) + np.outer(y, [0.8, 0, 0, 5])
    return x, y, c


def plain_fit(z, y, loss, weight):
    """Minimises the objective by plain gradient steps from its own value and slope."""
    z, s = np.concatenate([np.ones((len(z), 1)), z], 1), 2 * y - 1
    ridge = np.ones(z.shape[1])
    ridge[0] = float(loss == "squared_hinge")
    w = np.zeros(z.shape[1])
    rate = 1 / (2 * np.linalg.norm(z.T @ (z * weight[:, None]), 2) + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(6000):
        m = s * (z @ ahead)
        g = -s / (1 + np.exp(m)) if loss == "logistic" else -2 * s * np.maximum(1 - m, 0)
        new = ahead - rate * (z.T @ (weight * g) + ridge * ahead)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def plain(x, y, c, dealt, loss, confound, balanced):
    out = {}
    for repeat, fold in sorted({(r, f) for _, r, f in dealt}):
        held = np.array([i for i, r, f in dealt if (r, f) == (repeat, fold)])
        learn = np.setdiff1d(np.arange(len(y)), held)
        z = x.copy()
        if confound:
            a = np.stack([np.ones(len(y)), c], 1)
            z = x - a @ np.linalg.lstsq(a[learn], x[learn], rcond=None)[0]
        z = (z - z[learn].mean(0)) / z[learn].std(0)
        counts = np.bincount(y[learn], minlength=2)
        weight = (counts.sum() / (2 * counts))[y[learn]] if balanced else np.ones(len(learn))
        w = plain_fit(z[learn], y[learn], loss, weight)
        said = w[0] + z[held] @ w[1:] > 0
        good = said == (y[held] == 1)
        out[repeat, fold] = (len(held), good.mean(), np.mean([good[y[held] == k].mean() for k in (0, 1)]))
    return out


@pytest.mark.parametrize(("loss", "confound", "balanced"), [("logistic", None, True), ("squared_hinge", "c", False), ("logistic", "c", False)])
def test_against_a_loop(spark, loss, confound, balanced):
    x, y, c = data()
    t = table(spark, x, y, c)
    dealt = [(r["obs_id"], r["repeat"], r["fold"]) for r in validation.stratified_folds(t, 4, 2).collect()]
    want = plain(x, y, c, dealt, loss, confound, balanced)
    got = {(r["repeat"], r["fold"]): (r["n"], r["accuracy"], r["balanced_accuracy"]) for r in validation.cross_validate(t.repartition(3), 4, 2, loss, confound, balanced=balanced).collect()}
    assert set(got) == set(want) and len(got) == 8
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_folds_are_stratified_and_do_not_depend_on_partitions(spark):
    _, y, _ = data(203)
    t = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "obs_id bigint, y int")
    a = sorted(map(tuple, validation.stratified_folds(t.repartition(1), 5, 3, 9).collect()))
    assert a == sorted(map(tuple, validation.stratified_folds(t.repartition(7), 5, 3, 9).collect()))
    sizes = Counter((r, v, f) for _, v, r, f in a)
    for r in range(3):
        for v in (0, 1):
            s = [sizes[r, v, f] for f in range(5)]
            assert max(s) - min(s) <= 1 and sum(s) == (y == v).sum()
    assert len({tuple(f for i, _, r, f in a if r == k) for k in range(3)}) == 3


def test_confound_alone_is_all_there_is(spark):
    """Features that are the confound and noise say nothing once it is taken out."""
    r = np.random.default_rng(3)
    y = np.arange(200) % 2
    c = y * 3 + r.normal(size=200) * 0.3
    x = np.outer(c, [1, -2]) + r.normal(size=(200, 2)) * 0.5
    t = table(spark, x, y, c)
    mean = lambda d: d.agg(F.avg("balanced_accuracy")).first()[0]
    assert mean(validation.cross_validate(t, 5, 2, "squared_hinge")) > 0.97
    assert mean(validation.cross_validate(t, 5, 2, "squared_hinge", "c")) < 0.65


def test_held_out_part_bad_rows_and_ends(spark):
    x, y, c = data(80)
    t = table(spark, x, y, c)
    some = validation.cross_validate(t, 5, 3, held_out=1)
    first = sum(-(-int(k) // 5) for k in np.bincount(y))  # rows of a label are dealt from the first fold on
    assert sorted((r["repeat"], r["fold"], r["n"]) for r in some.collect()) == [(k, 0, first) for k in range(3)]
    bad = spark.createDataFrame([(900, 1, [float("nan")] * 4, 0.0), (901, None, [1.0] * 4, 0.0), (902, 2, [1.0] * 4, 0.0), (903, 1, None, 0.0), (None, 1, [1.0] * 4, 0.0), (904, 0, [1.0, None, 1.0, 1.0], 0.0)], t.schema)
    same = lambda d: sorted(map(tuple, validation.cross_validate(d, 4, 1).collect()))
    assert same(t) == same(t.unionByName(bad))
    assert validation.cross_validate(t.limit(0), 4, 1).count() == 0
    assert validation.cross_validate(t.where("y = 1"), 4, 1).count() == 0
    with pytest.raises(ValueError, match="columns"):
        validation.cross_validate(t.unionByName(spark.createDataFrame([(999, 1, [1.0], 0.0)], t.schema)), 4, 1)
    with pytest.raises(ValueError, match="none of"):
        validation.cross_validate(t, loss="absolute")


def test_log_variance(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 5.0), (1, "b", 5.0), (2, "a", 1.0), (2, "a", 2.0), (2, "b", None)], "obs_id bigint, channel string, value double")
    assert [(r["obs_id"], r["features"]) for r in validation.log_variance(s).collect()] == [(1, [0.0, pytest.approx(np.log(1e-12))])]


def test_summary(spark):
    d = spark.createDataFrame([(0, 0, 4, 0.5, 0.25), (0, 1, 4, 1.0, 0.75)], "repeat int, fold int, n bigint, accuracy double, balanced_accuracy double")
    assert tuple(validation.summary(d, "x").first()) == ("x", 2, 0.75, 0.25, 0.5, 0.25)


def test_places(spark):
    rows = spark.createDataFrame([(i, (i * 37 % 50) / 100, i % 3) for i in range(100)], "obs_id bigint, u double, g int")
    want, last = {}, {}
    for u, i, g in sorted((r["u"], r["obs_id"], r["g"]) for r in rows.collect()):
        want[i] = last[g] = last.get(g, -1) + 1
    assert {r["obs_id"]: r["place"] for r in places(rows.repartition(5), ("g",)).collect()} == want
    assert sorted(r["place"] for r in places(rows).collect()) == list(range(100))
    assert places(rows.limit(0)).count() == 0
