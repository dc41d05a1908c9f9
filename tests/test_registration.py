"""Chains of sections: parallel fits and running sums against a plain chain, audit rows, global search, errors against truth."""

import math

import numpy as np
import pytest

from lamina.operators import registration

OBS = "obs_id bigint, block string, section string, x double, y double, rank int"


def turn(t):
    return np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])


def sections(spark, angles, n=250, seed=1):
    """One tissue in several sections, each turned and shifted; names are in another order than ranks."""
    p = np.random.default_rng(seed).uniform(0, 2000, (n, 2))
    rows = []
    for k, a in enumerate(angles):
        q = (p - 1000) @ turn(math.radians(a)).T + 1000 + (30.0 * k, -20.0 * k)
        rows += [(1000 * k + i, "b", f"s{9 - k}", float(x), float(y), k) for i, (x, y) in enumerate(q)]
    return p, spark.createDataFrame(rows, OBS)


def test_a_chain_lays_all_sections_onto_the_first(spark):
    p, o = sections(spark, [0, 8, -3, 9])
    odd = spark.createDataFrame([(9001, None, None, 5.0, 6.0, 0), (9002, "two", "a", 1.0, 2.0, 0), (9003, "two", "b", 1.0, 2.0, 1), (9004, "b", "s9", None, None, 0)], OBS)
    every = o.unionByName(odd)
    rows = {(r["block"], r["section"]): r for r in registration.chain(every, "rank").collect()}
    assert len(rows) == 7 and [rows["b", f"s{9 - k}"]["order"] for k in range(4)] == [0, 1, 2, 3]
    assert rows["b", "s9"]["rotation_degrees"] is None and rows["b", "s9"]["theta"] == 0.0 and rows["b", "s9"]["n_obs"] == 251
    for k, (step, whole) in enumerate([(-8, -8), (11, 3), (-12, -9)], 1):
        r = rows["b", f"s{9 - k}"]
        assert r["rotation_degrees"] == pytest.approx(step, abs=1e-6) and math.degrees(r["theta"]) == pytest.approx(whole, abs=1e-6)
        assert r["overlap_after"] == 1.0 and r["trimmed_rmse"] < 1e-6
    assert rows["two", "b"]["trimmed_rmse"] is None and rows["two", "b"]["tx"] == 0.0
    got = {r["obs_id"]: r for r in registration.reconstruct(every, 5.0, order="rank").collect()}
    assert len(got) == every.count() and got[9001]["x"] == 5.0 and got[9004]["x"] is None and got[9003]["z"] == 5.0
    for k in range(4):
        at = np.array([(got[1000 * k + i]["x"], got[1000 * k + i]["y"]) for i in range(len(p))])
        assert np.abs(at - p).max() < 1e-5 and got[1000 * k]["z"] == 5.0 * k
    assert registration.reconstruct(every.limit(0), 1.0).count() == 0


def test_only_the_global_search_finds_large_turns(spark):
    p, o = sections(spark, [0, 100], 150)
    a, b = o.where("section = 's8'").select("block", "x", "y"), o.where("section = 's9'").select("block", "x", "y")
    near, whole = registration.register(a, b, ["block"]).first(), registration.register(a, b, ["block"], global_search=True).first()
    assert math.degrees(whole["theta"]) == pytest.approx(-100, abs=1e-6) and whole["overlap"] == 1.0 > near["overlap"]
    again = registration.register(a.repartition(5), b.repartition(3), ["block"]).first()
    assert again == near


def test_points_that_move_little_are_not_searched_again(monkeypatch):
    r = np.random.default_rng(4)
    p = np.concatenate([r.normal(size=(3000, 2)) * 50, r.integers(0, 9, (200, 2)), [[900.0, 900.0]]])  # with equal points and one far off
    grid, asked, plain = registration.Grid(p), [], registration.Grid._nearest
    monkeypatch.setattr(registration.Grid, "_nearest", lambda g, q, *a: (asked.append(len(q)) if g is grid else None, plain(g, q, *a))[1])
    q, before = np.concatenate([p[:1000] + r.normal(size=(1000, 2)), [[-2000.0, 50.0]]]), None
    for k in range(12):
        at, d, before = grid.follow(q, before)
        want = np.hypot(*(q[:, None] - p[None]).transpose(2, 0, 1))
        assert np.array_equal(d, want.min(1)) and np.array_equal(want[np.arange(len(q)), at], d)
        q = q @ turn(0.02 / 2**k).T + 1.0 / 2**k
    assert asked[0] == 1001 and asked[-1] < 200 and sum(asked) < 5 * 1001
    d = r.integers(0, 20, 300).astype(float)
    assert all(np.array_equal(registration._least(d, k), np.sort(np.argsort(d, kind="stable")[:k])) for k in (1, 7, 150, 299, 300))


def test_spacing_leaves_out_the_point_itself():
    p = np.random.default_rng(2).uniform(0, 100, (200, 2))
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    assert registration.Grid(p).nearest(p, apart=True)[1] == pytest.approx(d.min(1))


def test_errors_are_at_the_jitter_where_a_fit_is_found(spark):
    _, o = sections(spark, [0], 300)
    rows = {(r["regime"], r["method"]): r for r in registration.recovery(o, ["section"], {"small": (1.0, 14.0), "large": (60.0, 90.0)}, 2).collect()}
    assert len(rows) == 6 and all(r["n"] == 2 for r in rows.values())
    floor = 10 * math.sqrt(math.pi / 2)  # the mean length of a jitter of 10
    for regime, method in (("small", "closest_points"), ("small", "global_search"), ("large", "global_search")):
        assert rows[regime, method]["mean_error"] == pytest.approx(floor, abs=2) and rows[regime, method]["share_within"] == 1.0
    assert rows["large", "closest_points"]["median_error"] > 100 and rows["large", "centres"]["median_error"] > 100


def test_points_far_from_all_others_are_not_compared_with_all(monkeypatch):
    """A dense middle and thin outskirts: the nearest points are right and few distances are taken for them."""
    r = np.random.default_rng(5)
    p = np.concatenate([r.normal(0, 1, (4000, 2)), r.uniform(-400, 400, (200, 2)), np.zeros((3, 2))])
    q = np.concatenate([p[::7] + 0.1, r.uniform(-400, 400, (300, 2))])
    taken, plain = [], np.hypot
    monkeypatch.setattr(registration.np, "hypot", lambda x, y: taken.append(np.size(x)) or plain(x, y))
    grid = registration.Grid(p)
    at, d = grid.nearest(q)
    assert sum(taken) < 400 * len(q)  # 4,203 each by a plain search
    own = grid.nearest(p, apart=True)[1]
    monkeypatch.undo()
    every = np.hypot(*(q[:, None] - p[None]).transpose(2, 0, 1))
    assert d.tolist() == every.min(1).tolist() and every[np.arange(len(q)), at].tolist() == d.tolist()
    every = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(every, np.inf)
    assert own.tolist() == every.min(1).tolist()
