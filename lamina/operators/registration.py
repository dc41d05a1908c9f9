"""Sections into three dimensions: rigid fits, trimmed iterative closest points, stacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import written

from .resampling import uniform


def rigid_fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, theta, tx, ty, rmse of the best rotation and shift of (x, y) onto (u, v); in the plane the angle follows from two sums."""
    m = pairs.groupBy(*by).agg(*(F.avg(c).alias(f"m{c}") for c in "xyuv"))
    d = pairs.join(m, by).select(*by, *(F.col(f"m{c}") for c in "xyuv"), *((F.col(c) - F.col(f"m{c}")).alias(f"d{c}") for c in "xyuv"))
    dot = F.sum(F.col("dx") * F.col("du") + F.col("dy") * F.col("dv"))
    cross = F.sum(F.col("dx") * F.col("dv") - F.col("dy") * F.col("du"))
    size = F.sum(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in "xyuv"))
    g = d.groupBy(*by).agg(*(F.first(f"m{c}").alias(f"m{c}") for c in "xyuv"), dot.alias("a"), cross.alias("b"), size.alias("s"), F.count("*").alias("n"))
    t = F.atan2("b", "a")
    rest = F.sqrt(F.greatest(F.col("s") - 2 * F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), F.lit(0.0)) / F.col("n"))
    g = g.withColumn("theta", t).withColumn("rmse", rest)
    c, s = F.cos("theta"), F.sin("theta")
    return g.select(*by, "theta", (F.col("mu") - c * F.col("mx") + s * F.col("my")).alias("tx"), (F.col("mv") - s * F.col("mx") - c * F.col("my")).alias("ty"), "rmse")


def apply_affine(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """points with x and y turned and shifted by their group's fit."""
    c, s = F.cos("theta"), F.sin("theta")
    j = points.join(fits.select(*by, "theta", "tx", "ty"), by)
    return j.withColumn("_x", c * F.col("x") - s * F.col("y") + F.col("tx")).withColumn("y", s * F.col("x") + c * F.col("y") + F.col("ty")).withColumn("x", F.col("_x")).select(*points.columns)


#: Points that a point's square of a grid should hold on average, itself included, and how often squares are halved for it.
CROWD, HALVED = 3.0, 12


class Grid:
    """Nearest points by hashed grids, for one section at a time: squares as fine as the dense parts ask for, and for those with none near grids of twice the width, and so on."""

    def __init__(self, p: np.ndarray, w: float | None = None):
        self.p = p
        self.span = max(float(np.ptp(p, axis=0).max()), 1e-9)
        self.low = p.min(0)
        self.wider: Grid | None = None
        halved = 0 if w is None else HALVED
        self.w = self.span / max(1.0, math.sqrt(len(p) / 2)) if w is None else w
        while True:
            self.wide = int(self.span / self.w) + 3
            key = self._key(((p - self.low) // self.w).astype(int))
            self.order = np.argsort(key, kind="stable")
            self.keys = key[self.order]
            size = np.diff(np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1], True]))
            if halved == HALVED or (size.astype(float) ** 2).sum() <= CROWD * len(p):
                break
            self.w, halved = self.w / 2, halved + 1

    def _key(self, c: np.ndarray) -> np.ndarray:
        return (c[..., 0] + 1) * (self.wide + 2) + c[..., 1] + 1

    def nearest(self, q: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(index, distance) of the nearest point of each q. apart: q are the grid's own points, and a point is not its own neighbour."""
        return self._nearest(q, np.arange(len(q)) if apart else np.full(len(q), -1))[:2]

    def _nearest(self, q: np.ndarray, own: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """nearest() without the points numbered `own`, and, if `second`, a distance that no other point is within; those with none in the squares around look into a wider grid, and those further away than the section is wide are compared with all."""
        cell = np.clip(((q - self.low) // self.w).astype(int), -1, self.wide)
        # the three squares of a column follow each other in the order of keys
        keys = self._key(cell)[:, None] + np.array([-1, 0, 1]) * (self.wide + 2)
        lo, hi = np.searchsorted(self.keys, keys - 1, "left"), np.searchsorted(self.keys, keys + 1, "right")
        total = np.cumsum((hi - lo).sum(1))
        best, where, free = np.full(len(q), np.inf), np.zeros(len(q), int), np.full(len(q), self.w if second else 0.0)
        a = 0
        while a < len(q):  # as many points at a time as have some two million others around them
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 2_000_000, "right")))
            size = (hi[a:z] - lo[a:z]).ravel()
            of = np.repeat(np.arange(a, z), size.reshape(-1, 3).sum(1))
            at = self.order[np.repeat(lo[a:z].ravel() - (np.cumsum(size) - size), size) + np.arange(len(of))]
            d = np.hypot(self.p[at, 0] - q[of, 0], self.p[at, 1] - q[of, 1])
            d[at == own[of]] = np.inf
            if len(of):
                begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                least = np.minimum.reduceat(d, begins)
                hit = np.flatnonzero(d == np.repeat(least, np.diff(np.r_[begins, len(of)])))
                who, first = np.unique(of[hit], return_index=True)
                best[who], where[who] = least, at[hit[first]]
                if second:
                    d[hit[first]] = np.inf
                    free[who] = np.minimum(np.minimum.reduceat(d, begins), self.w)
            a = z
        far = np.flatnonzero(best > self.w)
        if len(far) and self.w < self.span:
            self.wider = self.wider or Grid(self.p, 2 * self.w)
            where[far], best[far], free[far] = self.wider._nearest(q[far], own[far], second)
            return where, best, free
        for a in range(0, len(far), 256):
            f = far[a : a + 256]
            d = np.hypot(q[f, None, 0] - self.p[None, :, 0], q[f, None, 1] - self.p[None, :, 1])
            mine = np.flatnonzero(own[f] >= 0)
            d[mine, own[f][mine]] = np.inf
            where[f], best[f], free[f] = d.argmin(1), d.min(1), 0.0
        return where, best, free

    def follow(self, q: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """nearest(), and what the next call takes as `before` when the same points have moved a little: a point whose nearest one is, after its move, still nearer than all others can be keeps it and is not searched again."""
        if before is None:
            where, best, free = self._nearest(q, np.full(len(q), -1), True)
            return where, best, (where, free, q)
        where, free, at = (x.copy() for x in before)
        best = np.hypot(self.p[where, 0] - q[:, 0], self.p[where, 1] - q[:, 1])
        # rounding has a margin
        lost = np.flatnonzero(best >= free - np.hypot(*(q - at).T) - 1e-9 * self.span)
        where[lost], best[lost], free[lost] = self._nearest(q[lost], np.full(len(lost), -1), True)
        at[lost] = q[lost]
        return where, best, (where, free, at)

    def overlap(self, q: np.ndarray, near: float) -> float:
        """The mean of two shares: of q near a point of the grid, and of the grid's points near one of q."""
        return float(((self.nearest(q)[1] <= near).mean() + (Grid(q).nearest(self.p)[1] <= near).mean()) / 2)


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    ma, mb = a.mean(0), b.mean(0)
    x, y = a - ma, b - mb
    t = math.atan2((x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum(), (x * y).sum())
    return t, mb - _turn(t) @ ma


def _turn(t: float) -> np.ndarray:
    return np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])


def _least(d: np.ndarray, keep: int) -> np.ndarray:
    """The places of the `keep` least numbers, of equal ones the first, in order of place."""
    if keep >= len(d):
        return np.arange(len(d))
    last = np.partition(d, keep - 1)[keep - 1]
    use = d < last
    use[np.flatnonzero(d == last)[: keep - int(use.sum())]] = True
    return np.flatnonzero(use)


#: Tasks that share the start angles of one pair of sections, so points are shuffled this many times and not once an angle.
SHARES = 4
_FIT = {"theta": "double", "tx": "double", "ty": "double", "rmse": "double", "overlap": "double", "overlap_before": "double", "iterations": "int"}


def closest_points(a: np.ndarray, grid: Grid, start: float, near: float, trim: float = 0.8, rounds: int = 80, tol: float = 1e-7) -> dict:
    """Trimmed iterative closest points onto a grid from one start angle (radians): theta, tx, ty, rmse of the pairs kept, overlap, iterations."""
    b = grid.p
    t, shift = start, b.mean(0) - _turn(start) @ a.mean(0)
    last, keep, done, before = math.inf, max(3, int(trim * len(a))), 0, None
    for done in range(1, rounds + 1):
        at, d, before = grid.follow(a @ _turn(t).T + shift, before)
        use = _least(d, keep)
        error = float((d[use] ** 2).mean())
        t, shift = _fit(a[use], b[at[use]])
        if abs(last - error) <= tol * max(1.0, last if math.isfinite(last) else 1.0):
            break
        last = error
    moved = a @ _turn(t).T + shift
    rest = np.sort(grid.nearest(moved)[1])[:keep]
    return {"theta": t, "tx": float(shift[0]), "ty": float(shift[1]), "rmse": float(np.sqrt((rest**2).mean())), "overlap": grid.overlap(moved, near), "iterations": done}


def _from_starts(source: DataFrame, target: DataFrame, by: list[str], angles: np.ndarray, near: float | None, rounds: int) -> DataFrame:
    """The best fit of each group from `angles` (degrees) around its `base` (radians)."""
    shares = min(SHARES, len(angles))
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    right = target.select(*by, "x", "y", share)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # names of its own, if both come from one table

    def f(key, s, t):
        if len(s) < 3 or len(t) < 3:
            return pd.DataFrame(columns=[*by, *_FIT])
        # in order of place, so that sums do not depend on the order of arrival
        a, b = (np.array(sorted(map(tuple, g[["x", "y"]].to_numpy(float)))) for g in (s, t))
        grid = Grid(b)
        reach = 1.25 * float(np.median(grid.nearest(b, apart=True)[1])) if near is None else near
        found = [closest_points(a, grid, float(s["base"].iloc[0] + np.deg2rad(x)), reach, rounds=rounds) for x in angles[key[-1] :: shares]]
        best = max(found, key=lambda r: (round(r["overlap"], 12), -round(r["rmse"] ** 2, 6)))
        return pd.DataFrame([{**dict(zip(by, key)), **best, "overlap_before": grid.overlap(a - a.mean(0) + b.mean(0), reach)}])

    kinds = ", ".join([*(f"{c} {source.schema[c].dataType.simpleString()}" for c in by), *(f"{k} {v}" for k, v in _FIT.items())])
    fits = source.select(*by, "x", "y", "base", share).groupBy(*by, "share").cogroup(right.groupBy(*by, "share")).applyInPandas(f, kinds)
    good = F.struct(F.round("overlap", 12).alias("o"), (-F.round(F.col("rmse") ** 2, 6)).alias("m"), *_FIT)
    return fits.groupBy(*by).agg(F.max(good).alias("b")).select(*by, *(f"b.{c}" for c in _FIT))


def register(source: DataFrame, target: DataFrame, by: list[str], starts: int = 31, reach: float = 15.0, global_search: bool = False, near: float | None = None) -> DataFrame:
    """by, theta, tx, ty, rmse, overlap, overlap_before, iterations: the best fit of each group's source onto its target from many start angles; the best overlap wins, then the least rmse.

    Starts are `starts` angles within `reach` degrees; the global search takes the whole circle in steps of 10 degrees and then steps of one degree
    around the best. Overlap counts points within `near` of the other section, 1.25 times the target's median spacing if not given (overlap_before: with
    centres laid over each other). Points without finite coordinates are left out; groups with fewer than 3 points on a side have no row.
    A task holds one pair of sections and a share of the starts."""
    placed = "x is not null and y is not null and abs(x) < double('inf') and abs(y) < double('inf')"  # so a NaN is out, too
    source, target = source.where(placed).withColumn("base", F.lit(0.0)), target.where(placed)
    if not global_search:
        return _from_starts(source, target, by, np.linspace(-reach, reach, starts), near, 80)
    coarse = written(_from_starts(source, target, by, np.arange(-180.0, 180.0, 10.0), near, 40).select(*by, F.col("theta").alias("base")), "starts")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    around = source.drop("base").join(coarse.select(*(F.col(c).alias(f"_{c}") for c in by), "base"), same)
    return _from_starts(around, target, by, np.arange(-10.0, 10.5, 1.0), near, 80)


def recovery(points: DataFrame, by: list[str], regimes: dict[str, tuple[float, float]], repeats: int = 3, drop: float = 0.1, jitter: float = 10.0, shift: float = 500.0, within: float = 50.0, near: float | None = None, seed: int = 0) -> DataFrame:
    """regime, method, n, median_error, mean_error, share_within: how far points (obs_id, x, y, by) end from where they were.

    Each section (by) is moved `repeats` times in each regime: some points are dropped, all others jittered (normal numbers), turned by an angle between the
    regime's bounds (degrees, either sign) and shifted, all by hashes. The methods lay it back: closest points from starts within 15 degrees, by global
    search, and centres alone. The error of a case is its points' mean distance; a method without a fit for a case has no row for it."""
    r, cases = np.random.default_rng(seed), []
    for name, (low, high) in regimes.items():
        for k in range(repeats):
            turn = float(r.uniform(low, high) * r.choice([-1, 1]))
            cases.append((f"{name}/{k}", name, math.radians(turn), *map(float, r.uniform(-shift, shift, 2))))
    table = points.sparkSession.createDataFrame(cases, "case string, regime string, angle double, dx double, dy double")
    p = points.select("obs_id", *by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).crossJoin(F.broadcast(table))  # repeats x regimes rows
    u = lambda use: uniform(F.col("obs_id"), F.col("case"), seed, use)
    size = F.sqrt(-2 * F.ln(1 - u("size"))) * jitter
    m = p.where(u("drop") >= drop).withColumns({"u": F.col("x") + size * F.cos(2 * math.pi * u("way")), "v": F.col("y") + size * F.sin(2 * math.pi * u("way"))})
    c, s = F.cos("angle"), F.sin("angle")
    m = m.select("obs_id", *by, "case", "regime", F.col("x").alias("true_x"), F.col("y").alias("true_y"), (c * F.col("u") - s * F.col("v") + F.col("dx")).alias("x"), (s * F.col("u") + c * F.col("v") + F.col("dy")).alias("y"))
    m, key = written(m, "moved"), [*by, "case"]
    target = p.select(*key, "x", "y")
    ways = {"closest_points": register(m, target, key, near=near), "global_search": register(m, target, key, global_search=True, near=near)}
    centres = m.groupBy(*key).agg(F.lit(0.0).alias("theta"), *((F.avg(f"true_{c}") - F.avg(c)).alias(f"t{c}") for c in "xy"))
    ways["centres"] = centres
    back = [apply_affine(m, fit, key).withColumn("method", F.lit(name)) for name, fit in ways.items()]
    every = back[0].unionByName(back[1]).unionByName(back[2])
    error = every.groupBy(*key, "regime", "method").agg(F.avg(F.hypot(F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y"))).alias("e"))
    return error.groupBy("regime", "method").agg(F.count("*").alias("n"), F.expr("percentile(e, 0.5D)").alias("median_error"), F.avg("e").alias("mean_error"), F.avg((F.col("e") < within).cast("double")).alias("share_within"))


def stack(points: DataFrame, spacing: float, order: str | None = None, z: str | None = None) -> DataFrame:
    """points with z: the column z if given, else order x spacing, else the section's place in its block x spacing."""
    if z:
        return points.withColumn("z", F.col(z).cast("double"))
    if order:
        return points.withColumn("z", F.col(order).cast("double") * spacing)
    places = points.select("block", "section").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("block").orderBy("section")) - 1)
    places = places.withColumnsRenamed({"block": "_b", "section": "_s"})
    on = F.col("block").eqNullSafe(F.col("_b")) & F.col("section").eqNullSafe(F.col("_s"))
    return points.join(places, on).withColumn("z", F.col("_i") * float(spacing)).select(*dict.fromkeys([*points.columns, "z"]))


def chain(points: DataFrame, order: str | None = None, near: float | None = None, global_search: bool = False) -> DataFrame:
    """The audit table, a row for each section: block, section, order, n_obs; the fit onto the section before (rotation_degrees, shift_x, shift_y, trimmed_rmse,
    overlap_before, overlap_after, iterations; null for the first and where a section has fewer than 3 points); and theta, tx, ty, which take the section to the frame of the first.

    Sections of a block go by the least value of the column `order`, if given, then by name. All neighbours are fitted in parallel, as they lie; the whole
    move of a section follows from running sums over its block's fits, a row each: angles add up, and each shift is turned by the angles before it.
    A section without a fit moves with the one before it."""
    key = F.min(F.col(order).cast("double")) if order else F.lit(0.0)
    sections = points.groupBy("block", "section").agg(key.alias("_o"), F.count("*").alias("n_obs"))
    sections = written(sections.select("block", "section", "n_obs", (F.row_number().over(Window.partitionBy("block").orderBy("_o", "section")) - 1).alias("order")), "sections")
    at = sections.select(F.col("block").alias("_b"), F.col("section").alias("_s"), F.col("order").alias("_order"))
    p = points.select("block", "section", "x", "y").join(at, F.col("block").eqNullSafe(F.col("_b")) & F.col("section").eqNullSafe(F.col("_s")))
    source = p.where("_order > 0").select("block", F.col("_order").alias("order"), "x", "y")
    fits = register(source, p.select("block", (F.col("_order") + 1).alias("order"), "x", "y"), ["block", "order"], near=near, global_search=global_search)
    fits = fits.withColumnsRenamed({"block": "_b", "order": "_order"})
    j = sections.join(fits, F.col("block").eqNullSafe(F.col("_b")) & (F.col("order") == F.col("_order")), "left")
    w = Window.partitionBy("block").orderBy("order")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    j = j.withColumn("_before", known(F.sum(known("theta")).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    c, s = F.cos("_before"), F.sin("_before")
    return j.select(
        "block", "section", "order", "n_obs", F.degrees("theta").alias("rotation_degrees"), F.col("tx").alias("shift_x"), F.col("ty").alias("shift_y"),
        F.col("rmse").alias("trimmed_rmse"), "overlap_before", F.col("overlap").alias("overlap_after"), "iterations", (F.col("_before") + known("theta")).alias("theta"),
        F.sum(known(c * F.col("tx") - s * F.col("ty"))).over(w).alias("tx"), F.sum(known(s * F.col("tx") + c * F.col("ty"))).over(w).alias("ty"),
    )


def reconstruct(points: DataFrame, spacing: float, register_sections: bool = True, order: str | None = None, z: str | None = None, audit: DataFrame | None = None) -> DataFrame:
    """obs_id, block, section, x, y, z: sections of a block laid onto each other from the first on, by `audit` (chain's table) if it is there already; heights as stack() has them."""
    flat = stack(points, spacing, order, z).select("obs_id", "block", "section", "x", "y", "z")
    if not register_sections:
        return flat
    a = (chain(points, order) if audit is None else audit).select(F.col("block").alias("_b"), F.col("section").alias("_s"), "theta", "tx", "ty")
    c, s = F.cos("theta"), F.sin("theta")
    j = flat.join(a, F.col("block").eqNullSafe(F.col("_b")) & F.col("section").eqNullSafe(F.col("_s")))
    return j.select("obs_id", "block", "section", (c * F.col("x") - s * F.col("y") + F.col("tx")).alias("x"), (s * F.col("x") + c * F.col("y") + F.col("ty")).alias("y"), "z")
