"""Many small linear models at once: repeated stratified cross-validation in which all folds of all repeats are fitted in the same passes.

A row is read once a pass and counts for every model whose fold does not hold it; tasks add up what Newton's steps need (a gradient and a matrix
of inner products for each model), and only these sums, whose size depends on repeats, folds and columns, are put together. The number of
models times the square of the number of columns is bounded by MOST."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import dropped, written

from .resampling import places, uniform

#: Numbers in the sums of one pass, at most: what a task and the driver hold (256 MB).
MOST = 1 << 25


def stratified_folds(labels: DataFrame, folds: int, repeats: int, seed: int = 0) -> DataFrame:
    """obs_id, y, repeat, fold: in every repeat the rows of a label are put in order of a hash and dealt to the folds in turn.

    No label is put in order in one task. Rows with a null label or id
    are left out; a repeated id is dealt as often as it is there."""
    rows = labels.where("obs_id is not null and y is not null").select("obs_id", "y").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = places(rows.withColumn("u", uniform(F.col("obs_id"), F.col("repeat"), seed)), ("repeat", "y"))
    return rows.select("obs_id", "y", "repeat", (F.col("place") % folds).cast("int").alias("fold"))


@dataclass(frozen=True)
class Loss:
    """Value, slope and curvature by margin of a loss, and whether the constant is penalised like the other weights."""

    parts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    whole: bool


def _logistic(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
    return np.logaddexp(0, -m), -p, p * (1 - p)


def _hinge(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.maximum(1 - m, 0)
    return gap * gap, -2 * gap, 2.0 * (gap > 0)


#: By name: logistic regression, and the support vector machine with squared hinge whose constant is one more weight.
LOSSES = {"logistic": Loss(_logistic, False), "squared_hinge": Loss(_hinge, True)}


def _pass(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], models: int) -> np.ndarray:
    """The sums over all rows of what `sums` makes of blocks (x, confound, y, held: model of each repeat), one array of numbers for each model."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                x, c, y, held = (np.array(part.column(i).to_pylist(), float) for i in range(4))
                got = sums(x, c, y, held.astype(int))
                total = got if total is None else total + got
        if total is not None:
            for m, v in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["m", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for m, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                out[m] = out[m] + v if m in out else v
        for m, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["m", "v"])

    parts = rows.select("x", "c", "y", "held").mapInArrow(add, "m int, v array<double>").repartition("m").mapInArrow(merged, "m int, v array<double>")
    found = {r["m"]: np.array(r["v"]) for r in parts.collect()}
    if not found:
        return np.zeros((models, 0))
    width = len(next(iter(found.values())))
    return np.stack([found.get(m, np.zeros(width)) for m in range(models)])


def _moments(x: np.ndarray, c: np.ndarray, y: np.ndarray, held: np.ndarray, models: int) -> np.ndarray:
    """By the fold that holds a row: counts of both classes, sums of c, cc, x, xx and cx."""
    row = np.concatenate([(1 - y)[:, None], y[:, None], c[:, None], (c * c)[:, None], x, x * x, c[:, None] * x], 1)
    out = np.zeros((models, row.shape[1]))
    for r in range(held.shape[1]):
        np.add.at(out, held[:, r], row)
    return out


@dataclass
class Frame:
    """How a model sees a row: (x - start - slope * confound) / scale, from the rows that it learns from."""

    start: np.ndarray
    slope: np.ndarray
    scale: np.ndarray
    counts: np.ndarray

    def apply(self, m: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        z = (x - self.start[m] - np.outer(c, self.slope[m])) / self.scale[m]
        return np.concatenate([np.ones((len(z), 1)), z], 1)


def _frames(own: np.ndarray, folds: int, d: int, confound: bool) -> Frame:
    """What every model learns from: the total of its repeat less its own fold."""
    total = own.reshape(-1, folds, own.shape[1])
    learn = (total.sum(1, keepdims=True) - total).reshape(own.shape)
    n0, n1, c, cc = learn[:, :4].T
    n = np.maximum(n0 + n1, 1)[:, None]
    x, xx, cx = learn[:, 4 : 4 + d] / n, learn[:, 4 + d : 4 + 2 * d] / n, learn[:, 4 + 2 * d :] / n
    mc = c[:, None] / n
    vc, cov = cc[:, None] / n - mc * mc, cx - mc * x
    slope = np.where(vc > 1e-12, cov / np.maximum(vc, 1e-12), 0.0) if confound else np.zeros_like(x)
    var = np.maximum(xx - x * x - 2 * slope * cov + slope * slope * vc, 0)
    return Frame(x - slope * mc, slope, np.where(var > 1e-18, np.sqrt(var), 1.0), learn[:, :2])


def fit_folds(rows: DataFrame, folds: int, repeats: int, frame: Frame, loss: str, strength: float, balanced: bool, rounds: int, tolerance: float, used: np.ndarray) -> np.ndarray:
    """Weights (constant first) of all models by Newton's method. A step that raises a model's own objective is halved; not to settle is an error."""
    kind, models, d = LOSSES[loss], len(used), frame.start.shape[1] + 1
    n = frame.counts.sum(1, keepdims=True)
    share = n / (2 * np.maximum(frame.counts, 1)) if balanced else np.ones_like(frame.counts)
    ridge = np.full(d, 1.0)
    if not kind.whole:
        ridge[0] = 0.0
    good = used & (frame.counts.min(1) > 0)
    w, step, lowest = np.zeros((models, d)), np.zeros((models, d)), np.full(models, np.inf)
    active = good.copy()
    for _ in range(rounds):
        now, todo = w + step, np.flatnonzero(active)

        def sums(x, c, y, held, now=now, todo=todo):
            out = np.zeros((models, 1 + d + d * d))
            for m in todo:
                take = held[:, m // folds] != m
                z, sign, cost = frame.apply(m, x[take], c[take]), 2 * y[take] - 1, strength * share[m][y[take].astype(int)]
                value, slope, bend = kind.parts(sign * (z @ now[m]))
                out[m, 0] = cost @ value
                out[m, 1 : 1 + d] = z.T @ (cost * slope * sign)
                out[m, 1 + d :] = (z.T @ (z * (cost * bend)[:, None])).ravel()
            return out

        got = _pass(rows, sums, models)
        for m in todo:
            value = got[m, 0] + 0.5 * ridge @ (now[m] * now[m])
            if value > lowest[m] + 1e-12 * abs(lowest[m]):
                step[m] /= 2
            else:
                w[m], lowest[m] = now[m], value
                slope = got[m, 1 : 1 + d] + ridge * w[m]
                step[m] = -np.linalg.solve(got[m, 1 + d :].reshape(d, d) + np.diag(ridge + 1e-10), slope)
            active[m] = np.abs(step[m]).max() > tolerance
        if not active.any():
            break
    else:
        raise RuntimeError(f"{int(active.sum())} of {models} models did not settle in {rounds} rounds")
    w[~good] = np.nan
    return w


def cross_validate(
    data: DataFrame, folds: int = 5, repeats: int = 10, loss: str = "logistic", confound: str | None = None, strength: float = 1.0, balanced: bool = False,
    held_out: int | None = None, seed: int = 0, rounds: int = 100, tolerance: float = 1e-8, dealt: DataFrame | None = None,
) -> DataFrame:
    """repeat, fold, n, accuracy, balanced_accuracy of every held-out fold; data has obs_id, y (0 or 1), features (array of doubles) and the confound.

    With a confound, what it explains of a column is taken out by a line fitted to the rows that a model learns from; columns are then scaled by
    the same rows. held_out=1 fits only the first fold of each repeat: repeated random halves, thirds and so on, stratified.
    dealt (obs_id, repeat, fold) takes the place of stratified_folds. Rows with a null or non-finite number, a null label or another label than 0 and 1 are left out, ids must not repeat.
    Folds with no row, or whose models learn from one class only, have no row in the result; the balanced accuracy of a fold with one class is that class's share."""
    if loss not in LOSSES:
        raise ValueError(f"loss {loss!r} is none of {', '.join(LOSSES)}")
    if folds < 2 or repeats < 1:
        raise ValueError(f"{folds} folds, {repeats} repeats")
    whole = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = data.where("obs_id is not null and y in (0, 1) and features is not null").select("obs_id", F.col("y").cast("int").alias("y"), F.transform("features", lambda v: v.cast("double")).alias("x"), (whole(confound) if confound else F.lit(0.0)).alias("c"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.where(finite(F.col("c")) & F.forall("x", finite))
    d = rows.select(F.size("x").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    schema = "repeat int, fold int, n bigint, accuracy double, balanced_accuracy double"
    if d["a"] is None:
        return data.sparkSession.createDataFrame([], schema)
    if d["a"] != d["b"]:
        raise ValueError(f"features of {d['a']} to {d['b']} columns")
    d, models = d["a"], folds * repeats
    if models * (d + 2) ** 2 > MOST:
        raise ValueError(f"{models} models of {d} columns: more than {MOST} sums")
    if dealt is None:
        dealt = stratified_folds(rows, folds, repeats, seed)
    held = dealt.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("repeat", "fold"))).alias("h"))
    rows = written(rows.join(held, "obs_id").select("x", "c", F.col("y").cast("double").alias("y"), F.transform("h", lambda h: h["repeat"] * folds + h["fold"]).alias("held")), "folds")
    used = np.arange(models) % folds < (folds if held_out is None else held_out)
    own = _pass(rows, lambda x, c, y, held: _moments(x, c, y, held, models), models)
    if not own.shape[1]:
        return data.sparkSession.createDataFrame([], schema)
    frame = _frames(own, folds, d, confound is not None)
    w = fit_folds(rows, folds, repeats, frame, loss, strength, balanced, rounds, tolerance, used)

    def confusion(x, c, y, held):
        out = np.zeros((models, 4))
        for r in range(held.shape[1]):
            for m in np.unique(held[:, r]):
                take = held[:, r] == m
                if np.isfinite(w[m]).all():
                    said = frame.apply(m, x[take], c[take]) @ w[m] > 0
                    out[m] += np.bincount((2 * y[take] + said).astype(int), minlength=4)
        return out

    out = []
    for m, (a, b, c, e) in enumerate(_pass(rows, confusion, models)):
        if (n := a + b + c + e) > 0:
            shares = [good / size for good, size in ((a, a + b), (e, c + e)) if size]
            out.append((m // folds, m % folds, int(n), float((a + e) / n), float(np.mean(shares))))
    dropped(rows)
    return data.sparkSession.createDataFrame(out, schema)


def summary(results: DataFrame, arm: str) -> DataFrame:
    """arm, splits, mean and population deviation of both accuracies."""
    kinds = [f(c).alias(f"{c}_{n}") for c in ("accuracy", "balanced_accuracy") for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    return results.agg(F.count("*").alias("splits"), *kinds).select(F.lit(arm).alias("arm"), "*")


def log_variance(samples: DataFrame, by: str = "channel") -> DataFrame:
    """obs_id, features: the log of the variance of every channel's values, in order of channels. Points without two values of some channel are left out; no variance counts as 1e-12."""
    v = samples.groupBy("obs_id", by).agg(F.var_pop("value").alias("v"), F.count("value").alias("n")).where("n > 1")
    every = samples.where(F.col(by).isNotNull()).agg(F.count_distinct(by).alias("every"))
    rows = v.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct(by, F.ln(F.greatest("v", F.lit(1e-12))).alias("x")))).alias("r"))
    return rows.crossJoin(F.broadcast(every)).where(F.size("r") == F.col("every")).select("obs_id", F.col("r.x").alias("features"))
