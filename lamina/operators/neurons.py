"""Model neurons: closed forms as expressions, and simulations as sweeps in which a row of parameters is one run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaky integrate-and-fire in ms, mV, nA and MOhm.
LIF = {"tau": 20.0, "rest": -70.0, "reset": -70.0, "threshold": -50.0, "resistance": 10.0, "refractory": 2.0}
#: The squid axon of Hodgkin and Huxley, in uF, mS and mV, with rest at -65 mV.
HH = {"c": 1.0, "g_na": 120.0, "g_k": 36.0, "g_l": 0.3, "e_na": 50.0, "e_k": -77.0, "e_l": -54.387}


def lif_rate(current: Column, p: dict = LIF) -> Column:
    """Firing rate in Hz at a constant current: 0 at or below the current that just reaches the threshold."""
    drive = current * p["resistance"]
    need = p["threshold"] - p["rest"]
    t = p["refractory"] + p["tau"] * F.ln((drive + (p["rest"] - p["reset"])) / (drive - need))
    return F.when(drive > need, 1000.0 / t).otherwise(0.0)


def simulate_lif(current: float, seconds: float, dt: float = 0.01, p: dict = LIF) -> int:
    """Spikes in `seconds`, with the exact step of the linear equation."""
    decay = math.exp(-dt / p["tau"])
    v, left, n = p["rest"], 0.0, 0
    goal = p["rest"] + p["resistance"] * current
    for _ in range(int(seconds * 1000 / dt)):
        if left > 1e-9:
            left -= dt
            continue
        v = goal + (v - goal) * decay
        if v >= p["threshold"]:
            v, left, n = p["reset"], p["refractory"], n + 1
    return n


def _ratio(x: np.ndarray, scale: float) -> np.ndarray:
    """x / (1 - exp(-x / scale)), and its limit at 0."""
    small = np.abs(x) < 1e-7
    y = np.where(small, 1.0, x)
    return np.where(small, scale, y / -np.expm1(-y / scale))


def _slopes(s: np.ndarray, current: np.ndarray, na: np.ndarray, p: dict) -> np.ndarray:
    v, m, h, n = s
    out = np.empty_like(s)
    ionic = p["g_na"] * na * m**3 * h * (v - p["e_na"]) + p["g_k"] * n**4 * (v - p["e_k"]) + p["g_l"] * (v - p["e_l"])
    out[0] = (current - ionic) / p["c"]
    out[1] = 0.1 * _ratio(v + 40, 10.0) * (1 - m) - 4 * np.exp(-(v + 65) / 18) * m
    out[2] = 0.07 * np.exp(-(v + 65) / 20) * (1 - h) - h / (1 + np.exp(-(v + 35) / 10))
    out[3] = 0.01 * _ratio(v + 55, 10.0) * (1 - n) - 0.125 * np.exp(-(v + 65) / 80) * n
    return out


def simulate_hh(current: np.ndarray, sodium: np.ndarray, ms: float = 500.0, dt: float = 0.02, p: dict = HH) -> np.ndarray:
    """Spikes per run, all runs of an array at once, by fourth-order Runge-Kutta; sodium is the share of its conductance that is left."""
    s = np.array([np.full(len(current), x) for x in (-65.0, 0.0529, 0.5961, 0.3177)])
    count = np.zeros(len(current), np.int64)
    for _ in range(int(ms / dt)):
        a = _slopes(s, current, sodium, p)
        b = _slopes(s + dt / 2 * a, current, sodium, p)
        c = _slopes(s + dt / 2 * b, current, sodium, p)
        d = _slopes(s + dt * c, current, sodium, p)
        new = s + dt / 6 * (a + 2 * b + 2 * c + d)
        count += (s[0] < 0) & (new[0] >= 0)
        s = new
    return count


def hh_sweep(runs: DataFrame, ms: float = 500.0, dt: float = 0.02) -> DataFrame:
    """run, current, sodium, n_spikes, rate for rows (run, current, sodium)."""

    def f(batches):
        for p in batches:
            n = simulate_hh(p["current"].to_numpy(float), p["sodium"].to_numpy(float), ms, dt)
            yield p.assign(n_spikes=n, rate=n / ms * 1000)

    return runs.select("run", "current", "sodium").mapInPandas(f, "run bigint, current double, sodium double, n_spikes bigint, rate double")


def brunel(g: float, eta: float, seed: int, n_e: int = 2000, ms: float = 1000.0, dt: float = 0.1, share: float = 0.1, weight: float = 0.1, delay: float = 1.5, burn: float = 100.0) -> dict:
    """Rates in Hz (excitatory, inhibitory), mean interval variation and synchrony after `burn` ms of a sparse random network under Poisson drive of eta times the threshold rate."""
    r = np.random.default_rng(seed)
    n_i = n_e // 4
    n, ce, ci = n_e + n_i, max(1, int(share * n_e)), max(1, int(share * n_i))
    post = np.repeat(np.arange(n), ce + ci)
    pre = np.concatenate([r.integers(0, n_e, (n, ce)), r.integers(n_e, n, (n, ci))], 1).ravel()
    order = np.argsort(pre, kind="stable")
    post, start = post[order], np.searchsorted(pre[order], np.arange(n + 1))
    tau, theta, reset, ref = 20.0, 20.0, 10.0, round(2.0 / dt)
    drive = eta * theta / (weight * tau) * dt  # external spikes a step
    steps, lag, decay = int(ms / dt), max(1, round(delay / dt)), math.exp(-dt / tau)
    v, still, queue = r.uniform(0, theta, n), np.zeros(n, int), np.zeros((lag, n))
    when, who = [], []
    for t in range(steps):
        slot = queue[t % lag]
        free = still <= 0
        v = np.where(free, v * decay + slot + weight * r.poisson(drive, n), v)
        slot[:] = 0
        still -= ~free
        fired = np.flatnonzero(v >= theta)
        if len(fired):
            v[fired], still[fired] = reset, ref
            when.append(np.full(len(fired), t * dt)), who.append(fired)
            for cells, w in ((fired[fired < n_e], weight), (fired[fired >= n_e], -g * weight)):
                if len(cells):
                    slot += w * np.bincount(np.concatenate([post[start[j] : start[j + 1]] for j in cells]), minlength=n)
    when, who = (np.concatenate(x) if x else np.empty(0) for x in (when, who))
    when, who = when[when >= burn], who[when >= burn].astype(int)
    rate = np.bincount(who, minlength=n) / max(1e-9, (ms - burn) / 1000)
    order = np.lexsort((when, who))
    t, i = when[order], who[order]
    gap, same = np.diff(t), np.diff(i) == 0
    cv = [x.std() / x.mean() for x in np.split(gap[same & (i[1:] < n_e)], np.flatnonzero(np.diff(i[1:][same & (i[1:] < n_e)])) + 1) if len(x) > 2 and x.mean() > 0]
    bins = np.zeros((max(1, int(ms - burn)), min(200, n_e)), np.float32)
    few = who < bins.shape[1]
    np.add.at(bins, (np.minimum((when[few] - burn).astype(int), len(bins) - 1), who[few]), 1)
    spread = bins.var(0).mean()
    return {"rate_e": float(rate[:n_e].mean()), "rate_i": float(rate[n_e:].mean()), "isi_cv": float(np.mean(cv)) if cv else math.nan, "synchrony": float(bins.mean(1).var() / spread) if spread > 0 else math.nan}


def brunel_sweep(runs: DataFrame, **kw) -> DataFrame:
    """run, g, eta and the measures of brunel() for rows (run, g, eta); a run is one task's work."""

    def f(batches):
        for p in batches:
            out = [brunel(float(a), float(b), int(i), **kw) for i, a, b in zip(p["run"], p["g"], p["eta"], strict=True)]
            yield pd.DataFrame({"run": p["run"], "g": p["g"], "eta": p["eta"], **{k: [x[k] for x in out] for k in ("rate_e", "rate_i", "isi_cv", "synchrony")}})

    return runs.select("run", "g", "eta").mapInPandas(f, "run bigint, g double, eta double, rate_e double, rate_i double, isi_cv double, synchrony double")
