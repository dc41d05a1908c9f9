"""Spike trains and other events in time: intervals, histograms around events, correlograms, rates, synchrony, band power."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(spikes: DataFrame) -> DataFrame:
    """unit, t, event_id, isi (to the spike before), next_isi."""
    w = Window.partitionBy("unit").orderBy("t", "event_id")
    s = spikes.select("unit", "t", "event_id").withColumn("isi", F.col("t") - F.lag("t").over(w))
    return s.withColumn("next_isi", F.lead("isi").over(w))


def unit_metrics(spikes: DataFrame, t_start: float | None = None, t_stop: float | None = None, refractory: float = 0.0015, burst: float = 0.010) -> DataFrame:
    """unit, n_spikes, rate, isi_cv (population deviation), lv, refractory_fraction, burst_fraction. Without a span each unit's first and last spike bound it."""
    s = intervals(spikes)
    w = Window.partitionBy("unit").orderBy("t", "event_id")
    s = s.withColumn("burst", (F.col("isi") < burst) | F.coalesce(F.lead("isi").over(w) < burst, F.lit(False)))
    a, b = F.col("isi"), F.col("next_isi")
    lv = F.when(a.isNotNull() & b.isNotNull() & (a + b > 0), 3 * (a - b) * (a - b) / ((a + b) * (a + b)))
    lo = F.lit(t_start) if t_start is not None else F.min("t")
    hi = F.lit(t_stop) if t_stop is not None else F.max("t")
    n = F.count("*")
    m = F.avg("isi")
    return s.groupBy("unit").agg(
        n.alias("n_spikes"), F.when(hi - lo > 0, n / (hi - lo)).alias("rate"), F.when(m > 0, F.stddev_pop("isi") / m).alias("isi_cv"), F.avg(lv).alias("lv"),
        F.avg((a < refractory).cast("double")).alias("refractory_fraction"), F.avg(F.coalesce(F.col("burst"), F.lit(False)).cast("double")).alias("burst_fraction"),
    )


def fano(spikes: DataFrame, window: float) -> DataFrame:
    """unit, n_windows, fano: variance over mean of counts in windows from a unit's first spike on; the last one may be partly past its last spike."""
    span = spikes.groupBy("unit").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    span = span.withColumn("k", F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / window)).cast("bigint"))
    c = spikes.join(span.select("unit", "t0", "k"), "unit")
    # the last window holds its right edge
    c = c.withColumn("b", F.least(F.floor((F.col("t") - F.col("t0")) / window), F.col("k") - 1)).groupBy("unit", "b").agg(F.count("*").cast("double").alias("c"))
    g = c.groupBy("unit").agg(F.sum(F.col("c") * F.col("c")).alias("q")).join(span, "unit")
    mean = F.col("n") / F.col("k")  # empty windows count through k
    return g.select("unit", F.col("k").alias("n_windows"), ((F.col("q") / F.col("k") - mean * mean) / mean).alias("fano"))


def _bucketed(left: DataFrame, right: DataFrame, lo: float, hi: float, by: list[str]) -> DataFrame:
    """Pairs with lo <= right.t - left.e < hi, through time buckets as wide as the window: a left row looks in the few buckets that it can reach."""
    width = max(hi - lo, 1e-9)
    first, last = F.floor((F.col("e") + lo) / width), F.floor((F.col("e") + hi) / width)
    a = left.withColumn("bucket", F.explode(F.sequence(first, last)))
    b = right.withColumn("bucket", F.floor(F.col("t") / width))
    return a.join(b, [*by, "bucket"]).where((F.col("t") >= F.col("e") + lo) & (F.col("t") < F.col("e") + hi)).drop("bucket")


def psth(spikes: DataFrame, stimuli: DataFrame, lo: float, hi: float, bin_s: float, by: list[str] | None = None) -> DataFrame:
    """bin, n, rate: spikes around events (column e) by bins of delay, over events and bin width. With `by`, events and spikes of a group."""
    by = by or []
    total = stimuli.groupBy(*by).agg(F.count("*").alias("events")) if by else stimuli.agg(F.count("*").alias("events"))
    j = _bucketed(stimuli.select(*by, "e"), spikes.select(*by, "t"), lo, hi, by)
    b = F.floor((F.col("t") - F.col("e") - lo) / bin_s)
    c = j.groupBy(*by, b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    c = c.join(total, by) if by else c.crossJoin(F.broadcast(total))
    return c.select(*by, "bin", "n", (F.col("n") / (F.col("events") * bin_s)).alias("rate"))


def cross_correlogram(a: DataFrame, b: DataFrame, window: float, bin_s: float) -> DataFrame:
    """bin, n of delays from spikes of one train to those of another."""
    j = _bucketed(a.select(F.col("t").alias("e")), b.select("t"), -window, window, [])
    return j.groupBy(F.floor((F.col("t") - F.col("e") + window) / bin_s).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def interval_counts(spikes: DataFrame, trials: DataFrame, length: float) -> DataFrame:
    """trial, unit, n: spikes of a trial's unit in [e, e + length), 0 included. trials has (trial, unit, e)."""
    hit = _bucketed(trials, spikes.select("unit", "t"), 0.0, length, ["unit"]).groupBy("trial").agg(F.count("*").alias("k"))
    return trials.join(hit, "trial", "left").select("trial", "unit", F.coalesce("k", F.lit(0)).cast("bigint").alias("n"))


def population_synchrony(spikes: DataFrame, bin_s: float) -> DataFrame:
    """n_units, n_bins, chi2: the variance of the mean rate over the mean variance of units, over the bins from the first to the last spike."""
    box = spikes.agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.countDistinct("unit").alias("u"))
    c = spikes.crossJoin(F.broadcast(box)).withColumn("b", F.floor((F.col("t") - F.col("t0")) / bin_s))
    k = F.floor((F.col("t1") - F.col("t0")) / bin_s) + 1
    unit = c.groupBy("unit", "b").agg(F.count("*").cast("double").alias("c")).groupBy("unit").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    pop = c.groupBy("b").agg(F.count("*").cast("double").alias("c")).agg(F.sum("c").alias("S"), F.sum(F.col("c") * F.col("c")).alias("Q"))
    units = unit.crossJoin(F.broadcast(box)).agg(F.avg(F.col("q") / k - F.col("s") / k * F.col("s") / k).alias("v"))
    one = pop.crossJoin(units).crossJoin(box)
    mean = F.col("S") / k / F.col("u")
    return one.select(F.col("u").alias("n_units"), k.cast("bigint").alias("n_bins"), ((F.col("Q") / k / F.col("u") / F.col("u") - mean * mean) / F.when(F.col("v") > 0, F.col("v"))).alias("chi2"))


def up_crossings(trace: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    """by, t of upward crossings, between samples by straight lines."""
    w = Window.partitionBy(*by).orderBy("t")
    n = trace.withColumn("v2", F.lead("v").over(w)).withColumn("t2", F.lead("t").over(w)).where((F.col("v") < threshold) & (F.col("v2") >= threshold))
    return n.select(*by, (F.col("t") + (F.col("t2") - F.col("t")) * (threshold - F.col("v")) / (F.col("v2") - F.col("v"))).alias("t"))


#: Names and edges in Hz of the usual bands.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided density) by the mean over half-overlapping Hann segments without their means."""
    size = max(2, min(size, len(x)))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, size - size // 2)
    seg = np.stack([x[i : i + size] for i in starts])
    p = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * win)) ** 2 / (fs * (win**2).sum())
    p[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p.mean(0)


def band_power(signal: DataFrame, fs: float, seconds: float = 2.0, fmax: float = 45.0, bands: dict | None = None) -> DataFrame:
    """channel, band, power, relative (to 1 Hz up to fmax) of samples (channel, i, value); one channel is one group."""
    bands = bands or BANDS

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        freq, p = welch(g["value"].to_numpy(float), fs, int(seconds * fs))
        area = lambda lo, hi: float(np.trapezoid(p[(freq >= lo) & (freq <= hi)], freq[(freq >= lo) & (freq <= hi)]))
        total = area(1.0, fmax)
        return pd.DataFrame([(g["channel"].iloc[0], k, area(lo, hi), area(lo, hi) / total if total > 0 else None) for k, (lo, hi) in bands.items()], columns=["channel", "band", "power", "relative"])

    kind = signal.schema["channel"].dataType.simpleString()
    return signal.select("channel", "i", "value").groupBy("channel").applyInPandas(f, f"channel {kind}, band string, power double, relative double")


def segment_power(signal: DataFrame, fs: float, seconds: float = 2.0, fmax: float = 45.0, bands: dict | None = None, segments: int = 64) -> DataFrame:
    """band_power for channels of any length: a group is a run of `segments` segments of a channel, and only sums of runs are put together.

    Samples are (channel, i, value) with i counted from 0; segments that lack a sample are left out, a channel without a whole one has no rows."""
    bands = bands or BANDS
    size = max(2, int(seconds * fs))
    hop = size - size // 2
    run = hop * segments
    spans = {**bands, "": (1.0, fmax)}

    def f(g: pd.DataFrame) -> pd.DataFrame:
        at = g["i"].to_numpy()
        x = np.full(run + size - hop, np.nan)
        x[at - g["run"].iloc[0] * run] = g["value"].to_numpy(float)
        seg = np.lib.stride_tricks.sliding_window_view(x, size)[:run:hop]
        seg = seg[~np.isnan(seg).any(1)]
        rows: list[tuple] = []
        if len(seg):
            freq, p = np.fft.rfftfreq(size, 1 / fs), np.mean([welch(v, fs, size)[1] for v in seg], 0)
        for k, (lo, hi) in spans.items() if len(seg) else ():
            m = (freq >= lo) & (freq <= hi)
            rows.append((g["channel"].iloc[0], k, float(np.trapezoid(p[m], freq[m])) * len(seg), len(seg)))
        return pd.DataFrame(rows, columns=["channel", "band", "s", "n"])

    kind = signal.schema["channel"].dataType.simpleString()
    first = F.floor(F.col("i") / run)
    # the last segment of a run reaches into the next one's samples
    runs = F.when((F.col("i") % run < size - hop) & (first > 0), F.array(first, first - 1)).otherwise(F.array(first))
    s = signal.where("i is not null and value is not null").select("channel", "i", "value", F.explode(runs).alias("run"))
    s = s.groupBy("channel", "run").applyInPandas(f, f"channel {kind}, band string, s double, n bigint")
    s = s.groupBy("channel", "band").agg((F.sum("s") / F.sum("n")).alias("power"))
    total = s.where("band = ''").select("channel", F.col("power").alias("total"))
    return s.where("band <> ''").join(total, "channel").select("channel", "band", "power", F.when(F.col("total") > 0, F.col("power") / F.col("total")).alias("relative"))
