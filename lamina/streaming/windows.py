"""Event streams: the batch measures that have a natural form on streams, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, window: str, late: str, unit: str = "unit", ts: str = "ts") -> DataFrame:
    """unit, start, n: counts in fixed windows, the basis of rates and Fano factors."""
    w = events.withWatermark(ts, late).groupBy(unit, F.window(ts, window)).agg(F.count("*").alias("n"))
    return w.select(unit, F.col("window.start").alias("start"), "n")


def bursts(events: DataFrame, gap: str, late: str, unit: str = "unit", ts: str = "ts") -> DataFrame:
    """unit, start, stop, n: runs of events with less than `gap` between neighbours."""
    w = events.withWatermark(ts, late).groupBy(unit, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(ts).alias("stop"))
    return w.select(unit, F.col("session_window.start").alias("start"), "stop", "n")


def fano(counted: DataFrame, unit: str = "unit") -> DataFrame:
    """unit, n_windows, fano of window counts that were kept (windows without events count as none)."""
    return counted.groupBy(unit).agg(F.count("*").alias("n_windows"), (F.var_pop("n") / F.avg("n")).alias("fano"))
