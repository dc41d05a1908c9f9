"""Quality of spike-sorted units by recording session, kept up to date as events arrive, late ones included.

Whoever works with units of many sessions first throws out those that are not single neurons: too few spikes, a rate too low, too many
intervals below the refractory time. This job keeps that table, by session (the UTC day), and counts what passes in each.

    python -m jobs.unit_quality jobs/unit_quality.json events=/data/events output=/data/quality

Output, partitioned by session: units (metrics and whether the unit passes), sessions (counts) and marks. A mark is a session's number
of events and a checksum of them that does not depend on their order. A run takes marks of the input, which reads three columns and
keeps no more than a row a session, compares them with those on disk, and works on sessions that are new or have changed only; their
partitions are replaced, the others stay as they are. Marks are written last, so sessions of a run that failed are done again.

Cases: events without a unit, a time or an id are left out; equal events count twice, as two spikes at one time; a session that is gone
from the input stays in the output; an empty input gives empty tables; other columns are left out."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import events as ev
from lamina.sources import tables

LOG = logging.getLogger("jobs.unit_quality")

METRICS = ("n_spikes", "rate", "isi_cv", "lv", "refractory_fraction", "burst_fraction")
TABLES = {
    "units": "unit bigint, n_spikes bigint, rate double, isi_cv double, lv double, refractory_fraction double, burst_fraction double, fano double, passed boolean, session date",
    "sessions": "n_units bigint, n_passed bigint, n_spikes bigint, session date",
    "marks": "n bigint, checksum bigint, session date",
}


def _saved(df: DataFrame, path: str) -> None:
    df.hint("rebalance", "session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)


def opened(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table of the output, without rows where none has been written."""
    return tables.read_or_empty(spark, f"{output}/{name}", TABLES[name])


def spikes_of(events: DataFrame) -> DataFrame:
    """session, unit, t (seconds), event_id of events with a time, a user and an id."""
    ts = F.col("ts").cast("timestamp_ntz")
    rows = events.select(F.to_date(ts).alias("session"), F.col("user_id").alias("unit"), F.col("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return rows.where("session is not null and unit is not null and event_id is not null")


def marks_of(spikes: DataFrame) -> DataFrame:
    """session, n, checksum."""
    return spikes.groupBy("session").agg(F.count("*").alias("n"), F.sum(F.xxhash64("unit", "t", "event_id") % 1_000_000_007).alias("checksum"))


def judged(spikes: DataFrame, refractory: float, burst: float, window: float, least_spikes: int, least_rate: float, most_refractory: float) -> DataFrame:
    """unit, its metrics, passed, session: of every unit in every session."""
    own = spikes.select(F.struct("session", "unit").alias("unit"), "t", "event_id")
    m = ev.unit_metrics(own, refractory=refractory, burst=burst).join(ev.fano(own, window).select("unit", "fano"), "unit", "left")
    good = (F.col("n_spikes") >= least_spikes) & (F.col("rate") >= least_rate) & (F.col("refractory_fraction") <= most_refractory)
    return m.select("unit.unit", *METRICS, "fano", F.coalesce(good, F.lit(False)).alias("passed"), "unit.session")


def run(
    spark: SparkSession, events: str, output: str, format: str = "parquet", refractory: float = 0.0015, burst: float = 0.010, window: float = 1.0, least_spikes: int = 100, least_rate: float = 0.1,
    most_refractory: float = 0.01,
) -> DataFrame:
    """Brings units, sessions and marks up to date with the events and returns the units of all sessions.

    events: a file or folder with event_id, ts, user_id, in `format` (parquet, orc, json, csv). output: a folder. refractory, burst and
    window: seconds. A unit passes with least_spikes spikes, least_rate spikes a second and most_refractory of its intervals below
    the refractory time."""
    reader = spark.read.format(format)
    if format in ("json", "csv"):
        reader = reader.schema("event_id bigint, ts timestamp_ntz, user_id bigint").option("header", True)
    spikes = spikes_of(reader.load(events))
    now, before = marks_of(spikes), opened(spark, output, "marks").select("session", F.col("n").alias("n0"), F.col("checksum").alias("c0"))
    new = now.join(before, "session", "left").where(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("checksum").eqNullSafe(F.col("c0")))).select("session", "n", "checksum")
    # a row for each new session
    rows = new.collect()
    LOG.info("read %s: %d sessions are new or have changed, with %d events", events, len(rows), sum(r["n"] for r in rows))
    if rows:
        todo = spark.createDataFrame(rows, new.schema)
        own = spikes.join(todo.select("session"), "session", "left_semi")
        # what these sessions had before goes as a whole: a partition is replaced even if it has fewer units now
        _saved(judged(own, refractory, burst, window, least_spikes, least_rate, most_refractory), f"{output}/units")
        sessions = opened(spark, output, "units").join(todo.select("session"), "session", "left_semi").groupBy("session")
        sessions = sessions.agg(F.count("*").alias("n_units"), F.count_if("passed").alias("n_passed"), F.sum("n_spikes").alias("n_spikes"))
        _saved(sessions.select("n_units", "n_passed", "n_spikes", "session"), f"{output}/sessions")
        _saved(todo.select("n", "checksum", "session"), f"{output}/marks")
    units = opened(spark, output, "units")
    n = opened(spark, output, "sessions").agg(F.count("*"), F.sum("n_units"), F.sum("n_passed")).first()
    LOG.info("%s holds %d sessions, %d units, of which %d pass", output, n[0], n[1] or 0, n[2] or 0)
    return units


if __name__ == "__main__":
    from jobs.cli import main

    main(run)
