"""The jobs as registered queries: each runs twice into a new folder of the shared one and returns the whole output after that."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import passage_index, unit_quality
from lamina.plans.registry import rounded
from lamina.session import shared_dir


def job1_passage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the stream, benchmark items as questions."""
    folder = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        out = passage_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/state", f"{sf_dir}/benchmark.parquet")
    return rounded(out)


JOB1 = """WITH q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
p AS MATERIALIZED (SELECT doc_id, i::BIGINT AS chunk, regexp_extract_all(lower(text[i * 1200 + 1 : i * 1200 + 1200]), '[a-z0-9]+') AS w FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1200.0) AS BIGINT))) AS i FROM d WHERE length(text) > 0)),
st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM p),
tf AS (SELECT doc_id, chunk, len, term, count(*) AS tf FROM (SELECT doc_id, chunk, len(w) AS len, unnest(w) AS term FROM p) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, chunk, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) * times) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT query_id, doc_id, chunk, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk) AS rank FROM s WHERE score > 0) WHERE rank <= 4"""


def job2_unit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as spikes and days as sessions, minutes for milliseconds."""
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        out = unit_quality.run(
            spark, f"{sf_dir}/events.parquet", folder, refractory=300.0, burst=3000.0, window=3600.0, least_spikes=3, least_rate=1e-5, most_refractory=0.2
        )
    return rounded(out.withColumn("rate", out["rate"] * 1000), session="string")


JOB2 = """WITH spikes AS (SELECT ts::DATE AS session, user_id AS unit, epoch_us(ts) / 1e6 AS t, event_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL),
s AS (SELECT *, t - lag(t) OVER w AS isi FROM spikes WINDOW w AS (PARTITION BY session, unit ORDER BY t, event_id)),
i AS (SELECT *, lead(isi) OVER (PARTITION BY session, unit ORDER BY t, event_id) AS nx FROM s),
m AS (SELECT session, unit, count(*) AS n_spikes, CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) END AS rate, CASE WHEN avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) END AS isi_cv,
  avg(CASE WHEN isi + nx > 0 THEN 3 * (isi - nx) * (isi - nx) / ((isi + nx) * (isi + nx)) END) AS lv, avg((isi < 300)::INT) AS refractory_fraction,
  avg((coalesce(isi < 3000, false) OR coalesce(nx < 3000, false))::INT) AS burst_fraction FROM i GROUP BY session, unit),
sp AS (SELECT session, unit, min(t) AS t0, greatest(1, ceil((max(t) - min(t)) / 3600))::BIGINT AS k, count(*)::DOUBLE AS n FROM spikes GROUP BY session, unit),
c AS (SELECT session, unit, least(floor((t - t0) / 3600), k - 1) AS b, count(*)::DOUBLE AS c FROM spikes JOIN sp USING (session, unit) GROUP BY ALL),
f AS (SELECT session, unit, (q / k - (n / k) * (n / k)) / (n / k) AS fano FROM (SELECT session, unit, sum(c * c) AS q FROM c GROUP BY ALL) JOIN sp USING (session, unit))
SELECT unit, n_spikes, round(rate * 1000, 6) AS rate, round(isi_cv, 6) AS isi_cv, round(lv, 6) AS lv, round(refractory_fraction, 6) AS refractory_fraction, round(burst_fraction, 6) AS burst_fraction, round(fano, 6) AS fano,
  coalesce(n_spikes >= 3 AND rate >= 1e-5 AND refractory_fraction <= 0.2, false) AS passed, session::VARCHAR AS session FROM m JOIN f USING (session, unit)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_passage_index": job1_passage_index, "job2_unit_quality": job2_unit_quality}


def oracle_sql() -> dict[str, str]:
    return {"job1_passage_index": JOB1, "job2_unit_quality": JOB2}
