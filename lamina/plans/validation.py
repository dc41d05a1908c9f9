"""Plans that fit many small models and test them on rows that they did not learn from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import validation
from lamina.sources import fixtures as fx

from .registry import plan, rounded

_U = "('0x' || substr(md5(obs_id || '|' || repeat || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_DEALT = f"""e AS (SELECT vec_id AS obs_id, (label >= 5)::INT AS y, embedding[1]::DOUBLE AS c FROM embeddings),
f AS MATERIALIZED (SELECT obs_id, y, c, repeat, (row_number() OVER (PARTITION BY repeat, y ORDER BY u, obs_id) - 1) % 5 AS fold FROM (SELECT e.*, repeat, {_U} AS u FROM e, range(10) r(repeat)))"""


def _labelled(spark, sf):
    """Vectors in two classes, the first component as what might explain them, 56 others as features."""
    e = F.col("embedding")
    return fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("obs_id"), (F.col("label") >= 5).cast("int").alias("y"), e[0].cast("double").alias("c"), F.slice(e, 9, 56).cast("array<double>").alias("features"))


@plan(f"WITH {_DEALT} SELECT obs_id, y::BIGINT AS y, repeat, fold FROM f")
def stratified_folds(spark, sf):
    return rounded(validation.stratified_folds(_labelled(spark, sf), 5, 10))


@plan(f"""WITH RECURSIVE {_DEALT}, l AS (SELECT f.repeat, g.fold, y, c FROM f JOIN range(5) g(fold) ON f.fold <> g.fold),
mo AS MATERIALIZED (SELECT repeat, fold, avg(c) AS mu, stddev_pop(c) AS sd, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM l GROUP BY ALL),
z AS MATERIALIZED (SELECT repeat, fold, 2 * y - 1 AS s, (c - mu) / sd AS x, (n0 + n1) / (2::DOUBLE * CASE WHEN y = 1 THEN n1 ELSE n0 END) AS k FROM l JOIN mo USING (repeat, fold)),
w AS (SELECT repeat, fold, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS i FROM mo UNION ALL
  SELECT repeat, fold, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), i + 1 FROM
  (SELECT repeat, fold, any_value(a) AS a, any_value(b) AS b, any_value(i) AS i, -sum(k * p * s) AS g0, any_value(b) - sum(k * p * s * x) AS g1, sum(k * p * (1 - p)) AS h00, sum(k * p * (1 - p) * x) AS h01, 1 + sum(k * p * (1 - p) * x * x) AS h11
   FROM (SELECT z.*, a, b, i, 1 / (1 + exp(s * (a + b * x))) AS p FROM w JOIN z USING (repeat, fold) WHERE i < 20) GROUP BY repeat, fold)),
t AS (SELECT repeat, fold, y, (a + b * (c - mu) / sd > 0)::INT = y AS good FROM f JOIN w USING (repeat, fold) JOIN mo USING (repeat, fold) WHERE i = 20)
SELECT repeat, fold, count(*) AS n, round(avg(good::INT), 6) AS accuracy, round((avg(good::INT) FILTER (y = 0) + avg(good::INT) FILTER (y = 1)) / 2, 6) AS balanced_accuracy FROM t GROUP BY repeat, fold""")
def motion_baseline(spark, sf):
    """How well what might explain the classes tells them apart by itself: balanced logistic regression, ten times five folds."""
    d = _labelled(spark, sf).select("obs_id", "y", F.array("c").alias("features"))
    return rounded(validation.cross_validate(d, 5, 10, "logistic", balanced=True))


@plan()
def confound_arms(spark, sf):
    """Three arms over the same folds: the confound alone, features by a support vector machine, and features without what the confound explains."""
    d = _labelled(spark, sf)
    alone = d.select("obs_id", "y", F.array("c").alias("features"))
    arms = {"confound alone": (alone, "logistic", None, True), "features": (d, "squared_hinge", None, False), "features without confound": (d, "squared_hinge", "c", False)}
    out = [validation.summary(validation.cross_validate(t, 5, 10, loss, confound, balanced=even), arm) for arm, (t, loss, confound, even) in arms.items()]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), 4)


@plan()
def log_variance_decoding(spark, sf):
    """Two classes of trials by the log variance of their channels: logistic regression, ten times a fifth held out."""
    s = fx.read(spark, sf, "events").select(F.col("user_id").alias("obs_id"), F.col("event_type").alias("channel"), "value")
    d = validation.log_variance(s).withColumn("y", (F.col("obs_id") % 2).cast("int"))
    return rounded(validation.cross_validate(d, 5, 10, "logistic", held_out=1), 4)
