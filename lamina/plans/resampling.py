"""Plans that draw random numbers from hashes, which SQL draws alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import resampling
from lamina.sources import fixtures as fx

from .registry import plan, rounded

_PMF = "exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(0.3::DOUBLE) + (m - k) * ln(0.7::DOUBLE))"


@plan(f"""WITH {fx.COUNTS}, n AS (SELECT obs_id, gene_id, floor(count)::BIGINT AS n FROM x),
i AS (SELECT *, least({resampling.TRIALS}, n - part * {resampling.TRIALS}) AS m, ('0x' || substr(md5(obs_id || '|' || gene_id || '|7|' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, (n + {resampling.TRIALS - 1}) // {resampling.TRIALS})) AS part FROM n)),
c AS (SELECT m, k, sum({_PMF}) OVER (PARTITION BY m ORDER BY k) AS below FROM (SELECT m, unnest(range(0, m)) AS k FROM (SELECT DISTINCT m FROM i))),
d AS (SELECT obs_id, gene_id, part, count(c.k) AS k FROM i LEFT JOIN c ON i.m = c.m AND below <= u GROUP BY ALL)
SELECT obs_id, gene_id, n AS count, sum(k)::BIGINT AS thinned FROM n JOIN d USING (obs_id, gene_id) GROUP BY ALL""")
def thinned_counts(spark, sf):
    """Each unit of every count stays with probability 0.3."""
    out = resampling.thin(fx.counts(spark, sf), 0.3, ["obs_id", "gene_id"], 7)
    return out.select("obs_id", "gene_id", F.floor("count").cast("bigint").alias("count"), "thinned")


@plan()
def planted_effect(spark, sf):
    """Half of the counts of every fifth gene by hash leave one half of the sections; which tests find these genes, and what else."""
    m = fx.obs_meta(spark, sf)
    section = F.concat_ws("/", F.col("replicate").cast("string"), (F.col("obs_id") % 8).cast("string"))
    meta = m.select("obs_id", F.when(F.col("obs_id") % 8 < 4, "A").otherwise("B").alias("grp"), section.alias("section"), F.col("replicate").alias("donor"))
    # genes that are seen often enough to be tested
    counts = fx.counts(spark, sf).withColumn("gene_id", F.col("gene_id") % 100)
    counts = counts.groupBy("obs_id", "gene_id").agg(F.sum("count").alias("count"))
    effect = counts.select("gene_id").distinct().where(resampling.uniform("gene_id", F.col("gene_id"), 1) < 0.2)
    return rounded(resampling.planted_effect(counts, meta, effect, seed=3), 5)


@plan(f"""WITH f AS (SELECT vec_id AS id, embedding[9]::DOUBLE AS x, embedding[10]::DOUBLE AS y FROM embeddings), d AS (SELECT draw, x, y, {resampling.copies_sql('id', 'draw', 11)} AS k FROM f, range(0, 400) r(draw)),
s AS (SELECT draw, sum(k) AS w, sum(k * x) AS x, sum(k * y) AS y, sum(k * x * x) AS xx, sum(k * y * y) AS yy, sum(k * x * y) AS xy FROM d GROUP BY draw UNION ALL SELECT -1, count(*), sum(x), sum(y), sum(x * x), sum(y * y), sum(x * y) FROM f),
v AS (SELECT draw, unnest(['mean_x', 'mean_y', 'correlation']) AS statistic, unnest([x / w, y / w, (w * xy - x * y) / sqrt((w * xx - x * x) * (w * yy - y * y))]) AS v FROM s WHERE w > 0)
SELECT statistic, round(max(v) FILTER (draw < 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (draw >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (draw >= 0), 6) AS high FROM v GROUP BY statistic""")
def bootstrap_intervals(spark, sf):
    """Means and correlation of two features, from 400 draws."""
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[8].cast("double").alias("x"), F.col("embedding")[9].cast("double").alias("y"))
    return rounded(resampling.bootstrap(e, 400, seed=11))


@plan(f"""WITH f AS (SELECT vec_id AS id, 'median_' || c AS statistic, v FROM (SELECT vec_id, unnest(['x', 'y', 'label']) AS c, unnest([embedding[9]::DOUBLE, embedding[10]::DOUBLE, label::DOUBLE]) AS v FROM embeddings) WHERE v IS NOT NULL),
d AS (SELECT draw, statistic, v, {resampling.copies_sql('id', 'draw', 13)} AS k FROM f, range(0, 200) r(draw) UNION ALL SELECT -1, statistic, v, 1 FROM f), s AS (SELECT draw, statistic, v, sum(k) AS k FROM d GROUP BY ALL HAVING sum(k) > 0),
u AS (SELECT *, sum(k) OVER (PARTITION BY draw, statistic ORDER BY v) AS z, sum(k) OVER (PARTITION BY draw, statistic) AS n FROM s), m AS (SELECT draw, statistic, (min(v) FILTER (z > (n - 1) // 2) + min(v) FILTER (z > n // 2)) / 2 AS v FROM u GROUP BY ALL)
SELECT statistic, round(max(v) FILTER (draw < 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (draw >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (draw >= 0), 6) AS high FROM m GROUP BY statistic""")
def bootstrap_median_intervals(spark, sf):
    """Medians of two features and of the labels, which have many equal values, from 200 draws."""
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[8].alias("x"), F.col("embedding")[9].alias("y"), "label")
    return rounded(resampling.bootstrap_medians(e, ["x", "y", "label"], 200, seed=13))
