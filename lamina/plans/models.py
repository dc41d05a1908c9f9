"""Plans with iterative or learned parts; tests hold them against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import diffusion, elimination, fuzzy, graph, learning, registration
from lamina.sources import fixtures as fx

from .registry import plan, rounded
from .spatial import graph_sql


@plan()
def pca_scores(spark, sf):
    return learning.pca(fx.features(spark, sf), 10)


@plan()
def kmeans_domains(spark, sf):
    return learning.detect_domains(fx.obs(spark, sf), fx.features(spark, sf), 6)


@plan()
def mixture_clusters(spark, sf):
    return learning.gaussian_mixture(learning.pca(fx.features(spark, sf), 20), 4)


@plan()
def niche_clusters(spark, sf):
    return learning.niches(fx.obs(spark, sf), 5)


@plan()
def forest_accuracy(spark, sf):
    o = fx.obs(spark, sf).select("obs_id", F.col("block").alias("label"), F.col("section").alias("grp"))
    return learning.random_forest(fx.features(spark, sf), o.withColumn("grp", F.col("obs_id") % 20), shuffles=20)


@plan()
def svc_accuracy(spark, sf):
    o = fx.obs(spark, sf).select("obs_id", (F.col("label") % 2).alias("label"), (F.col("obs_id") % 20).alias("grp"))
    return learning.svc_folds(fx.features(spark, sf), o, 5)


@plan()
def nnls_deconvolution(spark, sf):
    f = fx.features(spark, sf).withColumn("value", F.greatest("value", F.lit(0.0)))
    ref = f.join(fx.obs(spark, sf).select("obs_id", "label"), "obs_id").groupBy(F.concat(F.lit("T"), F.col("label").cast("string")).alias("type"), "gene_id").agg(F.avg("value").alias("value"))
    return learning.deconvolve(f, ref)


@plan("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS f, label::VARCHAR AS label FROM embeddings), d AS (SELECT q.vec_id AS obs_id, r.label, (r.vec_id % 30)::DOUBLE AS age, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.f, r.f), r.vec_id) AS k
  FROM e q JOIN e r ON q.vec_id % 2 = 1 AND r.vec_id % 2 = 0), n AS (SELECT * FROM d WHERE k <= 15), v AS (SELECT obs_id, label, count(*) AS c FROM n GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY c DESC, label) AS r FROM v) SELECT obs_id, label, round(c / 15.0::DOUBLE, 6) AS confidence, round(age, 6) AS age FROM t JOIN (SELECT obs_id, quantile_cont(age, 0.5) AS age FROM n GROUP BY obs_id) USING (obs_id) WHERE r = 1""")
def reference_mapping(spark, sf):
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("obs_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    ref, query = e.where("obs_id % 2 = 0"), e.where("obs_id % 2 = 1")
    labels = ref.select("obs_id", F.col("label").cast("string").alias("label"), (F.col("obs_id") % 30).cast("double").alias("age"))
    return rounded(learning.map_to_reference(query, ref, labels))


_RANK = "rank() OVER (PARTITION BY {b} ORDER BY value) + (count(*) OVER (PARTITION BY {b}, value) - 1) / 2.0::DOUBLE"


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, m AS (SELECT label AS cluster, gene_id, avg(value) AS value FROM feat JOIN obs USING (obs_id) GROUP BY ALL), r AS (SELECT block AS region, gene_id, avg(value) AS value FROM feat JOIN obs USING (obs_id) GROUP BY ALL),
a AS (SELECT cluster, gene_id, {_RANK.format(b='cluster')} AS ra FROM m), b AS (SELECT region, gene_id, {_RANK.format(b='region')} AS rb FROM r) SELECT cluster, region, round(corr(ra, rb), 6) AS rho FROM a JOIN b USING (gene_id) GROUP BY ALL""")
def region_identity(spark, sf):
    o, f = fx.obs(spark, sf), fx.features(spark, sf)
    regions = f.join(o.select("obs_id", F.col("block").alias("region")), "obs_id").groupBy("region", "gene_id").agg(F.avg("value").alias("value"))
    return rounded(learning.region_identity(f, o.select("obs_id", F.col("label").alias("cluster")), regions))


@plan(f"""WITH RECURSIVE {fx.OBS}, {graph_sql(6)}, r AS (SELECT 0::BIGINT AS node, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN g ON src = node WHERE d < (SELECT count(*) FROM obs)), s AS (SELECT node, min(d) AS d FROM r GROUP BY node)
SELECT o.src AS obs_id, round(d / (SELECT max(d) FROM s)::DOUBLE, 6) AS time FROM (SELECT DISTINCT src FROM g) o LEFT JOIN s ON o.src = node""")
def graph_pseudotime(spark, sf):
    o = fx.obs(spark, sf)
    return rounded(learning.pseudotime(graph.knn_graph(o, 6).withColumn("w", F.lit(1.0)), 0, graph.parts(o)))


@plan(f"""WITH {fx.OBS}, p AS (SELECT block, x, y, x * cos(0.1) - y * sin(0.1) + 120 + (obs_id % 5) AS u, x * sin(0.1) + y * cos(0.1) - 80 AS v FROM obs), m AS (SELECT block, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY block),
d AS (SELECT block, x - mx AS x, y - my AS y, u - mu AS u, v - mv AS v FROM p JOIN m USING (block)), s AS (SELECT block, sum(x * u + y * v) AS a, sum(x * v - y * u) AS b, sum(x * x + y * y + u * u + v * v) AS s, count(*) AS n FROM d GROUP BY block)
SELECT block, round(atan2(b, a), 6) AS theta, round(mu - cos(atan2(b, a)) * mx + sin(atan2(b, a)) * my, 6) AS tx, round(mv - sin(atan2(b, a)) * mx - cos(atan2(b, a)) * my, 6) AS ty, round(sqrt(greatest(s - 2 * sqrt(a * a + b * b), 0) / n), 6) AS rmse FROM s JOIN m USING (block)""")
def rigid_fit(spark, sf):
    c, s = F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    p = fx.obs(spark, sf).select("block", "x", "y", (F.col("x") * c - F.col("y") * s + 120 + F.col("obs_id") % 5).alias("u"), (F.col("x") * s + F.col("y") * c - 80).alias("v"))
    return rounded(registration.rigid_fit(p, ["block"]))


@plan()
def icp_registration(spark, sf):
    o = fx.obs(spark, sf).select("block", "x", "y")
    c, s = F.cos(F.lit(0.12)), F.sin(F.lit(0.12))
    return registration.register(o.select("block", (F.col("x") * c - F.col("y") * s + 20).alias("x"), (F.col("x") * s + F.col("y") * c - 10).alias("y")), o, ["block"]).select("block", "theta", "tx", "ty", "rmse", "overlap")


@plan(f"WITH {fx.OBS}, s AS (SELECT block, section, row_number() OVER (PARTITION BY block ORDER BY section) - 1 AS i FROM obs GROUP BY block, section) SELECT obs_id, block, section, round(x, 6) AS x, round(y, 6) AS y, i * 20.0::DOUBLE AS z FROM obs JOIN s USING (block, section)")
def stack_sections(spark, sf):
    return rounded(registration.reconstruct(fx.obs(spark, sf), 20.0, register_sections=False))


@plan()
def reconstruct_3d(spark, sf):
    return registration.reconstruct(fx.obs(spark, sf), 20.0)


@plan()
def section_audit(spark, sf):
    """What the fit of each section onto the one before it found, and where it went."""
    return registration.chain(fx.obs(spark, sf))


@plan()
def registration_error(spark, sf):
    """Every section moved three times by up to 15 degrees and three times by 15 to 45, and laid back by three methods."""
    return registration.recovery(fx.obs(spark, sf), ["section"], {"to_15": (0.0, 15.0), "15_to_45": (15.0, 45.0)})


@plan()
def diffusion_map_times(spark, sf):
    """Components of the diffusion map of the graph of nearest neighbours over all blocks, and diffusion pseudotime from one spot."""
    o = fx.obs(spark, sf).withColumn("block", F.lit("all"))
    g = graph.written(graph.knn_graph(o, 10, weight="gaussian"), "graph")
    mapped = diffusion.diffusion_map(g, 4, graph.parts(o), graph.squares(o, elimination.LEAF))
    out = mapped[1].withColumnRenamed("node", "obs_id").join(diffusion.diffusion_pseudotime(g, 0, 3, mapped), "obs_id")
    return rounded(out.select("obs_id", "v1", "v2", "v3", "time"), 5)


@plan(f"""WITH RECURSIVE {fx.FEATURES}, d AS (SELECT a.obs_id AS src, b.obs_id AS dst, sum((a.value - b.value) * (a.value - b.value)) AS d2 FROM feat a JOIN feat b ON a.gene_id = b.gene_id AND a.obs_id <> b.obs_id GROUP BY ALL),
nn AS MATERIALIZED (SELECT src, dst, sqrt(d2) AS d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d) WHERE rank <= 14),
p AS MATERIALIZED (SELECT src, list(d) AS ds, log2(count(*) + 1) AS t, coalesce(min(d) FILTER (d > 0), 0) AS r, avg(d) AS m FROM nn GROUP BY src),
b AS (SELECT src, 0::DOUBLE AS lo, NULL::DOUBLE AS hi, 1::DOUBLE AS s, 0 AS i FROM p UNION ALL
  SELECT src, CASE WHEN big THEN lo ELSE s END, CASE WHEN big THEN s ELSE hi END, CASE WHEN big THEN (lo + s) / 2 WHEN hi IS NULL THEN 2 * s ELSE (s + hi) / 2 END, i + 1
  FROM (SELECT b.*, list_sum([exp(-greatest(x - r, 0) / s) FOR x IN ds]) > t AS big FROM b JOIN p USING (src) WHERE i < {fuzzy.HALVINGS})),
w AS (SELECT src, dst, CASE WHEN d <= r THEN 1 ELSE exp(-(d - r) / greatest(s, {fuzzy.LEAST} * CASE WHEN r > 0 THEN m ELSE (SELECT avg(d) FROM nn) END)) END AS w FROM nn JOIN p USING (src) JOIN b USING (src) WHERE i = {fuzzy.HALVINGS}),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(w) - CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END AS w FROM w GROUP BY ALL)
SELECT a AS src, b AS dst, round(w, 6) AS w FROM u WHERE w > 0 UNION ALL SELECT b, a, round(w, 6) FROM u WHERE w > 0""")
def fuzzy_neighbours(spark, sf):
    """The fuzzy graph of spots and their 14 nearest others by 56 features."""
    f = fx.features(spark, sf).groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "value"))).alias("r")).select("obs_id", F.col("r.value").alias("features"))
    return rounded(fuzzy.fuzzy_graph(f, 15))
