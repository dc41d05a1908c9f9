"""Plans that put operators together as studies do."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import expression as ex
from lamina.functions.tails_sql import t_two_sided
from lamina.operators import graph, studies
from lamina.sources import fixtures as fx

from .measures import RANKS
from .registry import plan, rounded
from .spatial import BH, SMOOTH, graph_sql


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, a AS (SELECT label, gene_id, count(*)::DOUBLE AS n, sum(value) AS s, sum(value * value) AS q FROM feat JOIN obs USING (obs_id) GROUP BY ALL), t AS (SELECT gene_id, sum(n) AS nt, sum(s) AS st, sum(q) AS qt FROM a GROUP BY gene_id),
m AS (SELECT label, gene_id, n, nt - n AS k, s / n AS ma, (st - s) / (nt - n) AS mb, q, qt - q AS qb FROM a JOIN t USING (gene_id) WHERE n > 1 AND nt - n > 1),
r AS (SELECT label, gene_id, (ma - mb) / sqrt((q - n * ma * ma) / (n - 1) / n + (qb - k * mb * mb) / (k - 1) / k) AS t FROM m)
SELECT label, gene_id, round(t, 5) AS t, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(t, 9) DESC, gene_id) AS rank FROM r) WHERE rank <= 5""")
def informative_genes(spark, sf):
    return rounded(studies.informative_genes(fx.features(spark, sf), fx.obs(spark, sf).select("obs_id", "label"), 5), 5)


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, {SMOOTH}, c AS (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, corr(a.value, b.value) AS r FROM around a JOIN around b ON a.obs_id = b.obs_id AND a.gene_id < b.gene_id GROUP BY ALL)
SELECT gene_a, gene_b, round(r, 6) AS r FROM c WHERE abs(r) >= 0.1""")
def colocalised_genes(spark, sf):
    return rounded(studies.colocalised(graph.knn_graph(fx.obs(spark, sf), 6), fx.features(spark, sf), 0.1))


@plan("""WITH s AS (SELECT c_nationkey::BIGINT AS donor, o_orderpriority AS setting, avg(o_totalprice) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), t AS (SELECT setting, sum(score) AS total, count(*) AS m FROM s GROUP BY setting),
j AS (SELECT donor, setting, (total - score) / (m - 1) AS others FROM s JOIN t USING (setting)) SELECT donor, setting, round(others, 4) AS others FROM (SELECT *, row_number() OVER (PARTITION BY donor ORDER BY round(others, 9) DESC, setting) AS r FROM j) WHERE r = 1""")
def leave_one_out_choice(spark, sf):
    o, c = fx.read(spark, sf, "orders"), fx.read(spark, sf, "customer")
    s = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("bigint").alias("donor"), F.col("o_orderpriority").alias("setting")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(studies.leave_one_out_choice(s), 4)


@plan("""WITH d AS (SELECT n_regionkey AS s, n_nationkey AS d FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r <= 4 AND n_regionkey < 3), p AS (SELECT a.s, a.d AS d1, b.d AS d2 FROM d a JOIN d b ON a.s = b.s AND a.d < b.d)
SELECT array_to_string(list_transform(list_sort([x.d1, x.d2, y.d1, y.d2, z.d1, z.d2]), lambda v: v::VARCHAR), '-') AS split FROM p x, p y, p z WHERE x.s = 0 AND y.s = 1 AND z.s = 2""")
def balanced_splits(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    d = fx.read(spark, sf, "nation").withColumn("r", F.row_number().over(w)).where("r <= 4 and n_regionkey < 3")
    return studies.balanced_splits(d.select(F.col("n_regionkey").alias("stratum"), F.col("n_nationkey").alias("donor"))).select("split")


@plan("""WITH a AS (SELECT l_partkey AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS k, quantile_cont(l_extendedprice, 0.5) AS v FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(max(abs(a.v - b.v)), 4) AS max_abs, round(max(abs(a.v - b.v) / abs(b.v)), 6) AS max_rel, round(corr(a.v, b.v), 6) AS r FROM a JOIN b USING (k)""")
def agreement_table(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_extendedprice").alias("v"))
    b = li.groupBy(F.col("l_partkey").alias("k")).agg(F.expr("percentile(l_extendedprice, 0.5D)").alias("v"))
    return studies.agreement(a, b, ["k"], "v").select("n", F.round("max_abs", 4).alias("max_abs"), F.round("max_rel", 6).alias("max_rel"), F.round("r", 6).alias("r"))


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, p AS (SELECT obs_id, CASE gene_id // 16 WHEN 0 THEN 'pluripotency_core' WHEN 1 THEN 'esc_signature' WHEN 2 THEN 'self_renewal' ELSE 'differentiation' END AS name, avg(value) AS m FROM feat GROUP BY ALL),
s AS (SELECT obs_id, name, (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) AS v FROM p WINDOW w AS (PARTITION BY name)),
c AS (SELECT obs_id, sum(CASE name WHEN 'differentiation' THEN 1 - v WHEN 'esc_signature' THEN v ELSE 2 * v END) / 6 AS s FROM s GROUP BY obs_id) SELECT obs_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS stemness FROM c""")
def stemness_composite(spark, sf):
    names = F.array(*map(F.lit, studies.STEMNESS))
    sets = spark.range(8, 64).select(names[(F.col("id") / 16).cast("int")].alias("name"), F.col("id").alias("gene_id"))
    return rounded(studies.stemness(fx.features(spark, sf), sets))


@plan(f"""WITH {fx.FEATURES}, z AS (SELECT obs_id, gene_id // 8 AS panel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS zv FROM feat WINDOW w AS (PARTITION BY gene_id)), m AS (SELECT obs_id, panel, avg(zv) AS m FROM z GROUP BY ALL)
SELECT obs_id, first(panel ORDER BY round(m, 9) DESC, panel) AS label FROM m GROUP BY obs_id""")
def argmax_labels(spark, sf):
    panels = spark.range(8, 64).select(F.col("id").alias("gene_id"), F.expr("id div 8").alias("panel"))
    return studies.argmax_labels(ex.zscore_population(fx.features(spark, sf)), panels)


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, tr AS (SELECT obs_id, gene_id, floor(abs(value) * 20) AS value FROM feat), te AS (SELECT obs_id, gene_id, floor(abs(value) * 23) AS y FROM feat),
ar AS (SELECT obs_id, gene_id, coalesce(m, 0) AS a FROM tr LEFT JOIN (SELECT src AS obs_id, gene_id, sum(w * value) / sum(w) AS m FROM g JOIN tr ON dst = obs_id GROUP BY ALL) USING (obs_id, gene_id)), r AS (SELECT gene_id, y, greatest(0.7 * value + 0.3 * a, 0.001) AS l FROM tr JOIN ar USING (obs_id, gene_id) JOIN te USING (obs_id, gene_id))
SELECT gene_id, round(sum(2 * (CASE WHEN y > 0 THEN y * ln(y / l) ELSE 0 END - (y - l))), 4) AS deviance FROM r GROUP BY gene_id""")
def smoothing_deviance(spark, sf):
    f = fx.features(spark, sf)
    part = lambda k: f.select("obs_id", "gene_id", F.floor(F.abs("value") * k).cast("double").alias("value"))
    return rounded(studies.poisson_deviance(graph.knn_graph(fx.obs(spark, sf), 6), part(20), part(23), 0.3), 4)


@plan("""WITH d AS (SELECT vec_id AS obs_id, embedding[1]::DOUBLE * 1000 AS x, unnest(range(8, 64)) AS gene_id, unnest(embedding[9:64])::DOUBLE AS value FROM embeddings),
f AS (SELECT gene_id, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM d WHERE obs_id % 5 <> 0 GROUP BY gene_id) SELECT obs_id, d.gene_id, round(value - a - b * x, 6) AS value FROM d JOIN f ON d.gene_id = f.gene_id""")
def confound_free(spark, sf):
    return rounded(studies.confound_free(fx.features(spark, sf), fx.obs(spark, sf).select("obs_id", F.col("x").alias("c")), F.col("obs_id") % 5 != 0))


@plan("""SELECT CASE WHEN h + m > 0 AND h >= m THEN 'human' WHEN h + m > 0 THEN 'mouse' WHEN up > 0.8 THEN 'human' ELSE 'mouse' END AS species FROM (SELECT sum((p_name IN ('SLC17A7', 'GAD1'))::INT) AS h, sum((p_name IN ('Slc17a7', 'Gad1'))::INT) AS m, avg((p_name = upper(p_name))::INT) AS up FROM part)""")
def species_guess(spark, sf):
    return ex.species(fx.var(spark, sf), {"human": ["SLC17A7", "GAD1"], "mouse": ["Slc17a7", "Gad1"]})


@plan("""WITH c AS (SELECT o_orderpriority AS method, o_orderstatus AS grp, o_totalprice AS v FROM orders) SELECT method, count(*) AS n, round(quantile_cont(v, 0.5), 4) AS median, round(avg(v), 4) AS mean, round(avg((v < 50000)::INT), 6) AS below FROM c GROUP BY method""")
def method_summary(spark, sf):
    o = fx.read(spark, sf, "orders")
    g = o.groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"), F.expr("percentile(o_totalprice, 0.5D)").alias("median"), F.avg("o_totalprice").alias("mean"), F.avg((F.col("o_totalprice") < 50_000).cast("double")).alias("below"))
    return g.select("method", "n", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"), F.round("below", 6).alias("below"))


@plan(f"WITH {fx.OBS} SELECT obs_id, round(x * cos(0.3) - y * sin(0.3) + 5, 6) AS x, round(x * sin(0.3) + y * cos(0.3) - 7, 6) AS y FROM obs")
def affine_apply(spark, sf):
    from lamina.operators import registration

    o = fx.obs(spark, sf).select("obs_id", "block", "x", "y")
    fits = o.select("block").distinct().select("block", F.lit(0.3).alias("theta"), F.lit(5.0).alias("tx"), F.lit(-7.0).alias("ty"))
    return rounded(registration.apply_affine(o, fits, ["block"]).select("obs_id", "x", "y"))


@plan(f"""WITH {fx.FEATURES}, d AS (SELECT a.obs_id AS src, b.obs_id AS dst, sum((a.value - b.value) * (a.value - b.value)) AS d2 FROM feat a JOIN feat b ON a.gene_id = b.gene_id AND a.obs_id <> b.obs_id GROUP BY ALL)
SELECT src, dst, round(d2, 6) AS d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d) WHERE rank <= 5""")
def feature_knn(spark, sf):
    f = fx.features(spark, sf).groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "value"))).alias("r")).select("obs_id", F.col("r.value").alias("features"))
    return rounded(studies.feature_knn(f, 5))


_SUM = "SELECT {k}, size, CASE WHEN max(hit - miss) >= -min(before - miss) THEN max(hit - miss) ELSE min(before - miss) END AS es FROM (SELECT {k}, size, (place - i) / (n - size)::DOUBLE AS miss, cum / total AS hit, (cum - a) / total AS before FROM {t}) GROUP BY {k}, size"
_RUNS = "SELECT *, count(*) OVER w AS size, sum(a) OVER w AS total, row_number() OVER (w ORDER BY place) AS i, sum(a) OVER (w ORDER BY place ROWS UNBOUNDED PRECEDING) AS cum, (SELECT count(*) FROM var) AS n FROM {t} WINDOW w AS (PARTITION BY {k})"


@plan(f"""WITH {fx.VAR}, ra AS MATERIALIZED (SELECT gene_id, abs(score) AS a, row_number() OVER (ORDER BY score DESC, gene_id) AS place FROM var), gn AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) AS j FROM var),
mv AS (SELECT perm, o.gene_id AS was, g.gene_id AS "to" FROM (SELECT perm, gene_id, row_number() OVER (PARTITION BY perm ORDER BY ((gene_id * 7919 + perm * 104729) * (gene_id * 31 + 17)) % 1000003, gene_id) AS j FROM var, range(1000) r(perm)) g JOIN gn o USING (j)),
s0 AS (SELECT category AS term, a, place FROM var JOIN ra USING (gene_id)), r0 AS (SELECT * FROM ({_RUNS.format(t="s0", k="term")}) WHERE size BETWEEN 5 AND 500), e AS ({_SUM.format(k="term", t="r0")}),
s1 AS (SELECT DISTINCT perm, category AS term, "to" FROM var JOIN mv ON gene_id = was), s2 AS (SELECT perm, term, a, place FROM s1 JOIN ra ON "to" = gene_id), r1 AS (SELECT * FROM ({_RUNS.format(t="s2", k="perm, term")}) WHERE size BETWEEN 5 AND 500), z AS ({_SUM.format(k="perm, term", t="r1")}),
k AS (SELECT e.term, count(*) AS k, count(*) FILTER (abs(z.es) >= abs(e.es) - 1e-12) AS ge, avg(abs(z.es)) AS m FROM e JOIN z USING (term) WHERE (e.es >= 0) = (z.es >= 0) GROUP BY e.term)
SELECT term, size, round(es, 6) AS es, round(es / m, 6) AS nes, round((1 + coalesce(ge, 0)) / (1 + coalesce(k, 0))::DOUBLE, 6) AS p FROM e LEFT JOIN k USING (term)""")
def gsea_permutation(spark, sf):
    v = fx.var(spark, sf)
    return rounded(studies.gsea_test(v.select("gene_id", "score"), v.select(F.col("category").alias("term"), "gene_id"), 1000, portable=True))


@plan()
def hierarchical_annotation(spark, sf):
    v = fx.counts(spark, sf).select("obs_id", "gene_id", F.log1p("count").alias("value"))
    g = fx.var(spark, sf).where("gene_id % 20 = 0")  # controls come from the others
    top = g.select(F.concat(F.lit("C"), (F.col("gene_id") % 3).cast("string")).alias("panel"), F.lit(None).cast("string").alias("parent"), "gene_id")
    low = g.where("gene_id % 3 = 0").select(F.concat(F.lit("S"), (F.col("gene_id") % 2).cast("string")).alias("panel"), F.lit("C0").alias("parent"), "gene_id")
    return studies.annotate(v, top.unionByName(low), v.select("obs_id").distinct().count(), 1000, 0.2)


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, v AS (SELECT obs_id, gene_id, value, block FROM feat JOIN obs USING (obs_id) WHERE block IN (SELECT block FROM obs GROUP BY block HAVING count(*) >= 50)),
r AS MATERIALIZED (SELECT obs_id, block, gene_id, {RANKS.format(b="block, gene_id")} AS r FROM v), c AS (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, a.block AS context, count(*) AS n, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.obs_id = b.obs_id AND a.block = b.block AND a.gene_id < b.gene_id GROUP BY ALL),
t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, (n - 2)::DOUBLE AS df FROM c), p AS (SELECT *, {t_two_sided("t", "df")} AS p FROM t), k AS (SELECT gene_a, gene_b, context, rho, p, row_number() OVER (ORDER BY p, gene_a, gene_b, context) AS r, count(*) OVER () AS n FROM p),
q AS (SELECT gene_a, gene_b, context, rho, {BH} AS padj FROM k) SELECT gene_a, gene_b, context, round(rho, 6) AS rho, round(padj, 6) AS padj FROM (SELECT *, row_number() OVER (PARTITION BY gene_a, gene_b ORDER BY round(abs(rho), 9) DESC, context) AS top FROM q) WHERE top = 1""")
def context_network(spark, sf):
    pairs = spark.range(8, 64).select(F.col("id").alias("gene_a")).crossJoin(spark.range(8, 64).select(F.col("id").alias("gene_b"))).where("gene_a < gene_b")
    return rounded(studies.pair_network(fx.features(spark, sf), pairs, fx.obs(spark, sf).select("obs_id", F.col("block").alias("context")), 0.0, 1.1))


WEIGHTS = (0.1, 0.3, 0.5, 0.7, 0.9)


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, tr AS MATERIALIZED (SELECT obs_id, gene_id, floor(abs(value) * 20) AS value, floor(abs(value) * 23) AS y, floor(abs(value) * 29) AS t FROM feat),
ar AS MATERIALIZED (SELECT tr.*, coalesce(m, 0) AS a FROM tr LEFT JOIN (SELECT src AS obs_id, gene_id, sum(w * value) / sum(w) AS m FROM g JOIN tr ON dst = obs_id GROUP BY ALL) USING (obs_id, gene_id)),
l AS (SELECT gene_id, y, t, w, greatest((1 - w) * value + w * a, 0.001) AS l FROM ar, (SELECT unnest([0.0::DOUBLE, {", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}]) AS w)),
s AS MATERIALIZED (SELECT gene_id, w, sum(2 * (CASE WHEN y > 0 THEN y * ln(y / l) ELSE 0 END - (y - l))) AS dy, sum(2 * (CASE WHEN t > 0 THEN t * ln(t / l) ELSE 0 END - (t - l))) AS dt FROM l GROUP BY ALL),
b AS (SELECT w FROM (SELECT w, round(sum(dy), 9) AS d FROM s WHERE w > 0 GROUP BY w) ORDER BY d, w LIMIT 1)
SELECT gene_id, b.w AS weight, round(max(dt) FILTER (s.w = b.w), 4) AS deviance, round(max(dt) FILTER (s.w = 0), 4) AS own_deviance FROM s, b GROUP BY gene_id, b.w""")
def smoothing_tuned(spark, sf):
    f = fx.features(spark, sf)
    part = lambda k: f.select("obs_id", "gene_id", F.floor(F.abs("value") * k).cast("double").alias("value"))
    return rounded(studies.tuned_smoothing(graph.knn_graph(fx.obs(spark, sf), 6), part(20), part(23), part(29), list(WEIGHTS)), 4)


@plan()
def tangent_connectivity(spark, sf):
    s = fx.signal(spark, sf).withColumn("subject", F.col("t") % 2)
    return studies.tangent(s)
