"""Plans over spots in sections: neighbours, smoothing, autocorrelation, niches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import families, graph, raster
from lamina.operators.stats import ari_nmi
from lamina.sources import fixtures as fx

from .registry import plan, rounded


def knn_sql(k: int) -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in "xyz")
    return f"""nn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM
  (SELECT a.block, a.obs_id AS src, b.obs_id AS dst, {d2} AS d2 FROM obs a JOIN obs b ON a.block = b.block AND a.obs_id <> b.obs_id)) WHERE rank <= {k})"""


def graph_sql(k: int) -> str:
    return f"{knn_sql(k)}, g AS MATERIALIZED (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM nn UNION ALL SELECT dst, src, 1.0::DOUBLE FROM nn) GROUP BY src, dst)"


SMOOTH = "around AS MATERIALIZED (SELECT obs_id, gene_id, coalesce(m, 0) AS value FROM feat LEFT JOIN (SELECT src AS obs_id, gene_id, sum(w * value) / sum(w) AS m FROM g JOIN feat ON dst = obs_id GROUP BY ALL) USING (obs_id, gene_id))"
CROSS = """sec AS (SELECT block, section, quantile_cont(z, 0.5) AS mz FROM obs GROUP BY ALL),
adj AS (SELECT block, section AS a, lead(section) OVER (PARTITION BY block ORDER BY mz, section) AS b FROM sec), pairs AS (SELECT * FROM adj WHERE b IS NOT NULL UNION ALL SELECT block, b, a FROM adj WHERE b IS NOT NULL),
ce AS (SELECT *, row_number() OVER (PARTITION BY src, b ORDER BY d2, dst) AS rank FROM (SELECT o.block, p.b, o.obs_id AS src, q.obs_id AS dst, (o.x - q.x) ** 2 + (o.y - q.y) ** 2 AS d2, o.z - q.z AS dz
  FROM obs o JOIN pairs p ON o.block = p.block AND o.section = p.a JOIN obs q ON q.block = p.block AND q.section = p.b))"""


@plan(f"WITH {fx.OBS}, {knn_sql(6)} SELECT block, src, dst, round(d2, 6) AS d2, rank FROM nn")
def knn_edges(spark, sf):
    return rounded(graph.knn(fx.obs(spark, sf), 6))


@plan(f"WITH {fx.OBS}, {graph_sql(6)} SELECT * FROM g")
def knn_graph_sym(spark, sf):
    return graph.knn_graph(fx.obs(spark, sf), 6)


@plan(f"""WITH {fx.OBS}, {knn_sql(6)}, h AS (SELECT quantile_cont(sqrt(d2), 0.5) AS h FROM nn WHERE d2 > 0), e AS (SELECT src, dst, exp(-d2 / (2 * h * h)) AS w FROM nn, h)
SELECT src, dst, round(max(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL""")
def knn_graph_gaussian(spark, sf):
    return rounded(graph.knn_graph(fx.obs(spark, sf), 6, weight="gaussian"))


@plan(f"WITH {fx.OBS}, {CROSS} SELECT block, src, dst, round(d2, 6) AS d2, dz, rank FROM ce WHERE rank <= 3")
def cross_section_edges(spark, sf):
    return rounded(graph.cross_section_edges(fx.obs(spark, sf), 3))


@plan(f"""WITH {fx.OBS}, {CROSS}, flat AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM (SELECT a.block, a.section, a.obs_id AS src, b.obs_id AS dst,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, 0 AS rank FROM obs a JOIN obs b ON a.section = b.section AND a.obs_id <> b.obs_id)),
h AS (SELECT quantile_cont(m, 0.5) AS h FROM (SELECT quantile_cont(sqrt(d2), 0.5) AS m FROM flat WHERE rank = 1 GROUP BY section)),
w AS (SELECT src, dst, 1.0::DOUBLE AS w FROM flat WHERE rank <= 6), c AS (SELECT src, dst, exp(-(d2 + dz ** 2) / (h * h) / 2) AS w FROM ce, h WHERE rank <= 3)
SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, max(w) AS w FROM (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY ALL
  UNION ALL SELECT src, dst, max(w) FROM (SELECT * FROM c UNION ALL SELECT dst, src, w FROM c) GROUP BY ALL) GROUP BY ALL""")
def cross_section_graph(spark, sf):
    return rounded(graph.cross_section_graph(fx.obs(spark, sf)))


@plan(f"""WITH {fx.OBS}, {CROSS} SELECT ce.block, count(*) AS n, round(avg((o.label = q.label)::INT), 6) AS agreement, round(avg((o.label = q.label)::INT) - any_value(chance), 6) AS above_chance
FROM ce JOIN obs o ON src = o.obs_id JOIN obs q ON dst = q.obs_id JOIN (SELECT block, sum(n * n) / sum(n) ** 2 AS chance FROM (SELECT block, label, count(*)::DOUBLE AS n FROM obs GROUP BY ALL) GROUP BY block) k ON k.block = ce.block WHERE rank = 1 GROUP BY ce.block""")
def layer_agreement(spark, sf):
    o = fx.obs(spark, sf)
    e = graph.cross_section_edges(o, 1)
    lab = o.select("obs_id", "label")
    e = e.join(lab.toDF("src", "a"), "src").join(lab.toDF("dst", "b"), "dst")
    n = o.groupBy("block", "label").agg(F.count("*").cast("double").alias("k")).groupBy("block").agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), F.lit(2))).alias("chance"))
    same = F.avg((F.col("a") == F.col("b")).cast("double"))
    out = e.join(n, "block").groupBy("block").agg(F.count("*").alias("n"), same.alias("agreement"), (same - F.first("chance")).alias("above_chance"))
    return rounded(out)


@plan(f"WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, {SMOOTH} SELECT obs_id, gene_id, round(value, 6) AS value FROM around")
def neighbourhood_mean(spark, sf):
    return rounded(graph.neighbourhood_mean(graph.knn_graph(fx.obs(spark, sf), 6), fx.features(spark, sf)))


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, {SMOOTH}, p AS (SELECT obs_id, 'own' AS part, gene_id, value, 0.7 AS share FROM feat UNION ALL SELECT obs_id, 'around', gene_id, value, 0.3 FROM around),
n AS (SELECT part, avg(n) AS scale FROM (SELECT part, obs_id, sqrt(sum(value * value)) AS n FROM p GROUP BY ALL) GROUP BY part)
SELECT obs_id, part, gene_id, round(value / scale * sqrt(share), 6) AS value FROM p JOIN n USING (part)""")
def augmented_features(spark, sf):
    return rounded(graph.augmented(graph.knn_graph(fx.obs(spark, sf), 6), fx.features(spark, sf), 0.3))


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, l AS (SELECT * FROM g UNION ALL SELECT obs_id, obs_id, 1.0 FROM obs), d AS (SELECT src, sum(w) AS d FROM l GROUP BY src)
SELECT l.src AS obs_id, gene_id, round(greatest(sum(w / sqrt(a.d * b.d) * value), 0), 6) AS value FROM l JOIN d a ON l.src = a.src JOIN d b ON l.dst = b.src JOIN feat ON l.dst = feat.obs_id GROUP BY ALL""")
def gcn_layer(spark, sf):
    return rounded(graph.gcn_layer(graph.knn_graph(fx.obs(spark, sf), 6), fx.features(spark, sf)))


MORAN = """z AS MATERIALIZED (SELECT obs_id, gene_id, value - avg(value) OVER (PARTITION BY gene_id) AS z FROM feat), base AS (SELECT gene_id, sum(z * z) AS zz, count(*) AS n FROM z GROUP BY gene_id), sw AS (SELECT sum(w) AS sw FROM g)"""
_MORAN_OF = "SELECT a.gene_id, any_value(n) / any_value(sw) * sum(w * a.z * b.z) / any_value(zz) AS moran FROM g JOIN z a ON src = a.obs_id JOIN z b ON dst = b.obs_id AND a.gene_id = b.gene_id JOIN base ON base.gene_id = a.gene_id, sw GROUP BY a.gene_id"


@plan(f"WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, {MORAN} SELECT gene_id, round(moran, 6) AS moran FROM ({_MORAN_OF})")
def morans_i(spark, sf):
    return rounded(graph.morans_i(graph.knn_graph(fx.obs(spark, sf), 6), fx.features(spark, sf)))


PERMS = 199


def shuffle_sql(n: int) -> str:
    return f"""keys AS (SELECT perm, block, obs_id, ((obs_id * 7919 + perm * 104729) * (obs_id * 31 + 17)) % 1000003 AS key FROM obs, range({n}) r(perm)),
perm AS MATERIALIZED (SELECT a.perm, a.obs_id, b.obs_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY perm, block ORDER BY obs_id) AS r FROM keys) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY perm, block ORDER BY key, obs_id) AS r FROM keys) b USING (perm, block, r))"""


BH = "least(1, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING))"


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(8)}, {MORAN}, {shuffle_sql(PERMS)}, m AS ({_MORAN_OF}),
moved AS (SELECT p.perm, p.other AS a, q.other AS b, w FROM g JOIN perm p ON src = p.obs_id JOIN perm q ON dst = q.obs_id AND p.perm = q.perm),
mw AS (SELECT perm, a, gene_id, sum(w * y.z) AS wz FROM moved JOIN z y ON b = y.obs_id GROUP BY ALL), nm AS (SELECT perm, mw.gene_id, sum(x.z * wz) AS s FROM mw JOIN z x ON a = x.obs_id AND x.gene_id = mw.gene_id GROUP BY ALL),
nul AS (SELECT perm, gene_id, n / sw * s / zz AS i0 FROM nm JOIN base USING (gene_id), sw),
p AS (SELECT gene_id, any_value(moran) AS moran, (1 + count(*) FILTER (i0 >= moran - 1e-12)) / {PERMS + 1.0} AS p FROM nul JOIN m USING (gene_id) GROUP BY gene_id),
r AS (SELECT *, row_number() OVER (ORDER BY p, gene_id) AS r, count(*) OVER () AS n FROM p) SELECT gene_id, round(moran, 6) AS moran, round(p, 6) AS p, round({BH}, 6) AS padj FROM r""")
def svg_permutation(spark, sf):
    o = fx.obs(spark, sf)
    return rounded(graph.spatially_variable(o, graph.knn_graph(o, 8), fx.features(spark, sf), PERMS, portable=True))


@plan(f"WITH {fx.OBS}, {knn_sql(15)} SELECT src AS obs_id, label, round(count(*) / 15.0::DOUBLE, 6) AS share FROM nn JOIN obs ON dst = obs_id GROUP BY ALL")
def niche_composition(spark, sf):
    o = fx.obs(spark, sf)
    return rounded(graph.niche_composition(graph.knn(o, 15), o, 15))


@plan(f"""WITH {fx.OBS}, {graph_sql(6)}, c AS (SELECT src, o.label AS own, q.label AS other, count(*) AS n FROM g JOIN obs o ON src = o.obs_id JOIN obs q ON dst = q.obs_id GROUP BY ALL),
b AS (SELECT src, sum(n) AS every, coalesce(sum(n) FILTER (own = other), 0) AS same, first(other ORDER BY n DESC, other) AS top FROM c GROUP BY src)
SELECT obs_id, CASE WHEN same * 2 < every THEN top ELSE label END AS label FROM obs LEFT JOIN b ON src = obs_id""")
def label_refine(spark, sf):
    o = fx.obs(spark, sf)
    return graph.refine_labels(graph.knn_graph(o, 6), o.select("obs_id", "label"))


@plan(f"""WITH RECURSIVE {fx.OBS}, {graph_sql(2)}, r AS (SELECT src AS node, src AS c FROM g UNION SELECT g.dst, r.c FROM r JOIN g ON r.node = g.src)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def graph_components(spark, sf):
    return graph.components(graph.knn_graph(fx.obs(spark, sf), 2))


@plan(f"""WITH {fx.OBS}, {graph_sql(6)}, u AS (SELECT src AS a, dst AS b FROM g), t AS (SELECT x.a AS node, count(*) / 2 AS t FROM u x JOIN u y ON x.b = y.a JOIN u z ON y.b = z.a AND z.b = x.a GROUP BY x.a),
d AS (SELECT a AS node, count(*) AS degree FROM u GROUP BY a) SELECT node, degree, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END::DOUBLE, 6) AS clustering FROM d LEFT JOIN t USING (node)""")
def clustering_coefficient(spark, sf):
    return rounded(graph.clustering(graph.knn_graph(fx.obs(spark, sf), 6)))


@plan(f"""WITH {fx.OBS}, q AS (SELECT block, label AS t, CAST(floor((x - (min(x) OVER ())) / 100) AS BIGINT) AS p FROM obs), c AS (SELECT block, t, p, count(*)::DOUBLE AS n FROM q GROUP BY ALL),
a AS (SELECT block, t, sum(n) AS m FROM c GROUP BY ALL), b AS (SELECT block, p, sum(n) AS m FROM c GROUP BY ALL), tot AS (SELECT block, sum(n) AS en, sum(n * (n - 1) / 2) AS s FROM c GROUP BY block),
ha AS (SELECT block, sum(m * (m - 1) / 2) AS st, -sum(m / en * ln(m / en)) AS ht FROM a JOIN tot USING (block) GROUP BY block), hb AS (SELECT block, sum(m * (m - 1) / 2) AS sp, -sum(m / en * ln(m / en)) AS hp FROM b JOIN tot USING (block) GROUP BY block),
mi AS (SELECT block, sum(c.n / en * ln(en * c.n / (a.m * b.m))) AS mi FROM c JOIN a USING (block, t) JOIN b USING (block, p) JOIN tot USING (block) GROUP BY block)
SELECT block, en::BIGINT AS n, round((s - st * sp / (en * (en - 1) / 2)) / ((st + sp) / 2 - st * sp / (en * (en - 1) / 2)), 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi FROM tot JOIN ha USING (block) JOIN hb USING (block) JOIN mi USING (block)""")
def ari_nmi_by_block(spark, sf):
    o = fx.obs(spark, sf)
    low = o.agg(F.min("x").alias("x0"))
    q = o.crossJoin(F.broadcast(low)).withColumn("p", F.floor((F.col("x") - F.col("x0")) / 100).cast("bigint"))
    return rounded(ari_nmi(q, "label", "p", ["block"]))


@plan(f"""WITH {fx.OBS}, c AS (SELECT label, sum((block = 'm0')::INT) AS a, sum((block = 'm1')::INT) AS b FROM obs GROUP BY label) SELECT round(sum(abs(a / (SELECT sum(a) FROM c) - b / (SELECT sum(b) FROM c))) / 2, 6) AS tv FROM c""")
def crosstab_tv(spark, sf):
    from lamina.operators.stats import total_variation

    o = fx.obs(spark, sf)
    return rounded(total_variation(o.where("block = 'm0'"), o.where("block = 'm1'"), "label"))


_FLAT, _CROSSED = ([(g.name, g.k) for g in families.FAMILY if g.kind == k] for k in ("flat", "cross"))
_ISO = [(g.name, g.z_scale) for g in families.FAMILY if g.kind == "solid"]
_LIST = lambda rows: ", ".join(f"('{n}', {v})" for n, v in rows)
FAMILY_SQL = f"""{CROSS}, al AS MATERIALIZED (SELECT a.section AS sa, b.section AS sb, a.obs_id AS src, b.obs_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, a.z - b.z AS dz FROM obs a JOIN obs b ON a.block = b.block AND a.obs_id <> b.obs_id),
ow AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM al WHERE sa = sb),
h AS (SELECT quantile_cont(m, 0.5) AS h FROM (SELECT quantile_cont(sqrt(d2), 0.5) AS m FROM ow WHERE r = 1 GROUP BY sa)),
pa AS (SELECT graph, 0 AS part, src, dst, 1::DOUBLE AS w FROM ow, (VALUES {_LIST([*_FLAT, *_CROSSED])}) g(graph, k) WHERE r <= k
  UNION ALL SELECT graph, 0, src, dst, 1 FROM (SELECT graph, src, dst, row_number() OVER (PARTITION BY graph, src ORDER BY d2 + (dz * zs) * (dz * zs), dst) AS r FROM al, (VALUES {_LIST(_ISO)}) g(graph, zs)) WHERE r <= 6
  UNION ALL SELECT graph, 1, src, dst, exp(-(d2 + dz ** 2) / (h * h) / 2) FROM ce, h, (VALUES {_LIST(_CROSSED)}) g(graph, k) WHERE rank <= 3),
fam AS MATERIALIZED (SELECT graph, src, dst, sum(w) AS w FROM (SELECT graph, part, src, dst, max(w) AS w FROM (SELECT * FROM pa UNION ALL SELECT graph, part, dst, src, w FROM pa) GROUP BY ALL) GROUP BY ALL)"""


@plan(f"WITH {fx.OBS}, {FAMILY_SQL} SELECT graph, src, dst, round(w, 6) AS w FROM fam")
def graph_family(spark, sf):
    """Twenty graphs of the same spots from one search for neighbours."""
    return rounded(families.family(fx.obs(spark, sf)))


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {FAMILY_SQL}, gn AS (SELECT unnest([{", ".join(repr(g.name) for g in families.FAMILY)}]) AS graph),
sc AS (SELECT graph, count(*) AS n_edges, avg((a.label = b.label)::INT) AS agreement FROM fam JOIN obs a ON src = a.obs_id JOIN obs b ON dst = b.obs_id GROUP BY graph),
tr AS MATERIALIZED (SELECT obs_id, gene_id, floor(abs(value) * 20) AS v, floor(abs(value) * 23) AS y FROM feat),
m AS (SELECT graph, src AS obs_id, gene_id, sum(w * v) / sum(w) AS m FROM fam JOIN tr ON dst = obs_id GROUP BY ALL),
dv AS (SELECT graph, sum(2 * (CASE WHEN y > 0 THEN y * ln(y / l) ELSE 0 END - (y - l))) AS deviance FROM (SELECT gn.graph, y, greatest(0.5 * v + 0.5 * coalesce(m, 0), 0.001) AS l FROM gn CROSS JOIN tr LEFT JOIN m USING (graph, obs_id, gene_id)) GROUP BY graph)
SELECT graph, coalesce(n_edges, 0) AS n_edges, round(coalesce(n_edges, 0) / (SELECT count(*) FROM obs), 6) AS mean_degree, round(agreement, 6) AS agreement, round(deviance, 3) AS deviance FROM gn LEFT JOIN sc USING (graph) JOIN dv USING (graph)""")
def graph_family_scores(spark, sf):
    """Degree, agreement of labels along edges and deviance of smoothed counts for each of twenty graphs."""
    o, f = fx.obs(spark, sf), fx.features(spark, sf)
    part = lambda k: f.select("obs_id", "gene_id", F.floor(F.abs("value") * k).cast("double").alias("value"))
    e = graph.written(families.links(o), "links")
    s = families.scores(e, o, o.select("obs_id", "label"))
    d = families.deviances(e, part(20), part(23), 0.5, parts=graph.parts(o, families.PART))
    return rounded(s.join(d, "graph").withColumn("deviance", F.round("deviance", 3)))


@plan(f"""WITH {fx.OBS}, b AS (SELECT section, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM obs GROUP BY section),
p AS (SELECT section, least(floor((x - x0) / side * 16), 15)::BIGINT AS px, least(floor((y - y0) / side * 16), 15)::BIGINT AS py, 'L' || label AS value FROM obs JOIN b USING (section)),
c AS (SELECT section, px, py, value, count(*) AS k FROM p GROUP BY ALL) SELECT section, px, py, n, value FROM (SELECT *, sum(k) OVER w::BIGINT AS n, row_number() OVER (w ORDER BY k DESC, value) AS r FROM c WINDOW w AS (PARTITION BY section, px, py)) WHERE r = 1""")
def section_pixels(spark, sf):
    """Every section as 16 x 16 squares with their most frequent label."""
    return rounded(raster.pixels(fx.obs(spark, sf).withColumn("label", F.concat(F.lit("L"), F.col("label").cast("string"))), "label", 16))
