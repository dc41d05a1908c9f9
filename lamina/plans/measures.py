"""Plans over counts, groups, panels, gene sets and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import expression as ex
from lamina.functions.tails_sql import normal_sf, t_two_sided
from lamina.operators import graph, stats, studies
from lamina.sources import fixtures as fx

from .registry import plan, rounded
from .spatial import BH, graph_sql, shuffle_sql

BULK = f"""{fx.META}, {fx.COUNTS}, cells AS (SELECT unit, grp, count(*) AS n_cells FROM meta GROUP BY ALL HAVING count(*) >= 10),
bulk AS MATERIALIZED (SELECT unit, grp, gene_id, sum(count) AS total, any_value(n_cells) AS n_cells FROM x JOIN meta USING (obs_id) JOIN cells USING (unit, grp) GROUP BY ALL),
cpm AS MATERIALIZED (SELECT *, ln(1 + total / sum(total) OVER (PARTITION BY unit, grp) * 1e6) AS logcpm FROM bulk)"""
UNITS = """have AS (SELECT DISTINCT unit, grp FROM cpm WHERE grp IN ('F', 'O')), grid AS (SELECT * FROM have, (SELECT DISTINCT gene_id FROM cpm WHERE grp IN ('F', 'O'))),
u AS MATERIALIZED (SELECT unit, gene_id, max(coalesce(logcpm, 0)) FILTER (grp = 'F') AS va, max(coalesce(logcpm, 0)) FILTER (grp = 'O') AS vb FROM grid LEFT JOIN cpm USING (unit, grp, gene_id) GROUP BY ALL)"""


def _bulk(spark, sf):
    return stats.pseudobulk(fx.counts(spark, sf), fx.obs_meta(spark, sf))


def _units(spark, sf):
    return stats.dense_units(stats.log_cpm(_bulk(spark, sf)), "F", "O")


@plan(f"WITH {BULK} SELECT unit, grp, gene_id, total, n_cells FROM bulk")
def pseudobulk(spark, sf):
    return _bulk(spark, sf)


@plan(f"WITH {BULK} SELECT unit, grp, gene_id, round(logcpm, 6) AS logcpm FROM cpm")
def pseudobulk_logcpm(spark, sf):
    return rounded(stats.log_cpm(_bulk(spark, sf)).select("unit", "grp", "gene_id", "logcpm"))


@plan(f"""WITH {BULK}, {UNITS}, d AS (SELECT gene_id, count(*) AS n, avg(va - vb) AS m, stddev_samp(va - vb) AS s FROM u WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY gene_id)
SELECT gene_id, n, round(m / ln(2), 6) AS log2fc, round(CASE WHEN n >= 2 AND s > 1e-12 THEN m / (s / sqrt(n)) END, 6) AS t FROM d""")
def paired_t(spark, sf):
    return rounded(stats.paired_t(_units(spark, sf)))


@plan(f"""WITH {BULK}, {UNITS}, g AS (SELECT gene_id, count(va) AS na, count(vb) AS nb, avg(va) AS ma, avg(vb) AS mb, var_samp(va) / count(va) AS qa, var_samp(vb) / count(vb) AS qb FROM u GROUP BY gene_id)
SELECT gene_id, na, nb, round((ma - mb) / ln(2), 6) AS log2fc, round(CASE WHEN na >= 2 AND nb >= 2 AND qa + qb > 1e-20 THEN (ma - mb) / sqrt(qa + qb) END, 6) AS t,
  round(CASE WHEN na >= 2 AND nb >= 2 AND qa + qb > 1e-20 THEN (qa + qb) * (qa + qb) / (qa * qa / (na - 1) + qb * qb / (nb - 1)) END, 6) AS df FROM g""")
def welch_t(spark, sf):
    return rounded(stats.welch_t(_units(spark, sf)))


@plan(f"""WITH {BULK}, {UNITS}, d AS (SELECT gene_id, count(*) AS n, avg(va - vb) AS m, stddev_samp(va - vb) AS s FROM u WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY gene_id),
t AS (SELECT gene_id, m / ln(2) AS log2fc, CASE WHEN n >= 2 AND s > 1e-12 THEN m / (s / sqrt(n)) END AS t, (n - 1)::DOUBLE AS df FROM d), p AS (SELECT *, CASE WHEN t IS NOT NULL THEN {t_two_sided("t", "df")} END AS p FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY p, gene_id) AS r, count(*) OVER () AS n FROM p WHERE p IS NOT NULL), q AS (SELECT gene_id, {BH} AS padj FROM r)
SELECT gene_id, round(log2fc, 6) AS log2fc, round(t, 6) AS t, df, 'paired_t' AS test, round(p, 6) AS p, round(padj, 6) AS padj FROM p LEFT JOIN q USING (gene_id)""")
def pseudobulk_test(spark, sf):
    return rounded(stats.pseudobulk_test(fx.counts(spark, sf), fx.obs_meta(spark, sf), "F", "O"))


@plan(f"""WITH p AS (SELECT p_partkey AS gene_id, p_size AS grp, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE ((p_partkey * 7919) % 1000 + 1) / 1000.0::DOUBLE END AS p FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, gene_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM p WHERE p IS NOT NULL)
SELECT gene_id, p, round({BH.replace('OVER (', 'OVER (PARTITION BY grp ')}, 10) AS padj FROM r UNION ALL SELECT gene_id, p, NULL FROM p WHERE p IS NULL""")
def bh_fdr(spark, sf):
    p = fx.read(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_size").alias("grp"), F.when(F.col("p_partkey") % 50 != 0, ((F.col("p_partkey") * 7919) % 1000 + 1) / F.lit(1000.0)).alias("p"))
    return rounded(stats.benjamini_hochberg(p, "p", ["gene_id"], ["grp"]).select("gene_id", "p", "padj"), 10)


RANKS = "rank() OVER (PARTITION BY {b} ORDER BY value) + (count(*) OVER (PARTITION BY {b}, value) - 1) / 2.0::DOUBLE"


@plan(f"""WITH {fx.FEATURES}, r AS MATERIALIZED (SELECT obs_id, gene_id, {RANKS.format(b='gene_id')} AS r FROM feat)
SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.obs_id = b.obs_id AND a.gene_id < b.gene_id GROUP BY ALL""")
def spearman_pairs(spark, sf):
    return rounded(stats.spearman_pairs(fx.features(spark, sf)))


def mann_whitney_sql(by: str, a: str, b: str) -> str:
    """mw: by, na, nb, u, z of the rows (by, grp, value) of d."""
    sd = "sqrt(na * nb / 12.0::DOUBLE * ((na + nb + 1) - ties / ((na + nb)::DOUBLE * (na + nb - 1))))"
    return f"""r AS (SELECT *, {RANKS.format(b=by)} AS r FROM d), t AS (SELECT {by}, sum(k * k * k - k) AS ties FROM (SELECT {by}, count(*)::DOUBLE AS k FROM d GROUP BY {by}, value) GROUP BY {by}),
g AS (SELECT {by}, count(*) FILTER (grp = '{a}') AS na, count(*) FILTER (grp = '{b}') AS nb, sum(r) FILTER (grp = '{a}') AS ra FROM r GROUP BY {by}), uu AS (SELECT *, ra - na * (na + 1) / 2 AS u FROM g JOIN t USING ({by})),
mw AS (SELECT {by}, na, nb, u, CASE WHEN {sd} > 0 THEN greatest((abs(u - na * nb / 2) - 0.5) / {sd}, 0) ELSE 0 END AS z FROM uu)"""


_BLOCKS = f"{fx.OBS}, {fx.FEATURES}, d AS (SELECT gene_id, block AS grp, value FROM feat JOIN obs USING (obs_id) WHERE block IN ('m0', 'm1'))"


@plan(f"WITH {_BLOCKS}, {mann_whitney_sql('gene_id', 'm0', 'm1')} SELECT gene_id, na, nb, round(u, 6) AS u, round(z, 6) AS z FROM mw")
def mann_whitney_u(spark, sf):
    d = fx.features(spark, sf).join(fx.obs(spark, sf).select("obs_id", F.col("block").alias("grp")), "obs_id")
    return rounded(stats.mann_whitney(d, ["gene_id"], "grp", "m0", "m1"))


@plan(f"WITH {_BLOCKS}, {mann_whitney_sql('gene_id', 'm0', 'm1')} SELECT gene_id, na, nb, round(u, 6) AS u, round(z, 6) AS z, round(least(1, 2 * ({normal_sf('z')})), 6) AS p FROM mw")
def pseudobulk_rank_test(spark, sf):
    d = fx.features(spark, sf).join(fx.obs(spark, sf).select("obs_id", F.col("block").alias("grp")), "obs_id")
    return rounded(stats.mann_whitney_p(stats.mann_whitney(d, ["gene_id"], "grp", "m0", "m1")))


@plan(f"""WITH {fx.SPIKES}, tr AS (SELECT event_id AS trial, unit, t AS e FROM spikes WHERE kind = 'purchase'),
iv AS (SELECT trial, unit, e, 'after' AS grp FROM tr UNION ALL SELECT trial, unit, e - 86400, 'before' FROM tr), d AS (SELECT iv.trial, iv.unit, grp, count(s.t)::DOUBLE AS value FROM iv LEFT JOIN spikes s ON s.unit = iv.unit AND s.t >= e AND s.t < e + 86400 GROUP BY ALL),
{mann_whitney_sql('unit', 'after', 'before')}, p AS (SELECT *, least(1, 2 * ({normal_sf('z')})) AS p FROM mw), k AS (SELECT *, row_number() OVER (ORDER BY p, unit) AS r, count(*) OVER () AS n FROM p)
SELECT unit, na, nb, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p, round({BH}, 6) AS padj FROM k""")
def unit_responses(spark, sf):
    """Units that answer to their trials: counts in intervals, rank tests, false discovery rate."""
    s = fx.spikes(spark, sf)
    return rounded(studies.unit_responses(s, s.where("kind = 'purchase'").select(F.col("event_id").alias("trial"), "unit", F.col("t").alias("e")), 86_400.0))


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, m AS (SELECT section AS region, gene_id, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM feat JOIN obs USING (obs_id) GROUP BY ALL HAVING count(*) > 10)
SELECT a.region AS a, b.region AS b, a.gene_id, round(a.m - b.m, 6) AS diff, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
  round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 6) AS df FROM m a JOIN m b ON a.gene_id = b.gene_id AND a.region < b.region WHERE a.v > 0 AND b.v > 0""")
def region_de(spark, sf):
    return rounded(stats.region_de(fx.features(spark, sf), fx.obs(spark, sf).select("obs_id", F.col("section").alias("region"))))


@plan("""WITH q AS (SELECT quality AS t, CASE WHEN doc_id % 7 <> 0 THEN toxic END AS p FROM labels), c AS (SELECT t AS c FROM q GROUP BY t)
SELECT round(avg((p IS NOT NULL)::INT), 6) AS coverage, round(avg((t = p)::INT) FILTER (p IS NOT NULL), 6) AS accuracy,
  (SELECT round(avg(2.0::DOUBLE * (SELECT count(*) FROM q WHERE t = c AND p = c) / ((SELECT count(*) FROM q WHERE t = c) + (SELECT count(*) FROM q WHERE p = c))), 6) FROM c) AS macro_f1 FROM q""")
def accuracy_metrics(spark, sf):
    q = fx.read(spark, sf, "labels").select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic")).alias("p"))
    return rounded(stats.accuracy(q, "t", "p"))


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, d AS (SELECT gene_id, value AS y, (block = 'm0')::INT::DOUBLE AS g, x AS c FROM feat JOIN obs USING (obs_id)),
m AS (SELECT gene_id, count(*) AS n, regr_sxx(g, g) AS gg, regr_sxx(c, c) AS cc, regr_sxy(g, c) AS gc, regr_sxy(g, y) AS gy, regr_sxy(c, y) AS cy, regr_sxx(y, y) AS yy FROM d GROUP BY gene_id),
b AS (SELECT *, gg * cc - gc * gc AS det, (cc * gy - gc * cy) / (gg * cc - gc * gc) AS bg, (gg * cy - gc * gy) / (gg * cc - gc * gc) AS bc FROM m)
SELECT gene_id, n, round(bg, 5) AS slope, round(bg / sqrt((yy - bg * gy - bc * cy) / (n - 3) * cc / det), 5) AS t FROM b""")
def ols_group(spark, sf):
    d = fx.features(spark, sf).join(fx.obs(spark, sf), "obs_id").select("gene_id", F.col("value").alias("y"), (F.col("block") == "m0").cast("double").alias("g"), F.col("x").alias("c"))
    return rounded(stats.ols(d, "y", "g", "c", ["gene_id"]), 5)


# ---- counts --------------------------------------------------------------------------------------------------------


@plan(f"""WITH {fx.COUNTS}, f AS (SELECT p_partkey AS gene_id, regexp_matches(upper(p_name), '^[A-C]') AS mt, regexp_matches(upper(p_name), '[0-9]$') AS ribo FROM part)
SELECT obs_id, count(*) FILTER (count > 0) AS n_genes, sum(count) AS total, round(100 * coalesce(sum(count) FILTER (mt), 0) / sum(count), 6) AS pct_mt, round(100 * coalesce(sum(count) FILTER (ribo), 0) / sum(count), 6) AS pct_ribo FROM x JOIN f USING (gene_id) GROUP BY obs_id""")
def qc_metrics(spark, sf):
    return rounded(ex.qc_metrics(fx.counts(spark, sf), fx.var(spark, sf), "^[A-C]", "[0-9]$"))


@plan("WITH x AS (SELECT sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT bool_and(v >= 0 AND abs(v - round(v)) <= 1e-8 + 1e-5 * abs(round(v))) AS is_counts FROM x")
def count_detection(spark, sf):
    return ex.looks_like_counts(fx.counts(spark, sf))


@plan(f"""WITH {fx.COUNTS} SELECT * FROM x WHERE gene_id IN (SELECT gene_id FROM x WHERE count > 0 GROUP BY 1 HAVING count(*) >= 25) AND obs_id IN (SELECT obs_id FROM x WHERE count > 0 GROUP BY 1 HAVING count(*) >= 3)""")
def filter_genes_cells(spark, sf):
    return ex.filter_genes_cells(fx.counts(spark, sf), 25, 3)


@plan(f"WITH {fx.COUNTS} SELECT obs_id, gene_id, count, round(count * 1e4 / sum(count) OVER (PARTITION BY obs_id), 6) AS norm, round(ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY obs_id)), 6) AS lognorm FROM x")
def normalize_log1p(spark, sf):
    return rounded(ex.normalize_log1p(fx.counts(spark, sf)))


@plan(f"WITH {fx.COUNTS}, l AS (SELECT obs_id, sum(count) AS lib FROM x GROUP BY 1) SELECT obs_id, gene_id, count, round(count * (SELECT quantile_cont(lib, 0.5) FROM l) / lib, 6) AS norm FROM x JOIN l USING (obs_id)")
def normalize_median(spark, sf):
    return rounded(ex.normalize_median(fx.counts(spark, sf)))


MOMENTS = """n AS (SELECT count(DISTINCT obs_id)::DOUBLE AS n FROM x), mo AS (SELECT gene_id, sum(count) / any_value(n) AS mean, sum(count * count) / any_value(n) - (sum(count) / any_value(n)) * (sum(count) / any_value(n)) AS var FROM x, n GROUP BY gene_id)"""


def _values(spark, sf):
    c = fx.counts(spark, sf)
    return c.select("obs_id", "gene_id", F.col("count").alias("value")), c.select("obs_id").distinct().count()


@plan(f"WITH {fx.COUNTS}, {MOMENTS} SELECT gene_id, round(var, 6) AS var FROM mo ORDER BY mo.var DESC, gene_id LIMIT 100")
def top_variance(spark, sf):
    v, n = _values(spark, sf)
    return rounded(ex.top_variance(v, 100, n))


@plan(f"""WITH {fx.COUNTS}, {MOMENTS}, a AS (SELECT gene_id, ln(1 + mean) AS lm, ln(var * (n / (n - 1)) / mean) AS ld FROM mo, n WHERE mean > 0 AND var > 0),
b AS (SELECT *, least(19, floor((lm - min(lm) OVER ()) / (max(lm) OVER () - min(lm) OVER ()) * 20)::INT) AS bin FROM a),
z AS (SELECT gene_id, CASE WHEN count(*) OVER w > 1 THEN (ld - avg(ld) OVER w) / stddev_samp(ld) OVER w ELSE 1 END AS z FROM b WINDOW w AS (PARTITION BY bin))
SELECT gene_id, round(z, 6) AS dispersion_z, row_number() OVER (ORDER BY z DESC, gene_id) AS rank FROM z ORDER BY z DESC, gene_id LIMIT 200""")
def hvg_dispersion(spark, sf):
    v, n = _values(spark, sf)
    return rounded(ex.hvg_dispersion(v, n, 20, 200))


@plan(f"WITH {fx.FEATURES} SELECT obs_id, gene_id, round(greatest(-2, least(2, (value - avg(value) OVER w) / stddev_samp(value) OVER w)), 6) AS z FROM feat WINDOW w AS (PARTITION BY gene_id)")
def zscore_clip(spark, sf):
    return rounded(ex.zscore_clip(fx.features(spark, sf), 2.0))


@plan(f"WITH {fx.OBS}, {fx.FEATURES}, z AS (SELECT obs_id, gene_id, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS zv FROM feat WINDOW w AS (PARTITION BY gene_id)) SELECT label, gene_id // 8 AS panel, round(avg(zv), 6) AS score FROM z JOIN obs USING (obs_id) GROUP BY ALL")
def panel_zscores(spark, sf):
    """Programme scores: the mean z over a panel of eight genes, by group."""
    z = ex.zscore_population(fx.features(spark, sf)).join(fx.obs(spark, sf).select("obs_id", "label"), "obs_id")
    return rounded(z.groupBy("label", F.expr("gene_id div 8").alias("panel")).agg(F.avg("z").alias("score")))


@plan(f"WITH {fx.VAR} SELECT gene_id, panel, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS scaled FROM var WINDOW w AS (PARTITION BY panel)")
def minmax_scale(spark, sf):
    return rounded(ex.minmax(fx.var(spark, sf), "score", ["panel"]).select("gene_id", "panel", "scaled"))


@plan(f"WITH {fx.VAR} SELECT gene_id, CASE WHEN n > 0 THEN symbol || '-' || n ELSE symbol END AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gene_id) - 1 AS n FROM var)")
def unique_symbols(spark, sf):
    return ex.unique_symbols(fx.var(spark, sf))


@plan("SELECT p_partkey AS gene_id, upper(p_name[1:1]) || lower(p_name[2:]) AS symbol FROM part")
def mouse_symbols(spark, sf):
    return fx.var(spark, sf).select("gene_id", ex.to_mouse(F.col("symbol")).alias("symbol"))


BINS = f"{fx.COUNTS}, {MOMENTS}, bins AS MATERIALIZED (SELECT gene_id, least((row_number() OVER (ORDER BY mean, gene_id) - 1) * 25 // count(*) OVER (), 24) AS bin FROM mo)"


@plan(f"WITH {BINS} SELECT * FROM bins")
def expression_bins(spark, sf):
    v, n = _values(spark, sf)
    return ex.expression_bins(ex.gene_moments(v, n))


@plan(f"""WITH {BINS}, s AS (SELECT bin, count(*) AS n FROM bins GROUP BY bin), p AS (SELECT a.bin, w AS width, sum(b.n)::BIGINT AS pool FROM s a, range(0, 25) r(w), s b WHERE abs(a.bin - b.bin) <= w GROUP BY ALL HAVING sum(b.n) >= 200)
SELECT bin, min(width) AS width, min_by(pool, width) AS pool FROM p GROUP BY bin""")
def bin_pools(spark, sf):
    v, n = _values(spark, sf)
    return ex.bin_pools(ex.expression_bins(ex.gene_moments(v, n)), 200)


@plan(f"""WITH {fx.VAR}, det AS (SELECT l_partkey AS gene_id FROM lineitem GROUP BY 1 HAVING count(*) >= 28), g AS (SELECT upper(symbol) AS s, min(gene_id) AS gene_id FROM var GROUP BY 1), p AS (SELECT DISTINCT panel, upper(symbol) AS s FROM var)
SELECT panel, count(*) AS n_panel, count(g.gene_id) AS n_data, count(det.gene_id) AS n_detected, coalesce(string_agg(CASE WHEN det.gene_id IS NOT NULL THEN s END, ';' ORDER BY s), '') AS genes, count(det.gene_id) >= 3 AS usable
FROM p LEFT JOIN g USING (s) LEFT JOIN det ON det.gene_id = g.gene_id GROUP BY panel""")
def panel_coverage(spark, sf):
    det = fx.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene_id")).agg(F.count("*").alias("n")).where("n >= 28").select("gene_id")
    v = fx.var(spark, sf)
    return rounded(ex.panel_coverage(v.select("panel", "symbol"), v, det))


NULLS = 1000
#: Every eighth gene of the fixture belongs to its panel; controls are drawn from the others.
CONTROLS = f"""{BINS}, mine AS (SELECT DISTINCT panel, gene_id, bin FROM var JOIN bins USING (gene_id) WHERE gene_id % 8 = 0), free AS (SELECT * FROM bins WHERE gene_id % 8 <> 0),
rc AS (SELECT b.bin, r.w, count(*) AS pool FROM (SELECT DISTINCT bin FROM mine) b, range(0, 25) r(w), free f WHERE abs(f.bin - b.bin) <= r.w GROUP BY ALL), wd AS (SELECT bin, coalesce(min(w) FILTER (pool >= 10), max(w)) AS width FROM rc GROUP BY bin),
pl AS MATERIALIZED (SELECT wd.bin, f.gene_id AS drawn, row_number() OVER (PARTITION BY wd.bin ORDER BY f.gene_id) - 1 AS place, count(*) OVER (PARTITION BY wd.bin) AS pool FROM wd JOIN free f ON abs(f.bin - wd.bin) <= width),
gs AS MATERIALIZED (SELECT panel, -1 AS null_id, gene_id FROM mine UNION ALL SELECT panel, null_id, drawn FROM (SELECT panel, bin, r.n AS null_id, ((gene_id * 7919 + r.n * 104729) * (gene_id * 31 + 17)) % 1000003 % pool AS place
  FROM mine JOIN (SELECT DISTINCT bin, pool FROM pl) USING (bin), range({NULLS}) r(n)) JOIN pl USING (bin, place))"""
SETS = f"""{CONTROLS}, ps AS (SELECT panel, null_id, count(*) AS k FROM gs GROUP BY ALL), pc AS MATERIALIZED (SELECT obs_id, gene_id, ln(1 + count) AS value FROM x),
m AS MATERIALIZED (SELECT obs_id, panel, null_id, sum(value) / any_value(k) AS m FROM pc JOIN gs USING (gene_id) JOIN ps USING (panel, null_id) GROUP BY obs_id, panel, null_id),
grid AS (SELECT o.obs_id, p.panel, coalesce(m.m, 0) AS re FROM (SELECT DISTINCT obs_id FROM pc) o CROSS JOIN (SELECT DISTINCT panel FROM ps) p LEFT JOIN m ON m.obs_id = o.obs_id AND m.panel = p.panel AND m.null_id = -1),
sc AS (SELECT g.obs_id, g.panel, any_value(re) AS re, coalesce(sum(m), 0) / {NULLS} AS av, coalesce(sum(m * m), 0) / {NULLS} AS q, count(*) FILTER (m >= re - 1e-12) AS ge FROM grid g LEFT JOIN m ON m.obs_id = g.obs_id AND m.panel = g.panel AND m.null_id >= 0 GROUP BY g.obs_id, g.panel),
score AS MATERIALIZED (SELECT obs_id, panel, CASE WHEN sqrt(greatest(q - av * av, 0)) > 1e-12 THEN (re - av) / sqrt(greatest(q - av * av, 0)) ELSE 0 END AS effect, (1 + CASE WHEN re <= 0 THEN {NULLS} ELSE ge END) / {NULLS + 1.0}::DOUBLE AS p FROM sc)"""


def _controls(spark, sf):
    v, n = _values(spark, sf)
    panels = fx.var(spark, sf).where("gene_id % 8 = 0").select("panel", "gene_id")
    return studies.control_sets(panels, ex.expression_bins(ex.gene_moments(v, n)), NULLS, portable=True)


@plan(f"WITH {fx.VAR}, {CONTROLS} SELECT panel, null_id, gene_id FROM gs")
def matched_control_sets(spark, sf):
    return _controls(spark, sf)


def _scores(spark, sf):
    values = fx.counts(spark, sf).select("obs_id", "gene_id", F.log1p("count").alias("value"))
    return ex.panel_scores(values, _controls(spark, sf), NULLS)


@plan(f"WITH {fx.VAR}, {SETS} SELECT obs_id, panel, round(effect, 5) AS effect, round(p, 5) AS p FROM score")
def panel_scores(spark, sf):
    return rounded(_scores(spark, sf), 5)


@plan(f"""WITH {fx.VAR}, {SETS}, ok AS (SELECT obs_id, panel, round(effect, 4) AS effect, row_number() OVER w AS r, lead(round(effect, 4)) OVER w AS nx FROM score WHERE p < 0.05 / (SELECT count(DISTINCT panel) FROM ps) WINDOW w AS (PARTITION BY obs_id ORDER BY round(effect, 4) DESC, panel))
SELECT o.obs_id, coalesce(ok.panel, 'Unresolved') AS label, ok.effect, round(ok.effect - nx, 4) AS margin FROM (SELECT DISTINCT obs_id FROM pc) o LEFT JOIN ok ON o.obs_id = ok.obs_id AND r = 1""")
def call_labels(spark, sf):
    return rounded(ex.call_labels(_scores(spark, sf).withColumn("effect", F.round("effect", 4)), 0.05), 4)


#: The three interactions of the fixture name no gene from 24 on.
LR = """lr AS (SELECT * FROM (VALUES ('i1', 1, 1, 2), ('i2', 2, 3, 4), ('i3', 5, 5, 6)) v(interaction, a, b, c)), e AS (SELECT obs_id, gene_id - 8 AS g, greatest(value * 1000, 0) AS v FROM feat WHERE gene_id < 24),
lig AS (SELECT obs_id, interaction, exp((ln(greatest(x.v, y.v)) + ln(z.v)) / 2) AS value FROM lr JOIN e x ON x.g = lr.a JOIN e y USING (obs_id) JOIN e z USING (obs_id) WHERE y.g = lr.b + 6 AND z.g = lr.c AND greatest(x.v, y.v) > 0 AND z.v > 0),
rec AS (SELECT obs_id, interaction, v AS value FROM lr JOIN e ON e.g = lr.c + 3 WHERE v > 0)"""


def _lr(spark, sf):
    f = fx.features(spark, sf).where("gene_id < 24").select("obs_id", F.concat(F.lit("G"), (F.col("gene_id") - 8).cast("string")).alias("symbol"), F.greatest(F.col("value") * 1000, F.lit(0.0)).alias("value"))
    rows = [("i1", 1, 1, 2), ("i2", 2, 3, 4), ("i3", 5, 5, 6)]
    lig = spark.createDataFrame([(i, f"G{a}|G{b + 6};G{c}") for i, a, b, c in rows], "name string, spec string")
    rec = spark.createDataFrame([(i, f"G{c + 3}") for i, _, _, c in rows], "name string, spec string")
    return tuple(ex.abundance(f, s).withColumnRenamed("name", "interaction") for s in (lig, rec))


@plan(f"WITH {fx.FEATURES}, {LR} SELECT interaction, obs_id, 'ligand' AS side, round(value, 4) AS value FROM lig UNION ALL SELECT interaction, obs_id, 'receptor', round(value, 4) FROM rec")
def lr_abundance(spark, sf):
    lig, rec = _lr(spark, sf)
    both = lig.withColumn("side", F.lit("ligand")).unionByName(rec.withColumn("side", F.lit("receptor")))
    return rounded(both.select("interaction", "obs_id", "side", "value"), 4)


COMM_PERMS = 200
COMM = f"""ed AS MATERIALIZED (SELECT src, dst, o.label AS sender, q.label AS receiver, o.block FROM g JOIN obs o ON src = o.obs_id JOIN obs q ON dst = q.obs_id), bl AS (SELECT sender, receiver, block, count(*) AS cb FROM ed GROUP BY ALL),
ts AS (SELECT sender, receiver, sum(cb)::BIGINT AS n_edges, count(*) FILTER (cb >= 20) AS n_tested FROM bl GROUP BY ALL HAVING sum(cb) >= 20),
rb AS MATERIALIZED (SELECT lig.interaction, sender, receiver, block, sum(lig.value * rec.value) AS s FROM ed JOIN lig ON src = lig.obs_id JOIN rec ON dst = rec.obs_id AND rec.interaction = lig.interaction GROUP BY ALL),
nb AS MATERIALIZED (SELECT perm, lig.interaction, sender, receiver, block, sum(lig.value * rec.value) AS s FROM ed JOIN lig ON src = lig.obs_id JOIN perm ON dst = perm.obs_id JOIN rec ON other = rec.obs_id AND rec.interaction = lig.interaction GROUP BY ALL),
re AS (SELECT interaction, sender, receiver, any_value(n_edges) AS n_edges, any_value(n_tested) AS n_tested, sum(s) / any_value(n_edges) AS score FROM rb JOIN ts USING (sender, receiver) GROUP BY ALL),
nw AS (SELECT perm, interaction, sender, receiver, sum(s) AS s FROM nb GROUP BY ALL),
st AS (SELECT interaction, sender, receiver, n_edges, n_tested, score, coalesce(sum(s / n_edges), 0) / {COMM_PERMS} AS mu, coalesce(sum((s / n_edges) ** 2), 0) / {COMM_PERMS} AS q, count(*) FILTER (s / n_edges >= score - 1e-9) AS ge FROM re LEFT JOIN nw USING (interaction, sender, receiver) GROUP BY ALL),
zz AS (SELECT *, CASE WHEN sqrt(greatest(q - mu * mu, 0)) > 1e-9 THEN (score - mu) / sqrt(greatest(q - mu * mu, 0)) END AS z FROM st), pp AS (SELECT *, CASE WHEN z IS NOT NULL THEN {normal_sf("z")} WHEN score > mu THEN 0 ELSE 1 END AS p FROM zz),
li AS (SELECT interaction, sender, receiver, block, any_value(own) AS own, list_sort(list_concat(coalesce(list(s) FILTER (s IS NOT NULL), []::DOUBLE[]), list_resize([]::DOUBLE[], {COMM_PERMS} - count(s), 0.0::DOUBLE))) AS x
  FROM (SELECT interaction, sender, receiver, block, rb.s AS own, nb.s AS s FROM rb LEFT JOIN nb USING (interaction, sender, receiver, block)) GROUP BY interaction, sender, receiver, block),
su AS (SELECT interaction, sender, receiver, count(*) AS n_supporting FROM li JOIN bl USING (sender, receiver, block) WHERE cb >= 20 AND (own - (x[190] + (x[191] - x[190]) * (0.95::DOUBLE * 199 - 189))) / cb > 1e-9 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY p, interaction, sender, receiver) AS r, count(*) OVER () AS n FROM pp), ad AS (SELECT *, {BH} AS padj FROM rk)"""


@plan(f"""WITH {fx.OBS}, {fx.FEATURES}, {graph_sql(6)}, {LR}, {shuffle_sql(COMM_PERMS)}, {COMM}
SELECT interaction, sender, receiver, n_edges, round(score, 2) AS score, round(p, 6) AS p, round((1 + ge) / {COMM_PERMS + 1.0}, 6) AS p_empirical, n_tested, coalesce(n_supporting, 0) AS n_supporting, round(padj, 6) AS padj,
  padj < 0.05 AND coalesce(n_supporting, 0) / greatest(n_tested, 1) >= 0.5 AS significant FROM ad LEFT JOIN su USING (interaction, sender, receiver)""")
def communication(spark, sf):
    o = fx.obs(spark, sf)
    lig, rec = _lr(spark, sf)
    out = ex.communication_test(graph.knn_graph(o, 6), o.select("obs_id", "label", "block"), lig, rec, graph.permutation(o, COMM_PERMS, portable=True), COMM_PERMS, 20)
    return rounded(out.withColumn("score", F.round("score", 2)))


@plan(f"""WITH {fx.VAR}, h AS (SELECT gene_id FROM var WHERE score > 10000), k AS (SELECT category AS term, count(*) FILTER (score > 10000) AS k, count(*) AS set_size FROM var GROUP BY 1 HAVING count(*) >= 3)
SELECT term, k, set_size, (SELECT count(*) FROM h) AS n_hits, (SELECT count(*) FROM var) AS n_universe,
  round(least(1, (SELECT sum(exp(lgamma(set_size + 1) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(n - set_size + 1) - lgamma(d - i + 1) - lgamma(n - set_size - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)))
    FROM (SELECT unnest(range(k, least(set_size, d) + 1)) AS i))), 6) AS p FROM k, (SELECT (SELECT count(*) FROM h) AS d, (SELECT count(*) FROM var) AS n)""")
def ora_enrichment(spark, sf):
    v = fx.var(spark, sf)
    return rounded(ex.ora(v.where("score > 10000"), v, v.select(F.col("category").alias("term"), "gene_id")))


@plan(f"""WITH {fx.VAR}, r AS (SELECT gene_id, score, row_number() OVER (ORDER BY score DESC, gene_id) AS place FROM var), s AS (SELECT category AS term, count(*) AS size, sum(abs(score)) AS total FROM var GROUP BY 1 HAVING count(*) BETWEEN 5 AND 500),
run AS (SELECT s.term, size, sum(CASE WHEN category = s.term THEN abs(score) / total ELSE -1.0 / ((SELECT count(*) FROM var) - size) END) OVER (PARTITION BY s.term ORDER BY place) AS v FROM s, r JOIN var USING (gene_id, score))
SELECT term, any_value(size) AS size, round(CASE WHEN max(v) >= -min(v) THEN max(v) ELSE min(v) END, 6) AS es FROM run GROUP BY term""")
def gsea_es(spark, sf):
    v = fx.var(spark, sf)
    return rounded(ex.gsea_es(v.select("gene_id", "score"), v.select(F.col("category").alias("term"), "gene_id")))


@plan(f"""WITH {fx.VAR} SELECT 'both' AS part, count(*) AS n FROM (SELECT symbol FROM var WHERE gene_id % 2 = 0 INTERSECT SELECT symbol FROM var WHERE gene_id % 3 = 0)
UNION ALL SELECT 'either', count(*) FROM (SELECT symbol FROM var WHERE gene_id % 2 = 0 UNION SELECT symbol FROM var WHERE gene_id % 3 = 0) UNION ALL SELECT 'first only', count(*) FROM (SELECT symbol FROM var WHERE gene_id % 2 = 0 EXCEPT SELECT symbol FROM var WHERE gene_id % 3 = 0)""")
def set_operations(spark, sf):
    """Intersection, union and difference of gene lists, as replication and recall use them."""
    v = fx.var(spark, sf)
    a, b = (v.where(F.col("gene_id") % k == 0).select("symbol") for k in (2, 3))
    n = lambda part, d: d.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).unionByName(n("either", a.union(b).distinct())).unionByName(n("first only", a.distinct().subtract(b)))


@plan(f"""WITH RECURSIVE {fx.VAR}, o AS (SELECT panel, score, gene_id, lag(score) OVER w AS s0, lag(gene_id) OVER w AS g0 FROM var WINDOW w AS (PARTITION BY panel ORDER BY score, gene_id))
SELECT panel, round(max(CASE WHEN s0 < 0 AND score >= 0 THEN g0 + (gene_id - g0) * (0 - s0) / (score - s0) END), 6) AS at_zero FROM o GROUP BY panel""")
def interpolate(spark, sf):
    """The value at a given place between the two rows that bracket it."""
    w = Window.partitionBy("panel").orderBy("score", "gene_id")
    o = fx.var(spark, sf).withColumn("s0", F.lag("score").over(w)).withColumn("g0", F.lag("gene_id").over(w))
    v = F.when((F.col("s0") < 0) & (F.col("score") >= 0), F.col("g0") + (F.col("gene_id") - F.col("g0")) * (0 - F.col("s0")) / (F.col("score") - F.col("s0")))
    return rounded(o.groupBy("panel").agg(F.max(v).alias("at_zero")))
