"""Plans over events, trees, networks, tables and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import events, leiden, network, neurons, text, trees
from lamina.sources import fixtures as fx
from lamina.sources import tables

from .registry import plan, rounded

ISI = "s AS (SELECT unit, t, event_id, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS isi FROM spikes), i AS (SELECT *, lead(isi) OVER (PARTITION BY unit ORDER BY t, event_id) AS nx FROM s)"


@plan(f"""WITH {fx.SPIKES}, {ISI} SELECT unit, count(*) AS n_spikes, round(CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) END, 9) AS rate, round(CASE WHEN avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) END, 6) AS isi_cv,
  round(avg(CASE WHEN isi + nx > 0 THEN 3 * (isi - nx) * (isi - nx) / ((isi + nx) * (isi + nx)) END), 6) AS lv, round(avg((isi < 300)::INT), 6) AS refractory_fraction, round(avg((coalesce(isi < 3000, false) OR coalesce(nx < 3000, false))::INT), 6) AS burst_fraction FROM i GROUP BY unit""")
def spike_metrics(spark, sf):
    """Users' events as spikes, minutes for milliseconds."""
    out = events.unit_metrics(fx.spikes(spark, sf), refractory=300.0, burst=3000.0)
    return out.select("unit", "n_spikes", F.round("rate", 9).alias("rate"), *(F.round(c, 6).alias(c) for c in ("isi_cv", "lv", "refractory_fraction", "burst_fraction")))


@plan(f"""WITH {fx.SPIKES}, sp AS (SELECT unit, min(t) AS t0, greatest(1, ceil((max(t) - min(t)) / 86400))::BIGINT AS k, count(*)::DOUBLE AS n FROM spikes GROUP BY unit),
c AS (SELECT unit, least(floor((t - t0) / 86400), k - 1) AS b, count(*)::DOUBLE AS c FROM spikes JOIN sp USING (unit) GROUP BY ALL), q AS (SELECT unit, sum(c * c) AS q FROM c GROUP BY unit)
SELECT unit, k AS n_windows, round((q / k - (n / k) * (n / k)) / (n / k), 6) AS fano FROM q JOIN sp USING (unit)""")
def fano_factor(spark, sf):
    return rounded(events.fano(fx.spikes(spark, sf), 86_400.0))


@plan(f"""WITH {fx.SPIKES}, e AS (SELECT t AS e FROM spikes WHERE kind = 'purchase'), j AS (SELECT CAST(floor((t - e + 1800) / 300) AS BIGINT) AS bin FROM e JOIN spikes ON t >= e - 1800 AND t < e + 3600)
SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM e) * 300.0::DOUBLE), 9) AS rate FROM j GROUP BY bin""")
def psth(spark, sf):
    s = fx.spikes(spark, sf)
    return rounded(events.psth(s, s.where("kind = 'purchase'").select(F.col("t").alias("e")), -1800.0, 3600.0, 300.0), 9)


@plan(f"""WITH {fx.SPIKES}, e AS (SELECT unit, t AS e FROM spikes WHERE kind = 'purchase'), j AS (SELECT unit, CAST(floor((t - e + 43200) / 3600) AS BIGINT) AS bin FROM e JOIN spikes USING (unit) WHERE t >= e - 43200 AND t < e + 43200)
SELECT unit, bin, count(*) AS n, round(count(*) / (any_value(k) * 3600.0::DOUBLE), 9) AS rate FROM j JOIN (SELECT unit, count(*) AS k FROM e GROUP BY unit) USING (unit) GROUP BY unit, bin""")
def psth_by_unit(spark, sf):
    s = fx.spikes(spark, sf)
    return rounded(events.psth(s, s.where("kind = 'purchase'").select("unit", F.col("t").alias("e")), -43_200.0, 43_200.0, 3600.0, ["unit"]), 9)


@plan(f"""WITH {fx.SPIKES} SELECT CAST(floor((b.t - a.t + 600) / 60) AS BIGINT) AS bin, count(*) AS n FROM spikes a JOIN spikes b ON a.kind = 'click' AND b.kind = 'purchase' AND b.t >= a.t - 600 AND b.t < a.t + 600 GROUP BY bin""")
def cross_correlogram(spark, sf):
    s = fx.spikes(spark, sf)
    return events.cross_correlogram(s.where("kind = 'click'"), s.where("kind = 'purchase'"), 600.0, 60.0)


@plan(f"""WITH {fx.SPIKES}, tr AS (SELECT event_id AS trial, unit, t + 1 AS e FROM spikes WHERE kind = 'purchase') SELECT trial, tr.unit, count(s.t) AS n FROM tr LEFT JOIN spikes s ON s.unit = tr.unit AND s.t >= e AND s.t < e + 86400 GROUP BY ALL""")
def interval_counts(spark, sf):
    s = fx.spikes(spark, sf)
    return events.interval_counts(s, s.where("kind = 'purchase'").select(F.col("event_id").alias("trial"), "unit", (F.col("t") + 1).alias("e")), 86_400.0)


@plan(f"""WITH {fx.SPIKES}, b AS (SELECT min(t) AS t0, floor((max(t) - min(t)) / 3600) + 1 AS k, count(DISTINCT unit) AS u FROM spikes), c AS (SELECT unit, floor((t - t0) / 3600) AS b, count(*)::DOUBLE AS c FROM spikes, b GROUP BY ALL),
v AS (SELECT avg(q / k - s / k * s / k) AS v FROM (SELECT unit, sum(c) AS s, sum(c * c) AS q FROM c GROUP BY unit), b), p AS (SELECT sum(c) AS s, sum(c * c) AS q FROM (SELECT b, sum(c) AS c FROM c GROUP BY b))
SELECT u AS n_units, k::BIGINT AS n_bins, round((q / k / u / u - (s / k / u) * (s / k / u)) / v, 6) AS chi2 FROM b, v, p""")
def population_synchrony(spark, sf):
    return rounded(events.population_synchrony(fx.spikes(spark, sf), 3600.0))


@plan(f"""WITH {fx.SIGNAL}, m AS (SELECT region, t, value - avg(value) OVER (PARTITION BY region) AS v FROM ts), n AS (SELECT *, lead(v) OVER w AS v2, lead(t) OVER w AS t2 FROM m WINDOW w AS (PARTITION BY region ORDER BY t))
SELECT region, round(t + (t2 - t) * (0 - v) / (v2 - v), 6) AS t FROM n WHERE v < 0 AND v2 >= 0""")
def up_crossings(spark, sf):
    m = fx.signal(spark, sf).withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy("region")))
    return rounded(events.up_crossings(m, ["region"]))


@plan()
def band_power(spark, sf):
    s = fx.signal(spark, sf).select(F.col("region").alias("channel"), F.col("t").alias("i"), "value")
    return events.band_power(s, 250.0, 0.25)


# ---- trees ---------------------------------------------------------------------------------------------------------

SEG = "seg AS (SELECT c.neuron, c.id, c.parent, c.type, sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2) AS length, c.x, c.y, c.z, p.x AS px, p.y AS py, p.z AS pz FROM tree c JOIN tree p ON c.parent = p.id AND c.neuron = p.neuron)"


@plan(f"WITH {fx.TREE}, {SEG} SELECT neuron, id, parent, type, round(length, 6) AS length FROM seg")
def swc_segments(spark, sf):
    return rounded(trees.segments(fx.tree(spark, sf)).select("neuron", "id", "parent", "type", "length"))


@plan(f"""WITH {fx.TREE}, {SEG}, so AS (SELECT avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM tree WHERE type = 1), k AS (SELECT parent AS id, count(*) AS k FROM tree WHERE parent <> -1 GROUP BY 1)
SELECT t.neuron, count(*) AS n_nodes, (SELECT round(sum(length), 4) FROM seg WHERE type <> 1) AS total_length, count(*) FILTER (t.type <> 1 AND k >= 2) AS n_branch, count(*) FILTER (t.type <> 1 AND k IS NULL) AS n_tips,
  count(*) FILTER (t.type <> 1 AND u.type = 1) AS n_stems, round(max(sqrt((t.x - sx) ** 2 + (t.y - sy) ** 2 + (t.z - sz) ** 2)) FILTER (t.type <> 1), 4) AS max_radius
FROM tree t LEFT JOIN k USING (id) LEFT JOIN tree u ON t.parent = u.id, so GROUP BY t.neuron""")
def swc_morphometrics(spark, sf):
    return rounded(trees.morphometrics(fx.tree(spark, sf)), 4)


@plan(f"""WITH RECURSIVE {fx.TREE}, {SEG}, r AS (SELECT neuron, id, 0.0::DOUBLE AS dist, 0::BIGINT AS depth FROM tree WHERE parent = -1 UNION ALL SELECT seg.neuron, seg.id, dist + CASE WHEN type = 1 THEN 0 ELSE length END, depth + 1 FROM r JOIN seg ON seg.parent = r.id)
SELECT neuron, id, round(dist, 5) AS dist, depth FROM r""")
def max_path(spark, sf):
    return rounded(trees.path_lengths(fx.tree(spark, sf)), 5)


@plan(f"""WITH {fx.TREE}, {SEG}, so AS (SELECT avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM tree WHERE type = 1), d AS (SELECT sqrt((x - sx) ** 2 + (y - sy) ** 2 + (z - sz) ** 2) AS a, sqrt((px - sx) ** 2 + (py - sy) ** 2 + (pz - sz) ** 2) AS b FROM seg, so WHERE type IN (2, 3, 4))
SELECT 0::BIGINT AS neuron, r * 25.0::DOUBLE AS radius, (SELECT count(*) FROM d WHERE least(a, b) < r * 25 AND greatest(a, b) >= r * 25) AS n FROM range(1, 61) t(r)""")
def sholl(spark, sf):
    return trees.sholl(fx.tree(spark, sf), 25.0, 1500.0)


# ---- networks ------------------------------------------------------------------------------------------------------

CORR = "c AS (SELECT a.region AS a, b.region AS b, count(*) AS n, corr(a.value, b.value) AS r FROM ts a JOIN ts b ON a.t = b.t AND a.region < b.region GROUP BY ALL)"
CUT = "ed AS MATERIALIZED (SELECT a, b, abs(r) AS w FROM c WHERE abs(r) >= (SELECT quantile_cont(abs(r), 0.85) FROM c))"


@plan(f"WITH {fx.SIGNAL}, {CORR} SELECT a, b, n, round(r, 6) AS r FROM c")
def connectivity_corr(spark, sf):
    return rounded(network.correlations(fx.signal(spark, sf)))


def _cut(spark, sf):
    c = network.correlations(fx.signal(spark, sf)).select("a", "b", F.abs("r").alias("w"))
    return network.threshold(c, 0.15)


@plan(f"WITH {fx.SIGNAL}, {CORR}, {CUT} SELECT a, b, round(w, 6) AS w FROM ed")
def graph_threshold(spark, sf):
    return rounded(_cut(spark, sf))


@plan(f"""WITH RECURSIVE {fx.SIGNAL}, {CORR}, {CUT}, u AS (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed), r AS (SELECT x AS src, y AS dst, 1 AS hops FROM u UNION SELECT src, y, hops + 1 FROM r JOIN u ON dst = x WHERE hops < 20 AND src <> y)
SELECT round(sum(1.0::DOUBLE / h) / 380, 6) AS efficiency FROM (SELECT src, dst, min(hops) AS h FROM r GROUP BY ALL)""")
def global_efficiency(spark, sf):
    return rounded(network.global_efficiency(_cut(spark, sf), 20))


@plan(f"""WITH {fx.SIGNAL}, {CORR}, {CUT}, d AS (SELECT n % 4 AS m, sum(w) AS d FROM (SELECT a AS n, w FROM ed UNION ALL SELECT b, w FROM ed) GROUP BY 1)
SELECT round(sum(coalesce((SELECT sum(w) FROM ed WHERE a % 4 = m AND b % 4 = m), 0) / (SELECT sum(w) FROM ed) - (d / (2 * (SELECT sum(w) FROM ed))) ** 2), 6) AS modularity FROM d""")
def modularity(spark, sf):
    e = _cut(spark, sf)
    nodes = spark.range(20).select(F.col("id").alias("node"), (F.col("id") % 4).alias("module"))
    return rounded(network.modularity(e, nodes))


@plan()
def communities(spark, sf):
    return network.label_communities(_cut(spark, sf))


@plan(f"""WITH RECURSIVE {fx.SIGNAL}, {CORR}, {CUT}, dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ed UNION ALL SELECT b FROM ed) GROUP BY node), hb AS (SELECT * FROM dg ORDER BY degree DESC, node LIMIT 5), cs AS (SELECT node AS gone FROM hb UNION ALL SELECT -1),
u AS (SELECT gone, a AS x, b AS y FROM cs, ed WHERE gone <> a AND gone <> b UNION SELECT gone, b, a FROM cs, ed WHERE gone <> a AND gone <> b), r AS (SELECT gone, x AS src, y AS dst, 1 AS hops FROM u UNION SELECT r.gone, src, y, hops + 1 FROM r JOIN u ON u.gone = r.gone AND dst = x WHERE hops < 20 AND src <> y),
h AS (SELECT gone, sum(1.0::DOUBLE / h) AS total FROM (SELECT gone, src, dst, min(hops) AS h FROM r GROUP BY ALL) GROUP BY gone), n AS (SELECT count(*) AS n FROM dg)
SELECT node, degree, round(((SELECT total FROM h WHERE gone = -1) - coalesce(total, 0)) / (n * (n - 1)), 6) AS efficiency_drop FROM n, hb LEFT JOIN h ON gone = node""")
def hub_removal(spark, sf):
    return rounded(network.hub_removal(_cut(spark, sf), 5))


@plan()
def louvain_modules(spark, sf):
    """Communities of the thresholded network at the resolution that gives four of them."""
    return network.modules_by_count(_cut(spark, sf), 4, steps=12)


@plan()
def leiden_modules(spark, sf):
    """Connected communities of the thresholded network at resolution 1."""
    return leiden.leiden(_cut(spark, sf))


@plan()
def partial_connectivity(spark, sf):
    return network.partial_correlations(fx.signal(spark, sf).withColumn("subject", F.lit(0)))


# ---- tables --------------------------------------------------------------------------------------------------------


@plan("""WITH w AS (SELECT l_orderkey AS obs_id, l_linenumber AS g, l_quantity AS v FROM lineitem) SELECT w.obs_id, 'g' || g AS gene, sum(v) AS value, any_value(o_totalprice) AS x, any_value(o_orderstatus) AS grp FROM w JOIN orders ON w.obs_id = o_orderkey AND o_orderkey % 2 = 0 GROUP BY ALL""")
def triplet_load(spark, sf):
    """A wide gene x cell matrix made long, joined with places and labels by cell."""
    li = fx.read(spark, sf, "lineitem")
    wide = li.groupBy(F.col("l_orderkey").cast("string").alias("id")).pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity"))
    wide = wide.select("id", *(F.col(str(i)).alias(f"g{i}") for i in range(1, 8)))
    o = fx.read(spark, sf, "orders")
    places = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("x"))
    labels = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("grp"))
    out = tables.load_triplet(wide, places, labels)
    return out.select(F.col("id").cast("bigint").alias("obs_id"), "gene", "value", "x", "grp")


@plan("""SELECT 'coordinates' AS part, count(*) AS n, count(*) - count(DISTINCT c_nationkey) AS duplicates, count(*) FILTER (try_cast(c_name AS DOUBLE) IS NULL) AS not_numbers FROM customer""")
def validate_triplet(spark, sf):
    c = fx.read(spark, sf, "customer")
    return tables.check_table(c, "coordinates", "c_nationkey", ["c_name"])


@plan("""WITH c AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL)
SELECT name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS r FROM c) WHERE r <= 50""")
def summary_counts(spark, sf):
    return tables.value_counts(fx.read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], 50)


@plan("""WITH e AS (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS isle FROM events), r AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY isle) AS run, row_number() OVER (PARTITION BY user_id, isle ORDER BY event_id) AS k FROM e)
SELECT user_id, event_id FROM r WHERE run = 1 AND k <= 3""")
def first_runs(spark, sf):
    """The first rows of each user's first unbroken run of ids."""
    return tables.first_run(fx.read(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@plan("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 101 <> 0)
SELECT 'missing' AS change, count(*) AS n FROM a ANTI JOIN b USING (l_orderkey, l_linenumber) UNION ALL SELECT 'changed', count(*) FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.l_quantity IS DISTINCT FROM b.l_quantity UNION ALL SELECT 'added', count(*) FROM b ANTI JOIN a USING (l_orderkey, l_linenumber)""")
def table_difference(spark, sf):
    a = fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.where("l_orderkey % 101 <> 0").withColumn("l_quantity", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return tables.difference(a, b, ["l_orderkey", "l_linenumber"], ["l_quantity"])


@plan("""SELECT o_orderkey, coalesce(c_name, 'NA') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""")
def label_join(spark, sf):
    c = fx.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return fx.read(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("NA")).alias("name"))


@plan("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 7919) % 1000003, p_partkey) AS r FROM part) SELECT p_brand, p_partkey FROM p WHERE r <= 5""")
def balanced_sample(spark, sf):
    """Five rows of each class by a portable hash order."""
    w = Window.partitionBy("p_brand").orderBy((F.col("p_partkey") * 7919) % 1000003, "p_partkey")
    return fx.read(spark, sf, "part").withColumn("r", F.row_number().over(w)).where("r <= 5").select("p_brand", "p_partkey")


@plan("""SELECT p_partkey, regexp_replace(p_type, '[ _]*[0-9]+$', '') AS clean, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'brass' WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%a%' THEN 'other a' ELSE 'other' END AS class FROM part""")
def label_cleanup(spark, sf):
    t = F.col("p_type")
    low = F.lower(t)
    kind = F.when(low.contains("brass"), "brass").when(low.contains("steel"), "steel").when(low.contains("a"), "other a").otherwise("other")
    return fx.read(spark, sf, "part").select("p_partkey", F.regexp_replace(t, "[ _]*[0-9]+$", "").alias("clean"), kind.alias("class"))


@plan("""SELECT c_custkey, round(CASE WHEN c_acctbal / 500 * 10 > 20 THEN 1000 / (2.0::DOUBLE + 20 * ln((c_acctbal / 500 * 10) / (c_acctbal / 500 * 10 - 20))) ELSE 0 END, 6) AS rate FROM customer""")
def lif_closed_form(spark, sf):
    return rounded(fx.read(spark, sf, "customer").select("c_custkey", neurons.lif_rate(F.col("c_acctbal") / 500).alias("rate")))


@plan()
def hh_fi_curve(spark, sf):
    runs = spark.range(12).select(F.col("id").alias("run"), (F.col("id") * 2.0).alias("current"), F.lit(1.0).alias("sodium"))
    return neurons.hh_sweep(runs, 200.0)


@plan()
def brunel_networks(spark, sf):
    runs = spark.createDataFrame([(0, 5.0, 2.0), (1, 4.5, 0.9), (2, 6.0, 4.0)], "run bigint, g double, eta double").repartition(3, "run")
    return neurons.brunel_sweep(runs, ms=300.0)


# ---- texts ---------------------------------------------------------------------------------------------------------


@plan("""WITH q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / av)) * times) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN d USING (doc_id), st GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 4""")
def bm25_topk(spark, sf):
    q = fx.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(text.bm25(fx.read(spark, sf, "documents"), q))


@plan("""SELECT doc_id, i::BIGINT AS chunk, text[i * 1200 + 1 : i * 1200 + 1200] AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1200.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def text_chunks(spark, sf):
    return text.chunk(fx.read(spark, sf, "documents"))


_NEAR = "abs(token::DOUBLE - {a}) <= greatest(0.05 + 1e-12, abs({a}) * 1e-3)"


@plan(f"""WITH c AS (SELECT c_custkey AS answer_id, c_acctbal AS v, printf('%.1f', floor(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 1.5 + 11 ELSE c_acctbal END * 10) / 10) AS token FROM customer)
SELECT answer_id, token FROM c WHERE NOT ({_NEAR.format(a="v")} OR {_NEAR.format(a="(v * 100)")})""")
def ungrounded_numbers(spark, sf):
    """Money named in a customer's sentence, rounded down to a tenth, against the account."""
    c = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("answer_id"), "c_acctbal")
    said = F.when(F.col("answer_id") % 5 == 0, F.col("c_acctbal") * 1.5 + 11).otherwise(F.col("c_acctbal"))
    said = F.floor(said * 10) / 10
    answers = c.select("answer_id", F.concat(F.lit("In 2021 the balance was "), F.format_string("%.1f", said), F.lit(" in 3 accounts.")).alias("text"))
    return text.ungrounded(answers, c.select("answer_id", F.col("c_acctbal").alias("value")))


@plan("""SELECT name AS key, array_to_string(v[1:20], ',') AS "values", regexp_replace(t, '(/home/|/Users/|/root)[^/\\s]*', '~', 'g')[1:6000] AS text FROM (SELECT p_brand AS name, list(p_partkey ORDER BY p_partkey) AS v, '/home/me/out ' || string_agg(p_name, ' ' ORDER BY p_partkey) AS t FROM part GROUP BY p_brand) WHERE name <> 'Brand#11'""")
def sanitised_results(spark, sf):
    p = fx.read(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("rows"))
    p = p.select("key", F.col("rows.p_partkey").alias("values"), F.concat(F.lit("/home/me/out "), F.array_join("rows.p_name", " ")).alias("text"))
    return text.sanitise(p, drop=("Brand#11",)).withColumn("values", F.array_join("values", ","))
