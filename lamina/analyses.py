"""The built-in skills: the operators under names with typed parameters. Inputs are Parquet tables in long form, or files of the field
where a reader gives the same table: h5ad and 10x h5 for counts, NWB for spikes, EDF, BDF and BrainVision for signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import figures
from lamina.operators import events, expression, fuzzy, graph, learning, network, neurons, raster, registration, stats, trees
from lamina.sources import edf, hdf5, tables
from lamina.skills import markdown_table, param, skill

OBS = param("obs", "parquet", True, description="spots: obs_id, block, section, x, y, z")
VALUES = param("values", "parquet", True, description="obs_id, gene_id, value")
COUNTS = param("counts", "parquet", True, description="obs_id, gene_id, count")
GENES = param("genes", "parquet", True, description="gene_id, symbol")


def _read(spark: SparkSession, *paths: str) -> list[DataFrame]:
    return [spark.read.parquet(p) for p in paths]


def _counts(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".h5ad", ".h5")):
        return (hdf5.read_h5ad if path.endswith(".h5ad") else hdf5.read_10x)(spark, path).counts()
    return spark.read.parquet(path)


@skill("core.inspect", "Columns, rows, frequent values and ranges of a table", param("input", "parquet", True), param("top", "int", default=50))
def inspect_table(spark, ctx, input, top):
    (df,) = _read(spark, input)
    text = [c for c, k in df.dtypes if k in ("string", "boolean")]
    numbers = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint")]
    return {
        "rows": df.count(), "columns": df.dtypes, "values": [r.asDict() for r in tables.value_counts(df, text, top).collect()] if text else [],
        "ranges": [r.asDict() for r in tables.ranges(df, numbers).collect()] if numbers else [],
    }


@skill("core.figures", "Sections drawn by a column, its most frequent values, its table against another column, and a report with them", OBS, param("value", "str", default="label"), param("against", "str", default="section"), param("title", "str", default=""), param("top", "int", default=25))
def draw(spark, ctx, obs, value, against, title, top):
    (o,) = _read(spark, obs)
    title = title or value
    ctx.save_text(figures.panels(o, value, title), "sections.svg")
    ctx.save_text(figures.bars(o, value, title, top), "bars.svg")
    ctx.save_text(figures.heatmap(o, value, against, title=f"{title} by {against}"), "heat.svg")
    most = [r.asDict() for r in raster.largest(o, value, top).collect()]
    ctx.save_text(f"# {title}\n\n![sections](sections.svg)\n![bars](bars.svg)\n![heat map](heat.svg)\n\n{markdown_table(most, ['name', 'n'])}", "REPORT.md")
    return raster.pixels(o, value)


@skill("core.load_triplet", "Expression, coordinates and metadata files as one long table", param("expression", "csv", True), param("coordinates", "csv", True), param("metadata", "csv", True))
def load_triplet(spark, ctx, expression, coordinates, metadata):
    parts = [tables.read_table(spark, p) for p in (expression, coordinates, metadata)]
    if errors := tables.validate_triplet(*parts):
        raise ValueError("; ".join(errors))
    parts = [p.withColumnRenamed(tables.id_column(p), "id") for p in parts[1:]]
    wide = tables.read_table(spark, expression)
    return tables.load_triplet(wide.withColumnRenamed(wide.columns[0], "id"), *parts)


@skill(
    "core.preprocess", "Filters, library sizes to 10,000, logs; with clusters also genes that vary, components, fuzzy graph and communities", COUNTS, param("min_cells", "int", default=3), param("min_genes", "int", default=200), param("target", "float", default=1e4),
    param("clusters", "bool", default=False), param("n_top_genes", "int", default=2000), param("n_pcs", "int", default=50), param("n_neighbors", "int", default=15), param("resolution", "float", default=1.0),
)
def preprocess(spark, ctx, counts, min_cells, min_genes, target, clusters, n_top_genes, n_pcs, n_neighbors, resolution):
    c = _counts(spark, counts)
    out = expression.normalize_log1p(expression.filter_genes_cells(c, min_cells, min_genes), target)
    if not clusters:
        return out
    ctx.save_table(out, "normalized.parquet")
    values = spark.read.parquet(str(ctx.out / "normalized.parquet")).select("obs_id", "gene_id", F.col("lognorm").alias("value"))
    scores, edges, found, report = fuzzy.clusters(values, n_top_genes, n_pcs, n_neighbors, resolution)
    ctx.save_table(scores, "components.parquet")
    ctx.save_table(edges, "graph.parquet")
    ctx.save_json(report, "report.json")
    return found


@skill("atlas.annotate", "Panels against random sets of like expression, and labels", VALUES, param("sets", "parquet", True, description="panel, null_id (-1: the panel), gene_id"), param("n_null", "int", default=1000), param("alpha", "float", default=0.05))
def annotate(spark, ctx, values, sets, n_null, alpha):
    v, s = _read(spark, values, sets)
    scores = expression.panel_scores(v, s, n_null)
    ctx.save_table(scores, "scores.parquet")
    return expression.call_labels(spark.read.parquet(str(ctx.out / "scores.parquet")), alpha)


@skill("spatial3d.reconstruct", "Sections of a block laid over each other in three dimensions", OBS, param("spacing", "float", default=10.0), param("register", "bool", default=True), param("order", "str", description="column that sections go by"), param("height", "str", description="column with heights"))
def reconstruct(spark, ctx, obs, spacing, register, order, height):
    o, audit = _read(spark, obs)[0], None
    if register:
        ctx.save_table(registration.chain(o, order), "audit.parquet")
        audit = spark.read.parquet(str(ctx.out / "audit.parquet"))
    return registration.reconstruct(o, spacing, register, order, height, audit)


@skill("spatial3d.domains", "Tissue domains from smoothed components", OBS, VALUES, param("n_domains", "int", default=7), param("k", "int", default=6), param("lam", "float", default=0.5), param("n_pcs", "int", default=20), param("method", "str", default="kmeans", choices=("kmeans", "gmm")), param("cross_sections", "bool", default=False), param("refine", "bool", default=True))
def domains(spark, ctx, obs, values, n_domains, k, lam, n_pcs, method, cross_sections, refine):
    o, v = _read(spark, obs, values)
    return learning.detect_domains(o, v, n_domains, k, lam, n_pcs=n_pcs, method=method, cross_sections=cross_sections, refine=refine, seed=ctx.seed)


@skill("spatial3d.svg", "Genes whose values follow space", OBS, VALUES, param("k", "int", default=8), param("n_permutations", "int", default=199), param("n_top", "int", default=500))
def svg(spark, ctx, obs, values, k, n_permutations, n_top):
    o, v = _read(spark, obs, values)
    top = expression.top_variance(v, n_top)
    v = v.join(F.broadcast(top.select("gene_id")), "gene_id", "left_semi")
    return graph.spatially_variable(o, graph.knn_graph(o, k), v, n_permutations, ctx.seed)


@skill("spatial3d.niches", "Clusters of neighbourhoods by labels", OBS, param("n_niches", "int", default=6), param("k", "int", default=15))
def niches(spark, ctx, obs, n_niches, k):
    return learning.niches(_read(spark, obs)[0], n_niches, k, ctx.seed)


@skill("spatial3d.communication", "Ligands and receptors between labels that are neighbours", OBS, param("ligands", "parquet", True, description="obs_id, interaction, value"), param("receptors", "parquet", True), param("k", "int", default=8), param("n_permutations", "int", default=200), param("min_edges", "int", default=20))
def communication(spark, ctx, obs, ligands, receptors, k, n_permutations, min_edges):
    o, lig, rec = _read(spark, obs, ligands, receptors)
    return expression.communication_test(graph.knn_graph(o, k), o.select("obs_id", "label", "block"), lig, rec, graph.permutation(o, n_permutations, ctx.seed), n_permutations, min_edges)


@skill("stats.replicate_de", "Groups compared over replicates", COUNTS, param("meta", "parquet", True, description="obs_id, unit, grp"), param("a", "str", True), param("b", "str", True), param("min_cells", "int", default=10), param("paired", "bool", default=True))
def replicate_de(spark, ctx, counts, meta, a, b, min_cells, paired):
    c, m = _read(spark, counts, meta)
    return stats.pseudobulk_test(c, m, a, b, min_cells, paired)


@skill("legacy.region_de", "All pairs of regions, by Welch tests", VALUES, param("regions", "parquet", True, description="obs_id, region"), param("min_cells", "int", default=10))
def region_de(spark, ctx, values, regions, min_cells):
    from lamina.functions.distributions import p_t

    d = stats.region_de(*_read(spark, values, regions), min_cells)
    return stats.benjamini_hochberg(d.withColumn("p", F.greatest(p_t(F.col("t"), F.col("df")), F.lit(1e-300))), "p", ["gene_id"], ["a", "b"])


@skill("legacy.grn", "Rank correlations of regulators and targets", VALUES, param("pairs", "parquet", True, description="gene_a, gene_b"), param("threshold", "float", default=0.2), param("fdr", "float", default=0.05))
def grn(spark, ctx, values, pairs, threshold, fdr):
    v, p = _read(spark, values, pairs)
    out = stats.benjamini_hochberg(stats.spearman_p(stats.spearman_pairs(v, p)), "p", ["gene_a", "gene_b"])
    return out.where((F.abs("rho") >= threshold) & (F.col("padj") < fdr))


@skill("legacy.development", "Stemness from stem and differentiation panels", VALUES, param("panels", "parquet", True, description="panel (stem, quiescent, differentiated), gene_id"))
def development(spark, ctx, values, panels):
    v, p = _read(spark, values, panels)
    m = v.join(F.broadcast(p), "gene_id").groupBy("obs_id", "panel").agg(F.avg("value").alias("m"))
    m = expression.minmax(m, "m", ["panel"])
    side = F.when(F.col("panel") == "stem", 2 * F.col("scaled")).when(F.col("panel") == "differentiated", 1 - F.col("scaled")).otherwise(F.col("scaled"))
    weight = F.when(F.col("panel") == "stem", 2.0).otherwise(1.0)
    s = m.groupBy("obs_id").agg((F.sum(side) / F.sum(weight)).alias("s")).withColumn("all", F.lit(0))
    return expression.minmax(s, "s", ["all"]).select("obs_id", F.col("scaled").alias("stemness"))


@skill("legacy.trajectory", "Distances along a graph from a root", OBS, param("k", "int", default=15), param("root", "int", True))
def trajectory(spark, ctx, obs, k, root):
    return learning.pseudotime(graph.knn_graph(_read(spark, obs)[0], k), root)


@skill("legacy.ml", "A forest on groups that were held out, and on shuffled labels", VALUES, param("labels", "parquet", True, description="obs_id, label, grp"), param("shuffles", "int", default=20))
def forest(spark, ctx, values, labels, shuffles):
    return learning.random_forest(*_read(spark, values, labels), shuffles=shuffles, seed=ctx.seed)


@skill("legacy.enrichment", "Gene sets by ranked scores", param("ranked", "parquet", True, description="gene_id, score"), param("sets", "parquet", True, description="term, gene_id"))
def enrichment(spark, ctx, ranked, sets):
    return expression.gsea_es(*_read(spark, ranked, sets))


@skill("legacy.misc", "Types of a reference in mixed points", VALUES, param("reference", "parquet", True, description="type, gene_id, value"))
def deconvolution(spark, ctx, values, reference):
    return learning.deconvolve(*_read(spark, values, reference))


@skill("organoid.fidelity", "Labels and ages from the nearest reference points", param("query", "parquet", True, description="obs_id, features"), param("reference", "parquet", True), param("labels", "parquet", True, description="obs_id, label, age"), param("k", "int", default=15))
def fidelity(spark, ctx, query, reference, labels, k):
    return learning.map_to_reference(*_read(spark, query, reference, labels), k)


@skill("ephys.spikes", "Rates, intervals and bursts of units", param("spikes", "parquet", True, description="unit, t, event_id"), param("window", "float", default=1.0))
def spikes(spark, ctx, spikes, window):
    s = hdf5.read_units(spark, spikes) if spikes.endswith(".nwb") else spark.read.parquet(spikes)
    return events.unit_metrics(s).join(events.fano(s, window), "unit", "left")


@skill("ephys.eeg_bandpower", "Power by bands", param("signal", "parquet", True, description="channel, i, value"), param("fs", "float", default=0.0, description="samples a second; recordings know theirs"), param("fmax", "float", default=45.0))
def eeg_bandpower(spark, ctx, signal, fs, fmax):
    if signal.lower().endswith((".edf", ".bdf", ".vhdr")):
        fs = fs or edf.rate(signal)
        return events.segment_power(edf.read(spark, signal), fs, fmax=fmax)
    if fs <= 0:
        raise ValueError("fs is needed where the signal is a table")
    return events.segment_power(_read(spark, signal)[0], fs, fmax=fmax)


@skill("modeling.hh", "Firing rates of a Hodgkin-Huxley neuron by current", param("currents", "list", default="0,5,10,15,20"), param("sodium", "float", default=1.0), param("ms", "float", default=500.0))
def hodgkin_huxley(spark, ctx, currents, sodium, ms):
    return neurons.hh_sweep(spark.createDataFrame([(i, float(c), sodium) for i, c in enumerate(currents)], "run bigint, current double, sodium double"), ms)


@skill("modeling.network", "Rates and synchrony of sparse random networks", param("g", "float", default=5.0), param("eta", "float", default=2.0), param("runs", "int", default=3), param("ms", "float", default=1000.0))
def brunel(spark, ctx, g, eta, runs, ms):
    return neurons.brunel_sweep(spark.range(runs).selectExpr(f"id + {ctx.seed} AS run", f"{g}D AS g", f"{eta}D AS eta").repartition(runs, "run"), ms=ms)


@skill("morphology.swc", "Lengths, branches and Sholl counts of neuron trees", param("input", "swc", True), param("step", "float", default=10.0), param("max_radius", "float", default=500.0))
def morphology(spark, ctx, input, step, max_radius):
    t = tables.read_swc(spark, input)
    ctx.save_table(trees.sholl(t, step, max_radius), "sholl.parquet")
    return trees.morphometrics(t)


@skill("imaging.connectome", "Correlations of regions and the strongest edges", param("series", "parquet", True, description="t, region, value"), param("density", "float", default=0.15))
def connectome(spark, ctx, series, density):
    c = network.correlations(_read(spark, series)[0])
    ctx.save_table(c, "correlations.parquet")
    return network.threshold(c.select("a", "b", F.col("r").alias("w")), density)
