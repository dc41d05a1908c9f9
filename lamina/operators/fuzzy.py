"""Fuzzy neighbour graphs in feature space, and the way from counts to communities on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import written

from . import expression, learning, leiden, studies

#: Halvings of a bandwidth's interval (a float's precision), and the least bandwidth as a share of the mean distance.
HALVINGS, LEAST = 64, 1e-3


def bandwidth(distances: Column, nearest: Column, target: Column) -> Column:
    """The s for which the sum of exp(-max(d - nearest, 0) / s) over an array of distances is the target, by bisection inside the row."""
    reach = lambda s: F.aggregate(distances, F.lit(0.0), lambda a, d: a + F.exp(-F.greatest(d - nearest, F.lit(0.0)) / s))

    def halve(state: Column, _: Column) -> Column:
        low, high, s = (state[k] for k in ("low", "high", "s"))
        over = reach(s) > target
        new_low, new_high = F.when(over, low).otherwise(s), F.when(over, s).otherwise(high)
        return F.struct(new_low.alias("low"), new_high.alias("high"), F.when(F.isnull(new_high), s * 2).otherwise((new_low + new_high) / 2).alias("s"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda state: state["s"])


def memberships(edges: DataFrame) -> DataFrame:
    """src, dst, w: how far each neighbour (src, dst, d2) belongs to its point's surroundings.

    The nearest neighbour at a positive distance belongs wholly, as do all that are no farther; the bandwidth makes the sum the logarithm to
    base 2 of the number of neighbours and the point itself. A bandwidth is at least a thousandth of the point's mean distance, or of the mean
    over all points where all its neighbours are at distance 0. Edges with a null and edges from a point to itself are left out."""
    e = edges.where("src <> dst and d2 is not null").select("src", "dst", F.sqrt("d2").alias("d"))
    near = e.groupBy("src").agg(F.collect_list(F.struct("dst", "d")).alias("near"))  # k rows a point
    d = F.col("near.d")
    near = near.withColumn("nearest", F.coalesce(F.array_min(F.filter(d, lambda x: x > 0)), F.lit(0.0)))
    near = near.withColumn("s", bandwidth(d, F.col("nearest"), F.log2(F.size(d) + 1.0)))
    near = near.crossJoin(F.broadcast(e.agg(F.avg("d").alias("overall"))))  # a single row
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
    near = near.withColumn("s", F.greatest(F.col("s"), F.when(F.col("nearest") > 0, mean).otherwise(F.col("overall")) * LEAST))
    out = near.select("src", "nearest", "s", F.explode("near").alias("n")).select("src", "n.dst", (F.col("n.d") - F.col("nearest")).alias("d"), "s")
    return out.select("src", "dst", F.when(F.col("d") <= 0, 1.0).otherwise(F.exp(-F.col("d") / F.col("s"))).alias("w"))


def union(weights: DataFrame) -> DataFrame:
    """src, dst, w in both directions: the probability that at least one of the two memberships of a pair holds, a + b - ab."""
    pair = weights.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    both = pair.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w")).where("w > 0")
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return both.select(ends.alias("e"), "w").select("e.src", "e.dst", "w")


def fuzzy_graph(features: DataFrame, k: int = 15) -> DataFrame:
    """The fuzzy graph of rows (obs_id, features array) and their k - 1 nearest others (a point counts as its own first neighbour)."""
    return union(memberships(written(studies.feature_knn(features, k - 1), "neighbours")))


def dense(values: DataFrame, genes: list) -> DataFrame:
    """obs_id, gene_id, value of sparse values for the given genes, with 0 where a point has none; no point is lost, and rows are shuffled once."""
    ids = F.lit(genes).cast(f"array<{values.schema['gene_id'].dataType.simpleString()}>")
    own = values.groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("gene_id").isin(genes), F.struct("gene_id", F.col("value").cast("double"))))).alias("m"))
    return own.select("obs_id", "m", F.explode(ids).alias("gene_id")).select("obs_id", "gene_id", F.coalesce(F.element_at("m", F.col("gene_id")), F.lit(0.0)).alias("value"))


def clusters(values: DataFrame, n_top: int = 2000, n_pcs: int = 50, k: int = 15, resolution: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """From normalised sparse values (obs_id, gene_id, value): components (obs_id, gene_id, value), graph (src, dst, w), obs_id and cluster, and what was counted.

    Genes that stand out by dispersion, scaled and clipped at 10, principal components, fuzzy graph, connected communities. The genes (at most n_top)
    are a list on the driver; points, components and edges are tables."""
    n_obs = values.select("obs_id").distinct().count()
    genes = [r["gene_id"] for r in expression.hvg_dispersion(values, n_obs, 20, n_top).select("gene_id").collect()]
    if n_obs < 3 or len(genes) < 3:
        raise ValueError(f"{n_obs} points and {len(genes)} genes that vary: too few for components")
    z = expression.zscore_clip(dense(values, sorted(genes)), 10.0).withColumnRenamed("z", "value")
    pcs = max(2, min(n_pcs, len(genes) - 1, n_obs - 1))
    scores = written(learning.pca(z, pcs), "components")
    rows = scores.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "value"))).alias("r")).select("obs_id", F.col("r.value").alias("features"))
    g = written(fuzzy_graph(rows, min(k, n_obs)), "fuzzy")
    found = leiden.leiden(g.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), resolution)
    found = written(found.select(F.col("node").alias("obs_id"), F.col("module").alias("cluster")), "clusters")
    report = {"n_obs": n_obs, "n_genes": len(genes), "n_pcs": pcs, "n_clusters": found.select("cluster").distinct().count()}
    return scores, g, found, report
