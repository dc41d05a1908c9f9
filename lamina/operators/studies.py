"""What studies are put together from: matched control sets, hierarchical labels, selection, agreement, resampling and decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import expression, graph, stats
from lamina.session import tasks, written

#: Gene sets of the stemness composite; sets whose name holds pluripotency, self_renewal or core count twice.
STEMNESS = {
    "pluripotency_core": ["POU5F1", "NANOG", "SOX2", "KLF4", "MYC", "LIN28A", "LIN28B", "SALL4", "ESRRB", "UTF1"],
    "esc_signature": ["DNMT3B", "GDF3", "GABRB3", "ZFP42", "TDGF1", "PODXL", "THY1", "CD9", "FUT4", "PROM1"],
    "self_renewal": ["TERT", "BMI1", "EZH2", "SUZ12", "EED", "WNT3", "WNT3A", "FGF2", "FGF4", "TGFB1"],
    "differentiation": ["GATA6", "SOX17", "FOXA2", "CDX2", "MIXL1", "EOMES", "TBXT", "PAX6", "OTX2", "HOXB1"],
}


#: Fixed value: draws that a task makes, about.
DRAWS = 2**22


def control_sets(panels: DataFrame, bins: DataFrame, n_null: int, seed: int = 0, least: int = 10, portable: bool = False) -> DataFrame:
    """panel, null_id, gene_id: each panel's genes that have a bin (null_id -1) and n_null random sets, in which each gene of the panel has a gene of like expression in its place.

    It is drawn from the genes of its expression bin that no panel has, with as many neighbouring bins as it takes for `least` of them; a gene may be drawn
    twice for a set. Portable draws are arithmetic that any SQL engine can follow; the others are hashes."""
    bins = written(bins.select("gene_id", "bin"), "bins")
    free = bins.join(panels.select("gene_id").distinct(), "gene_id", "left_anti")
    mine = written(panels.distinct().join(bins, "gene_id").select("panel", "gene_id", "bin"), "mine")
    need = mine.select("bin").distinct()
    size = free.groupBy("bin").agg(F.count("*").alias("n"))
    widths = panels.sparkSession.range(bins.agg(F.max("bin")).first()[0] + 1).select(F.col("id").alias("width"))
    reach = need.crossJoin(F.broadcast(widths)).join(size.select(F.col("bin").alias("b2"), "n"), F.abs(F.col("b2") - F.col("bin")) <= F.col("width"))
    reach = reach.groupBy("bin", "width").agg(F.sum("n").alias("pool"))
    # the first width with enough genes, or the widest
    width = reach.groupBy("bin").agg(F.coalesce(F.min(F.when(F.col("pool") >= least, F.col("width"))), F.max("width")).alias("width"))
    if free.isEmpty():
        raise ValueError("all genes belong to panels: there are none to draw from")
    pool = width.join(free.select(F.col("gene_id").alias("drawn"), F.col("bin").alias("b2")), F.abs(F.col("b2") - F.col("bin")) <= F.col("width"))
    by_bin = Window.partitionBy("bin")
    pool = pool.select("bin", "drawn", (F.row_number().over(by_bin.orderBy("drawn")) - 1).cast("bigint").alias("place"), F.count("*").over(by_bin).alias("pool"))
    pool = written(pool, "pools")
    sizes = pool.select("bin", "pool").distinct()
    nulls = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_null - 1).cast("bigint"))).alias("null_id") if n_null else F.explode(F.array().cast("array<bigint>")).alias("null_id")
    # genes are dealt out by the draws that they will make, not by their bytes
    dealt = mine.join(F.broadcast(sizes), "bin").repartition(tasks(panels.sparkSession, mine.count() * n_null, DRAWS), "gene_id")
    key = graph.portable_key("gene_id", "null_id") if portable else F.xxhash64("gene_id", "null_id", "panel", F.lit(seed))
    draws = dealt.select("panel", "gene_id", "bin", "pool", nulls).select("panel", "null_id", "bin", F.pmod(key, F.col("pool")).alias("place"))
    real = mine.select("panel", F.lit(-1).cast("bigint").alias("null_id"), "gene_id")
    return real.unionByName(draws.join(pool, ["bin", "place"]).select("panel", "null_id", F.col("drawn").alias("gene_id")))


def annotate(values: DataFrame, panels: DataFrame, n_obs: int, n_null: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """obs_id, cls, subclass: the class among panels without a parent, then the subclass among those of that class. panels has (panel, parent, gene_id)."""
    bins = expression.expression_bins(expression.gene_moments(values, n_obs))
    scores = written(expression.panel_scores(values, written(control_sets(panels.select("panel", "gene_id"), bins, n_null, seed), "sets"), n_null), "scores")
    kin = panels.select("panel", "parent").distinct()
    top = scores.join(kin.where("parent is null"), "panel", "left_semi")
    cls = expression.call_labels(top, alpha).select("obs_id", F.col("label").alias("cls"))
    low = scores.join(kin.where("parent is not null"), "panel").join(cls, "obs_id").where("parent = cls")
    sub = expression.call_labels(low.select("obs_id", "panel", "effect", "p"), alpha) if not low.isEmpty() else None
    if sub is None:
        return cls.withColumn("subclass", F.lit("Unresolved"))
    return cls.join(sub.select("obs_id", F.col("label").alias("subclass")), "obs_id", "left").select("obs_id", "cls", F.coalesce("subclass", F.lit("Unresolved")).alias("subclass"))


def stemness(values: DataFrame, sets: DataFrame) -> DataFrame:
    """obs_id, stemness from 0 to 1. sets has (name, gene_id); values is dense over its genes. Each set's mean is scaled, differentiation is turned round."""
    m = values.join(sets, "gene_id").groupBy("obs_id", "name").agg(F.avg("value").alias("m"))
    m = expression.minmax(m, "m", ["name"])
    twice = F.col("name").rlike("pluripotency|self_renewal|core")
    side = F.when(~twice & F.col("name").contains("differentiation"), 1 - F.col("scaled")).otherwise(F.col("scaled"))
    w = F.when(twice, 2.0).otherwise(1.0)
    s = m.groupBy("obs_id").agg((F.sum(side * w) / F.sum(w)).alias("s")).withColumn("all", F.lit(0))
    return expression.minmax(s, "s", ["all"]).select("obs_id", F.col("scaled").alias("stemness"))


def informative_genes(values: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """label, gene_id, t, rank of the n genes that stand out most in a label against all others, from moments: the rest is the total minus the label."""
    v = values.join(labels, "obs_id")
    agg = lambda *by: v.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    a = agg("label", "gene_id")
    t = agg("gene_id").select("gene_id", *(F.col(c).alias(f"{c}t") for c in "nsq"))
    j = a.join(t, "gene_id").where("n > 1 and nt - n > 1")
    m = F.col("nt") - F.col("n")
    ma, mb = F.col("s") / F.col("n"), (F.col("st") - F.col("s")) / m
    va = (F.col("q") - F.col("n") * ma * ma) / (F.col("n") - 1)
    vb = (F.col("qt") - F.col("q") - m * mb * mb) / (m - 1)
    d = F.sqrt(F.greatest(va, F.lit(0.0)) / F.col("n") + F.greatest(vb, F.lit(0.0)) / m)
    j = j.select("label", "gene_id", F.when(d > 1e-12, (ma - mb) / d).otherwise(0.0).alias("t"))
    w = Window.partitionBy("label").orderBy(F.desc(F.round("t", 9)), "gene_id")
    return j.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def colocalised(edges: DataFrame, values: DataFrame, threshold: float) -> DataFrame:
    """gene_a, gene_b, r of genes whose smoothed values go together."""
    s = graph.neighbourhood_mean(edges, values)
    a, b = (s.select("obs_id", F.col("gene_id").alias(f"gene_{x}"), F.col("value").alias(f"v{x}")) for x in "ab")
    c = a.join(b, "obs_id").where("gene_a < gene_b").groupBy("gene_a", "gene_b").agg(F.corr("va", "vb").alias("r"))
    return c.where(F.abs("r") >= threshold)


def leave_one_out_choice(scores: DataFrame) -> DataFrame:
    """donor, setting, others: the setting that is best on all other donors. scores has (donor, setting, score); means without a donor are totals minus its own."""
    own = scores.groupBy("donor", "setting").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    total = scores.groupBy("setting").agg(F.sum("score").alias("S"), F.count("*").alias("m"))
    total = total.select("setting", F.col("S").alias("total"), "m")
    j = own.join(total, "setting").where("m > n").withColumn("others", (F.col("total") - F.col("s")) / (F.col("m") - F.col("n")))
    w = Window.partitionBy("donor").orderBy(F.desc(F.round("others", 9)), "setting")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("donor", "setting", "others")


def balanced_splits(donors: DataFrame) -> DataFrame:
    """split, donor, side: all ways to share the donors of each stratum out to two halves, (stratum, donor), strata of four donors each, as combinations joined over strata."""
    a, b = (donors.select("stratum", F.col("donor").alias(x)) for x in ("d1", "d2"))
    pair = a.join(b, "stratum").where("d1 < d2").select("stratum", F.array("d1", "d2").alias("half"))
    names = [r["stratum"] for r in donors.select("stratum").distinct().orderBy("stratum").collect()]
    out = pair.where(F.col("stratum") == names[0]).select(F.col("half").alias("first"))
    for n in names[1:]:
        out = out.crossJoin(F.broadcast(pair.where(F.col("stratum") == n).select("half"))).select(F.concat("first", "half").alias("first"))
    return out.select(F.array_join(F.transform(F.array_sort("first"), lambda d: d.cast("string")), "-").alias("split"), "first")


def agreement(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, max_abs, max_rel, r of two columns of measurements."""
    j = a.select(*key, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), key).where("va is not null and vb is not null")
    d = F.abs(F.col("va") - F.col("vb"))
    return j.agg(F.count("*").alias("n"), F.max(d).alias("max_abs"), F.max(d / F.when(F.abs("vb") > 0, F.abs("vb"))).alias("max_rel"), F.corr("va", "vb").alias("r"))


def gsea_test(ranked: DataFrame, sets: DataFrame, n_perm: int, seed: int = 0, portable: bool = False) -> DataFrame:
    """term, size, es, nes, p: against the same sets with genes shuffled; p and the scale of nes come from shuffles of the same sign. Portable shuffles are arithmetic."""
    real = expression.gsea_es(ranked, sets)
    perms = sets.sparkSession.range(n_perm).select(F.col("id").alias("perm"))
    genes = ranked.select("gene_id").withColumn("i", F.row_number().over(Window.orderBy("gene_id")))
    key = graph.portable_key("gene_id", "perm") if portable else F.xxhash64("gene_id", "perm", F.lit(seed))
    w = Window.partitionBy("perm").orderBy(key, "gene_id")
    moved = genes.crossJoin(F.broadcast(perms)).withColumn("j", F.row_number().over(w)).select("perm", F.col("gene_id").alias("to"), "j").join(genes.select("gene_id", F.col("i").alias("j")), "j")
    shuffled = sets.join(moved, "gene_id").select(F.concat_ws("\u0001", "term", "perm").alias("term"), F.col("to").alias("gene_id"))
    null = expression.gsea_es(ranked, shuffled).select(F.split("term", "\u0001")[0].alias("term"), F.col("es").alias("e0"))
    j = real.join(null, "term").where((F.col("es") >= 0) == (F.col("e0") >= 0))
    g = j.groupBy("term", "size", "es").agg(F.count("*").alias("k"), F.count_if(F.abs("e0") >= F.abs("es") - 1e-12).alias("ge"), F.avg(F.abs("e0")).alias("m"))
    return real.join(g.drop("size", "es"), "term", "left").select("term", "size", "es", (F.col("es") / F.col("m")).alias("nes"), ((1 + F.coalesce("ge", F.lit(0))) / (1 + F.coalesce("k", F.lit(0)))).alias("p"))


def signed_rank(differences: list[float]) -> tuple[float, float]:
    """(W, two-sided p) of a handful of paired differences: exact by counting up to 25 without ties or zeros, else the normal approximation with ties."""
    d = np.array([x for x in differences if x != 0 and math.isfinite(x)])
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    order = np.abs(d)
    rank = np.array([(order < x).sum() + ((order == x).sum() + 1) / 2 for x in order])
    plus = float(rank[d > 0].sum())
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and len(set(order)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return low, min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n)
    ties = sum(float(c) ** 3 - c for c in np.unique(order, return_counts=True)[1])
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (low - n * (n + 1) / 4) / sd if sd > 0 else 0.0
    return low, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def poisson_deviance(edges: DataFrame, train: DataFrame, test: DataFrame, weight: float) -> DataFrame:
    """gene_id, deviance of test counts under own and neighbours' training rates, mixed by weight. Dense (obs_id, gene_id, value) on both sides."""
    around = graph.neighbourhood_mean(edges, train).withColumnRenamed("value", "around")
    j = train.join(around, ["obs_id", "gene_id"]).join(test.withColumnRenamed("value", "y"), ["obs_id", "gene_id"])
    rate = F.greatest((1 - weight) * F.col("value") + weight * F.col("around"), F.lit(1e-3))
    dev = 2 * (F.when(F.col("y") > 0, F.col("y") * F.ln(F.col("y") / rate)).otherwise(0.0) - (F.col("y") - rate))
    return j.groupBy("gene_id").agg(F.sum(dev).alias("deviance"))


def tuned_smoothing(edges: DataFrame, train: DataFrame, tune: DataFrame, test: DataFrame, weights: list[float]) -> DataFrame:
    """gene_id, weight, deviance, own_deviance: the weight of neighbours whose total deviance on the tuning counts is least (ties: the smaller), and each gene's
    deviance of test counts with it and with no neighbours. Dense (obs_id, gene_id, value) everywhere."""
    around = graph.neighbourhood_mean(edges, train).withColumnRenamed("value", "around")
    j = train.join(around, ["obs_id", "gene_id"]).join(tune.withColumnRenamed("value", "y"), ["obs_id", "gene_id"]).join(test.withColumnRenamed("value", "t"), ["obs_id", "gene_id"])
    rate = lambda w: F.greatest((1 - w) * F.col("value") + w * F.col("around"), F.lit(1e-3))
    dev = lambda y, w: 2 * (F.when(F.col(y) > 0, F.col(y) * F.ln(F.col(y) / rate(w))).otherwise(0.0) - (F.col(y) - rate(w)))
    # all weights in one pass: sums by gene, tuned over all genes
    sums = written(j.groupBy("gene_id").agg(*(F.sum(dev(y, w)).alias(f"{y}{i}") for i, w in enumerate([0.0, *weights]) for y in "yt")), "deviance")
    total = F.array(*(F.struct(F.round(F.sum(f"y{i}"), 9).alias("d"), F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(weights, 1)))
    best = sums.agg(F.array_min(total).alias("b"))
    tests = F.array(*(f"t{i}" for i in range(len(weights) + 1)))
    return sums.crossJoin(F.broadcast(best)).select("gene_id", F.col("b.w").alias("weight"), tests[F.col("b.i")].alias("deviance"), F.col("t0").alias("own_deviance"))


def unit_responses(spikes: DataFrame, trials: DataFrame, length: float) -> DataFrame:
    """unit, na, nb, u, z, p, padj: whether a unit has more or fewer spikes in the time after its trials than as long before them (rank test over trials, false discovery rate over units). trials has (trial, unit, e)."""
    from lamina.operators import events

    after = events.interval_counts(spikes, trials, length).withColumn("grp", F.lit("after"))
    before = events.interval_counts(spikes, trials.withColumn("e", F.col("e") - length), length).withColumn("grp", F.lit("before"))
    both = after.unionByName(before).select("unit", "grp", F.col("n").cast("double").alias("value"))
    return stats.benjamini_hochberg(stats.mann_whitney_p(stats.mann_whitney(both, ["unit"], "grp", "after", "before")), "p", ["unit"])


def nearest_columns(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least finite numbers of each row of d, equal ones by ids; only what the k-th does not exceed is put in order."""
    d = np.where(np.isnan(d), np.inf, d)
    k = min(k, d.shape[1])
    row, column = np.nonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(d))
    order = np.lexsort((ids[column], d[row, column], row))
    row, column = row[order], column[order]
    use = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[use], column[use]


#: Fixed value: rows whose neighbours one task looks for, at most; right rows that it compares with a block of 512 of them at a time.
CHUNK, AT_ONCE = 65_536, 2048


def _best(row: np.ndarray, d: np.ndarray, dst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row by (d, dst), in order."""
    order = np.lexsort((dst, d, row))
    row, d, dst = row[order], d[order], dst[order]
    use = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[use], d[use], dst[use]


def _near_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest right rows (side 1) of each left row (side 0) of a cell; partitions are in order of (cell, side), and right rows go by batch by batch."""
    at, left, x = None, [], None

    def found() -> Iterator[pa.RecordBatch]:
        if x is not None:
            row, d, dst = (c[0] for c in kept)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], kind), pa.array(dst, kind), pa.array(d)], names=["src", "dst", "d2"])

    for batch in batches:
        cell, side = (batch.column(c).to_numpy() for c in ("cell", "side"))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
            if hi == lo:
                continue
            if cell[lo] != at:
                yield from found()
                at, left, x = cell[lo], [], None
            rows = batch.slice(lo, hi - lo)
            mine, kind = rows.column("obs_id").to_numpy(zero_copy_only=False), rows.column("obs_id").type
            values = rows.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
            if side[lo] == 0:
                left.append((mine, values))
                continue
            if not left:
                continue
            if x is None:
                ids, x = (np.concatenate(c) for c in zip(*left))
                square, bound, kept = (x * x).sum(1), np.full(len(x), np.inf), ([], [], [])
            for a in range(0, len(mine), AT_ONCE):
                y, names = values[a : a + AT_ONCE], mine[a : a + AT_ONCE]
                other = (y * y).sum(1)
                for s in range(0, len(x), 512):
                    d = np.maximum(square[s : s + 512, None] + other - 2 * x[s : s + 512] @ y.T, 0)
                    # after the first rows few are near enough to matter
                    if np.isinf(bound[s : s + 512]).any():
                        d[ids[s : s + 512, None] == names] = np.inf
                        row, column = nearest_columns(d, names, k)
                    else:
                        row, column = np.nonzero(d <= bound[s : s + 512, None])
                        other_one = ids[s + row] != names[column]
                        row, column = row[other_one], column[other_one]
                    for c, new in zip(kept, (s + row, d[row, column], names[column])):
                        c.append(new)
                best = _best(*map(np.concatenate, kept), k)
                for c, new in zip(kept, best):
                    c[:] = [new]
                full = np.bincount(best[0], minlength=len(x)) == k
                last = np.flatnonzero(np.diff(best[0], append=-1))
                bound[best[0][last]] = best[1][last]
                bound[~full] = np.inf
    yield from found()


def feature_knn(features: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """src, dst, d2, rank of the k nearest rows in feature space (obs_id, features array), exact.

    Rows are dealt into chunks of at most `CHUNK` (smaller ones, of `block_rows`, for few rows); a task has a chunk and streams a slice of all rows past it. So rows are sent
    once for each chunk, and a task sends on k candidates for each row of its chunk, of which the best stay."""
    n, spark = features.count(), features.sparkSession
    chunks = max(1, math.ceil(n / CHUNK), min(8, math.ceil(n / block_rows)))
    slices = max(1, min(math.ceil(n / block_rows), math.ceil(3 * spark.sparkContext.defaultParallelism / chunks)))
    kind = features.schema["obs_id"].dataType.simpleString()
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("o")
    part = lambda seed, m: F.pmod(F.xxhash64("obs_id", F.lit(seed)), F.lit(m))
    row = [F.col("obs_id").alias("obs_id"), F.col("features").cast("array<double>").alias("features")]
    left = features.select(*row, every(slices)).select((part(0, chunks) * slices + F.col("o")).cast("int").alias("cell"), F.lit(0).alias("side"), "obs_id", "features")
    right = features.select(*row, every(chunks)).select((F.col("o") * slices + part(1, slices)).cast("int").alias("cell"), F.lit(1).alias("side"), "obs_id", "features")
    rows = left.unionByName(right).repartitionById(chunks * slices, F.col("cell")).sortWithinPartitions("cell", "side")
    best = rows.mapInArrow(lambda b: _near_rows(b, k), f"src {kind}, dst {kind}, d2 double")
    w = Window.partitionBy("src").orderBy("d2", "dst")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def spatial_filters(a: np.ndarray, b: np.ndarray, pairs: int = 3) -> np.ndarray:
    """Common spatial patterns of two classes of trials (trial, channel, sample): filters that give one class most and the other least power."""
    ca, cb = (np.mean([x @ x.T / np.trace(x @ x.T) for x in t], 0) for t in (a, b))
    w, u = np.linalg.eigh(ca + cb)
    white = (u / np.sqrt(np.maximum(w, 1e-12))).T
    _, v = np.linalg.eigh(white @ ca @ white.T)
    f = v.T @ white
    return np.concatenate([f[:pairs], f[-pairs:]])


def decode(trials: DataFrame, folds: int = 5, pairs: int = 3, seed: int = 0) -> DataFrame:
    """subject, n, accuracy of telling two classes (y 0 or 1) of trials by log power after spatial filters and a linear discriminant. trials has (subject, trial, y, channel, samples array); a subject is one task."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        order = g[["trial", "y"]].drop_duplicates().sort_values("trial")
        x = np.stack([np.array(t.sort_values("channel")["samples"].tolist(), float) for _, t in g.groupby("trial")])
        y = order["y"].to_numpy()
        fold = np.random.default_rng(seed).permutation(len(y)) % folds
        good = 0
        for k in range(folds):
            tr, te = fold != k, fold == k
            if not te.any() or len(set(y[tr])) < 2:
                continue
            w = spatial_filters(x[tr & (y == 0)], x[tr & (y == 1)], min(pairs, x.shape[1] // 2))
            p = np.log(np.maximum(np.einsum("fc,tcs->tfs", w, x).var(2), 1e-12))
            m0, m1 = p[tr & (y == 0)].mean(0), p[tr & (y == 1)].mean(0)
            r = p[tr] - np.where(y[tr][:, None] == 0, m0, m1)
            c = r.T @ r / max(1, len(r) - 2)
            c += 1e-3 * np.trace(c) / len(c) * np.eye(len(c))
            d = np.linalg.solve(c, m1 - m0)
            good += int((((p[te] - (m0 + m1) / 2) @ d > 0) == (y[te] == 1)).sum())
        return pd.DataFrame({"subject": [g["subject"].iloc[0]], "n": [len(y)], "accuracy": [good / len(y)]})

    return trials.groupBy("subject").applyInPandas(f, f"subject {trials.schema['subject'].dataType.simpleString()}, n bigint, accuracy double")


def tangent(series: DataFrame) -> DataFrame:
    """subject, a, b, value: log of each subject's covariance whitened by the mean covariance. Region counts are some hundreds at most, so matrices of all subjects pass through groups of one subject; the mean is a sum."""
    a, b = (series.select("subject", "t", F.col("region").alias(x), F.col("value").alias(f"v{x}")) for x in "ab")
    cov = written(a.join(b, ["subject", "t"]).groupBy("subject", "a", "b").agg(F.covar_samp("va", "vb").alias("c")), "cov")
    mean = cov.groupBy("a", "b").agg(F.avg("c").alias("m")).toPandas().pivot_table(index="a", columns="b", values="m").sort_index()
    names, m = mean.index.to_numpy(), mean.to_numpy()
    w, u = np.linalg.eigh(m + 1e-9 * np.trace(m) / len(m) * np.eye(len(m)))
    white = (u / np.sqrt(np.maximum(w, 1e-12))) @ u.T

    def f(g: pd.DataFrame) -> pd.DataFrame:
        c = g.pivot_table(index="a", columns="b", values="c").reindex(index=names, columns=names).fillna(0.0).to_numpy()
        x, v = np.linalg.eigh(white @ c @ white.T)
        log = (v * np.log(np.maximum(x, 1e-9))) @ v.T
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"subject": g["subject"].iloc[0], "a": names[i], "b": names[j], "value": log[i, j]})

    k = {c: series.schema[c].dataType.simpleString() for c in ("subject", "region")}
    return cov.groupBy("subject").applyInPandas(f, f"subject {k['subject']}, a {k['region']}, b {k['region']}, value double")


def perturb(points: DataFrame, drop: float = 0.1, jitter: float = 10.0, theta: float = 0.1, dx: float = 0.0, dy: float = 0.0, seed: int = 0) -> DataFrame:
    """points with some left out by hash, the rest jittered, turned and shifted; hashes make it the same every time."""
    u = lambda s: (F.pmod(F.xxhash64("obs_id", F.lit(seed), F.lit(s)), F.lit(1_000_003)) + 0.5) / 1_000_003
    r = F.sqrt(-2 * F.ln(u(1))) * jitter
    x, y = F.col("x") + r * F.cos(2 * math.pi * u(2)), F.col("y") + r * F.sin(2 * math.pi * u(2))
    c, s = math.cos(theta), math.sin(theta)
    kept = points.where(u(0) >= drop)
    return kept.withColumn("_x", c * x - s * y + dx).withColumn("y", s * x + c * y + dy).withColumn("x", F.col("_x")).drop("_x")


def confound_free(values: DataFrame, covariate: DataFrame, train) -> DataFrame:
    """obs_id, gene_id, value without what a covariate (obs_id, c) explains; slopes come from rows where `train` holds only."""
    v = values.join(covariate, "obs_id")
    fit = v.where(train).groupBy("gene_id").agg(F.regr_slope("value", "c").alias("b"), F.regr_intercept("value", "c").alias("a"))
    return v.join(fit, "gene_id").select("obs_id", "gene_id", (F.col("value") - F.col("a") - F.col("b") * F.col("c")).alias("value"))


def stage_index(scores: DataFrame, mature: str, early: str) -> DataFrame:
    """obs_id, maturation: the effect of one panel less that of another."""
    pick = lambda p: F.max(F.when(F.col("panel") == p, F.col("effect")))
    return scores.groupBy("obs_id").agg((pick(mature) - pick(early)).alias("maturation"))


def argmax_labels(z: DataFrame, panels: DataFrame) -> DataFrame:
    """obs_id, label of the panel with the largest mean z, without a test."""
    m = z.join(panels, "gene_id").groupBy("obs_id", "panel").agg(F.avg("z").alias("m"))
    return m.groupBy("obs_id").agg(F.min(F.struct((-F.round("m", 9)).alias("m"), "panel")).alias("b")).select("obs_id", F.col("b.panel").alias("label"))


def pair_network(values: DataFrame, pairs: DataFrame, contexts: DataFrame | None, threshold: float, fdr: float) -> DataFrame:
    """gene_a, gene_b, context, rho, padj: rank correlations over all points or within contexts (obs_id, context) of 50 points or more, one family for the false discovery rate, the strongest context of each pair."""
    if contexts is None:
        rho = stats.spearman_pairs(values, pairs).withColumn("context", F.lit("all"))
    else:
        big = contexts.groupBy("context").agg(F.count("*").alias("n")).where("n >= 50").select("context")
        v = values.join(contexts.join(big, "context", "left_semi"), "obs_id")
        r = stats.average_ranks(v, "value", ["context", "gene_id"]).select("obs_id", "context", "gene_id", "rank")
        a, b = (r.select("obs_id", "context", F.col("gene_id").alias(f"gene_{x}"), F.col("rank").alias(f"r{x}")) for x in "ab")
        rho = a.join(pairs, "gene_a").join(b, ["obs_id", "context", "gene_b"]).groupBy("gene_a", "gene_b", "context").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    q = stats.benjamini_hochberg(stats.spearman_p(rho.where("rho is not null")), "p", ["gene_a", "gene_b", "context"])
    q = q.where((F.abs("rho") >= threshold) & (F.col("padj") < fdr))
    w = Window.partitionBy("gene_a", "gene_b").orderBy(F.desc(F.round(F.abs("rho"), 9)), "context")
    return q.withColumn("r", F.row_number().over(w)).where("r = 1").select("gene_a", "gene_b", "context", "rho", "padj")
