"""Connectomes and other networks: correlations, thresholds, hop distances, modules."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import dropped, written


def correlations(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, a, b, n, r for regions a < b over the times that both have."""
    by = by or []
    a, b = (series.select(*by, "t", F.col("region").alias(s), F.col("value").alias(f"v{s}")) for s in "ab")
    return a.join(b, [*by, "t"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.corr("va", "vb").alias("r"))


def partial_correlations(series: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """subject, a, b, r from the inverse covariance of each subject's regions (one subject is one group)."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot_table(index="t", columns="region", values="value").dropna()
        c = np.cov(m.to_numpy().T)
        p = np.linalg.inv(c + ridge * np.trace(c) / len(c) * np.eye(len(c)))
        d = np.sqrt(np.diag(p))
        r = -p / d[:, None] / d[None, :]
        i, j = np.triu_indices(len(c), 1)
        return pd.DataFrame({"subject": g["subject"].iloc[0], "a": m.columns.to_numpy()[i], "b": m.columns.to_numpy()[j], "r": r[i, j]})

    kinds = {c: series.schema[c].dataType.simpleString() for c in ("subject", "region")}
    return series.groupBy("subject").applyInPandas(f, f"subject {kinds['subject']}, a {kinds['region']}, b {kinds['region']}, r double")


def threshold(edges: DataFrame, density: float) -> DataFrame:
    """a, b, w of the strongest edges: |w| at or above the quantile 1 - density."""
    cut = edges.agg(F.expr(f"percentile(abs(w), {1 - density}D)").alias("cut"))
    return edges.crossJoin(F.broadcast(cut)).where(F.abs("w") >= F.col("cut")).select("a", "b", "w")


def _rings(edges: DataFrame, by: list[str]) -> list[DataFrame]:
    """Written tables (by, src, dst) of the ordered pairs that are 1, 2, ... steps apart. A neighbour of a ring lies in the ring before, in it or in the next, so only two rings are looked at."""
    e = written(edges.select(*by, F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(*by, F.col("b").alias("x"), F.col("a").alias("y"))).where("x <> y").distinct(), "hops")
    rings = [written(e.select(*by, F.col("x").alias("src"), F.col("y").alias("dst")), "ring")]
    while not rings[-1].isEmpty():
        step = rings[-1].join(e.withColumnRenamed("x", "dst"), [*by, "dst"]).select(*by, "src", F.col("y").alias("dst")).where("src <> dst").distinct()
        for known in rings[-2:]:
            step = step.join(known, [*by, "src", "dst"], "left_anti")
        rings.append(written(step, "ring"))
    dropped(e, rings.pop())
    return rings


def hop_distances(edges: DataFrame) -> DataFrame:
    """src, dst, hops of all connected ordered pairs, one ring of neighbours after the other. edges is undirected (a, b)."""
    out = edges.sparkSession.createDataFrame([], f"src {edges.schema['a'].dataType.simpleString()}, dst {edges.schema['a'].dataType.simpleString()}, hops bigint")
    for k, ring in enumerate(_rings(edges, []), 1):
        out = out.unionByName(ring.withColumn("hops", F.lit(k).cast("bigint")))
    return out


def _closeness(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, total: the sum of 1 / hops over ordered pairs; pairs are counted ring by ring and deleted."""
    rings = _rings(edges, by)
    parts = [ring.groupBy(*by).agg((F.count("*") / F.lit(float(k))).alias("total")) for k, ring in enumerate(rings, 1)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = written(out.groupBy(*by).agg(F.sum("total").alias("total")), "closeness")
    dropped(*rings)
    return out


def global_efficiency(edges: DataFrame, n_nodes: int) -> DataFrame:
    """efficiency: the mean of 1 / hops over all ordered pairs, 0 where there is no way."""
    if edges.isEmpty():
        return edges.sparkSession.createDataFrame([(0.0,)], "efficiency double")
    return _closeness(edges, []).agg((F.coalesce(F.sum("total"), F.lit(0.0)) / F.lit(float(n_nodes * (n_nodes - 1)))).alias("efficiency"))


def modularity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """modularity of a partition (node, module) of an undirected weighted graph (a, b, w)."""
    m = edges.agg(F.sum("w").alias("m"))
    ends = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    deg = ends.join(modules, "node").groupBy("module").agg(F.sum("w").alias("d"))
    ma, mb = (modules.select(F.col("node").alias(s), F.col("module").alias(f"m{s}")) for s in "ab")
    within = edges.join(ma, "a").join(mb, "b").where("ma = mb").groupBy(F.col("ma").alias("module")).agg(F.sum("w").alias("l"))
    j = deg.join(within, "module", "left").crossJoin(F.broadcast(m))
    return j.agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))


def label_communities(edges: DataFrame) -> DataFrame:
    """node, module by label propagation: the heaviest label around a node, ties to its own and then to the smallest.

    Half the nodes, another half by hash in each round, may move; it ends when no node would."""
    e = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "w")), "modules")
    lab = written(e.select(F.col("x").alias("node"), F.col("x").alias("module")).distinct(), "modules")
    r = 0
    while True:
        votes = e.join(lab.withColumnRenamed("node", "y"), "y").groupBy("x", "module").agg(F.sum("w").alias("w"))
        votes = votes.join(lab.select(F.col("node").alias("x"), F.col("module").alias("own")), "x")
        best = votes.groupBy("x").agg(F.min(F.struct((-F.round("w", 9)).alias("m"), (F.col("module") != F.col("own")).alias("o"), "module")).alias("b")).select(F.col("x").alias("node"), F.col("b.module").alias("new"))
        moves = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        new = written(lab.join(best, "node").select("node", (F.col("new") != F.col("module")).alias("wants"), F.when(moves, F.col("new")).otherwise(F.col("module")).alias("module")), "modules")
        dropped(lab)
        lab, r = new.select("node", "module"), r + 1
        lab._lamina_path = new._lamina_path
        if new.where("wants").isEmpty():
            dropped(e)
            return lab


def louvain(edges: DataFrame, resolutions: list[float], rounds: int = 40) -> DataFrame:
    """resolution, node, module: communities by moves that raise modularity, for all resolutions at once.

    In a round half the nodes (another half by hash each time) may move to the neighbouring module of the largest gain, ties to the smallest; a level ends when
    no node would move; from round `rounds` on nodes move to modules of smaller names only, so moves cannot go in circles. Then modules become nodes, until a level joins nothing. edges is undirected (a, b, w)."""
    spark = edges.sparkSession
    res = spark.createDataFrame([(float(x),) for x in resolutions], "resolution double")
    key = ["resolution"]
    both = edges.select("a", "b", "w").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = both.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("w"))
    e = written(both.crossJoin(F.broadcast(res)), "louvain")
    mass = e.groupBy(*key).agg(F.sum("w").alias("m2"))
    member = written(e.select(*key, F.col("x").alias("node"), F.col("x").alias("module")).distinct(), "member")
    while True:
        degree = written(e.groupBy(*key, F.col("x").alias("node")).agg(F.sum("w").alias("k")).join(mass, key), "degree")
        lab = written(degree.select(*key, "node", F.col("node").alias("module")), "module")
        for r in itertools.count():
            total = lab.join(degree, [*key, "node"]).groupBy(*key, "module").agg(F.sum("k").alias("tot"))
            around = e.where("x <> y").join(lab.withColumnRenamed("node", "y"), [*key, "y"]).groupBy(*key, F.col("x").alias("node"), "module").agg(F.sum("w").alias("w"))
            around = around.unionByName(lab.select(*key, "node", "module", F.lit(0.0).alias("w"))).groupBy(*key, "node", "module").agg(F.sum("w").alias("w"))
            j = around.join(degree, [*key, "node"]).join(lab.withColumnRenamed("module", "own"), [*key, "node"]).join(total, [*key, "module"])
            own = F.col("module") == F.col("own")
            gain = F.col("w") - F.col("resolution") * F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / F.col("m2")
            j = j.select(*key, "node", "module", own.alias("own"), F.round(gain, 9).alias("gain"))
            best = j.groupBy(*key, "node").agg(F.min(F.struct((-F.col("gain")).alias("g"), (~F.col("own")).alias("o"), "module")).alias("b"))
            moves = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
            wants = F.col("b.module") != F.col("module") if r < rounds else F.col("b.module") < F.col("module")
            new = best.join(lab, [*key, "node"]).select(*key, "node", wants.alias("wants"), F.when(moves & wants, F.col("b.module")).otherwise(F.col("module")).alias("module"))
            new = written(new, "module")
            dropped(lab)
            lab = new.select(*key, "node", "module")
            lab._lamina_path = new._lamina_path
            if new.where("wants").isEmpty():
                break
        moved = not lab.where("node <> module").isEmpty()
        to = lab.select(*key, F.col("node").alias("module"), F.col("module").alias("into"))
        joined = written(member.join(to, [*key, "module"]).select(*key, "node", F.col("into").alias("module")), "member")
        up = lambda end: lab.select(*key, F.col("node").alias(end), F.col("module").alias(f"m{end}"))
        coarse = written(e.join(up("x"), [*key, "x"]).join(up("y"), [*key, "y"]).groupBy(*key, F.col("mx").alias("x"), F.col("my").alias("y")).agg(F.sum("w").alias("w")), "louvain")
        mass = coarse.groupBy(*key).agg(F.sum("w").alias("m2"))
        dropped(member, e, degree, lab)
        member, e = joined, coarse
        if not moved:
            dropped(e)
            return member


def modules_by_count(edges: DataFrame, k: int, low: float = 0.01, high: float = 3.0, steps: int = 30) -> DataFrame:
    """node, module: the communities at the least of `steps` resolutions (rising by one factor) that gives k of them, else the nearest count."""
    every = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
    found = louvain(edges, every)
    counts = found.groupBy("resolution").agg(F.countDistinct("module").alias("n"))
    best = counts.orderBy(F.abs(F.col("n") - k), "resolution").limit(1).select("resolution")
    return found.join(F.broadcast(best), "resolution", "left_semi").select("node", "module")


def hub_removal(edges: DataFrame, top: int) -> DataFrame:
    """node, degree, efficiency_drop of removing each of the `top` nodes of highest degree, ties to the smaller id.

    The network without each of them, and as it is, go through one search from all nodes, a ring of neighbours at a time."""
    e = written(edges.select("a", "b").distinct(), "edges")
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    n = degree.count()
    hubs = written(degree.orderBy(F.desc("degree"), "node").limit(top), "hubs")
    cases = hubs.select(F.col("node").alias("gone")).unionByName(e.sparkSession.range(1).select(F.lit(None).cast(edges.schema["a"].dataType).alias("gone")))
    without = cases.join(e, F.col("gone").isNull() | ((F.col("gone") != F.col("a")) & (F.col("gone") != F.col("b"))))
    # a null would not join
    total = _closeness(without.withColumn("case", F.coalesce(F.col("gone").cast("string"), F.lit(""))).select("case", "a", "b"), ["case"])
    scale = float(max(1, n * (n - 1)))
    whole = total.where("case = ''").select(F.col("total").alias("full"))
    out = hubs.join(total.select("case", "total"), F.col("node").cast("string") == F.col("case"), "left").crossJoin(F.broadcast(whole))
    return out.select("node", "degree", ((F.col("full") - F.coalesce("total", F.lit(0.0))) / scale).alias("efficiency_drop"))
