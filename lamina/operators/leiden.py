"""Communities by local moves with a refinement inside each before nodes are merged, so that none is disconnected.

Many nodes move at once, so a round may lower modularity although every single move would raise it. A round is taken only if it raises
modularity; else half as many nodes, by hash, try again, down to the one with the largest gain, which always raises it. So every level ends
by itself: with a partition in which no node gains by moving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import dropped, written

from . import graph

#: Gains below this are rounding.
LEAST = 1e-9


def both_ways(edges: DataFrame) -> DataFrame:
    """x, y, w of an undirected graph (a, b, w): every edge from both ends, a loop once with twice its weight."""
    e = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "w"))
    return e.groupBy("x", "y").agg(F.sum("w").alias("w"))


def modularity(e: DataFrame, lab: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (node, module) on edges from both ends."""
    own = e.join(lab.select(F.col("node").alias("x"), F.col("module").alias("mx")), "x").join(lab.select(F.col("node").alias("y"), F.col("module").alias("my")), "y")
    m = own.groupBy("mx").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("mx") == F.col("my"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = m.agg(F.sum("inside").alias("i"), F.sum("tot").alias("m2"), F.sum(F.col("tot") * F.col("tot")).alias("q")).first()
    return (r["i"] - resolution * r["q"] / r["m2"]) / r["m2"] if r["m2"] else 0.0


def settled(e: DataFrame, lab: DataFrame, resolution: float, homes: DataFrame | None = None) -> DataFrame:
    """Labels after moves between neighbouring modules, until none raises modularity. With homes (node, home) only inside a home."""
    degree = written(e.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")), "degree")
    m2 = degree.agg(F.sum("k")).first()[0] or 1.0
    near = e.where("x <> y")
    if homes is not None:
        near = near.join(homes.select(F.col("node").alias("x"), F.col("home").alias("hx")), "x").join(homes.select(F.col("node").alias("y"), F.col("home").alias("hy")), "y").where("hx = hy").select("x", "y", "w")
    near = written(near.select("x", "y", "w"), "near")
    lab, now, share, r = written(lab, "module"), None, 1.0, 0
    while True:
        if now is None:
            now = modularity(e, lab, resolution)
        total = lab.join(degree, "node").groupBy("module").agg(F.sum("k").alias("tot"))
        around = near.join(lab.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node"), "module").agg(F.sum("w").alias("w"))
        around = around.unionByName(lab.select("node", "module", F.lit(0.0).alias("w"))).groupBy("node", "module").agg(F.sum("w").alias("w"))
        j = around.join(degree, "node").join(lab.withColumnRenamed("module", "own"), "node").join(total, "module")
        same = F.col("module") == F.col("own")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(same, F.col("k")).otherwise(0.0)) / m2, 9)
        best = j.groupBy("node").agg(F.max(F.when(same, gain)).alias("stay"), F.min(F.struct((-gain).alias("g"), (~same).alias("o"), F.col("module").alias("to"))).alias("b"))
        wish = written(best.select("node", F.col("b.to").alias("to"), (-F.col("b.g") - F.col("stay")).alias("gain")).where(F.col("gain") > LEAST), "wish")
        count = wish.count()
        if not count:
            dropped(wish, near, degree)
            return lab
        while True:
            if share * count < 1:
                movers = wish.orderBy(F.desc("gain"), "node").limit(1)
            else:
                movers = wish.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(1 << 20)) < int(share * (1 << 20)))
            new = written(lab.join(movers.select("node", "to"), "node", "left").select("node", F.coalesce("to", "module").alias("module")), "module")
            got, r = modularity(e, new, resolution), r + 1
            if got > now + 1e-13 or share * count < 1:
                break
            dropped(new)
            share /= 2
        dropped(lab, wish)
        lab, now, share = new, got, min(1.0, share * 2)


def connected(e: DataFrame, lab: DataFrame) -> DataFrame:
    """Labels (node, module) with every module split into its connected parts, each named by its smallest node."""
    inner = e.join(lab.select(F.col("node").alias("x"), F.col("module").alias("mx")), "x").join(lab.select(F.col("node").alias("y"), F.col("module").alias("my")), "y").where("mx = my")
    parts = graph.components(inner.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    return lab.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("module"))


def leiden(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, module: communities of an undirected graph (a, b, w), each connected and named by its smallest node.

    At each level nodes move until none gains; inside each community, nodes that start alone move again, and what they form, split into connected
    parts, are the nodes of the next level, which start in the community that they came from. It ends at a level that merges nothing."""
    e = written(both_ways(edges), "level")
    first = e
    nodes = e.select(F.col("x").alias("node")).distinct()
    lab = written(nodes.select("node", F.col("node").alias("module")), "module")
    member = written(nodes.select("node", F.col("node").alias("at")), "member")
    while True:
        community = settled(e, lab, resolution)
        homes = community.withColumnRenamed("module", "home")
        alone = community.select("node", F.col("node").alias("module"))
        fine = written(connected(e, settled(e, alone, resolution, homes)), "fine")
        size, parts = fine.count(), fine.select("module").distinct().count()
        if parts == size:
            out = member.join(community.select(F.col("node").alias("at"), "module"), "at").select("node", "module")
            out = written(connected(first, out), "communities")
            dropped(member, community, fine, first, *([e] if e is not first else []))
            return out
        up = fine.select(F.col("node").alias("at"), F.col("module").alias("into"))
        new_member = written(member.join(up, "at").select("node", F.col("into").alias("at")), "member")
        end = lambda c: fine.select(F.col("node").alias(c), F.col("module").alias(f"m{c}"))
        coarse = written(e.join(end("x"), "x").join(end("y"), "y").groupBy(F.col("mx").alias("x"), F.col("my").alias("y")).agg(F.sum("w").alias("w")), "level")
        lab = written(fine.join(community.withColumnRenamed("module", "home"), "node").groupBy(F.col("module").alias("node")).agg(F.min("home").alias("module")), "module")
        dropped(member, community, fine, *([e] if e is not first else []))
        member, e = new_member, coarse
