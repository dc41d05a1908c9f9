"""Neuron trees as rows (neuron, id, type, x, y, z, parent; -1 for a root)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import dropped, written


def _length():
    return F.sqrt(sum((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"))


def segments(tree: DataFrame) -> DataFrame:
    """neuron, id, parent, type, length, and both ends, of each node with a parent."""
    up = tree.select("neuron", F.col("id").alias("parent"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    return tree.join(up, ["neuron", "parent"]).select("neuron", "id", "parent", "type", "x", "y", "z", "px", "py", "pz", _length().alias("length"))


def soma(tree: DataFrame) -> DataFrame:
    """neuron, sx, sy, sz: the mean of soma nodes (type 1), else of roots."""
    some = F.count_if(F.col("type") == 1) > 0
    pick = lambda c: F.when(some, F.avg(F.when(F.col("type") == 1, F.col(c)))).otherwise(F.avg(F.when(F.col("parent") == -1, F.col(c))))
    return tree.groupBy("neuron").agg(*(pick(c).alias(f"s{c}") for c in "xyz"))


def morphometrics(tree: DataFrame) -> DataFrame:
    """neuron, n_nodes, total_length (without soma segments), n_branch, n_tips, n_stems, max_radius."""
    kids = tree.where("parent <> -1").groupBy("neuron", F.col("parent").alias("id")).agg(F.count("*").alias("k"))
    t = tree.join(kids, ["neuron", "id"], "left").join(soma(tree), "neuron")
    up = tree.select("neuron", F.col("id").alias("parent"), F.col("type").alias("ptype"))
    t = t.join(up, ["neuron", "parent"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    r = F.sqrt(sum((F.col(c) - F.col(f"s{c}")) ** 2 for c in "xyz"))
    own = F.col("type") != 1
    g = t.groupBy("neuron").agg(
        F.count("*").alias("n_nodes"), F.count_if(own & (F.col("k") >= 2)).alias("n_branch"), F.count_if(own & (F.col("k") == 0)).alias("n_tips"),
        F.count_if(own & (F.col("ptype") == 1)).alias("n_stems"), F.max(F.when(own, r)).alias("max_radius"),
    )
    length = segments(tree).where("type <> 1").groupBy("neuron").agg(F.sum("length").alias("total_length"))
    return g.join(length, "neuron", "left").select("neuron", "n_nodes", F.coalesce("total_length", F.lit(0.0)).alias("total_length"), "n_branch", "n_tips", "n_stems", "max_radius")


def path_lengths(tree: DataFrame) -> DataFrame:
    """neuron, id, dist, depth along the tree from the root; soma segments have no length. Each round doubles the reach, so a chain of n nodes takes log2 n joins."""
    s = segments(tree).select("neuron", "id", F.when(F.col("type") == 1, 0.0).otherwise(F.col("length")).alias("d"))
    t = tree.join(s, ["neuron", "id"], "left").select("neuron", "id", F.col("parent").alias("up"), F.coalesce("d", F.lit(0.0)).alias("dist"), F.when(F.col("parent") == -1, 0).otherwise(1).cast("bigint").alias("depth"))
    known = tree.select("neuron", F.col("id").alias("up"), F.lit(True).alias("has"))
    t = written(t.join(known, ["neuron", "up"], "left").select("neuron", "id", F.when(F.col("has"), F.col("up")).otherwise(-1).alias("up"), "dist", "depth"), "paths")
    while not t.where("up <> -1").isEmpty():
        a = t.select("neuron", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("depth").alias("n2"))
        last = t
        t = written(last.join(a, ["neuron", "up"], "left").select("neuron", "id", F.coalesce("up2", F.lit(-1).cast("bigint")).alias("up"), (F.col("dist") + F.coalesce("d2", F.lit(0.0))).alias("dist"), (F.col("depth") + F.coalesce("n2", F.lit(0).cast("bigint"))).alias("depth")), "paths")
        dropped(last)
    return t.select("neuron", "id", "dist", "depth")


def sholl(tree: DataFrame, step: float, max_radius: float, types: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """neuron, radius, n: segments whose nearer end is inside a sphere and whose farther end is on it or outside, 0 included."""
    s = segments(tree).where(F.col("type").isin(*types)).join(soma(tree), "neuron")
    r = lambda p: F.sqrt(sum((F.col(f"{p}{c}") - F.col(f"s{c}")) ** 2 for c in "xyz"))
    s = s.select("neuron", r("").alias("a"), r("p").alias("b")).select("neuron", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    top = int(max_radius / step)
    k = F.sequence(F.greatest(F.lit(1), F.floor(F.col("lo") / step) + 1).cast("bigint"), F.least(F.lit(top), F.floor(F.col("hi") / step)).cast("bigint"))
    hit = s.where(F.floor(F.col("lo") / step) + 1 <= F.least(F.lit(top), F.floor(F.col("hi") / step))).select("neuron", F.explode(k).alias("k")).groupBy("neuron", "k").agg(F.count("*").alias("c"))
    grid = tree.select("neuron").distinct().select("neuron", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(top).cast("bigint"))).alias("k"))
    return grid.join(hit, ["neuron", "k"], "left").select("neuron", (F.col("k") * F.lit(step)).alias("radius"), F.coalesce("c", F.lit(0)).cast("bigint").alias("n"))
