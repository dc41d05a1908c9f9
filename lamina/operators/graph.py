"""Neighbour graphs over points in blocks, and what is computed along their edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import dropped, tasks, written


def distance2(a: str, b: str) -> Column:
    """Squared distance of two points that are struct-like prefixes of columns."""
    return sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in ("x", "y", "z"))


#: Fixed value: pairs that a task compares, about.
PAIRS = 2**21


def nearest(sources: DataFrame, targets: DataFrame, k: int, small: int = 1024, same: bool = False) -> DataFrame:
    """The k nearest targets of the same block for each source: block, src, dst, d2, rank; ties go to the smaller id.

    sources has block, src, x, y, z and targets block, dst, x, y, z; with `same` a point is no neighbour of itself. Each source looks in the
    3 x 3 squares of a grid around it. It is done once its k-th neighbour is no farther than a square is wide, as no point outside can
    be nearer, or once the squares hold the whole block; the others look again with squares twice as wide. Joins are on (block, square):
    all pairs of a block are compared only where it has at most `small` targets, which make one square.

    Dense places do not become tasks of their own: of targets in one and the same place only the k + 1 smallest ids can be anyone's
    neighbours, and squares start as small as it takes for the fullest one to hold some 64 k targets at most."""
    place = Window.partitionBy("block", "x", "y", "z").orderBy("dst")
    targets = targets.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r")
    both = sources.select("block", "x", "y", F.lit(0).alias("t")).unionByName(targets.select("block", "x", "y", F.lit(1).alias("t")))
    box = both.groupBy("block").agg(F.sum("t").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    fine = F.greatest(F.col("extent") * F.sqrt(F.lit(2.0 * max(k, 1)) / F.col("n")) / 2, F.col("extent") * 1e-6, F.lit(1e-12))
    width = F.when(F.col("n") <= small, F.col("extent") * 1.01 + 1e-12).otherwise(fine)
    box = written(box.where(F.col("n") > int(same)).select("block", "n", "x0", "y0", "extent", width.alias("w0")), "boxes")
    s, t = written(sources.join(box, "block"), "sources"), written(targets.join(box, "block"), "targets")
    shrink = 1.0
    while shrink > 1e-9:
        w = F.when(F.col("n") > small, F.col("w0") * shrink).otherwise(F.col("w0"))
        full = t.groupBy("block", "n", F.floor((F.col("x") - F.col("x0")) / w).alias("cx"), F.floor((F.col("y") - F.col("y0")) / w).alias("cy")).agg(F.count("*").alias("c"))
        most, met, biggest = full.agg(F.max(F.when(F.col("n") > small, F.col("c"))), F.sum(F.col("c") * F.col("c")) / F.sum("c"), F.max("n")).first()
        if (most or 0) <= max(256, 64 * k):
            break
        shrink /= 2.0 ** max(1, math.ceil(math.log2(math.sqrt(most / (16 * k)))))
    width = F.when(F.col("n") > small, F.col("w0") * shrink).otherwise(F.col("w0"))
    s, t = s.withColumn("w0", width), t.withColumn("w0", width)
    # a point without others in its block has no neighbours
    left, steps = s.agg(F.count("*").alias("c"), F.max(F.col("extent") / F.col("w0")).alias("m")).first()
    last = max(0, math.ceil(math.log2(max(1.0, steps or 1.0)))) + 1
    done: DataFrame | None = None
    for level in range(last + 1):
        w = F.col("w0") * float(2**level)
        cell = lambda c, o: F.floor((F.col(c) - F.col(o)) / w)  # noqa: B023, E731
        todo = s if done is None else s.join(done.select("block", "src").distinct(), ["block", "src"], "left_anti")
        near = t.select("block", "dst", *(F.col(c).alias(f"b{c}") for c in "xyz"), cell("x", "x0").alias("cx"), cell("y", "y0").alias("cy"))
        own = todo.select("block", "src", *(F.col(c).alias(f"a{c}") for c in "xyz"), w.alias("w"), "extent", "n", cell("x", "x0").alias("gx"), cell("y", "y0").alias("gy"))
        own = own.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        own = own.withColumn("cx", F.col("gx") + F.col("dx")).withColumn("cy", F.col("gy") + F.col("dy")).drop("dx", "dy", "gx", "gy")
        # a task's share goes by the pairs it will make, not by the bytes that reach it: a point meets some nine squares' targets, at most its block's
        n = tasks(s.sparkSession, int((left or 0) * min(9.0 * (met or 0) * 4.0**level, biggest or 0)), PAIRS)
        own, near = (d.repartition(n, "block", "cx", "cy") for d in (own, near))
        pairs = own.join(near, ["block", "cx", "cy"]).withColumn("d2", distance2("a", "b"))
        pairs = pairs.where("src <> dst") if same else pairs
        by = Window.partitionBy("block", "src")
        ranked = pairs.withColumn("rank", F.row_number().over(by.orderBy("d2", "dst"))).where(F.col("rank") <= k)
        far = ranked.withColumn("far", F.max("d2").over(by)).withColumn("got", F.count("*").over(by))
        ok = ((F.col("got") == F.least(F.lit(k), F.col("n") - int(same))) & (F.col("far") <= F.col("w") * F.col("w"))) | (F.col("w") > F.col("extent"))
        found = written(far.where(ok).select("block", "src", "dst", "d2", F.col("rank").cast("bigint").alias("rank")), "nearest")
        done = found if done is None else done.unionByName(found)
        left -= found.where("rank = 1").count()
        if left <= 0:
            break
    return done


def knn(points: DataFrame, k: int, z_scale: float = 1.0, small: int = 1024) -> DataFrame:
    """The k nearest other points of the same block: block, src, dst, d2, rank. points has obs_id, block, x, y, z."""
    z = (F.col("z") * z_scale).alias("z")
    return nearest(points.select("block", F.col("obs_id").alias("src"), "x", "y", z), points.select("block", F.col("obs_id").alias("dst"), "x", "y", z), k, small, same=True)


#: Fixed value: points of a part, about.
PART = 8192


def squares(points: DataFrame, size: int) -> DataFrame:
    """node, i, j: points (obs_id, x, y) dealt into squares of about `size` that lie together: strips i by x, cut j by y."""
    p = points.select(F.col("obs_id").alias("node"), "x", "y")
    side = max(1, math.ceil(math.sqrt(p.count() / size)))
    shares = [i / side for i in range(1, side)]
    if not shares:
        return p.select("node", F.lit(0).alias("i"), F.lit(0).alias("j"))
    cut = lambda c: F.percentile_approx(c, F.array(*map(F.lit, shares)), 1000)
    over = lambda c, cuts: F.coalesce(F.size(F.filter(cuts, lambda q: q < F.col(c))), F.lit(0))
    p = p.crossJoin(F.broadcast(p.agg(cut("x").alias("cx")))).select("node", "y", over("x", "cx").alias("i"))
    return p.join(F.broadcast(p.groupBy("i").agg(cut("y").alias("cy"))), "i").select("node", "i", over("y", "cy").alias("j"))


def parts(points: DataFrame, size: int = PART) -> DataFrame:
    """node, part: points (obs_id, x, y) dealt into parts of about `size` that lie together (squares()); places that hold many more are split by hash."""
    p = squares(points, size).select("node", (F.col("i") * 1_000_000 + F.col("j")).cast("bigint").alias("tile"))
    split = p.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(4.0 * size)).alias("n"))
    return p.join(F.broadcast(split), "tile").select("node", (F.col("tile") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("n"))).alias("part"))


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst, w with the larger weight of both directions."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def knn_graph(points: DataFrame, k: int = 6, z_scale: float = 1.0, weight: str = "binary", sections: bool = False) -> DataFrame:
    """A symmetric graph of nearest neighbours. Gaussian weights have the median positive edge length as bandwidth. With sections and z_scale 0, section joins the block."""
    p = points
    if sections and z_scale == 0:
        p = p.withColumn("block", F.concat_ws("\u0001", "block", "section"))
    e = knn(p, k, z_scale)
    if weight == "binary":
        e = e.withColumn("w", F.lit(1.0))
    else:
        e = written(e, "edges")
        band = e.where("d2 > 0").agg(F.expr("percentile(sqrt(d2), 0.5D)").alias("h"))
        e = e.crossJoin(F.broadcast(band)).withColumn("w", F.exp(-F.col("d2") / (2 * F.col("h") * F.col("h"))))
    return symmetric(e)


def section_pairs(points: DataFrame) -> DataFrame:
    """Neighbouring sections of a block, by median z: block, a, b, both ways."""
    s = points.groupBy("block", "section").agg(F.expr("percentile(z, 0.5D)").alias("mz"))
    s = s.withColumn("other", F.lead("section").over(Window.partitionBy("block").orderBy("mz", "section"))).where("other is not null")
    return s.select("block", F.col("section").alias("a"), F.col("other").alias("b")).unionByName(s.select("block", F.col("other").alias("a"), F.col("section").alias("b")))


def cross_section_edges(points: DataFrame, k: int = 3, small: int = 1024) -> DataFrame:
    """block, src, dst, d2 (in the plane), dz, rank: for each spot its k nearest in the next and in the previous section, each pair of sections being a block of its own."""
    pairs = written(section_pairs(points), "sections")
    pair = F.concat_ws("\u0001", "block", "a", "b").alias("block")
    flat = F.lit(0.0).alias("z")
    own = points.withColumnRenamed("section", "a").join(pairs, ["block", "a"]).select(pair, F.col("obs_id").alias("src"), "x", "y", flat)
    other = points.withColumnRenamed("section", "b").join(pairs, ["block", "b"]).select(pair, F.col("obs_id").alias("dst"), "x", "y", flat)
    e = nearest(own, other, k, small).select("src", "dst", "d2", "rank")
    e = e.join(points.select(F.col("obs_id").alias("src"), "block", F.col("z").alias("az")), "src").join(points.select(F.col("obs_id").alias("dst"), F.col("z").alias("bz")), "dst")
    return e.select("block", "src", "dst", "d2", (F.col("az") - F.col("bz")).alias("dz"), "rank")


def cross_section_graph(points: DataFrame, k_within: int = 6, k_between: int = 3, z_scale: float = 1.0) -> DataFrame:
    """The binary graph within sections plus Gaussian edges between neighbouring ones; the spacing is the median over sections of the median distance to the nearest in the plane."""
    flat = points.withColumn("z", F.lit(0.0)).withColumn("block", F.concat_ws("\u0001", "block", "section"))
    near = written(knn(flat, k_within), "edges")
    within = symmetric(near.withColumn("w", F.lit(1.0)))
    spacing = near.where("rank = 1").groupBy("block").agg(F.expr("percentile(sqrt(d2), 0.5D)").alias("m")).agg(F.expr("percentile(m, 0.5D)").alias("h"))
    e = cross_section_edges(points, k_between).crossJoin(F.broadcast(spacing))
    d2 = F.col("d2") + (F.col("dz") * z_scale) ** 2
    e = symmetric(e.withColumn("w", F.exp(-d2 / (F.col("h") * F.col("h")) / 2)))
    return within.unionByName(e).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def neighbourhood_mean(edges: DataFrame, values: DataFrame) -> DataFrame:
    """obs_id, gene_id, value: the weighted mean over neighbours, 0 for points without any. values has (obs_id, gene_id, value) for every point."""
    v = values.select(F.col("obs_id").alias("dst"), "gene_id", F.col("value").alias("v"))
    m = edges.join(v, "dst").groupBy(F.col("src").alias("obs_id"), "gene_id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return values.select("obs_id", "gene_id").join(m, ["obs_id", "gene_id"], "left").select("obs_id", "gene_id", F.coalesce("m", F.lit(0.0)).alias("value"))


def augmented(edges: DataFrame, values: DataFrame, lam: float = 0.5, hops: int = 1) -> DataFrame:
    """obs_id, part (own or around), gene_id, value: own and smoothed features, each by its mean norm, weighted by the roots of 1 - lam and lam."""
    around = values
    for _ in range(hops):
        around = neighbourhood_mean(edges, around)
    out = None
    for part, v, share in (("own", values, 1 - lam), ("around", around, lam)):
        norm = v.groupBy("obs_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n")).agg(F.avg("n").alias("scale"))
        scaled = v.crossJoin(F.broadcast(norm)).select("obs_id", F.lit(part).alias("part"), "gene_id", (F.col("value") / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0) * math.sqrt(share)).alias("value"))
        out = scaled if out is None else out.unionByName(scaled)
    return out


def gcn_layer(edges: DataFrame, values: DataFrame, relu: bool = True) -> DataFrame:
    """One graph convolution with self loops and symmetric normalisation."""
    own = values.select("obs_id").distinct()
    loops = edges.unionByName(own.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"), F.lit(1.0).alias("w")))
    degree = loops.groupBy("src").agg(F.sum("w").alias("d"))
    e = loops.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    e = e.select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    v = values.select(F.col("obs_id").alias("dst"), "gene_id", "value")
    out = e.join(v, "dst").groupBy(F.col("src").alias("obs_id"), "gene_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return out.withColumn("value", F.greatest("value", F.lit(0.0))) if relu else out


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """gene_id, moran: (n / sum w) sum(z_i w_ij z_j) / sum z^2 over dense values."""
    mean = values.groupBy("gene_id").agg(F.avg("value").alias("m"))
    z = values.join(mean, "gene_id").select("obs_id", "gene_id", (F.col("value") - F.col("m")).alias("z"))
    base = z.groupBy("gene_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    total = edges.agg(F.sum("w").alias("sw"))
    around = edges.join(z.select(F.col("obs_id").alias("dst"), "gene_id", F.col("z").alias("zd")), "dst").groupBy("src", "gene_id").agg(F.sum(F.col("w") * F.col("zd")).alias("wz"))
    num = around.join(z.withColumnRenamed("obs_id", "src"), ["src", "gene_id"]).groupBy("gene_id").agg(F.sum(F.col("z") * F.col("wz")).alias("num"))
    out = num.join(base, "gene_id").crossJoin(F.broadcast(total))
    return out.select("gene_id", (F.col("n") / F.col("sw") * F.col("num") / F.when(F.col("zz") > 0, F.col("zz"))).alias("moran"))


def portable_key(item: str, draw: str) -> Column:
    """((item * 7919 + draw * 104729) * (item * 31 + 17)) % 1000003 of two columns of whole numbers, from remainders: the product leaves 64 bits from items of some six million on."""
    i, d = F.col(item).cast("bigint"), F.col(draw).cast("bigint")
    return (((i * 7919 + d * 104729) % 1000003) * ((i * 31 + 17) % 1000003)) % 1000003


def permutation(points: DataFrame, n: int, seed: int = 0, portable: bool = False) -> DataFrame:
    """perm, obs_id, other: n shuffles of the points within their blocks. Portable keys are arithmetic that any SQL engine can follow; the others are hashes."""
    perms = points.sparkSession.range(n).select(F.col("id").alias("perm"))
    p = points.select("obs_id", "block").crossJoin(F.broadcast(perms))
    if portable:
        key = portable_key("obs_id", "perm")
    else:
        key = F.xxhash64("obs_id", "perm", F.lit(seed))
    p = p.withColumn("key", key)
    a = points.select("block", "obs_id", F.row_number().over(Window.partitionBy("block").orderBy("obs_id")).alias("r"))
    b = p.select("perm", "block", F.col("obs_id").alias("other"), F.row_number().over(Window.partitionBy("perm", "block").orderBy("key", "obs_id")).alias("r"))
    return a.join(b, ["block", "r"]).select("perm", "obs_id", "other")


def dense(values: DataFrame, value: str = "value") -> tuple[DataFrame, list]:
    """(obs_id, v: the values of a point in order of gene_id, the gene_ids) of dense values. The names of genes are some ten thousands at most."""
    genes = [r["gene_id"] for r in values.select("gene_id").distinct().orderBy("gene_id").collect()]
    rows = values.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", F.col(value).alias("x")))).alias("r"))
    return rows.select("obs_id", F.col("r.x").alias("v")), genes


#: Fixed value: points whose arrays a task holds for one end of its pairs.
CHUNK = 65_536


def _cell_sums(batches: Iterator[pa.RecordBatch], by: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """Sums of runs of equal `by` over a partition in order of (cell, side, by): the arrays of a cell's left (0) and right (1) ends, then its pairs (2), batch by batch."""
    at, parts, ends = None, {}, {}
    for batch in batches:
        cell, side = (batch.column(c).to_numpy() for c in ("cell", "side"))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
            if hi == lo:
                continue
            if cell[lo] != at:
                at, parts, ends = cell[lo], {0: [], 1: []}, {}
            rows = batch.slice(lo, hi - lo)
            if side[lo] < 2:
                parts[side[lo]].append((rows.column("a").to_numpy(zero_copy_only=False), rows.column("v").flatten().to_numpy().reshape(len(rows), n)))
                continue
            if not (parts[0] and parts[1]) and not ends:
                continue
            if not ends:
                for k in (0, 1):
                    ids, v = (np.concatenate(x) for x in zip(*parts[k]))
                    order = np.argsort(ids, kind="stable")
                    ends[k] = ids[order], v[order]
                parts = {0: [], 1: []}
            ok, found = np.ones(len(rows), bool), []
            for k, c in ((0, "a"), (1, "b")):
                ids, key = ends[k][0], rows.column(c).to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
                ok &= ids[place] == key
                found.append(place)
            if not ok.all():
                rows, found = rows.filter(pa.array(ok)), [x[ok] for x in found]
            if not len(rows):
                continue
            x = ends[0][1][found[0]] * ends[1][1][found[1]] * rows.column("w").to_numpy()[:, None]
            new = np.zeros(len(rows), bool)
            new[0] = True
            for c in by:
                new[1:] |= np.diff(rows.column(c).dictionary_encode("encode").indices.to_numpy()) != 0
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(x, starts)
            s = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * n), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(starts)) for c in by), s], names=[*by, "s"])


def product_sums(pairs: DataFrame, left: DataFrame, right: DataFrame, n: int, by: list[str], at_once: int = 64, chunk: int = CHUNK) -> DataFrame:
    """by, i, s: for each place i of arrays the sum over pairs (by, a, b, w) of w x left[i] x right[i]; left and right have (obs_id, v), null counts as 0.

    Arrays do not go along with pairs: points are dealt into chunks of about `chunk` by hash, a pair goes to the cell of its two chunks, and each chunk once
    to every cell that it is in. A task holds the two chunks of a cell and streams the cell's pairs, at most `at_once` places of the arrays at a time."""
    spark = pairs.sparkSession
    k = max(1, math.ceil(max(left.count(), right.count()) / chunk))
    # few chunks make few cells: each is then cut into slices
    slices = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / (k * k)))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(k))
    cell = lambda i, j, part: ((i * k + j) * slices + part).alias("cell")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = pairs.where("a is not null and b is not null and w is not null").select(
        cell(dealt("a"), dealt("b"), F.pmod(F.xxhash64("a", "b"), F.lit(slices))), F.lit(2).alias("side"), *by, "a", "b", F.col("w").cast("double").alias("w")
    )
    kinds = {f.name: f.dataType for f in own.schema.fields}
    out = None
    for start in range(0, n, at_once):
        size = min(at_once, n - start)
        values = F.transform(F.slice("v", start + 1, size), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v")

        def ends(d: DataFrame, side: int) -> DataFrame:
            d = d.where("obs_id is not null").select("obs_id", values, every(k).alias("o")).select("*", every(slices).alias("part"))  # noqa: B023
            at = (dealt("obs_id"), F.col("o")) if side == 0 else (F.col("o"), dealt("obs_id"))
            null = (F.lit("" if kinds[c].typeName() == "string" else None).cast(kinds[c]).alias(c) for c in by)
            return d.select(cell(*at, F.col("part")), F.lit(side).alias("side"), *null, F.col("obs_id").cast(kinds["a"]).alias("a"), F.lit(None).cast(kinds["b"]).alias("b"), F.lit(None).cast("double").alias("w"), "v")

        # empty, not null: Arrow's writer goes over a batch's nulls in lists and texts again for every row
        rows = own.withColumn("v", F.array().cast("array<double>")).unionByName(ends(left, 0)).unionByName(ends(right, 1))
        rows = rows.repartitionById(k * k * slices, F.col("cell").cast("int")).sortWithinPartitions("cell", "side", *by, "a")
        sums = rows.mapInArrow(lambda b, m=size: _cell_sums(b, by, m), own.select(*by, F.array(F.lit(0.0)).alias("s")).schema)
        sums = sums.select(*by, F.posexplode("s").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("s")).withColumn("i", F.col("i") + start)
        out = sums if out is None else out.unionByName(sums)
    return out


def shuffled_pairs(edges: DataFrame, perm: DataFrame, both: bool, keep: list[str]) -> DataFrame:
    """keep, perm, a, b, w: edges as they are (perm -1) and between the points that each shuffle puts at their ends (`both`), or at dst only.

    Each point's partners go along as one array, so edges are shuffled by src and dst once and not for every permutation."""
    partners = perm.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("perm", "other"))).alias("p")).select("obs_id", F.col("p.other").alias("p"))
    e = edges.join(partners.select(F.col("obs_id").alias("dst"), F.concat(F.array("obs_id"), "p").alias("pb")), "dst")
    if both:
        e = e.join(partners.select(F.col("obs_id").alias("src"), F.concat(F.array("obs_id"), "p").alias("pa")), "src")
        e = e.select(*keep, "w", F.posexplode(F.arrays_zip("pa", "pb")).alias("perm", "z")).select(*keep, "perm", F.col("z.pa").alias("a"), F.col("z.pb").alias("b"), "w")
    else:
        e = e.select(*keep, "w", F.col("src").alias("a"), F.posexplode("pb").alias("perm", "b"))
    return e.withColumn("perm", F.col("perm") - 1)


def spatially_variable(points: DataFrame, edges: DataFrame, values: DataFrame, n_perm: int, seed: int = 0, portable: bool = False) -> DataFrame:
    """gene_id, moran, p, padj: Moran's I against shuffles within blocks, p = (1 + as large) / (n + 1), then Benjamini-Hochberg.

    All shuffles go through one job with a row for each edge and shuffle, both directions of an edge in one; see product_sums."""
    from lamina.operators.stats import benjamini_hochberg

    edges = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    edges = written(edges, "edges")
    mean = values.groupBy("gene_id").agg(F.avg("value").alias("m"))
    z, genes = dense(values.join(mean, "gene_id").select("obs_id", "gene_id", (F.col("value") - F.col("m")).alias("value")))
    z = written(z, "dense")
    base = z.select(F.posexplode("v").alias("i", "z")).groupBy("i").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    total = edges.agg(F.sum("w").alias("sw"))
    pairs = shuffled_pairs(edges, permutation(points, n_perm, seed, portable), True, [])
    sums = written(product_sums(pairs, z, z, len(genes), ["perm"]), "sums").join(base, "i").crossJoin(F.broadcast(total))
    sums = sums.select("perm", "i", (F.col("n") / F.col("sw") * F.col("s") / F.when(F.col("zz") > 0, F.col("zz"))).alias("m"))
    real = sums.where("perm = -1").select("i", F.col("m").alias("moran"))
    # twice the rounding of these sums counts as a tie
    p = sums.where("perm >= 0").join(real, "i").groupBy("i").agg(F.first("moran").alias("moran"), ((1 + F.count_if(F.col("m") >= F.col("moran") - 1e-12)) / F.lit(n_perm + 1.0)).alias("p"))
    names = values.sparkSession.createDataFrame(list(enumerate(genes)), f"i int, gene_id {values.schema['gene_id'].dataType.simpleString()}")
    return benjamini_hochberg(p.join(names, "i").drop("i"), "p", ["gene_id"]).select("gene_id", "moran", "p", "padj")


def niche_composition(edges: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """obs_id, label, share: the share of each label among a point's k directed neighbours."""
    return edges.join(labels.select(F.col("obs_id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("obs_id"), "label").agg((F.count("*") / F.lit(float(k))).alias("share"))


def refine_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """obs_id, label: a label held by fewer than half of the neighbours gives way to their most frequent one (ties: the smallest), all at once."""
    c = edges.join(labels.select(F.col("obs_id").alias("dst"), F.col("label").alias("other")), "dst").groupBy("src", "other").agg(F.count("*").alias("n"))
    c = c.join(labels.select(F.col("obs_id").alias("src"), F.col("label").alias("own")), "src")
    best = c.groupBy("src").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("other") == F.col("own"), F.col("n"))), F.lit(0)).alias("same"), F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("top"))
    out = labels.join(best.withColumnRenamed("src", "obs_id"), "obs_id", "left")
    return out.select("obs_id", F.when(F.col("same") * 2 < F.col("all"), F.col("top.other")).otherwise(F.col("label")).alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph src, dst.

    In each round a node joins the one of least hash among itself and its neighbours, and edges go between what has joined; half or more of the nodes
    that have edges vanish in a round on average, so all rounds together cost little more than the first. Names are then followed back."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null")
    both = written(both.distinct(), "links")
    nodes = both.select(F.col("src").alias("node")).distinct()
    left, maps = both.where("src <> dst"), []
    while not left.isEmpty():
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        to = left.groupBy("src").agg(F.min(key("dst")).alias("k")).select(F.col("src").alias("node"), F.least("k", key("src"))["to"].alias("to"))
        maps.append(written(to, "joined"))
        at = lambda c, name: maps[-1].select(F.col("node").alias(c), F.col("to").alias(name))
        new = written(left.join(at("src", "a"), "src").join(at("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links")
        if len(maps) > 1:
            dropped(left)
        left = new
    root = None
    for m in reversed(maps):
        up = m if root is None else m.join(root.select(F.col("node").alias("to"), F.col("root").alias("up")), "to", "left").select("node", F.coalesce("up", "to").alias("to"))
        root = written(up.select("node", F.col("to").alias("root")), "roots")
    every = nodes.withColumn("root", F.col("node")) if root is None else nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    every = written(every, "roots")
    dropped(both, *maps)
    least = every.groupBy("root").agg(F.min("node").alias("component"))
    return every.join(least, "root").select("node", "component")


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, clustering of an undirected graph: triangles by joining ordered edges, so each is met once."""
    u = edges.where("src < dst").select("src", "dst").distinct()
    degree = u.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # edges run from the end of smaller degree, so a hub has few of its own
    at = lambda c: F.struct(F.col(f"d{c}").alias("d"), F.col(c).alias("n"))
    o = u.join(degree.select(F.col("node").alias("src"), F.col("degree").alias("dsrc")), "src").join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("ddst")), "dst")
    o = o.select(F.least(at("src"), at("dst")).alias("x"), F.greatest(at("src"), at("dst")).alias("y")).select(F.col("x.n").alias("x"), F.col("y.n").alias("y"))
    ab, bc, ac = (o.toDF(*names) for names in (("a", "b"), ("b", "c"), ("a", "c")))
    t = ab.join(bc, "b").join(ac, ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    out = degree.join(t, "node", "left")
    return out.select("node", "degree", F.when(F.col("degree") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))
