"""Replicate-aware statistics: pseudobulk, paired and Welch tests, ranks, rank tests, false discovery rates, agreement measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.distributions import p_normal, p_t
from lamina.session import written


def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], by: list[str] | None = None, out: str = "padj") -> DataFrame:
    """Adds q values within `by`; null and NaN p stay null and do not count. `ties` makes the order unique."""
    by = by or []
    ok = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    up = Window.partitionBy(*by).orderBy(p, *ties)
    ranked = ok.withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_r", "_n")
    return ranked.unionByName(df.where(F.col(p).isNull() | F.isnan(p)).withColumn(out, F.lit(None).cast("double")))


def pseudobulk(counts: DataFrame, meta: DataFrame, min_cells: int = 10) -> DataFrame:
    """unit, grp, gene_id, total, n_cells: sums over the cells of each unit and group with at least min_cells cells. Units are samples or donors: a table of them fits a task."""
    cells = meta.groupBy("unit", "grp").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    sums = counts.join(meta.select("obs_id", "unit", "grp"), "obs_id").groupBy("unit", "grp", "gene_id").agg(F.sum("count").alias("total"))
    return sums.join(F.broadcast(cells), ["unit", "grp"])


def log_cpm(bulk: DataFrame) -> DataFrame:
    """Adds logcpm = ln(1 + total / library x 1e6). Libraries are partial sums: no task has all genes of a unit."""
    bulk = written(bulk, "bulk")
    library = bulk.groupBy(F.col("unit").alias("_unit"), F.col("grp").alias("_grp")).agg(F.sum("total").alias("_library"))
    j = bulk.join(F.broadcast(library), F.col("unit").eqNullSafe(F.col("_unit")) & F.col("grp").eqNullSafe(F.col("_grp")))
    return j.select(*bulk.columns, F.log1p(F.col("total") / F.when(F.col("_library") > 0, F.col("_library")).otherwise(1.0) * 1e6).alias("logcpm"))


def dense_units(bulk: DataFrame, a: str, b: str) -> DataFrame:
    """unit, gene_id, va, vb: log-CPM of two groups for every unit and gene, 0 where a gene was not seen in a unit that has the group.

    A gene is one row with its values by unit, from which its rows for all units are made where it is: no table of units x genes is joined or shuffled."""
    bulk = bulk.where(F.col("grp").isin(a, b))
    has = lambda g, out: F.max(F.col("grp") == g).alias(out)
    units = bulk.groupBy("unit").agg(has(a, "a"), has(b, "b")).where("unit is not null").agg(F.collect_list(F.struct("unit", "a", "b")).alias("units"))
    mine = lambda g, out: F.map_from_entries(F.collect_list(F.when((F.col("grp") == g) & F.col("unit").isNotNull() & F.col("gene_id").isNotNull(), F.struct("unit", "logcpm")))).alias(out)
    genes = bulk.groupBy("gene_id").agg(mine(a, "ma"), mine(b, "mb"))
    rows = genes.crossJoin(F.broadcast(units)).select("gene_id", "ma", "mb", F.explode("units").alias("u"))
    v = lambda m, has: F.when(F.col(has), F.coalesce(F.col(m)[F.col("u.unit")], F.lit(0.0)))
    return rows.select("u.unit", "gene_id", v("ma", "u.a").alias("va"), v("mb", "u.b").alias("vb"))


def paired_t(units: DataFrame) -> DataFrame:
    """gene_id, n, log2fc, t: paired over the units that have both groups; t is null with fewer than two of them or no spread."""
    d = units.where("va is not null and vb is not null").withColumn("d", F.col("va") - F.col("vb"))
    g = d.groupBy("gene_id").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.when((F.col("n") >= 2) & (F.col("s") > 1e-12), F.col("m") / (F.col("s") / F.sqrt("n")))
    return g.select("gene_id", "n", (F.col("m") / math.log(2)).alias("log2fc"), t.alias("t"))


def welch_t(units: DataFrame) -> DataFrame:
    """gene_id, na, nb, log2fc, t, df: unequal variances, null with fewer than two units on either side."""
    g = units.groupBy("gene_id").agg(*(f(f"v{s}").alias(f"{n}{s}") for s in "ab" for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    qa, qb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2) & (qa + qb > 1e-20)
    t = F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(qa + qb))
    df = F.when(ok, (qa + qb) * (qa + qb) / (qa * qa / (F.col("na") - 1) + qb * qb / (F.col("nb") - 1)))
    return g.select("gene_id", "na", "nb", ((F.col("ma") - F.col("mb")) / math.log(2)).alias("log2fc"), t.alias("t"), df.alias("df"))


def pseudobulk_test(counts: DataFrame, meta: DataFrame, a: str, b: str, min_cells: int = 10, paired: bool = True) -> DataFrame:
    """gene_id, log2fc, t, p, padj, test: paired if two units or more have both groups, else Welch, else insufficient_replicates."""
    bulk = log_cpm(pseudobulk(counts, meta, min_cells))
    units = dense_units(bulk, a, b)
    shared = bulk.where(F.col("grp").isin(a, b)).groupBy("unit").agg(F.max(F.col("grp") == a).alias("a"), F.max(F.col("grp") == b).alias("b")).where("a and b").count() if paired else 0
    if shared >= 2:
        r = paired_t(units).select("gene_id", "log2fc", "t", (F.col("n") - 1).cast("double").alias("df"), F.lit("paired_t").alias("test"))
    else:
        r = welch_t(units).select("gene_id", "log2fc", "t", "df", F.when((F.col("na") >= 2) & (F.col("nb") >= 2), "welch_t").otherwise("insufficient_replicates").alias("test"))
    return benjamini_hochberg(r.withColumn("p", F.when(F.col("t").isNotNull(), p_t(F.col("t"), F.col("df")))), "p", ["gene_id"])


def average_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Ranks from 1 within `by`, equal values sharing the mean of their places."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    return df.withColumn(out, first + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def spearman_pairs(values: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """gene_a, gene_b, n, rho of dense values for all a < b, or for the pairs given."""
    r = average_ranks(values, "value", ["gene_id"]).select("obs_id", "gene_id", "rank")
    a, b = (r.select("obs_id", F.col("gene_id").alias(f"gene_{s}"), F.col("rank").alias(f"r{s}")) for s in "ab")
    j = a.join(b, "obs_id").where("gene_a < gene_b") if pairs is None else a.join(pairs, "gene_a").join(b, ["obs_id", "gene_b"])
    return j.groupBy("gene_a", "gene_b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def spearman_p(rho: DataFrame) -> DataFrame:
    """Adds the p of a rank correlation by its t approximation."""
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(F.abs("rho") < 1, 1 - F.col("rho") * F.col("rho")))
    return rho.withColumn("p", F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(p_t(t, F.col("n") - 2)))


def mann_whitney(df: DataFrame, by: list[str], group: str, a, b) -> DataFrame:
    """by, na, nb, u, z: U of group a from average ranks and its tie-corrected normal score with continuity correction."""
    d = df.where(F.col(group).isin(a, b))
    ties = d.groupBy(*by, "value").agg(F.count("*").cast("double").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("ties"))
    r = average_ranks(d, "value", by)
    g = r.groupBy(*by).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"), F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("ra")).join(ties, by)
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    n = na + nb
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when((na > 0) & (nb > 0) & (sd > 0), (F.abs(u - na * nb / 2) - 0.5) / sd)
    return g.select(*by, "na", "nb", F.when((na > 0) & (nb > 0), u).alias("u"), F.greatest(z, F.lit(0.0)).alias("z"))


def mann_whitney_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.least(F.lit(1.0), 2 * p_normal(F.col("z"))))


def region_de(values: DataFrame, regions: DataFrame, min_cells: int = 10) -> DataFrame:
    """comparison (a, b), gene_id, log2fc, t, df of Welch tests between all pairs of regions with more than min_cells points, from moments; genes vary in both."""
    sizes = regions.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > min_cells)
    v = values.join(regions.join(sizes.select("region"), "region", "left_semi"), "obs_id")
    g = v.groupBy("region", "gene_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a, b = (g.select("gene_id", F.col("region").alias(s), *(F.col(c).alias(f"{c}{s}") for c in "nmv")) for s in "ab")
    j = a.join(b, "gene_id").where("a < b and va > 0 and vb > 0")
    qa, qb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    df = (qa + qb) * (qa + qb) / (qa * qa / (F.col("na") - 1) + qb * qb / (F.col("nb") - 1))
    return j.select("a", "b", "gene_id", (F.col("ma") - F.col("mb")).alias("diff"), ((F.col("ma") - F.col("mb")) / F.sqrt(qa + qb)).alias("t"), df.alias("df"))


def bootstrap_ci(values: DataFrame, draws: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """mean, low, high of the column value: each row goes into each draw a Poisson(1) number of times, in one pass that sends sums of draws only. No row if there are no values."""
    from .resampling import bootstrap  # which needs this module

    # hashed, as the ids of two partitions would be the same modulo the prime that bootstrap() takes
    rows = values.select(F.xxhash64(F.monotonically_increasing_id()).alias("id"), F.col("value").alias("x"), F.col("value").alias("y"))
    return bootstrap(rows, draws, alpha, seed).where("statistic = 'mean_x'").select(F.col("estimate").alias("mean"), "low", "high")


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def ari_nmi(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """by, n, ari, nmi (arithmetic mean of the entropies) from the table of counts."""
    c = df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    side = lambda k: c.groupBy(*by, k).agg(F.sum("n").alias("m"))
    total = c.groupBy(*by).agg(F.sum("n").alias("every"), F.sum(pairs(F.col("n"))).alias("s"))
    ent = lambda k, o: side(k).join(total, by).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias(f"s{o}"), (-F.sum(F.col("m") / F.col("every") * F.ln(F.col("m") / F.col("every")))).alias(f"h{o}"))
    mi = c.join(side("t").withColumnRenamed("m", "mt"), [*by, "t"]).join(side("p").withColumnRenamed("m", "mp"), [*by, "p"]).join(total, by)
    mi = mi.groupBy(*by).agg(F.sum(F.col("n") / F.col("every") * F.ln(F.col("every") * F.col("n") / (F.col("mt") * F.col("mp")))).alias("mi"))
    j = total.join(ent("t", "t"), by).join(ent("p", "p"), by).join(mi, by)
    expect = F.col("st") * F.col("sp") / pairs(F.col("every"))
    top = (F.col("st") + F.col("sp")) / 2
    ari = F.when(F.abs(top - expect) < 1e-12, F.lit(1.0)).otherwise((F.col("s") - expect) / (top - expect))
    mean = (F.col("ht") + F.col("hp")) / 2
    return j.select(*by, F.col("every").cast("bigint").alias("n"), ari.alias("ari"), F.when(mean < 1e-12, F.lit(1.0)).otherwise(F.col("mi") / mean).alias("nmi"))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """coverage (share with a prediction), accuracy among those, and macro F1 over the classes of the truth."""
    t, p = F.col(truth), F.col(pred)
    base = df.agg(F.avg(p.isNotNull().cast("double")).alias("coverage"), F.avg(F.when(p.isNotNull(), (t == p).cast("double"))).alias("accuracy"))
    tp = df.where(t == p).groupBy(t.alias("c")).agg(F.count("*").alias("tp"))
    nt, np_ = df.groupBy(t.alias("c")).agg(F.count("*").alias("nt")), df.where(p.isNotNull()).groupBy(p.alias("c")).agg(F.count("*").alias("np"))
    f1 = nt.join(tp, "c", "left").join(np_, "c", "left")
    f1 = f1.agg(F.avg(2.0 * F.coalesce("tp", F.lit(0)) / (F.col("nt") + F.coalesce("np", F.lit(0)))).alias("macro_f1"))
    return base.crossJoin(f1)


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """tv: half the summed difference of two distributions of a label."""
    pa, pb = (x.groupBy(key).agg(F.count("*").alias("n")).withColumn(s, F.col("n") / F.sum("n").over(Window.partitionBy())).select(key, s) for x, s in ((a, "pa"), (b, "pb")))
    return pa.join(pb, key, "full").agg((F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))) / 2).alias("tv"))


def ols(df: DataFrame, y: str, group: str, covariate: str, by: list[str]) -> DataFrame:
    """by, n, slope, t of the 0/1 group in y ~ 1 + group + covariate, from centred sums."""
    m = df.groupBy(*by).agg(*(F.avg(c).alias(f"m_{c}") for c in (y, group, covariate)), F.count("*").alias("n"))
    d = df.join(m, by)
    dev = {c: F.col(c) - F.col(f"m_{c}") for c in (y, group, covariate)}
    s = lambda a, b: F.sum(dev[a] * dev[b])
    q = d.groupBy(*by).agg(F.first("n").alias("n"), s(group, group).alias("gg"), s(covariate, covariate).alias("cc"), s(group, covariate).alias("gc"), s(group, y).alias("gy"), s(covariate, y).alias("cy"), s(y, y).alias("yy"))
    det = F.col("gg") * F.col("cc") - F.col("gc") * F.col("gc")
    bg, bc = (F.col("cc") * F.col("gy") - F.col("gc") * F.col("cy")) / det, (F.col("gg") * F.col("cy") - F.col("gc") * F.col("gy")) / det
    rss = F.col("yy") - bg * F.col("gy") - bc * F.col("cy")
    return q.where(det > 1e-12).select(*by, "n", bg.alias("slope"), (bg / F.sqrt(rss / (F.col("n") - 3) * F.col("cc") / det)).alias("t"))
