"""Resampling by hashes: binomial thinning of counts, planted effects with the tests that should find them, bootstrap intervals.

A random number belongs to a row, a seed and a use, never to a task: results are the same on any partitioning and in any engine that has MD5."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.distributions import p_normal, p_t
from lamina.session import written

from . import stats

#: Ranges of a number in [0, 1) that are counted before rows are put in order inside them.
RANGES = 65_536
#: Trials that one random number decides on; more are done in parts, so that no probability is too small for a float.
TRIALS = 256


def uniform(*keys) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the keys, written with bars between them."""
    text = F.concat_ws("|", *((k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def places(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (obs_id, u in [0, 1), others) with `place`: 0, 1, ... in order of u, within groups if asked for; equal u go by obs_id.

    No group is put in order in one task: ranges of u are counted, and rows are numbered inside their range."""
    parts = rows.withColumn("part", F.floor(F.col("u") * RANGES).cast("int"))
    own = F.row_number().over(Window.partitionBy(*by, "part").orderBy("u", "obs_id")) - 1
    counts = parts.groupBy(*by, "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy(*by).orderBy("part")) - F.col("count")).drop("count")
    return parts.withColumn("own", own).join(before, [*by, "part"]).withColumn("place", F.col("before") + F.col("own")).drop("part", "own", "before", "u")


def _steps(p: float) -> np.ndarray:
    """Row m: the cumulative probabilities of 0 to m - 1 successes of m trials, for every m up to TRIALS; 2 fills the rest."""
    out = np.full((TRIALS + 1, TRIALS), 2.0)
    for m in range(1, TRIALS + 1):
        k = np.arange(m)
        out[m, :m] = np.cumsum(np.concatenate([[1.0], np.cumprod((m - k[:-1]) / (k[:-1] + 1) * (p / (1 - p)))]) * (1 - p) ** m)
    return out


def _below(steps: np.ndarray, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many steps of each m are at most u, by bisection of all rows at once."""
    m, low = m.astype(np.int64), np.zeros(len(m), np.int64)
    high = m.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        up = open_ & (steps[m, np.minimum(mid, TRIALS - 1)] <= u)
        low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
    return low


def thin(counts: DataFrame, p: float, keys: list[str], seed: int = 0, count: str = "count") -> DataFrame:
    """counts with `thinned`: how many of each row's count stay if each unit of it stays with probability p, exactly binomial.

    Rows are told apart by `keys`. A null or negative count gives null, p of 0 or 1 none or all; counts are rounded down to whole numbers."""
    if not 0 <= p <= 1:
        raise ValueError(f"a probability of {p}")
    n = F.floor(F.col(count)).cast("bigint")
    if p in (0.0, 1.0):
        return counts.withColumn("thinned", F.when(n >= 0, n * int(p)))
    small = min(p, 1 - p)
    steps = _steps(small)
    u = lambda i: uniform(*map(F.col, keys), seed, i)
    several = F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / TRIALS) - 1), u)

    @F.pandas_udf("bigint")
    def one(n: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(_below(steps, n.to_numpy(), u.to_numpy()))

    @F.pandas_udf("bigint")
    def many(n: pd.Series, u: pd.Series) -> pd.Series:
        parts = u.map(len).to_numpy()
        trials = np.full(parts.sum(), TRIALS)
        ends = np.cumsum(parts)
        # all parts but the last have TRIALS trials
        trials[ends - 1] = (n.to_numpy() - 1) % TRIALS + 1
        drawn = _below(steps, trials, np.concatenate(u.to_numpy()))
        return pd.Series(np.add.reduceat(drawn, ends - parts))

    # rows of one part, as most are, need no array; a kernel gets the other's rows as one trial
    single = n.between(1, TRIALS)
    k = one(F.when(single, n).otherwise(F.lit(1)), F.when(single, u(0)).otherwise(0.0))
    rest = many(F.when(n > TRIALS, n).otherwise(F.lit(1)), F.when(n > TRIALS, several).otherwise(F.array(F.lit(0.0))))
    j = counts.withColumns({"_one": k, "_many": rest})
    drawn = F.when(single, F.col("_one")).otherwise(F.col("_many"))
    return j.select(*counts.columns, F.when(n > 0, drawn if p <= 0.5 else n - drawn).when(n == 0, F.lit(0).cast("bigint")).alias("thinned"))


def sparse_tests(values: DataFrame, meta: DataFrame, a: str, b: str) -> DataFrame:
    """gene_id, p_t, p_rank: Welch's t and rank sum tests of two groups of observations, whose values (obs_id, gene_id, value) are 0 where no row says otherwise and positive there."""
    grp = meta.where(F.col("grp").isin(a, b)).select("obs_id", "grp")
    size = grp.groupBy().agg(F.count_if(F.col("grp") == a).cast("double").alias("na"), F.count_if(F.col("grp") == b).cast("double").alias("nb"))
    d = values.where("value > 0").join(grp, "obs_id")
    isa = F.col("grp") == a
    when = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    g = d.groupBy("gene_id").agg(*(when(c, F.col("value") ** k if k else F.lit(1.0)).alias(f"{n}{s}") for s, c in (("a", isa), ("b", ~isa)) for n, k in (("k", 0), ("s", 1), ("q", 2))))
    r = stats.average_ranks(d, "value", ["gene_id"]).groupBy("gene_id").agg(when(isa, F.col("rank")).alias("ra"))
    ties = d.groupBy("gene_id", "value").agg(F.count("*").cast("double").alias("t")).groupBy("gene_id").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    j = g.join(r, "gene_id").join(ties, "gene_id").crossJoin(F.broadcast(size))
    na, nb = F.col("na"), F.col("nb")
    n = na + nb
    za, zeros = na - F.col("ka"), n - F.col("ka") - F.col("kb")
    # values above 0 rank after all zeros, which share the mean of the first places
    u = F.col("ra") + F.col("ka") * zeros + za * (zeros + 1) / 2 - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - (F.col("ties") + zeros**3 - zeros) / (n * (n - 1))))
    z = F.greatest((F.abs(u - na * nb / 2) - 0.5) / F.when(sd > 0, sd), F.lit(0.0))
    var = lambda s, m: F.greatest(F.col(f"q{s}") - F.col(f"s{s}") * F.col(f"s{s}") / m, F.lit(0.0)) / (m - 1) / m
    qa, qb = var("a", na), var("b", nb)
    t = F.when((na > 1) & (nb > 1) & (qa + qb > 1e-20), (F.col("sa") / na - F.col("sb") / nb) / F.sqrt(qa + qb))
    j = j.select("gene_id", t.alias("t"), ((qa + qb) ** 2 / (qa * qa / (na - 1) + qb * qb / (nb - 1))).alias("df"), F.when((na > 0) & (nb > 0), z).alias("z"))
    return j.select("gene_id", F.when(F.col("t").isNotNull(), p_t(F.col("t"), F.col("df"))).alias("p_t"), F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), 2 * p_normal(F.col("z")))).alias("p_rank"))


def planted_effect(counts: DataFrame, meta: DataFrame, effect: DataFrame, keep: float = 0.5, a: str = "A", b: str = "B", min_cells: int = 10, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """method, n_genes, n_called, sensitivity, fdp: four tests of groups a and b after the counts of some genes are thinned in group b.

    counts: obs_id, gene_id, count; meta: obs_id, grp, section, donor (a section is of one group, a donor has both); effect: gene_id. The tests are by
    observation (Welch's t and rank sums on log-normalised values) and by unit (Welch over sections, paired over donors, on log-CPM sums).
    A gene without a p counts as 1; q values are by Benjamini and Hochberg within a method."""
    counts = counts.where("count > 0").join(meta.where(F.col("grp").isin(a, b)).select("obs_id", "grp"), "obs_id")
    library = counts.groupBy("obs_id").agg(F.sum("count").alias("library"))
    planted = counts.join(effect.select("gene_id", F.lit(True).alias("planted")), "gene_id", "left").withColumn("planted", F.coalesce("planted", F.lit(False)))
    hit = F.col("planted") & (F.col("grp") == b)
    # all rows that stay as they are go around the sampler
    made = planted.where(~hit).select("obs_id", "gene_id", "count").unionByName(thin(planted.where(hit).select("obs_id", "gene_id", "count"), keep, ["obs_id", "gene_id"], seed).select("obs_id", "gene_id", F.col("thinned").cast(counts.schema["count"].dataType).alias("count")))
    made = written(made.where("count > 0"), "thinned")
    logs = made.join(library, "obs_id").select("obs_id", "gene_id", F.log1p(F.col("count") / F.col("library") * 1e4).alias("value"))
    by_obs = sparse_tests(logs, meta, a, b)

    def by_unit(unit: str, paired: bool) -> DataFrame:
        bulk = stats.dense_units(stats.log_cpm(stats.pseudobulk(made, meta.select("obs_id", F.col(unit).alias("unit"), "grp"), min_cells)), a, b)
        test = stats.paired_t(bulk).withColumn("df", F.col("n") - 1.0) if paired else stats.welch_t(bulk)
        return test.select("gene_id", F.when(F.col("t").isNotNull(), p_t(F.col("t"), F.col("df"))).alias(f"p_{unit}"))

    genes = planted.groupBy("gene_id").agg(F.max("planted").alias("truth"))
    p = genes.join(by_obs, "gene_id", "left").join(by_unit("section", False), "gene_id", "left").join(by_unit("donor", True), "gene_id", "left")
    names = {"p_t": "observations_t", "p_rank": "observations_rank", "p_section": "sections", "p_donor": "donors_paired"}
    long = p.select("gene_id", "truth", F.explode(F.array(*(F.struct(F.lit(v).alias("method"), F.coalesce(F.nanvl(F.col(k), F.lit(1.0)), F.lit(1.0)).alias("p")) for k, v in names.items()))).alias("m")).select("gene_id", "truth", "m.*")
    q = stats.benjamini_hochberg(long, "p", ["gene_id"], ["method"])
    called = F.col("padj") < alpha
    return q.groupBy("method").agg(
        F.count("*").alias("n_genes"), F.count_if(called).alias("n_called"), (F.count_if(called & F.col("truth")) / F.when(F.count_if("truth") > 0, F.count_if("truth"))).alias("sensitivity"),
        (F.count_if(called & ~F.col("truth")) / F.greatest(F.count_if(called), F.lit(1))).alias("fdp"),
    )


#: A prime and multipliers of the hash that gives a row's number of copies in a draw.
PRIME, MULTIPLIERS = 2_147_483_647, (48_271, 16_807, 69_621)
#: Cumulative probabilities of a Poisson number with mean 1, in units of the prime.
_POISSON = np.floor(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])) * PRIME).astype(np.int64)


def copies(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each row is in each draw: Poisson numbers with mean 1, by squares modulo a prime of row, draw and seed."""
    a, b, c = MULTIPLIERS
    x = (ids[:, None] % PRIME * a + (np.arange(draws)[None] + 1) * b + seed * c) % PRIME
    for k in (a, b, c):
        x = (x * x % PRIME * k + k) % PRIME
    return np.searchsorted(_POISSON, x, "right")


def copies_sql(row: str, draw: str, seed: int) -> str:
    """The same number as SQL text."""
    a, b, c = MULTIPLIERS
    x = f"(({row}) % {PRIME} * {a} + (({draw}) + 1) * {b} + {seed * c}) % {PRIME}"
    for k in (a, b, c):
        x = f"((({x})::HUGEINT * ({x}) % {PRIME} * {k} + {k}) % {PRIME})"
    return f"len(list_filter([{', '.join(map(str, _POISSON.tolist()))}], lambda t: t <= {x}))"


def bootstrap(rows: DataFrame, draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """statistic, estimate, low, high: intervals of the means of x and y and of their correlation, from rows (id, x, y).

    Every row is in every draw a Poisson number of times, so one pass gives all draws: a batch of rows adds six sums to each draw, and
    what is shuffled is draws x tasks rows of sums. Rows with a null in x or y are left out; draws in which y or x does not vary have no correlation."""
    names = ["w", "x", "y", "xx", "yy", "xy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, 6))
        for b in batches:
            i, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for s in range(0, len(i), 1024):
                u, v = x[s : s + 1024], y[s : s + 1024]
                total += copies(i[s : s + 1024], draws, seed).T @ np.stack([np.ones_like(u), u, v, u * u, v * v, u * v], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *map(pa.array, total.T)], names=["draw", *names])

    good = rows.where("id is not null and x is not null and y is not null").select(F.col("id").cast("bigint"), F.col("x").cast("double"), F.col("y").cast("double"))
    s = good.mapInArrow(run, "draw bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("draw").agg(*(F.sum(n).alias(n) for n in names)).where("w > 0")
    own = good.agg(F.lit(-1).cast("bigint").alias("draw"), F.count("*").cast("double").alias("w"), *(F.sum(e).alias(n) for n, e in zip(names[1:], (F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y")), strict=True)))
    vx, vy = F.col("w") * F.col("xx") - F.col("x") * F.col("x"), F.col("w") * F.col("yy") - F.col("y") * F.col("y")
    r = F.when((vx > 1e-12) & (vy > 1e-12), (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy))
    found = F.array(*(F.struct(F.lit(n).alias("statistic"), v.alias("v")) for n, v in (("mean_x", F.col("x") / F.col("w")), ("mean_y", F.col("y") / F.col("w")), ("correlation", r))))
    every = s.unionByName(own.where("w > 0")).select("draw", F.explode(found).alias("f")).select("draw", "f.*")
    out = every.groupBy("statistic").agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("estimate"), *(F.expr(f"percentile(v, {q}D) FILTER (WHERE draw >= 0)").alias(n) for n, q in (("low", alpha / 2), ("high", 1 - alpha / 2))))
    return out


def bootstrap_medians(rows: DataFrame, columns: list[str], draws: int = 1000, alpha: float = 0.05, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """statistic (median_<column>), estimate, low, high: intervals of medians, in the draws of bootstrap() and as a plain sample's median (the mean of the middle two).

    A first pass adds the copies of each draw by bucket of values, arrays of sums being all that is shuffled; they tell in which bucket a draw's middle
    lies. A second pass looks at rows of those buckets only, for the draws that need them: some draws x rows / buckets sums by value, equal values added
    before they are shuffled. Rows without an id and values that are null or NaN are left out; a column without values has no row."""
    long = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("f")
    good = rows.where("id is not null").select(F.col("id").cast("bigint"), long).select("id", "f.*").where("v is not null and not isnan(v)")
    # buckets - 1 numbers a column; any bounds give the same medians
    cuts = {r["c"]: np.unique(r["q"]) for r in good.groupBy("c").agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10_000).alias("q")).collect()}

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(column, values, buckets, copies in each draw with a last one for the rows as they are)."""
        for batch in batches:
            i, c, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for s in range(0, len(i), 1024):
                k = np.concatenate([copies(i[s : s + 1024], draws, seed), np.ones((len(i[s : s + 1024]), 1), np.int64)], 1)
                for at in np.unique(c[s : s + 1024]).tolist():
                    mine = np.flatnonzero(c[s : s + 1024] == at)
                    x = v[s : s + 1024][mine]
                    yield at, x, np.searchsorted(cuts[at], x, "right"), k[mine]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros((len(q) + 1, draws + 1), np.int64) for c, q in cuts.items()}
        for c, _, b, k in slices(batches):
            order = np.argsort(b, kind="stable")
            names, begins = np.unique(b[order], return_index=True)
            total[c][names] += np.add.reduceat(k[order], begins)
        for c, t in total.items():
            some = np.flatnonzero(t.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), pa.array(some.astype(np.int32)), pa.array(list(t[some]), pa.list_(pa.int64()))], names=["c", "b", "w"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in table.column("w").to_pylist()], 0)
        return pa.table({"c": table.column("c")[:1], "b": table.column("b")[:1], "w": pa.array([total], pa.list_(pa.int64()))})

    sums = good.mapInArrow(first, "c int, b int, w array<bigint>").groupBy("c", "b").applyInArrow(add, "c int, b int, w array<bigint>")
    own = Window.partitionBy("c", "draw")
    cum = sums.select("c", "b", F.posexplode("w").alias("draw", "w")).withColumn("z", F.sum("w").over(own.orderBy("b"))).withColumn("n", F.sum("w").over(own))
    middle = F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("p")
    wanted = cum.where("n > 0 and w > 0").select("c", "b", "draw", "w", "z", middle).where("p < z and p >= z - w").select("c", "b", "draw", (F.col("p") - F.col("z") + F.col("w")).alias("p"))
    wanted = written(wanted, "middles")  # two rows for each draw and column
    which = {(c, b): np.unique(d) for c, b, d in wanted.groupBy("c", "b").agg(F.collect_set("draw")).collect()}

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, x, b, k in slices(batches):
            for at in np.unique(b).tolist():
                of = which.get((c, at))
                if of is None:
                    continue
                mine = b == at
                value, begins = np.unique(x[mine], return_inverse=True)
                w = np.zeros((len(value), len(of)), np.int64)
                np.add.at(w, begins, k[mine][:, of])
                i, j = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c, np.int32)), pa.array(np.full(len(i), at, np.int32)), pa.array(of[j].astype(np.int32)), pa.array(value[i]), pa.array(w[i, j])], names=["c", "b", "draw", "v", "w"])

    values = good.mapInArrow(second, "c int, b int, draw int, v double, w bigint").groupBy("c", "b", "draw", "v").agg(F.sum("w").alias("w"))
    values = values.withColumn("z", F.sum("w").over(Window.partitionBy("c", "b", "draw").orderBy("v")))
    found = values.join(wanted, ["c", "b", "draw"]).where("p < z and p >= z - w").groupBy("c", "draw").agg(F.avg("v").alias("v"))
    name = F.element_at(F.array(*(F.lit(f"median_{c}") for c in columns)), F.col("c") + 1)
    ends = (F.expr(f"percentile(v, {q}D) FILTER (WHERE draw < {draws})").alias(n) for n, q in (("low", alpha / 2), ("high", 1 - alpha / 2)))
    return found.groupBy(name.alias("statistic")).agg(F.max(F.when(F.col("draw") == draws, F.col("v"))).alias("estimate"), *ends)
