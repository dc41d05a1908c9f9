"""Counts and expression: quality metrics, filters, normalisation, variable genes, panels, ligands and receptors, gene sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.distributions import p_hypergeom
from lamina.session import written


def qc_metrics(counts: DataFrame, genes: DataFrame, mt: str = r"^MT-", ribo: str = r"^RP[SL]\d") -> DataFrame:
    """obs_id, n_genes, total, pct_mt, pct_ribo."""
    flags = genes.select("gene_id", F.upper("symbol").rlike(mt).alias("mt"), F.upper("symbol").rlike(ribo).alias("ribo"))
    j = counts.join(flags, "gene_id")
    total = F.sum("count")
    pct = lambda c: F.when(total > 0, 100 * F.sum(F.when(F.col(c), F.col("count")).otherwise(0.0)) / total).otherwise(0.0)
    return j.groupBy("obs_id").agg(F.count_if(F.col("count") > 0).alias("n_genes"), total.alias("total"), pct("mt").alias("pct_mt"), pct("ribo").alias("pct_ribo"))


def looks_like_counts(counts: DataFrame) -> DataFrame:
    """is_counts: whether all values are non-negative and whole, within rounding."""
    v, r = F.col("count"), F.round("count")
    return counts.agg(F.coalesce(F.bool_and((v >= 0) & (F.abs(v - r) <= 1e-8 + 1e-5 * F.abs(r))), F.lit(True)).alias("is_counts"))


def filter_genes_cells(counts: DataFrame, min_cells: int, min_genes: int) -> DataFrame:
    """Rows of genes seen in min_cells cells and of cells with min_genes genes; cells are counted over all genes, before genes are dropped."""
    seen = counts.where("count > 0")
    genes = seen.groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("gene_id")
    cells = seen.groupBy("obs_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes).select("obs_id")
    return counts.join(genes, "gene_id", "left_semi").join(cells, "obs_id", "left_semi").select("obs_id", "gene_id", "count")


def normalize_log1p(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds norm and lognorm: counts of each cell scaled to `target`."""
    total = F.sum("count").over(Window.partitionBy("obs_id"))
    n = F.col("count") * target / F.when(total > 0, total).otherwise(1.0)
    return counts.withColumn("norm", n).withColumn("lognorm", F.log1p(n))


def normalize_median(counts: DataFrame) -> DataFrame:
    """Adds norm: counts of each cell scaled to the median library."""
    lib = counts.groupBy("obs_id").agg(F.sum("count").alias("lib"))
    mid = lib.agg(F.expr("percentile(lib, 0.5D)").alias("mid"))
    return counts.join(lib, "obs_id").crossJoin(F.broadcast(mid)).select("obs_id", "gene_id", "count", (F.col("count") * F.col("mid") / F.when(F.col("lib") > 0, F.col("lib")).otherwise(1.0)).alias("norm"))


def gene_moments(values: DataFrame, n_obs: int | None = None) -> DataFrame:
    """gene_id, mean, var (population) of sparse values: zeros that are left out count through n_obs."""
    n = F.lit(float(n_obs)) if n_obs else F.count("*").cast("double")
    g = values.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), n.alias("n"))
    m = F.col("s") / F.col("n")
    return g.select("gene_id", m.alias("mean"), F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)).alias("var"))


def top_variance(values: DataFrame, n: int, n_obs: int | None = None) -> DataFrame:
    """gene_id, var of the n genes of largest variance; ties go to the smaller id."""
    return gene_moments(values, n_obs).select("gene_id", "var").orderBy(F.desc("var"), "gene_id").limit(n)


def hvg_dispersion(values: DataFrame, n_obs: int, n_bins: int, n_top: int) -> DataFrame:
    """gene_id, dispersion_z, rank of the n_top genes whose log dispersion stands out most among genes of similar mean."""
    m = gene_moments(values, n_obs).withColumn("v1", F.col("var") * (n_obs / (n_obs - 1.0)))
    m = m.where("mean > 0 and v1 > 0").select("gene_id", F.log1p("mean").alias("lm"), F.ln(F.col("v1") / F.col("mean")).alias("ld"))
    box = m.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    b = F.least(F.lit(n_bins - 1), F.floor((F.col("lm") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * n_bins).cast("int"))
    m = m.crossJoin(F.broadcast(box)).withColumn("bin", b)
    w = Window.partitionBy("bin")
    # a bin of one gene has no spread of its own: the gene stands at 1
    sd = F.stddev_samp("ld").over(w)
    z = F.when(F.count("*").over(w) > 1, (F.col("ld") - F.avg("ld").over(w)) / F.when(sd > 0, sd).otherwise(1.0)).otherwise(1.0)
    m = m.withColumn("dispersion_z", z)
    top = m.orderBy(F.desc("dispersion_z"), "gene_id").limit(n_top)
    return top.select("gene_id", "dispersion_z", F.row_number().over(Window.orderBy(F.desc("dispersion_z"), "gene_id")).cast("bigint").alias("rank"))


def zscore_clip(values: DataFrame, limit: float = 10.0) -> DataFrame:
    """obs_id, gene_id, z of dense values by sample deviation, clipped on both sides."""
    g = values.groupBy("gene_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return values.join(g, "gene_id").select("obs_id", "gene_id", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)).alias("z"))


def zscore_population(values: DataFrame) -> DataFrame:
    """obs_id, gene_id, z of dense values by population deviation; genes that do not vary are 0."""
    g = values.groupBy("gene_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return values.join(g, "gene_id").select("obs_id", "gene_id", ((F.col("value") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0)).alias("z"))


def minmax(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds scaled: value from 0 to 1 within `by`, as it is where there is no range."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.col(value)))


def unique_symbols(genes: DataFrame) -> DataFrame:
    """gene_id, symbol: repeats get -1, -2, ... in order of id."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("gene_id")) - 1
    return genes.select("gene_id", F.when(n > 0, F.concat("symbol", F.lit("-"), n.cast("string"))).otherwise(F.col("symbol")).alias("symbol"))


def species(genes: DataFrame, hints: dict[str, list[str]]) -> DataFrame:
    """species: of the hint lists the one with more hits (human if as many), without any by whether most symbols are upper case."""
    hit = {k: F.sum(F.col("symbol").isin(v).cast("int")) for k, v in hints.items()}
    h, m = hit["human"], hit["mouse"]
    upper = F.avg((F.col("symbol") == F.upper("symbol")).cast("double"))
    return genes.agg(F.when((h + m > 0) & (h >= m), "human").when(h + m > 0, "mouse").when(upper > 0.8, "human").otherwise("mouse").alias("species"))


def to_mouse(symbol):
    """Slc17a7 from SLC17A7."""
    return F.concat(F.upper(F.substring(symbol, 1, 1)), F.lower(F.substring(symbol, 2, 1_000_000)))


def expression_bins(means: DataFrame, n_bins: int = 25) -> DataFrame:
    """gene_id, bin: genes by rank of their mean in bins of equal size."""
    r = means.withColumn("r", F.row_number().over(Window.orderBy("mean", "gene_id"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return r.select("gene_id", F.least(F.floor((F.col("r") - 1) * n_bins / F.col("n")), F.lit(n_bins - 1)).cast("bigint").alias("bin"))


def bin_pools(bins: DataFrame, least: int = 10) -> DataFrame:
    """bin, width, pool: for each bin how many bins on either side must join for at least `least` genes, and how many genes that makes."""
    size = bins.groupBy("bin").agg(F.count("*").alias("n"))
    top = size.agg(F.max("bin").alias("top"))
    reach = size.select("bin").crossJoin(F.broadcast(top)).select("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("width"))
    pool = reach.join(size.select(F.col("bin").alias("b2"), "n"), F.abs(F.col("b2") - F.col("bin")) <= F.col("width")).groupBy("bin", "width").agg(F.sum("n").alias("pool"))
    full = pool.where((F.col("pool") >= least)).groupBy("bin").agg(F.min(F.struct("width", "pool")).alias("x"))
    return full.select("bin", F.col("x.width").alias("width"), F.col("x.pool").alias("pool"))


def panel_coverage(panels: DataFrame, genes: DataFrame, detected: DataFrame, min_genes: int = 3) -> DataFrame:
    """panel, n_panel, n_data, n_detected, genes (joined by ;), usable. panels has (panel, symbol), detected has (gene_id)."""
    g = genes.select("gene_id", F.upper("symbol").alias("s")).groupBy("s").agg(F.min("gene_id").alias("gene_id"))
    p = panels.select("panel", F.upper("symbol").alias("s")).distinct().join(g, "s", "left").join(detected.select("gene_id", F.lit(True).alias("seen")), "gene_id", "left")
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("seen"), F.col("s")))), ";")
    n = F.count_if("seen")
    return p.groupBy("panel").agg(F.count("*").alias("n_panel"), F.count("gene_id").alias("n_data"), n.alias("n_detected"), names.alias("genes"), (n >= min_genes).alias("usable"))


#: Rows of sets that pass through the driver and go to every task as arrays; more are joined.
MOST_SET_ROWS = 500_000
#: Pairs of a cell's value and a set that are added up at a time.
MOST_PAIRS = 2_000_000


def panel_scores(values: DataFrame, sets: DataFrame, n_null: int, most_rows: int = MOST_SET_ROWS) -> DataFrame:
    """obs_id, panel, effect, p of each cell's panel mean against that cell's means over random sets.

    sets has (panel, null_id, gene_id), null_id -1 being the panel itself; a gene may be in a set twice. effect is the mean's distance from the null's in its
    deviations, p is (1 + nulls as large) / (n_null + 1). values is sparse, so means divide by the size of the set.

    Values are grouped by cell once. Sets up to `most_rows` rows (panels x nulls x genes of a panel, whatever the number of cells) go along with the
    tasks as a sparse matrix of genes by sets; beyond that each value is joined with the numbers of its gene's sets."""
    sets = written(sets, "sets")
    if sets.count() > most_rows:
        return _joined_scores(values, sets, n_null)
    frame = sets.toPandas()
    panels = sorted(frame["panel"].unique().tolist())
    column = frame["panel"].map({p: i for i, p in enumerate(panels)}).to_numpy(np.int64) * (n_null + 1) + frame["null_id"].to_numpy(np.int64) + 1
    genes, place = np.unique(frame["gene_id"].to_numpy(), return_inverse=True)
    order = np.argsort(place, kind="stable")
    column, begins = column[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(genes)))])
    size = np.maximum(np.bincount(column, minlength=len(panels) * (n_null + 1)), 1).reshape(len(panels), n_null + 1)
    del frame, place, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 2_000_000 // size.size)
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                lists, amounts = part.column("genes"), part.column("values").flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                mine = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(genes, mine), len(genes) - 1)
                known = genes[at] == mine
                at, owner, amounts = at[known], owner[known], amounts[known]
                n = begins[at + 1] - begins[at]
                flat = np.repeat(begins[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                m = np.bincount(np.repeat(owner, n) * size.size + column[flat], np.repeat(amounts, n), part.num_rows * size.size).reshape(part.num_rows, *size.shape) / size
                real, null = m[:, :, 0], m[:, :, 1:]
                mean = null.sum(2) / n_null
                sd = np.sqrt(np.maximum((null * null).sum(2) / n_null - mean * mean, 0))
                # sums in another order may differ in their last digits, so a tie has a margin
                ge = np.where(real <= 0, n_null, (null >= real[:, :, None] - 1e-12).sum(2))
                effect = np.where(sd > 1e-12, (real - mean) / np.where(sd > 1e-12, sd, 1), 0.0)
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(panels)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("obs_id").take(rows), pa.array(panels * part.num_rows), pa.array(effect.ravel()), pa.array(((1 + ge) / (n_null + 1.0)).ravel())], names=["obs_id", "panel", "effect", "p"]
                )

    cells = values.groupBy("obs_id").agg(F.collect_list("gene_id").alias("genes"), F.collect_list(F.col("value").cast("double")).alias("values"))
    return cells.mapInArrow(run, f"obs_id {values.schema['obs_id'].dataType.simpleString()}, panel {sets.schema['panel'].dataType.simpleString()}, effect double, p double")


def packed(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Lists of whole numbers in order, as bytes: a number is its step from the one before (from 0), as a byte of 255 for every 255 of it and one of the rest."""
    step = np.diff(numbers, prepend=0)
    first = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
    step[first] = numbers[first]
    ends = np.cumsum(step // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = step % 255
    at = np.concatenate([[0], ends])[offsets - offsets[0]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each list of packed() has (a null none), and all of them."""
    long = pc.binary_length(codes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(long)])
    data = np.frombuffer(b"".join(x for x in codes.to_pylist() if x), np.uint8)
    sums, ends = np.concatenate([[0], np.cumsum(data, dtype=np.int64)]), np.concatenate([[0], np.cumsum(data != 255)])
    n = np.diff(ends[at])
    return n, sums[1:][data != 255] - np.repeat(sums[at[:-1]], n)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("codes")
        yield pa.RecordBatch.from_arrays([b.column("gene_id"), packed(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64))], names=["gene_id", "codes"])


def _joined_scores(values: DataFrame, sets: DataFrame, n_null: int) -> DataFrame:
    """panel_scores() for sets of any number: a gene's sets are numbers in order, packed by their steps (`packed`), which its values take along to their cells.

    The driver holds a size for each panel and null. Sets in which a cell has nothing have mean 0 and are not looked at."""
    size = sets.groupBy("panel", "null_id").agg(F.count("*").alias("k")).toPandas()
    panels, per = sorted(size["panel"].unique().tolist()), n_null + 1
    place = F.array_position(F.array(*map(F.lit, panels)), F.col("panel")) - 1
    sizes = np.ones(len(panels) * per)
    sizes[size["panel"].map({p: i for i, p in enumerate(panels)}).to_numpy(np.int64) * per + size["null_id"].to_numpy(np.int64) + 1] = size["k"]
    codes = sets.groupBy("gene_id").agg(F.sort_array(F.collect_list((place * per + F.col("null_id") + 1).cast("int"))).alias("codes"))
    codes = codes.mapInArrow(_pack, f"gene_id {sets.schema['gene_id'].dataType.simpleString()}, codes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("genes")
            long = pc.binary_length(lists.flatten().field("codes")).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(long)])[np.cumsum(np.diff(lists.offsets.to_numpy()))]
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_PAIRS, "right")))
                z = min(z, b.num_rows, a + max(1, MOST_PAIRS // len(panels)))
                yield scored(b.slice(a, z - a))
                a = z

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        lists, rows = part.column("genes"), part.num_rows
        genes = lists.flatten()
        owner = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
        n, found = unpacked(genes.field("codes"))
        key = np.repeat(owner, n) * len(sizes) + found
        # a sum's parts stay in order: places are the low bits of what is sorted
        bits = len(key).bit_length()
        key = np.sort((key << bits) | np.arange(len(key)))
        order, key = key & ((1 << bits) - 1), key >> bits
        amounts = np.repeat(genes.field("value").to_numpy(zero_copy_only=False), n)[order]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        key = key[begins]
        m = (np.add.reduceat(amounts, begins) if len(begins) else amounts) / sizes[key % len(sizes)]
        group, of_panel, cells = key // per, key % per == 0, rows * len(panels)
        real = np.zeros(cells)
        real[group[of_panel]] = m[of_panel]
        group, m = group[~of_panel], m[~of_panel]
        mean = np.bincount(group, m, cells) / n_null
        sd = np.sqrt(np.maximum(np.bincount(group, m * m, cells) / n_null - mean * mean, 0))
        ge = np.where(real <= 0, n_null, np.bincount(group[m >= real[group] - 1e-12], minlength=cells))
        effect = np.where(sd > 1e-12, (real - mean) / np.where(sd > 1e-12, sd, 1), 0.0)
        ids = part.column("obs_id").take(pa.array(np.repeat(np.arange(rows), len(panels))))
        return pa.RecordBatch.from_arrays([ids, pa.array(panels * rows, kind), pa.array(effect), pa.array((1 + ge) / (n_null + 1.0))], names=["obs_id", "panel", "effect", "p"])

    panel = sets.schema["panel"].dataType.simpleString()
    kind = pa.string() if panel == "string" else None
    gene = F.struct(F.col("value").cast("double").alias("value"), F.col("codes").alias("codes"))
    cells = values.join(codes, "gene_id", "left").groupBy("obs_id").agg(F.collect_list(gene).alias("genes"))
    return cells.mapInArrow(run, f"obs_id {values.schema['obs_id'].dataType.simpleString()}, panel {panel}, effect double, p double")


def call_labels(scores: DataFrame, alpha: float) -> DataFrame:
    """obs_id, label, effect, margin: the significant panel of largest effect, and how far the next significant one is; else Unresolved. Scores are worked out once."""
    if not hasattr(scores, "_lamina_path"):
        # numbers of panels that cannot become labels are not kept: nearly all, where panels are many
        scores = written(scores.select("obs_id", "panel", *(F.when(F.col("p") < alpha, F.col(c)).alias(c) for c in ("effect", "p"))), "scores")
    n = scores.select("panel").distinct().count()
    ok = scores.withColumn("ok", F.col("p") < alpha / max(1, n))
    w = Window.partitionBy("obs_id").orderBy(F.desc("effect"), "panel")
    best = ok.where("ok").withColumn("next", F.lead("effect").over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    best = best.select("obs_id", F.col("panel").alias("label"), "effect", (F.col("effect") - F.col("next")).alias("margin"))
    return scores.select("obs_id").distinct().join(best, "obs_id", "left").select("obs_id", F.coalesce("label", F.lit("Unresolved")).alias("label"), "effect", "margin")


def abundance(values: DataFrame, specs: DataFrame) -> DataFrame:
    """obs_id, name, value of specs like "A|B;C": the geometric mean over groups (;) of the best alternative (|), 0 where a group is 0.

    A spec with a group that no measured gene belongs to has no rows. values is sparse (obs_id, symbol, value); a zero has no row."""
    g = specs.select("name", F.posexplode(F.split("spec", ";")).alias("grp", "alt")).select("name", "grp", F.explode(F.split("alt", r"\|")).alias("symbol"))
    known = g.join(values.select("symbol").distinct(), "symbol", "left_semi")
    want = g.select("name", "grp").distinct().groupBy("name").agg(F.count("*").alias("k"))
    have = known.select("name", "grp").distinct().groupBy("name").agg(F.count("*").alias("h"))
    full = want.join(have, "name").where("k = h").select("name", "k")
    best = values.join(known.join(full, "name"), "symbol").where("value > 0").groupBy("obs_id", "name", "grp", "k").agg(F.max("value").alias("v"))
    return best.groupBy("obs_id", "name").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.exp(F.avg(F.ln("v"))).alias("value")).where("n = k").select("obs_id", "name", "value")


def communication(edges: DataFrame, labels: DataFrame, ligand: DataFrame, receptor: DataFrame, min_edges: int) -> DataFrame:
    """interaction, sender, receiver, n_edges, score: the mean of ligand x receptor over the edges from one label to another."""
    e = edges.join(labels.select(F.col("obs_id").alias("src"), F.col("label").alias("sender")), "src").join(labels.select(F.col("obs_id").alias("dst"), F.col("label").alias("receiver")), "dst")
    n = e.groupBy("sender", "receiver").agg(F.count("*").alias("n_edges")).where(F.col("n_edges") >= min_edges)
    v = e.join(ligand.select(F.col("obs_id").alias("src"), "interaction", F.col("value").alias("l")), "src").join(receptor.select(F.col("obs_id").alias("dst"), "interaction", F.col("value").alias("r")), ["dst", "interaction"])
    s = v.groupBy("interaction", "sender", "receiver").agg(F.sum(F.col("l") * F.col("r")).alias("s"))
    return s.join(n, ["sender", "receiver"]).select("interaction", "sender", "receiver", "n_edges", (F.col("s") / F.col("n_edges")).alias("score"))


def communication_test(edges: DataFrame, labels: DataFrame, ligand: DataFrame, receptor: DataFrame, perm: DataFrame, n_perm: int, min_edges: int, least_share: float = 0.5) -> DataFrame:
    """The scores of communication() against receptors shuffled within blocks; labels has (obs_id, label, block), an edge belongs to the block of its src.

    interaction, sender, receiver, n_edges, score; p from the normal law with the shuffles' mean and deviation, p_empirical = (1 + as large) / (n + 1);
    n_tested blocks with at least min_edges such edges and n_supporting ones whose score is above the 95 % quantile of their own shuffles;
    padj (Benjamini-Hochberg over all rows), and significant: padj below 0.05 and, with several blocks, the share of supporting ones at least least_share.

    A row for each edge and shuffle has all interactions; a pair of labels in a block has an array of n_perm scores at most."""
    from lamina.functions.distributions import p_normal
    from lamina.operators.graph import product_sums, shuffled_pairs
    from lamina.operators.stats import benjamini_hochberg

    names = sorted(r["interaction"] for r in ligand.select("interaction").intersect(receptor.select("interaction")).collect())
    pair = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")

    def arrays(side: DataFrame) -> DataFrame:
        m = side.groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.struct("interaction", "value"))).alias("m"))
        return written(m.select("obs_id", F.transform(pair, lambda x: F.coalesce(F.col("m")[x], F.lit(0.0))).alias("v")), "dense")

    e = edges.select("src", "dst", F.lit(1.0).alias("w")).join(labels.select(F.col("obs_id").alias("src"), F.col("label").alias("sender"), "block"), "src")
    e = written(e.join(labels.select(F.col("obs_id").alias("dst"), F.col("label").alias("receiver")), "dst"), "edges")
    by = ["sender", "receiver"]
    blocks = e.groupBy(*by, "block").agg(F.count("*").alias("cb"))
    tested = blocks.groupBy(*by).agg(F.sum("cb").alias("n_edges"), F.count_if(F.col("cb") >= min_edges).alias("n_tested")).where(F.col("n_edges") >= min_edges)
    sums = written(product_sums(shuffled_pairs(e, perm, False, [*by, "block"]), arrays(ligand), arrays(receptor), len(names), ["perm", *by, "block"]).where("s > 0"), "sums")
    whole = sums.groupBy("perm", "i", *by).agg(F.sum("s").alias("s")).join(tested, by)
    whole = whole.withColumn("m", F.col("s") / F.col("n_edges"))
    real = whole.where("perm = -1").select("i", *by, "n_edges", "n_tested", F.col("m").alias("score"))
    # shuffles without a product have no row, and score 0
    null = real.join(whole.where("perm >= 0").select("i", *by, "m"), ["i", *by], "left").groupBy("i", *by, "n_edges", "n_tested", "score")
    null = null.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("s2"), F.count_if(F.col("m") >= F.col("score") - 1e-9).alias("ge"))
    mean = F.col("s1") / n_perm
    sd = F.sqrt(F.greatest(F.col("s2") / n_perm - mean * mean, F.lit(0.0)))
    null = null.withColumn("z", F.when(sd > 1e-9, (F.col("score") - mean) / sd)).withColumn("above", F.col("score") > mean)
    # each block's own score against the 95 % quantile of its shuffles
    own = sums.where("perm = -1").select("i", *by, "block", F.col("s").alias("own"))
    lists = own.join(sums.where("perm >= 0").select("i", *by, "block", "s"), ["i", *by, "block"], "left").groupBy("i", *by, "block", "own").agg(F.collect_list("s").alias("x"))
    place = 0.95 * (n_perm - 1)
    low = int(place)
    lists = lists.withColumn("x", F.sort_array(F.concat("x", F.array_repeat(F.lit(0.0), F.lit(n_perm) - F.size("x")))))
    quantile = F.col("x")[low] + (F.col("x")[min(low + 1, n_perm - 1)] - F.col("x")[low]) * (place - low)
    support = lists.join(blocks.where(F.col("cb") >= min_edges), [*by, "block"]).where((F.col("own") - quantile) / F.col("cb") > 1e-9).groupBy("i", *by).agg(F.count("*").alias("n_supporting"))
    out = null.join(support, ["i", *by], "left")
    p = F.when(F.col("z").isNotNull(), p_normal(F.col("z"))).when(F.col("above"), 0.0).otherwise(1.0)
    out = out.select(pair[F.col("i")].alias("interaction"), *by, "n_edges", "score", p.alias("p"), ((1 + F.col("ge")) / F.lit(n_perm + 1.0)).alias("p_empirical"), "n_tested", F.coalesce("n_supporting", F.lit(0).cast("bigint")).alias("n_supporting"))
    out = benjamini_hochberg(out, "p", ["interaction", *by])
    many = labels.select("block").distinct().count() > 1
    enough = F.col("n_supporting") / F.greatest("n_tested", F.lit(1)) >= least_share if many else F.lit(True)
    return out.withColumn("significant", (F.col("padj") < 0.05) & enough)


def ora(hits: DataFrame, universe: DataFrame, sets: DataFrame, min_size: int = 3) -> DataFrame:
    """term, k, set_size, n_hits, n_universe, p of hits among the genes of each set, all within the universe."""
    u = universe.select("gene_id").distinct()
    h = hits.select("gene_id").distinct().join(u, "gene_id", "left_semi")
    s = sets.join(u, "gene_id", "left_semi").distinct()
    size = s.groupBy("term").agg(F.count("*").alias("set_size")).where(F.col("set_size") >= min_size)
    k = s.join(h, "gene_id", "left_semi").groupBy("term").agg(F.count("*").alias("k"))
    n = u.agg(F.count("*").alias("n_universe")).crossJoin(h.agg(F.count("*").alias("n_hits")))
    out = size.join(k, "term", "left").crossJoin(F.broadcast(n)).select("term", F.coalesce("k", F.lit(0)).alias("k"), "set_size", "n_hits", "n_universe")
    return out.withColumn("p", p_hypergeom(F.col("k"), F.col("n_universe"), F.col("set_size"), F.col("n_hits")))


def gsea_es(ranked: DataFrame, sets: DataFrame, min_size: int = 5, max_size: int = 500) -> DataFrame:
    """term, size, es: the largest departure of the weighted running sum; ranked has (gene_id, score). One pass over a term's genes only:
    between two of them the sum falls evenly, so it is known from their places."""
    r = ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "gene_id")))
    n = F.lit(ranked.count())
    s = sets.select("term", "gene_id").distinct().join(r, "gene_id").withColumn("a", F.abs("score"))
    w = Window.partitionBy("term")
    s = s.withColumn("size", F.count("*").over(w)).where(F.col("size").between(min_size, max_size)).withColumn("total", F.sum("a").over(w))
    up = Window.partitionBy("term").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy("place"))).withColumn("cum", F.sum("a").over(up))
    miss = (F.col("place") - F.col("i")) / (n - F.col("size"))
    hit, before = F.col("cum") / F.col("total"), (F.col("cum") - F.col("a")) / F.col("total")
    g = s.where((F.col("total") > 0) & (F.col("size") < n)).groupBy("term", "size").agg(F.max(hit - miss).alias("hi"), F.min(before - miss).alias("lo"))
    return g.select("term", "size", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))
