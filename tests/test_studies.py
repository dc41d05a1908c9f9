"""Study operators against known answers, and every built-in skill from files."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina import catalogue, skills
from lamina.operators import events, expression, graph, learning, studies
from lamina.sources import fixtures as fx


def test_signed_rank():
    assert studies.signed_rank([1, 2, 3, 4, 5]) == (0.0, 0.0625)
    assert studies.signed_rank([1, -2, 3, 4, 5, 6])[0] == 2.0 and studies.signed_rank([1, -2, 3, 4, 5, 6])[1] == pytest.approx(6 / 64)
    w, p = studies.signed_rank([1.0, 1.0, -1.0, 2.0, 2.0, 3.0] * 5)
    assert 0 < p < 0.01 and w < 100
    assert studies.signed_rank([0.0, math.nan]) == (0.0, 1.0)


def test_control_sets_match_their_panels(spark):
    bins = spark.createDataFrame([(g, g // 20) for g in range(200)], "gene_id bigint, bin bigint")
    panels = spark.createDataFrame([("p", g) for g in (3, 4, 45, 46, 150)] + [("q", g) for g in (5, 47)], "panel string, gene_id bigint")
    rows = studies.control_sets(panels, bins, 30).collect()
    used = {3, 4, 45, 46, 150, 5, 47}
    sets = {}
    for r in rows:
        sets.setdefault((r["panel"], r["null_id"]), []).append(r["gene_id"])
    assert len(sets) == 62 and sorted(sets["p", -1]) == [3, 4, 45, 46, 150]
    for (panel, k), genes in sets.items():
        if k >= 0:
            assert not set(genes) & used and len(genes) == len(sets[panel, -1])
            assert sorted(g // 20 for g in genes) == sorted(g // 20 for g in sets[panel, -1])
    assert len({tuple(sorted(v)) for v in sets.values()}) > 40


def test_control_sets_take_in_neighbouring_bins(spark):
    # bin 0 has one free gene, so its pool reaches into the next bins; a panel larger than a pool still gets sets of its size
    bins = spark.createDataFrame([(g, 0 if g < 6 else 1 + (g - 6) // 6) for g in range(30)], "gene_id bigint, bin bigint")
    panels = spark.createDataFrame([("p", g) for g in range(5)], "panel string, gene_id bigint")
    for portable in (False, True):
        rows = studies.control_sets(panels, bins, 20, portable=portable).where("null_id >= 0").collect()
        assert len(rows) == 100 and {r["gene_id"] for r in rows} <= set(range(5, 18)) and len({r["gene_id"] for r in rows}) > 5
    with pytest.raises(ValueError):
        studies.control_sets(panels, bins.where("gene_id < 5"), 3)


def test_portable_draws_of_large_ids(spark):
    """Beyond some six million the product of the key leaves 64 bits; draws are those of whole numbers of any size."""
    low = 7_200_000
    bins = spark.createDataFrame([(low + g, 0) for g in range(40)], "gene_id bigint, bin bigint")
    panels = spark.createDataFrame([("p", low + g) for g in range(0, 40, 8)], "panel string, gene_id bigint")
    free = [low + g for g in range(40) if g % 8]
    key = lambda g, n: (g * 7919 + n * 104729) * (g * 31 + 17) % 1000003
    want = sorted((n, free[key(low + g, n) % len(free)]) for g in range(0, 40, 8) for n in range(30))
    got = studies.control_sets(panels, bins, 30, portable=True).where("null_id >= 0")
    assert sorted((r["null_id"], r["gene_id"]) for r in got.collect()) == want
    ids = spark.createDataFrame([(i, d) for i in (0, 1, 6_129_000, low, 10**12, 2**40) for d in (0, 999)], "i bigint, d bigint")
    assert all(r["k"] == key(r["i"], r["d"]) for r in ids.select("i", "d", graph.portable_key("i", "d").alias("k")).collect())
    ranked = spark.createDataFrame([(low + g, float(g - 20)) for g in range(40)], "gene_id bigint, score double")
    sets = spark.createDataFrame([("t", low + g) for g in range(30, 40)], "term string, gene_id bigint")
    assert studies.gsea_test(ranked, sets, 20, portable=True).first()["p"] <= 0.1


def test_draws_are_dealt_out_by_their_number(spark, monkeypatch):
    kept, asked, plain = [], [], studies.written
    monkeypatch.setattr(studies, "written", lambda d, n="step": kept.append(n) or plain(d, n))
    monkeypatch.setattr(studies, "tasks", lambda s, rows, most: asked.append(rows) or 3)
    bins = spark.createDataFrame([(g, g % 2) for g in range(60)], "gene_id bigint, bin bigint")
    sets = studies.control_sets(spark.createDataFrame([("p", g) for g in range(7)], "panel string, gene_id bigint"), bins, 40)
    assert sets.count() == 7 * 41 and asked == [7 * 40] and kept == ["bins", "mine", "pools"]
    assert studies.control_sets(spark.createDataFrame([("p", 1)], "panel string, gene_id bigint"), bins, 0).count() == 1


def test_panel_scores_by_matrix_and_by_joins(spark):
    r = np.random.default_rng(5)
    v = spark.createDataFrame([(i, g, float(x)) for i in range(40) for g, x in enumerate(r.poisson(0.7, 60)) if x], "obs_id bigint, gene_id bigint, value double")
    sets = [(p, k, int(g)) for p in "ab" for k in range(-1, 50) for g in r.choice(70, 5)]
    s = spark.createDataFrame(sets, "panel string, null_id bigint, gene_id bigint")
    one, two = ({(x["obs_id"], x["panel"]): (x["effect"], x["p"]) for x in expression.panel_scores(v, s, 50, most).collect()} for most in (10**6, 10))
    assert len(one) == 80 and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_many_sets_do_not_pass_through_the_driver(spark, monkeypatch):
    """Beyond the bound the driver asks for nothing but sizes, a row for each panel and null; cells without a gene of any set have rows."""
    r, taken, plain = np.random.default_rng(6), [], type(spark.range(0)).toPandas
    v = spark.createDataFrame([(i, int(g), float(1 + g % 3)) for i in range(30) for g in {*r.integers(0, 60, 5), 1000}] + [(99, 1000, 1.0)], "obs_id bigint, gene_id bigint, value double")
    s = spark.createDataFrame([(p, k, int(g)) for p in "ab" for k in range(-1, 20) for g in r.choice(60, 6)], "panel string, null_id bigint, gene_id bigint")
    monkeypatch.setattr(type(s), "toPandas", lambda d: taken.append(d.columns) or plain(d))
    found = {(x["obs_id"], x["panel"]): (x["effect"], x["p"]) for x in expression.panel_scores(v, s, 20, 10).collect()}
    assert taken == [["panel", "null_id", "k"]] and len(found) == 62 and found[99, "a"] == (0.0, 1.0)
    assert expression.MOST_SET_ROWS <= 1_000_000


def test_sets_of_a_gene_are_packed():
    r = np.random.default_rng(9)
    lists = [sorted(r.integers(0, 25_025, 143).tolist()), [], [0, 0, 254, 255, 510, 70_000], [7], None, [25_024]]
    full = [x or [] for x in lists]
    codes = expression.packed(np.array(sum(full, [])), np.concatenate([[5], 5 + np.cumsum([len(x) for x in full])]))
    assert len(codes[0].as_py()) < 2 * 143
    codes = pa.array([None if x is None else c for x, c in zip(lists, codes.to_pylist())], pa.binary())
    n, back = expression.unpacked(codes.slice(0))
    assert n.tolist() == [len(x) for x in full] and back.tolist() == sum(full, [])
    n, back = expression.unpacked(codes.slice(2, 2))
    assert back.tolist() == full[2] + full[3] and expression.unpacked(codes.slice(4, 1))[0].tolist() == [0]


def test_labels_are_called_from_one_computation_of_scores(spark, monkeypatch):
    kept, plain = [], expression.written
    monkeypatch.setattr(expression, "written", lambda d, n="step": kept.append(n) or plain(d, n))
    s = spark.createDataFrame([(1, "a", 3.0, 0.001), (1, "b", 2.0, 0.001), (2, "a", 1.0, 0.9), (2, "b", 0.0, 1.0)], "obs_id bigint, panel string, effect double, p double")
    assert sorted(map(tuple, expression.call_labels(s, 0.05).collect())) == [(1, "a", 3.0, 1.0), (2, "Unresolved", None, None)]
    assert kept == ["scores"]


def test_scores_that_cannot_be_labels_are_not_kept(spark, monkeypatch):
    kept, plain = [], expression.written
    monkeypatch.setattr(expression, "written", lambda d, n="step": kept.append(plain(d, n)) or kept[-1])
    s = spark.createDataFrame([(1, "a", 3.0, 0.001), (1, "b", 2.0, 0.3), (2, "a", 1.0, 0.9)], "obs_id bigint, panel string, effect double, p double")
    assert sorted(map(tuple, expression.call_labels(s, 0.05).collect())) == [(1, "a", 3.0, None), (2, "Unresolved", None, None)]
    assert sorted(tuple(r) for r in kept[0].where("p is null or effect is null").collect()) == [(1, "b", None, None), (2, "a", None, None)]


def test_nearest_columns_puts_few_in_order(monkeypatch):
    r, sorted_, plain = np.random.default_rng(8), [], np.lexsort
    d, ids = r.integers(0, 400, (30, 900)).astype(float), r.permutation(900)
    d[0], d[1, 5:], d[2, ::2] = np.inf, np.nan, np.inf
    monkeypatch.setattr(studies.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or plain(keys))
    row, column = studies.nearest_columns(d, ids, 7)
    monkeypatch.undo()
    assert sum(sorted_) < 30 * 30  # 900 a row by a plain sort
    want = [(i, c) for i in range(30) for c in np.lexsort((ids, d[i]))[:7] if np.isfinite(d[i, c])]
    assert list(zip(row, column)) == want


def test_annotation_finds_classes_and_subclasses(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(40):
        x = r.poisson(1.0, 120).astype(float)
        x[:6] += 8 * (i < 20)
        x[6:12] += 8 * (i >= 20)
        x[12:17] += 8 * (i < 10)
        rows += [(i, g, float(v)) for g, v in enumerate(x) if v]
    v = spark.createDataFrame(rows, "obs_id bigint, gene_id bigint, value double")
    p = spark.createDataFrame([("A", None, g) for g in range(6)] + [("B", None, g) for g in range(6, 12)] + [("A1", "A", g) for g in range(12, 17)], "panel string, parent string, gene_id bigint")
    got = {x["obs_id"]: x for x in studies.annotate(v, p, 40, 199).collect()}
    assert sum(got[i]["cls"] == ("A" if i < 20 else "B") for i in range(40)) >= 34
    assert sum(got[i]["subclass"] == "A1" for i in range(10)) >= 8 and all(got[i]["subclass"] == "Unresolved" for i in range(20, 40))


def test_gsea_finds_what_is_on_top(spark):
    ranked = spark.createDataFrame([(g, float(100 - g)) for g in range(200)], "gene_id bigint, score double")
    sets = spark.createDataFrame([("top", g) for g in range(0, 20)] + [("any", g) for g in range(0, 200, 10)], "term string, gene_id bigint")
    got = {r["term"]: r for r in studies.gsea_test(ranked, sets, 60).collect()}
    assert got["top"]["es"] > 0.9 and got["top"]["p"] < 0.05 and got["any"]["p"] > 0.05


def test_decoding_two_kinds_of_trials(spark):
    r = np.random.default_rng(1)
    mix = r.normal(0, 1, (4, 4))
    rows = []
    for t in range(60):
        y = t % 2
        s = r.normal(0, 1, (4, 100)) * np.array([3 if y else 1, 1 if y else 3, 1, 1])[:, None]
        rows += [(0, t, y, c, [float(v) for v in x]) for c, x in enumerate(mix @ s)]
    d = spark.createDataFrame(rows, "subject int, trial int, y int, channel int, samples array<double>")
    assert studies.decode(d).first()["accuracy"] > 0.9


def test_tangent_of_equal_subjects_is_zero(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (50, 3))
    rows = [(s, t, g, float(x[t, g])) for s in range(2) for t in range(50) for g in range(3)]
    got = studies.tangent(spark.createDataFrame(rows, "subject int, t int, region int, value double")).collect()
    assert len(got) == 12 and max(abs(q["value"]) for q in got) < 1e-6


def test_perturbation_is_repeatable(spark):
    p = spark.range(1000).select(F.col("id").alias("obs_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    a, b = (sorted(map(tuple, studies.perturb(p, 0.1, 10.0, seed=s).collect())) for s in (1, 1))
    assert a == b and 850 < len(a) < 950
    x = np.array([q[1] for q in a])
    assert abs(x.mean()) < 1.5 and 8.5 < x.std() < 11.5


def test_small_pieces(spark):
    s = spark.createDataFrame([(1, "m", 3.0), (1, "r", 1.0)], "obs_id int, panel string, effect double")
    assert studies.stage_index(s, "m", "r").first()["maturation"] == 2.0
    t = spark.createDataFrame([("a", float(i), v) for i, v in enumerate([-1.0, 1.0, -1.0, -0.5, 0.5])], "k string, t double, v double")
    assert [r["t"] for r in events.up_crossings(t, ["k"]).orderBy("t").collect()] == [0.5, 3.5]
    v = spark.createDataFrame([(i, 0, float(i // 10) * 100 + i % 10) for i in range(30)], "obs_id bigint, gene_id bigint, value double")
    assert learning.elbow(v, range(2, 7)) == 3
    c = spark.createDataFrame([(0, 0, 1.5), (0, 1, -1.0)], "obs_id bigint, gene_id bigint, count double")
    assert expression.looks_like_counts(c).first()[0] is False


def test_classifiers_learn(spark):
    r = np.random.default_rng(3)
    rows = [(i, g, float(r.normal(2.0 * (i % 2) * (g < 2), 1))) for i in range(160) for g in range(5)]
    v = spark.createDataFrame(rows, "obs_id bigint, gene_id bigint, value double")
    lab = spark.createDataFrame([(i, i % 2, i // 2 % 16) for i in range(160)], "obs_id bigint, label bigint, grp bigint")
    got = {x["shuffle"]: x["balanced_accuracy"] for x in learning.random_forest(v, lab.withColumn("label", F.col("label").cast("string")), trees=20, shuffles=1).collect()}
    assert got[-1] > 0.8 and got[0] < 0.75
    acc = learning.svc_folds(v, lab, 3).agg((F.sum(F.col("n") * F.col("accuracy")) / F.sum("n"))).first()[0]
    assert acc > 0.8


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    o, f, x = fx.obs(spark, sf_dir), fx.features(spark, sf_dir), fx.counts(spark, sf_dir)
    lr = f.where("gene_id < 10").select("obs_id", F.concat(F.lit("i"), "gene_id").alias("interaction"), F.abs("value").alias("value"))
    e = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    small = f.where("gene_id < 14")
    made = {
        "obs": o, "values": f, "few": small, "counts": x, "meta": fx.obs_meta(spark, sf_dir), "genes": fx.var(spark, sf_dir), "lr": lr, "query": e.where("obs_id % 2 = 0"), "ref": e.where("obs_id % 2 = 1"),
        "sets": spark.range(8, 64).select(F.expr("concat('p', id div 8)").alias("panel"), F.explode(F.array(*(F.lit(k).cast("bigint") for k in (-1, 0, 1, 2)))).alias("null_id"), F.col("id").alias("gene_id")).withColumn("gene_id", F.expr("8 + pmod(gene_id - 8 + (null_id + 1) * 13, 56)")),
        "labels": e.select("obs_id", F.col("label").cast("string").alias("label"), (F.col("obs_id") % 20).alias("grp"), F.lit(1.0).alias("age")), "regions": o.select("obs_id", F.col("block").alias("region")),
        "pairs": spark.createDataFrame([(8, 9), (10, 12)], "gene_a bigint, gene_b bigint"), "panels": spark.createDataFrame([("stem", 8), ("stem", 9), ("differentiated", 10), ("quiescent", 11)], "panel string, gene_id bigint"),
        "ranked": fx.var(spark, sf_dir).select("gene_id", "score"), "terms": fx.var(spark, sf_dir).select(F.col("category").alias("term"), "gene_id"),
        "types": small.select(F.concat(F.lit("T"), (F.col("obs_id") % 3).cast("string")).alias("type"), "gene_id", F.abs("value").alias("value")).groupBy("type", "gene_id").agg(F.avg("value").alias("value")),
        "spikes": fx.spikes(spark, sf_dir), "signal": fx.signal(spark, sf_dir).select(F.col("region").alias("channel"), F.col("t").alias("i"), "value"), "series": fx.signal(spark, sf_dir),
    }
    for k, v in made.items():
        v.write.parquet(str(d / k))
    (d / "e.csv").write_text("id,g1,g2\na,1,2\nb,3,4\n")
    (d / "c.csv").write_text("id,x,y\na,0,1\nb,2,3\n")
    (d / "m.csv").write_text("id,kind\na,u\nb,v\n")
    (d / "n.swc").write_text("1 1 0 0 0 5 -1\n2 3 10 0 0 1 1\n3 3 20 0 0 1 2\n")
    return d


SKILLS = {
    "core.inspect": {"input": "genes"}, "core.figures": {"obs": "obs"}, "core.load_triplet": {"expression": "e.csv", "coordinates": "c.csv", "metadata": "m.csv"}, "core.preprocess": {"counts": "counts", "min_cells": 2, "min_genes": 2},
    "atlas.annotate": {"values": "values", "sets": "sets", "n_null": 3, "alpha": 5.0}, "spatial3d.reconstruct": {"obs": "obs"}, "spatial3d.domains": {"obs": "obs", "values": "few", "n_domains": 3, "n_pcs": 3}, "spatial3d.svg": {"obs": "obs", "values": "few", "n_permutations": 5},
    "spatial3d.niches": {"obs": "obs", "n_niches": 3}, "spatial3d.communication": {"obs": "obs", "ligands": "lr", "receptors": "lr", "n_permutations": 5}, "stats.replicate_de": {"counts": "counts", "meta": "meta", "a": "F", "b": "O", "min_cells": 2},
    "legacy.region_de": {"values": "values", "regions": "regions"}, "legacy.grn": {"values": "values", "pairs": "pairs", "threshold": 0, "fdr": 1.1}, "legacy.development": {"values": "values", "panels": "panels"}, "legacy.trajectory": {"obs": "obs", "root": 0},
    "legacy.ml": {"values": "few", "labels": "labels", "shuffles": 0}, "legacy.enrichment": {"ranked": "ranked", "sets": "terms"}, "legacy.misc": {"values": "few", "reference": "types"}, "organoid.fidelity": {"query": "query", "reference": "ref", "labels": "labels"},
    "ephys.spikes": {"spikes": "spikes", "window": 86400}, "ephys.eeg_bandpower": {"signal": "signal", "fs": 250}, "modeling.hh": {"currents": "0,10", "ms": 100}, "modeling.network": {"runs": 1, "ms": 150}, "morphology.swc": {"input": "n.swc"}, "imaging.connectome": {"series": "series"},
}


@pytest.mark.parametrize("name", sorted(SKILLS))
def test_every_skill_runs(spark, files, tmp_path, name):
    known = set(skills.get(name).properties)
    given = {k: str(files / v) if isinstance(v, str) and (files / v).exists() else v for k, v in SKILLS[name].items()}
    assert set(given) <= known
    r = skills.run(spark, name, given, tmp_path, origin="synthetic")
    assert r["status"] == "ok" and (r["results"].get("rows") or 0) > 0 and (tmp_path.glob("*/run.log"))


def test_all_skills_are_tried():
    assert set(SKILLS) == set(skills.discover())


def test_bundle(spark, sf_dir, tmp_path):
    from lamina.sources import bundle

    o = fx.obs(spark, sf_dir)
    obs = o.select("obs_id", F.lit("one").alias("donor"), F.when(F.col("block") != "m0", F.col("block")).alias("batch"))
    spatial = o.select("obs_id", F.array("x", "y").alias("value"))
    b = bundle.Bundle(obs, spark.createDataFrame([(8, "A"), (9, "B")], "gene_id bigint, gene_name string"), fx.features(spark, sf_dir).where("gene_id < 10").withColumn("count", F.lit(1)), {"spatial": spatial}, {"a": 1, "x_colors": 2})
    got = {r["block"] for r in b.blocks().select("block").distinct().collect()}
    assert got == {"Unknown", "m1", "m2"} and {r["block"] for r in b.blocks("donor").select("block").distinct().collect()} == {"one"}
    bundle.Bundle(b.blocks(), b.var, b.x, b.obsm, b.uns).write(str(tmp_path / "b"))
    c = bundle.read(spark, str(tmp_path / "b"))
    assert c.uns == {"a": 1} and c.expression().count() == b.x.count() and c.counts().agg(F.max("count")).first()[0] == 1.0
    assert {r["symbol"] for r in c.symbols().collect()} == {"A", "B"}
    p = c.points().select("x", "z").first()
    assert p["z"] == 0.0 and p["x"] is not None and "PartitionFilters: [isnotnull(block" in c.x.where("block = 'm1'")._jdf.queryExecution().toString()
    with pytest.raises(KeyError):
        c.expression("none")
    np.savez(tmp_path / "s.npz", timeseries=np.arange(12.0).reshape(2, 3, 2), labels=np.array(["u", "v"]))
    s, lab = bundle.read_npz(spark, str(tmp_path / "s.npz"))
    assert s.count() == 12 and s.agg(F.max("value")).first()[0] == 11.0 and lab.count() == 2


def test_registered_plans_have_all_sets_and_pairs(spark, sf_dir):
    plans = catalogue.queries()
    sets = plans["matched_control_sets"](spark, sf_dir)
    assert sets.where("null_id >= 0").select("null_id").distinct().count() == 1000
    got = plans["context_network"](spark, sf_dir)
    assert got.count() == 56 * 55 // 2 and got.where("gene_a >= gene_b").isEmpty()


def test_registered_models_are_whole(spark, sf_dir, monkeypatch):
    trees, rounds = [], []
    forest, svc = learning.RandomForestClassifier, learning.LinearSVC
    monkeypatch.setattr(learning, "RandomForestClassifier", lambda **k: trees.append(k["numTrees"]) or forest(**k))
    monkeypatch.setattr(learning, "LinearSVC", lambda **k: rounds.append(k["maxIter"]) or svc(**k))
    plans = catalogue.queries()
    assert sorted(r["shuffle"] for r in plans["forest_accuracy"](spark, sf_dir).collect()) == list(range(-1, 20))
    assert trees == [50] * 21
    assert plans["svc_accuracy"](spark, sf_dir).count() == 3 and rounds == [50] * 3


def test_registered_gsea_has_all_shuffles(spark, sf_dir, monkeypatch):
    asked = []
    real = studies.gsea_test
    monkeypatch.setattr(studies, "gsea_test", lambda ranked, sets, n_perm, **k: asked.append(n_perm) or real(ranked, sets, n_perm, **k))
    assert catalogue.queries()["gsea_permutation"](spark, sf_dir).count() > 0 and asked == [1000]


def test_all_shuffles_of_a_forest_are_one_table(spark, monkeypatch):
    tables, write = [], learning.written

    def seen(df, name="step"):
        out = write(df, name)
        tables.append((name, out.collect()))
        return out

    monkeypatch.setattr(learning, "written", seen)
    v = spark.createDataFrame([(i, g, float((i * 7 + g) % 11)) for i in range(60) for g in range(2)], "obs_id bigint, gene_id bigint, value double")
    lab = spark.createDataFrame([(i, "ab"[i % 3 == 0], i % 10) for i in range(60)], "obs_id bigint, label string, grp bigint")
    got = learning.random_forest(v, lab, trees=3, shuffles=4).collect()
    assert sorted(r["shuffle"] for r in got) == [-1, 0, 1, 2, 3] and all(0 <= r["balanced_accuracy"] <= 1 for r in got)
    assert [n for n, _ in tables].count("shuffled") == 1 and len(tables) == 2
    ys = np.array([r["ys"] for r in tables[-1][1]])
    assert ys.shape == (60, 5) and (np.sort(ys, 0) == np.sort(ys[:, :1], 0)).all() and len({tuple(c) for c in ys.T}) == 5
