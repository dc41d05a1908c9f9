"""Every registered plan runs, and gives the rows of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lamina import catalogue

PLANS, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    a, b = canon(PLANS[name](spark, sf_dir).toPandas()), canon(duck.sql(SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert [str(x) for x in a.dtypes] == [str(x) for x in b.dtypes]
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert PLANS[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 56


def test_components_write_no_more_as_paths_grow_longer(spark, monkeypatch):
    import numpy as np

    from lamina.operators import graph

    rows, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="step": (lambda out: rows.append(out.count()) or out)(write(df, name)))
    n = 4096
    ids = np.random.default_rng(5).permutation(n).tolist()
    edges = [(ids[i], ids[i + 1]) for i in range(n - 1) if i != 999] + [(n, n), (n + 2, n + 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    first, second = ids[:1000], ids[1000:]
    want = {i: min(first) for i in first} | {i: min(second) for i in second} | {n: n, n + 1: n + 1, n + 2: n + 1}
    assert got == want
    assert sum(rows) < 11 * n


def test_products_of_pairs_are_summed_without_sending_arrays_along(spark):
    """chunks of points go to cells of pairs; no join puts the arrays of both ends beside a pair, whatever the size of the arrays."""
    import numpy as np

    from lamina.operators import graph

    r = np.random.default_rng(2)
    v = r.normal(size=(40, 5))
    ends = [spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "obs_id bigint, v array<double>") for m in (v, v * v)]
    rows = [(int(k % 3), "xy"[k % 2], int(a), int(b), float(w)) for k, (a, b, w) in enumerate(zip(r.integers(0, 42, 600), r.integers(0, 42, 600), r.integers(1, 4, 600)))]
    pairs = spark.createDataFrame(rows, "perm int, kind string, a bigint, b bigint, w double")
    sums = graph.product_sums(pairs, *ends, 5, ["perm", "kind"], at_once=3, chunk=15)
    assert "Join" not in sums._jdf.queryExecution().executedPlan().toString()
    want = {}
    for p, k, a, b, w in rows:
        if a < 40 and b < 40:
            want[p, k] = want.get((p, k), 0) + w * v[a] * v[b] * v[b]
    got = {(x["perm"], x["kind"], x["i"]): x["s"] for x in sums.collect()}
    assert len(got) == 30 and all(abs(got[p, k, i] - s[i]) < 1e-9 for (p, k), s in want.items() for i in range(5))


def test_units_are_filled_without_a_grid_and_libraries_without_windows(spark):
    """no task has all genes of a unit, and a gene's units come from its own row."""
    import math

    from lamina.operators import stats

    rows = [("u1", "F", 1, 3.0), ("u1", "F", 2, 1.0), ("u1", "O", 1, 2.0), ("u2", "F", 2, 4.0), ("u2", "O", 2, 4.0), ("u3", "O", 3, 5.0), ("u3", "X", 4, 5.0)]
    bulk = spark.createDataFrame(rows, "unit string, grp string, gene_id int, total double")
    units = stats.dense_units(stats.log_cpm(bulk), "F", "O")
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "CartesianProduct", "SortMergeJoin")) and plan.count("hashpartitioning(gene_id") == 1
    size = {("u1", "F"): 4.0, ("u1", "O"): 2.0, ("u2", "F"): 4.0, ("u2", "O"): 4.0, ("u3", "O"): 5.0}
    at = {r[:3]: r[3] for r in rows}
    value = lambda u, g, k: pytest.approx(math.log1p(at.get((u, g, k), 0.0) / size[u, g] * 1e6)) if (u, g) in size else None
    got = {(r["unit"], r["gene_id"]): (r["va"], r["vb"]) for r in units.collect()}
    assert set(got) == {(u, k) for u in ("u1", "u2", "u3") for k in (1, 2, 3)}
    assert all(va == value(u, "F", k) and vb == value(u, "O", k) for (u, k), (va, vb) in got.items())


def test_thinning_needs_no_arrays_for_small_counts(spark):
    """steps are bisected in batches; counts join no table of steps and are not filtered against one step by step."""
    from lamina.operators import resampling

    df = spark.range(300).select("id", (F.col("id") * 3).cast("double").alias("count")).unionByName(spark.createDataFrame([(-1, None), (-2, -4.0)], "id bigint, count double"))
    out = resampling.thin(df, 0.3, ["id"], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "filter(" not in plan.lower()
    got = {r["id"]: r["thinned"] for r in out.collect()}
    assert got[-1] is None and got[-2] is None and got[0] == 0 and all(0 <= got[i] <= 3 * i for i in range(300)) and 0.28 < sum(got[i] for i in range(300)) / (3 * 299 * 150) < 0.32


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, monkeypatch):
    """texts are read once, and a document's scores are added up in the task that has its words."""
    import re

    from lamina.operators import text

    monkeypatch.setattr(text, "written", lambda d, name="step": spark.createDataFrame(d.collect(), d.schema))
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "nothing here")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "fox RED"), (8, "absent")], "query_id bigint, text string")
    out = text.bm25(docs, queries)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#", plan)
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in out.orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """folds share one table and do not wait for each other."""
    import threading

    from lamina.operators import learning

    both, real = threading.Barrier(2, timeout=60), learning.LinearSVC

    class Waiting:
        def __init__(self, **k):
            self.model = real(**k)

        def fit(self, d):
            both.wait()
            return self.model.fit(d)

    monkeypatch.setattr(learning, "LinearSVC", Waiting)
    labels = spark.range(80).select(F.col("id").alias("obs_id"), (F.col("id") % 2).alias("label"), F.floor(F.col("id") / 4).alias("grp"))
    values = labels.select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("gene_id"), (F.col("label") * 2.0 - 1 + F.col("obs_id") / 1000).alias("value"))
    got = learning.svc_folds(values, labels, 2).collect()
    assert sorted(r["fold"] for r in got) == [0, 1] and sum(r["n"] for r in got) == 80 and all(r["accuracy"] == 1 for r in got)


def test_counts_go_by_cell_into_tasks_of_few_lines(spark, sf_dir, monkeypatch):
    """what a task of counts holds is bounded by lines, and sums by cell take no other shuffle."""
    from lamina.sources import fixtures

    lines = fixtures.read(spark, sf_dir, "lineitem")
    monkeypatch.setattr(fixtures, "LINES", 500)
    counts = fixtures.counts(spark, sf_dir)
    assert counts.rdd.getNumPartitions() == -(-lines.count() // 500)
    want = lines.groupBy("l_orderkey", "l_partkey").agg({"l_quantity": "sum"})
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    plan = counts.groupBy("obs_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
