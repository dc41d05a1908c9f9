"""Fixed-block anchors and delta Lloyd against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import centroids, fixed_blocks

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_repeats(rows, window=13):
    """Sorted (doc_id, n_words, n_removed, kept) by looking at every window of every document."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - window + 1) if i is not None and least[tuple(w[s : s + window])] < i for p in range(s, s + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def results(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def passages():
    """Texts that share passages at all alignments, with lengths around the window, at starts and ends, and chains over three documents."""
    r = random.Random(3)
    shared = [prose(n, 50 + n).split() for n in (12, 13, 14, 20, 33, 80)]
    out = []
    for i in range(60):
        w = prose(r.randrange(0, 40), 1000 + i).split()
        for s in r.sample(shared, 2):
            w += s[r.randrange(3) if len(s) > 14 else 0 :] + prose(r.randrange(0, 9), 2000 + i).split()
        out.append((" " if i % 2 else "\n\t").join(w))
    return out


@pytest.mark.parametrize(("window", "slices"), [(13, 3), (13, 1), (6, 2), (1, 1)])
def test_repeats_match_brute_force(make, edge_texts, window, slices):
    texts = [*passages(), *edge_texts]
    ids = [*range(100, 100 + len(texts))]
    ids[3], ids[4], ids[10], ids[11] = ids[5], ids[5], None, None
    docs = make(texts, ids).union(make(texts[:3], ids[:3]))
    got = fixed_blocks.remove_repeats(docs, window, slices)
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    assert results(got) == brute_repeats([*zip(ids, texts, strict=True), *zip(ids[:3], texts[:3], strict=True)], window)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] and all(s["length"] >= window for s in r["spans"]) for r in got.collect())


def test_repeats_by_sql(make, edge_texts):
    docs = make([*passages(), *edge_texts])
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    want = sorted(duckdb.connect().sql(fixed_blocks.oracle_sql()).fetchall(), key=str)
    assert sorted(map(tuple, fixed_blocks.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str) == want


def test_a_passage_in_every_document(make):
    shared = prose(20, 7)
    texts = [f"{'own ' * (i % 9)}b{i} {shared} e{i} {prose(5, 500 + i)}" for i in range(300)]
    rows = fixed_blocks.remove_repeats(make(texts)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in rows] == [0] + [20] * 299


def test_repeats_of_an_empty_table(make):
    assert fixed_blocks.remove_repeats(make([])).count() == 0
    assert fixed_blocks.remove_repeats(make([None, ""])).select("n_words", "kept").distinct().collect() == [(0, "")]


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(fixed_blocks, "BYTES", 50)
    texts = [None, "", "a bc", "  x y é\x1fz ", "ab " * 99, "q" * 300, "b a"]
    small = fixed_blocks.Words(pa.array(texts))
    h = small.hashes(0)
    monkeypatch.undo()
    assert (fixed_blocks.Words(pa.array(texts)).hashes(0) == h).all()
    want = [w for t in texts for w in WORD.findall(t or "")]
    assert [small.data[a:b].tobytes().decode() for a, b in zip(small.start, small.stop, strict=True)] == want
    assert len(set(h.tolist())) == len(set(want)) and small.count.tolist() == [len(WORD.findall(t or "")) for t in texts]


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, `a.b` string"


def vectors(n, dims=64, seed=1, odd=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=(9, dims))[r.integers(0, 9, n)] * 0.1 + r.normal(size=(n, dims)) * 0.05
    rows = [(i, v, 1, "c", "d") for i, v in enumerate(x.astype(np.float32).tolist())]
    if odd and n > 5:
        rows += [(None, rows[0][1], 1, "c", "d"), rows[1], rows[1], (1, rows[2][1], 1, "c", "d"), (n, [0.0] * dims, None, None, None), (n + 1, [3000.0, *[-0.001] * (dims - 1)], 1, "c", "d")]
        bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None, *[0.5] * (dims - 1)], [float("nan"), *[0.5] * (dims - 1)], [float("-inf"), *[0.5] * (dims - 1)]]
        rows += [(n + 2 + i, v, 1, "c", "d") for i, v in enumerate(bad)]
    return rows


def brute_lloyd(rows, k, rounds, dims):
    """Plain Lloyd rounds in Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    by = [sum(d for d, o in last if o == n) for n in range(len(cents))]
    return sorted(((i, o, d, by[o], sum(by), ",".join(map(str, cents[o]))) for (i, _), (d, o) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize(("n", "k", "dims"), [(200, 7, 64), (3, 7, 64), (120, 40, 5), (0, 4, 64)])
def test_delta_lloyd_matches_plain_rounds(spark, n, k, dims):
    rows = vectors(n, dims)
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=k, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    got = sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], ",".join(map(str, r["centroid"]))) for r in got.collect()), key=str)
    assert got == brute_lloyd(rows, k, 5, dims)


def test_delta_lloyd_by_sql(spark):
    df = spark.createDataFrame(vectors(300), VECTORS)
    embeddings = df.select("vec_id", "embedding").toArrow()  # noqa: F841
    want = sorted(duckdb.connect().sql(centroids.oracle_sql()).fetchall(), key=str)
    got = centroids.cluster(df).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], centroids.centroid_sha256(r["centroid"])) for r in got), key=str) == want


def test_only_what_changed_is_compared(spark):
    """A vector in a cluster that stayed takes its old distance as it is and sees changed centroids only."""
    state = spark.createDataFrame([(0, [0] * 4, 0, 7), (1, [9] * 4, 1, 0), (2, [5] * 4, 2, 50)], "vec_id bigint, v array<int>, cluster int, distance bigint")
    cents = np.array([[100] * 4, [9] * 4, [8] * 4])
    rows = {r["vec_id"]: (r["cluster"], r["distance"], r["was"]) for r in centroids.assigned(state, cents, np.array([False, False, True])).collect()}
    assert rows == {0: (0, 7, 0), 1: (1, 0, 1), 2: (2, 36, 2)}
    moves = {r["at"]: (r["n"], r["s0"]) for r in centroids.transfers(spark.createDataFrame([([3] * 4, 1, 0), ([4] * 4, 1, -1), ([5] * 4, 0, 0)], "v array<int>, cluster int, was int"), 4)}
    assert moves == {0: (-1, -3), 1: (2, 7)}
