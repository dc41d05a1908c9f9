"""The HDF5 data source on files of a small writer of the format."""

import numpy as np
import pytest

from lamina.sources import hdf5
from lamina.sources.hdf5 import File

from .hdf5_writer import Data, Group, write

R = np.random.default_rng(1)


def sparse(n, m, density=0.2, seed=0):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, m)) < density, r.integers(1, 9, (n, m)), 0)
    x[n // 2] = 0
    return x


def compressed(x, **options):
    """data, indices and indptr of the rows of a matrix."""
    rows, cols = np.nonzero(x)
    return {
        "data": Data(x[rows, cols].astype("f4"), **options), "indices": Data(cols.astype("i4"), **options),
        "indptr": Data(np.concatenate([[0], np.cumsum((x != 0).sum(1))]).astype("i8")),
    }


@pytest.mark.parametrize("dtype", ["<i4", ">i2", "u1", "<f8", ">f4", "<f4"])
@pytest.mark.parametrize("how", [{}, {"compact": True}, {"chunks": (7, 3)}, {"chunks": (4, 5), "filters": True}])
def test_rows_of_all_layouts(tmp_path, dtype, how):
    v = R.integers(0, 100, (53, 11)).astype(dtype)
    write(tmp_path / "a.h5", {"deep": {"er": {"v": Data(v, **how)}}})
    f = File(str(tmp_path / "a.h5"))
    node = f.find("deep/er/v")
    for a, b in ((0, 53), (0, 1), (6, 8), (50, 99), (20, 20)):
        assert (f.rows(node, a, b) == v[a:b].astype(float)).all() and f.rows(node, a, b).shape[1] == 11


def test_only_chunks_of_the_rows_are_read(tmp_path):
    v = R.random((400, 30))
    write(tmp_path / "a.h5", {"v": Data(v, chunks=(20, 500), fan=3)})
    f = File(str(tmp_path / "a.h5"))
    assert (f.rows(f.find("v"), 105, 131) == v[105:131]).all()
    assert [n for _, n in f.bytes.large] == [20 * 500 * 8] * 2
    w = Data(np.ones((40, 2)), chunks=(10, 2), skip={(10, 0)})
    write(tmp_path / "b.h5", {"v": w})
    g = File(str(tmp_path / "b.h5"))
    assert g.rows(g.find("v"), 5, 25).sum(1).tolist() == [2.0] * 5 + [0.0] * 10 + [2.0] * 5


def test_arrays_in_parts(spark, tmp_path):
    path = str(tmp_path / "a.h5")
    v, words = R.random((90, 4)), [f"wörd {i}" * (i % 4) for i in range(50)]
    write(path, {"v": Data(v, chunks=(8, 2), filters=True), "w": words, "s": Data(["ab", "c", ""], fixed=True), "b": np.array([True, False]), "none": np.zeros(0)})
    d = hdf5.read(spark, path, "array", "v", partition=20)
    assert d.rdd.getNumPartitions() == 4 and d.dtypes == [("i", "bigint"), ("j", "bigint"), ("value", "double")]
    assert sorted(map(tuple, d.collect())) == [(i, j, v[i, j]) for i in range(90) for j in range(4)]
    assert sorted(r["i"] for r in hdf5.read(spark, path, "array", "v", start=30, stop=33).where("j = 1").collect()) == [30, 31, 32]
    assert [r["value"] for r in hdf5.read(spark, path, "array", "w").orderBy("i").collect()] == words
    assert [r["value"] for r in hdf5.read(spark, path, "array", "s").orderBy("i").collect()] == ["ab", "c", ""]
    assert [r["value"] for r in hdf5.read(spark, path, "array", "b").orderBy("i").collect()] == [True, False]
    assert hdf5.read(spark, path, "array", "none").count() == 0
    with pytest.raises(KeyError, match="there are b, none, s, v, w"):
        File(path).find("x")
    with pytest.raises(ValueError, match="no HDF5"):
        File(__file__)


def test_an_annotated_matrix(spark, tmp_path):
    path = str(tmp_path / "a.h5ad")
    x, counts, xy = sparse(37, 12), sparse(37, 12, 0.3, 1), R.random((37, 2))
    layer = [("A", "B")[i % 2] for i in range(37)]
    obs = Group({"_index": [f"c{i}" for i in range(37)], "n": np.arange(37), "ok": np.arange(37) % 3 == 0, "layer": Group({"codes": np.where(np.arange(37) == 5, -1, np.arange(37) % 2).astype("i1"), "categories": ["A", "B"]})}, **{"_index": "_index", "column-order": ["layer", "n", "ok"]})
    var = Group({"_index": [f"g{i}" for i in range(12)], "symbol": [f"S{i}" for i in range(12)]}, **{"_index": "_index"})
    write(path, {
        "obs": obs, "var": var, "X": Group(compressed(x, chunks=(50,), filters=True), **{"encoding-type": "csr_matrix"}),
        "layers": {"counts": Group(compressed(counts.T), **{"encoding-type": "csc_matrix"}), "dense": Data(x * 2.0, chunks=(10, 12))}, "obsm": {"spatial": xy},
    })
    b = hdf5.read_h5ad(spark, path)
    got = {(r["obs_id"], r["gene_id"]): (r["value"], r["count"], r["dense"]) for r in b.x.collect()}
    want = {(i, j): (x[i, j], counts[i, j], 2 * x[i, j]) for i in range(37) for j in range(12) if x[i, j] or counts[i, j]}
    assert got == want
    rows = b.obs.orderBy("obs_id").collect()
    assert [r["layer"] for r in rows] == [None if i == 5 else v for i, v in enumerate(layer)] and [r["ok"] for r in rows][:4] == [True, False, False, True]
    assert b.obs.columns == ["obs_id", "_index", "layer", "n", "ok"] and rows[3]["_index"] == "c3"
    assert [r["symbol"] for r in b.symbols().orderBy("gene_id").collect()] == [f"S{i}" for i in range(12)]
    assert [(r["x"], r["y"], r["z"]) for r in b.points().orderBy("obs_id").collect()] == [(*map(float, p), 0.0) for p in xy]
    d = hdf5.matrix(spark, path, "X", partition=10)
    assert d.rdd.getNumPartitions() == 4 and {(r["row"], r["col"]): r["value"] for r in d.collect()} == {(i, j): x[i, j] for i, j in zip(*np.nonzero(x))}


def test_units_and_barcodes(spark, tmp_path):
    path = str(tmp_path / "a.nwb")
    trains = [np.sort(R.random(n)) for n in (4, 0, 9, 1)]
    write(path, {"units": {"id": np.arange(4), "spike_times": Data(np.concatenate(trains), chunks=(5,), filters=True), "spike_times_index": np.cumsum([len(t) for t in trains]).astype("u1")}})
    units = hdf5.read_units(spark, path)
    assert sorted(map(tuple, units.select("unit", "event_id", "t").collect())) == [(u, i, t) for u, train in enumerate(trains) for i, t in enumerate(train)]
    assert sorted(map(tuple, hdf5.read(spark, path, "ragged", "units/spike_times", partition=1, start=2).collect())) == [(u, i, t) for u in (2, 3) for i, t in enumerate(trains[u])]
    x = sparse(20, 6)
    tenx = str(tmp_path / "m.h5")
    write(tenx, {"matrix": {**compressed(x), "barcodes": [f"b{i}" for i in range(20)], "shape": np.array([6, 20]), "features": {"id": [f"E{i}" for i in range(6)], "name": [f"N{i}" for i in range(6)]}}})
    b = hdf5.read_10x(spark, tenx)
    assert {(r["obs_id"], r["gene_id"]): r["count"] for r in b.counts().collect()} == {(i, j): x[i, j] for i, j in zip(*np.nonzero(x))}
    assert b.obs.where("obs_id = 3").first()["barcode"] == "b3" and b.symbols().where("gene_id = 2").first()["symbol"] == "N2"
