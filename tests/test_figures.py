"""Pixels, bars and cells against plain versions; files that are well formed."""

import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pytest

from lamina import figures
from lamina.operators import raster

SVG = "{http://www.w3.org/2000/svg}"


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(0)
    rows = [(f"s{i % 3}", float(x), float(y), "abc"[i % 7 % 3], float(i % 5)) for i, (x, y) in enumerate(r.uniform(0, 100, (600, 2)))]
    rows += [("s1", None, 1.0, "a", 1.0), ("s1", float("nan"), 1.0, "a", 1.0), ("s2", 5.0, 5.0, None, float("nan")), ("lone", 3.0, 4.0, "<&>", 2.0), (None, 1.0, 1.0, "a", None)]
    return rows, spark.createDataFrame(rows, "section string, x double, y double, label string, value double")


def test_pixels_equal_a_plain_version(points):
    rows, df = points
    good = [r for r in rows if r[1] is not None and r[1] == r[1]]
    want_label, want_mean = {}, {}
    for s in {r[0] for r in good}:
        mine = [r for r in good if r[0] == s]
        x0, y0 = min(r[1] for r in mine), min(r[2] for r in mine)
        side = max(max(r[1] for r in mine) - x0, max(r[2] for r in mine) - y0)
        for r in mine:
            at = (s, *(min(int((v - o) / side * 8), 7) if side else 0 for v, o in ((r[1], x0), (r[2], y0))))
            if r[3] is not None:
                want_label.setdefault(at, []).append(r[3])
            if r[4] is not None and r[4] == r[4]:
                want_mean.setdefault(at, []).append(r[4])
    got = {(r["section"], r["px"], r["py"]): (r["n"], r["value"]) for r in raster.pixels(df, "label", 8).collect()}
    assert got == {k: (len(v), min(set(v), key=lambda x: (-v.count(x), x))) for k, v in want_label.items()}
    got = {(r["section"], r["px"], r["py"]): r["value"] for r in raster.pixels(df, "value", 8).collect()}
    assert set(got) == set(want_mean) and all(got[k] == pytest.approx(np.mean(v)) for k, v in want_mean.items())
    assert {r["section"] for r in raster.pixels(df, "label", 8, panels=2).collect()} == {None, "lone"}


def test_cells_and_bars(points):
    rows, df = points
    assert [tuple(r) for r in raster.largest(df, "label", 2).collect()] == sorted(((k, sum(r[3] == k for r in rows)) for k in "abc"), key=lambda t: (-t[1], t[0]))[:2]
    got = {(r["row"], r["column"]): r["value"] for r in raster.cells(df, "label", "section", most=3).collect()}
    assert set(got) == {(a, s) for a in "abc" for s in ("s0", "s1", "s2")} and sum(got.values()) == 602
    mean = {(r["row"], r["column"]): r["value"] for r in raster.cells(df, "label", "section", "value").collect()}
    assert mean["<&>", "lone"] == 2.0 and mean["a", "s0"] == pytest.approx(np.mean([r[4] for r in rows if r[0] == "s0" and r[3] == "a"]))


def test_a_png_reads_back():
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    data = figures.png(image)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + size
    assert list(parts) == [b"IHDR", b"IDAT", b"IEND"] and struct.unpack(">IIBBBBB", parts[b"IHDR"]) == (7, 5, 8, 2, 0, 0, 0)
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(5, 22)
    assert (lines[:, 0] == 0).all() and (lines[:, 1:].reshape(5, 7, 3) == image).all()


def test_figures_are_well_formed(points):
    _, df = points
    made = [figures.panels(df, "label", "a < b", width=32), figures.panels(df, "value", width=32), figures.bars(df, "label"), figures.heatmap(df, "label", "section", "value", centre=2.0), figures.heatmap(df, "label", "section")]
    roots = [ET.fromstring(x) for x in made]
    assert len(roots[0].findall(f"{SVG}image")) == 5 and "<&>" in [t.text for t in roots[0].findall(f"{SVG}text")]
    assert len(roots[2].findall(f"{SVG}rect")) == 1 + 4
    empty = df.limit(0)
    for x in (figures.panels(empty, "label"), figures.panels(empty, "value"), figures.bars(empty, "label"), figures.heatmap(empty, "label", "section")):
        ET.fromstring(x)
    assert len(set(figures.palette(30))) == 30
    assert (figures.scale(np.array([0.0, 1.0]), 0, 1) == [figures.RISING[0], figures.RISING[-1]]).all()
