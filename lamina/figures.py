"""Figures without a plotting library: pixels, bars and cells that Spark has added up become PNG and SVG. What comes to the driver is bounded by the size of the picture."""

from __future__ import annotations

import base64
import colorsys
import struct
import zlib
from html import escape

import numpy as np
from pyspark.sql import DataFrame

from lamina.operators import raster

PANEL, GAP, TEXT = 256, 24, 'font-family="sans-serif" font-size="12"'
#: Corners of the scales from least to greatest (red, green, blue).
RISING = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
AROUND = ((33, 102, 172), (247, 247, 247), (178, 24, 43))


def palette(n: int) -> list[tuple[int, int, int]]:
    """n colours, each a golden angle of hue after the one before, in three tones."""
    return [tuple(round(255 * v) for v in colorsys.hsv_to_rgb(k * 0.618034 % 1, (0.85, 0.6, 0.75)[k % 3], (0.8, 0.9, 0.6)[k % 3])) for k in range(n)]


def scale(values: np.ndarray, low: float, high: float, corners: tuple = RISING) -> np.ndarray:
    """Colours (n, 3) of values between low and high."""
    at = np.clip((np.asarray(values, float) - low) / (high - low if high > low else 1.0), 0, 1)
    knots = np.linspace(0, 1, len(corners))
    return np.stack([np.interp(at, knots, [c[k] for c in corners]) for k in range(3)], -1).round().astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A PNG of (height, width, 3) bytes."""
    h, w = image.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, -1)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 9)) + part(b"IEND", b"")


def _svg(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" {TEXT}>\n<rect width="100%" height="100%" fill="white"/>\n' + "\n".join(parts) + "\n</svg>\n"


def _text(x: float, y: float, words: object, more: str = "") -> str:
    return f'<text x="{x:g}" y="{y:g}" {more}>{escape(str(words))}</text>'


def _hex(c) -> str:
    return "#%02x%02x%02x" % tuple(int(v) for v in c)


def _bar_of_colours(x: float, y: float, low: float, high: float, corners: tuple) -> list[str]:
    image = base64.b64encode(png(scale(np.linspace(high, low, 64), low, high, corners)[:, None])).decode()
    return [f'<image x="{x:g}" y="{y:g}" width="14" height="128" preserveAspectRatio="none" href="data:image/png;base64,{image}"/>', _text(x + 20, y + 10, f"{high:.4g}"), _text(x + 20, y + 128, f"{low:.4g}")]


def panels(points: DataFrame, value: str, title: str = "", by: str = "section", width: int = PANEL, most: int = 12) -> str:
    """SVG of the first `most` sections, points drawn as pixels by the mean of a number or the most frequent label; one scale or legend for all."""
    got = raster.pixels(points, value, width, by, most).toPandas()  # most x width^2 rows at most
    names = sorted(got[by].unique(), key=str)
    labels = points.schema[value].dataType.typeName() in ("string", "boolean")
    if labels:
        kinds = sorted(got["value"].unique())
        colours = np.array(palette(len(kinds)), np.uint8).reshape(-1, 3)[np.searchsorted(kinds, got["value"])] if kinds else np.empty((0, 3), np.uint8)
    else:
        v = got["value"].to_numpy(float)
        low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 1.0)
        colours = scale(v, low, high)
    across = max(1, min(4, len(names)))
    parts, top = [_text(8, 18, title, 'font-weight="bold"')], 30
    for k, name in enumerate(names):
        mine = (got[by] == name).to_numpy() if name is not None else got[by].isna().to_numpy()
        image = np.full((width, width, 3), 255, np.uint8)
        image[got["py"].to_numpy()[mine], got["px"].to_numpy()[mine]] = colours[mine]
        x, y = 8 + k % across * (PANEL + GAP), top + k // across * (PANEL + GAP)
        parts += [_text(x, y + 12, name), f'<image x="{x}" y="{y + 16}" width="{PANEL}" height="{PANEL}" style="image-rendering:pixelated" href="data:image/png;base64,{base64.b64encode(png(image)).decode()}"/>']
    x = 8 + across * (PANEL + GAP)
    if labels:
        for k, (kind, c) in enumerate(zip(kinds, palette(len(kinds)), strict=True)):
            parts += [f'<rect x="{x}" y="{top + 18 * k}" width="12" height="12" fill="{_hex(c)}"/>', _text(x + 18, top + 11 + 18 * k, kind)]
    else:
        parts += _bar_of_colours(x, top + 16, low, high, RISING)
    rows = max(1, -(-len(names) // across))
    return _svg(x + 160, top + max(rows * (PANEL + GAP), 18 * len(kinds) if labels else 0) + 16, parts)


def bars(rows: DataFrame, name: str, title: str = "", top: int = 25) -> str:
    """SVG of the `top` most frequent values, the largest first."""
    got = raster.largest(rows, name, top).collect()
    most = max([r["n"] for r in got], default=1)
    parts = [_text(8, 18, title, 'font-weight="bold"')]
    for k, r in enumerate(got):
        y, w = 30 + 20 * k, 400 * r["n"] / most
        parts += [_text(190, y + 12, r["name"], 'text-anchor="end"'), f'<rect x="196" y="{y}" width="{w:g}" height="15" fill="{_hex(palette(1)[0])}"/>', _text(200 + w, y + 12, r["n"])]
    return _svg(680, 40 + 20 * len(got), parts)


def heatmap(rows: DataFrame, row: str, column: str, value: str | None = None, title: str = "", most: int = 200, centre: float | None = None) -> str:
    """SVG of means (or counts) of pairs of names; with a centre, colours go both ways from it. Pairs that never occur stay white."""
    got = raster.row_order(raster.cells(rows, row, column, value, most)).toPandas()  # most^2 rows at most
    v = got["value"].to_numpy(float)
    low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 1.0)
    corners = RISING
    if centre is not None:
        reach = max(abs(low - centre), abs(high - centre), 1e-12)
        low, high, corners = centre - reach, centre + reach, AROUND
    h, w = (int(got[c].max()) + 1 if len(got) else 0 for c in "ij")
    image = np.full((max(h, 1), max(w, 1), 3), 255, np.uint8)
    image[got["i"].to_numpy(), got["j"].to_numpy()] = scale(v, low, high, corners)
    side, left, top = 16, 170, 30
    picture = base64.b64encode(png(image)).decode()
    parts = [_text(8, 18, title, 'font-weight="bold"'), f'<image x="{left}" y="{top}" width="{side * w}" height="{side * h}" preserveAspectRatio="none" style="image-rendering:pixelated" href="data:image/png;base64,{picture}"/>']
    parts += [_text(left - 6, top + side * i + 12, name, 'text-anchor="end"') for i, name in got[["i", "row"]].drop_duplicates().itertuples(index=False)]
    for j, name in got[["j", "column"]].drop_duplicates().itertuples(index=False):
        x, y = left + side * j + 12, top + side * h + 8
        parts.append(_text(x, y, name, f'text-anchor="end" transform="rotate(-60 {x} {y})"'))
    return _svg(left + side * w + 120, top + max(side * h, 150) + 120, [*parts, *_bar_of_colours(left + side * w + 16, top, low, high, corners)])
