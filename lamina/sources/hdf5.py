"""HDF5 files as a Spark data source: annotated matrices (h5ad), 10x matrices and spike tables (NWB) without conversion.

    spark.dataSource.register(Hdf5)
    spark.read.format("hdf5").option("kind", "sparse").option("node", "X").load(path)

A partition is a range of rows. The driver reads headers only; a task walks the index of chunks down to those of its rows and reads
these by byte range, so neither a file nor an index passes through one process, and `start`/`stop` keep all other chunks unread.

| kind | node | rows |
|-|-|-|
| array | a dataset of one or two dimensions | i, value or i, j, value |
| frame | a group of columns of equal length (plain, or categorical as codes and categories) | i and a column for each |
| sparse | a group with data, indices, indptr; `major` col for columns in a run (csc) | row, col, value |
| ragged | a dataset x beside x_index with the end of each entry | entry, i, value |

Read are the structures that HDF5 libraries write by default: superblocks 0 to 3, object headers 1 and 2, groups of symbol tables or
compact links, compact, contiguous and chunked layouts (index by version 1 trees), shuffle, deflate and Fletcher filters, whole
numbers, floats, booleans, and strings of fixed and variable length. Everything else is an error that names it.

Cases: a dataset without rows gives no rows; chunks that were never written are zeros; strings that were never written are null; a
category of code -1 is null; a name that is not there is a KeyError with the names that are."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bundle import Bundle
from .byte_ranges import Bytes

UNDEFINED = 0xFFFFFFFFFFFFFFFF
#: Values that a task turns into one Arrow batch, and that a partition has by default.
BATCH, PART = 1 << 18, 1 << 22


def _int(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "little")


@dataclass
class Kind:
    """An element type: a numpy type, and what its values mean (number, bool, text, heap)."""

    dtype: np.dtype
    means: str = "number"

    @property
    def sql(self) -> str:
        return {"bool": "boolean", "text": "string", "heap": "string"}.get(self.means) or ("double" if self.dtype.kind == "f" else "bigint")

    @staticmethod
    def parse(b: bytes) -> Kind:
        cls, bits, size = b[0] & 15, _int(b, 1, 3), _int(b, 4, 4)
        order = ">" if bits & 1 else "<"
        if cls == 0:
            return Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
        if cls == 1:
            return Kind(np.dtype(f"{order}f{size}"))
        if cls == 3:
            return Kind(np.dtype(f"S{size}"), "text")
        if cls == 8:  # booleans are enumerations of one byte
            base = Kind.parse(b[8:])
            return Kind(base.dtype, "bool" if base.dtype.itemsize == 1 and bits & 0xFFFF == 2 else "number")
        if cls == 9 and bits & 15 == 1:
            return Kind(np.dtype([("n", "<u4"), ("at", f"V{size - 8}"), ("k", "<u4")]), "heap")
        raise NotImplementedError(f"HDF5 element type of class {cls}")


@dataclass
class Node:
    """What an object's header says."""

    at: int
    shape: tuple[int, ...] | None = None
    kind: Kind | None = None
    layout: tuple = ()
    filters: list = field(default_factory=list)
    attributes: dict = field(default_factory=dict)
    links: dict = field(default_factory=dict)


class File:
    def __init__(self, path: str):
        self.path, self.bytes, self.heaps = path, Bytes(path), {}
        head = self.bytes.read(0, 128)
        if head[:8] != b"\x89HDF\r\n\x1a\n":
            raise ValueError(f"{path} is no HDF5 file")
        version = head[8]
        self.o, self.n = (head[13], head[14]) if version < 2 else (head[9], head[10])
        if version < 2:
            start = 24 + 4 * (version == 1)
            self.base, self.root_at = _int(head, start, self.o), _int(head, start + 5 * self.o, self.o)
        else:
            self.base, self.root_at = _int(head, 12, self.o), _int(head, 12 + 3 * self.o, self.o)

    def read(self, at: int, n: int) -> bytes:
        return self.bytes.read(self.base + at, n)

    @cached_property
    def root(self) -> Node:
        return self.node(self.root_at)

    def find(self, name: str) -> Node:
        """The object with a path of names."""
        node = self.root
        for part in filter(None, name.split("/")):
            if part not in node.links:
                raise KeyError(f"no {part} of {name} in {self.path}; there are {', '.join(sorted(node.links))}")
            node = self.node(node.links[part])
        return node

    def __contains__(self, name: str) -> bool:
        try:
            return self.find(name) is not None
        except KeyError:
            return False

    # ---- headers ----

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        head = self.read(at, 64)
        if head[:4] == b"OHDR":
            flags, start = head[5], 6 + 16 * bool(head[5] & 0x20) + 4 * bool(head[5] & 0x10)
            width = 1 << (flags & 3)
            blocks = [(at + start + width, _int(head, start, width), 4 + 2 * bool(flags & 4))]
        else:
            flags = None
            blocks = [(at + 16, _int(head, 8, 4), 8)]
        while blocks:
            begin, length, skip = blocks.pop(0)
            b, i = self.read(begin, length), 0
            while i + skip <= length:
                kind, size = (_int(b, i, 2), _int(b, i + 2, 2)) if flags is None else (b[i], _int(b, i + 1, 2))
                body = b[i + skip : i + skip + size]
                i += skip + size
                if kind == 0x10:
                    to, n = _int(body, 0, self.o), _int(body, self.o, self.n)
                    blocks.append((to, n, skip) if flags is None else (to + 4, n - 8, skip))
                else:
                    yield kind, body

    def node(self, at: int) -> Node:
        out = Node(at)
        for kind, b in self.messages(at):
            if kind == 0x01:
                out.shape = self.space(b)
            elif kind == 0x03:
                out.kind = Kind.parse(b)
            elif kind == 0x06:
                name, to = self.link(b)
                out.links[name] = to
            elif kind == 0x02 and _int(b, 2 + 8 * (b[1] & 1), self.o) != UNDEFINED >> (64 - 8 * self.o):
                raise NotImplementedError("HDF5 groups with links in a fractal heap")
            elif kind == 0x08:
                out.layout = self.layout(b)
            elif kind == 0x0B:
                out.filters = self.pipeline(b)
            elif kind == 0x0C:
                name, value = self.attribute(b)
                out.attributes[name] = value
            elif kind == 0x11:
                out.links |= self.table(_int(b, 0, self.o), _int(b, self.o, self.o))
        return out

    def space(self, b: bytes) -> tuple[int, ...]:
        start = 8 if b[0] == 1 else 4
        return tuple(_int(b, start + i * self.n, self.n) for i in range(b[1]))

    def link(self, b: bytes) -> tuple[str, int]:
        flags, i = b[1], 2 + bool(b[1] & 8) + 8 * bool(b[1] & 4) + bool(b[1] & 16)
        width = 1 << (flags & 3)
        n = _int(b, i, width)
        name = b[i + width : i + width + n].decode()
        if flags & 8 and b[2]:
            raise NotImplementedError(f"HDF5 link {name} that is not hard")
        return name, _int(b, i + width + n, self.o)

    def table(self, tree: int, heap: int) -> dict[str, int]:
        head = self.read(heap, 8 + 2 * self.n + self.o)
        names = self.read(_int(head, 8 + 2 * self.n, self.o), _int(head, 8, self.n))
        out = {}
        for leaf in self.leaves(tree):
            n = _int(self.read(leaf, 8), 6, 2)
            step = 2 * self.o + 24
            b = self.read(leaf + 8, n * step)
            for i in range(0, n * step, step):
                at = _int(b, i, self.o)
                out[names[at : names.index(b"\0", at)].decode()] = _int(b, i + self.o, self.o)
        return out

    def leaves(self, at: int) -> Iterator[int]:
        head = self.read(at, 8 + 2 * self.o)
        n, step = _int(head, 6, 2), self.n + self.o
        b = self.read(at + len(head), n * step + self.n)
        for i in range(n):
            child = _int(b, i * step + self.n, self.o)
            if head[5]:
                yield from self.leaves(child)
            else:
                yield child

    def layout(self, b: bytes) -> tuple:
        if b[0] != 3:
            raise NotImplementedError(f"HDF5 data layout {b[0]}")
        if b[1] == 0:
            return "compact", b[4 : 4 + _int(b, 2, 2)]
        if b[1] == 1:
            return "contiguous", _int(b, 2, self.o)
        return "chunked", _int(b, 3, self.o), tuple(_int(b, 3 + self.o + 4 * i, 4) for i in range(b[2] - 1))

    def pipeline(self, b: bytes) -> list[tuple[int, list[int]]]:
        out, i = [], 8 if b[0] == 1 else 2
        for _ in range(b[1]):
            code, named = _int(b, i, 2), b[0] == 1 or _int(b, i, 2) >= 256
            size = _int(b, i + 2, 2) if named else 0
            i += 2 + 2 * named
            n = _int(b, i + 2, 2)
            i += 4 + (size + 7) // 8 * 8 if b[0] == 1 else 4 + size
            out.append((code, [_int(b, i + 4 * k, 4) for k in range(n)]))
            i += 4 * (n + (n % 2 if b[0] == 1 else 0))
        return out

    def attribute(self, b: bytes):
        sizes = [_int(b, 2 + 2 * i, 2) for i in range(3)]
        i, ends = 8 + (b[0] == 3), []
        for s in sizes:
            ends.append((i, i + s))
            i += (s + 7) // 8 * 8 if b[0] == 1 else s
        name, kind, space = (b[x:y] for x, y in ends)
        name = name.split(b"\0")[0].decode()
        try:
            kind = Kind.parse(kind)
        except NotImplementedError:
            return name, None
        shape = self.space(space)
        raw = np.frombuffer(b[i:], kind.dtype, int(np.prod(shape, dtype=np.int64)))
        values = self.plain(raw, kind)
        return name, values.tolist() if shape else values[0]

    # ---- data ----

    def plain(self, raw: np.ndarray, kind: Kind) -> np.ndarray:
        """Values as Python or numpy has them."""
        if kind.means == "text":
            return np.array([x.decode(errors="replace").rstrip() for x in raw.ravel().tolist()], object).reshape(raw.shape)
        if kind.means == "heap":
            flat = [self.heap(int.from_bytes(bytes(x["at"]), "little"), int(x["k"]), int(x["n"])) for x in raw.ravel()]
            out = np.empty(len(flat), object)
            out[:] = flat
            return out.reshape(raw.shape)
        if kind.means == "bool":
            return raw.astype(bool)
        return raw.astype(np.float64 if raw.dtype.kind == "f" else np.int64)

    def heap(self, at: int, k: int, n: int) -> str | None:
        """An object of a global heap collection; the last few collections stay at hand."""
        if not at:
            return None
        if at not in self.heaps:
            if len(self.heaps) > 16:
                self.heaps.clear()
            size = _int(self.read(at, 8 + self.n), 8, self.n)
            b, i, found = self.read(at, size), 8 + self.n, {}
            while i + 8 + self.n <= size and _int(b, i, 2):
                length = _int(b, i + 8, self.n)
                found[_int(b, i, 2)] = b[i + 8 + self.n : i + 8 + self.n + length]
                i += 8 + self.n + (length + 7) // 8 * 8
            self.heaps[at] = found
        return self.heaps[at][k][:n].decode(errors="replace")

    def chunks(self, at: int, shape: tuple[int, ...], a: int, b: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Offsets, address, stored size and filter mask of the chunks that meet the rows a to b."""
        if at == UNDEFINED >> (64 - 8 * self.o):
            return
        head = self.read(at, 8 + 2 * self.o)
        n, key = _int(head, 6, 2), 8 + 8 * (len(shape) + 1)
        step = key + self.o
        body = self.read(at + len(head), n * step + key)
        first = [_int(body, i * step + 8, 8) for i in range(n + 1)]
        for i in range(n):
            # no chunk below this entry begins after the next one's first row
            if first[i] >= b or first[i + 1] + shape[0] <= a:
                continue
            child = _int(body, i * step + key, self.o)
            if head[5]:
                yield from self.chunks(child, shape, a, b)
            elif first[i] + shape[0] > a:
                yield tuple(_int(body, i * step + 8 + 8 * d, 8) for d in range(len(shape))), child, _int(body, i * step, 4), _int(body, i * step + 4, 4)

    def unfiltered(self, raw: bytes, filters: list, mask: int, width: int) -> bytes:
        for i, (code, values) in reversed(list(enumerate(filters))):
            if mask >> i & 1:
                continue
            if code == 1:
                raw = zlib.decompress(raw)
            elif code == 2:
                w = values[0] if values else width
                whole = len(raw) // w * w
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(w, -1).T.tobytes() + raw[whole:]
            elif code == 3:
                raw = raw[:-4]
            else:
                raise NotImplementedError(f"HDF5 filter {code}")
        return raw

    def rows(self, node: Node, a: int, b: int) -> np.ndarray:
        """Rows a to b of a dataset."""
        kind, shape = node.kind, node.shape
        b = min(b, shape[0])
        rest = int(np.prod(shape[1:], dtype=np.int64))
        width = kind.dtype.itemsize
        if node.layout[0] == "chunked":
            out = np.zeros((max(b - a, 0), *shape[1:]), kind.dtype)
            for at, where, size, mask in self.chunks(node.layout[1], node.layout[2], a, b):
                raw = self.unfiltered(self.read(where, size), node.filters, mask, width)
                chunk = np.frombuffer(raw, kind.dtype, int(np.prod(node.layout[2]))).reshape(node.layout[2])
                lo, hi = max(a, at[0]), min(b, at[0] + chunk.shape[0])
                ends = [min(s - o, c) for s, o, c in zip(shape[1:], at[1:], chunk.shape[1:], strict=True)]
                out[(slice(lo - a, hi - a), *(slice(o, o + e) for o, e in zip(at[1:], ends, strict=True)))] = chunk[(slice(lo - at[0], hi - at[0]), *(slice(0, e) for e in ends))]
        elif node.layout[0] == "compact":
            out = np.frombuffer(node.layout[1], kind.dtype, shape[0] * rest).reshape(shape)[a:b]
        elif node.layout[1] == UNDEFINED >> (64 - 8 * self.o) or b <= a:
            out = np.zeros((max(b - a, 0), *shape[1:]), kind.dtype)
        else:
            out = np.frombuffer(self.read(node.layout[1] + a * rest * width, (b - a) * rest * width), kind.dtype).reshape(b - a, *shape[1:])
        return self.plain(out, kind)

    def columns(self, node: Node) -> dict[str, Node]:
        """The columns of a frame, in the order that the file gives if it gives one, its index first."""
        order = node.attributes.get("column-order")
        names = [*([node.attributes["_index"]] if "_index" in node.attributes else []), *(order if isinstance(order, list) else sorted(node.links))]
        found = {n: self.node(node.links[n]) for n in dict.fromkeys(names) if n in node.links and n != "__categories"}
        return {n: x for n, x in found.items() if "codes" in x.links or (x.kind is not None and len(x.shape or ()) == 1)}


@dataclass
class RowRange(InputPartition):
    a: int
    b: int


class Hdf5(DataSource):
    """The data source; options kind, node, major, start, stop, partition (rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        return Hdf5Reader(self.options).schema()

    def reader(self, schema) -> DataSourceReader:
        return Hdf5Reader(self.options)


class Hdf5Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.name = options["path"], options.get("kind", "array"), options.get("node", "/")
        self.major, self.start, self.stop, self.size = options.get("major", "row"), int(options.get("start", 0)), options.get("stop"), options.get("partition")

    def schema(self) -> str:
        f = File(self.path)
        node = f.find(self.name)
        if self.kind == "array":
            return ("i bigint, " if len(node.shape) == 1 else "i bigint, j bigint, ") + f"value {node.kind.sql}"
        if self.kind == "frame":
            types = {n: f.find(f"{self.name}/{n}/categories").kind.sql if "codes" in x.links else x.kind.sql for n, x in f.columns(node).items()}
            return ", ".join(["i bigint", *(f"`{n.replace('`', '``')}` {t}" for n, t in types.items())])
        if self.kind == "sparse":
            return f"row bigint, col bigint, value {f.find(f'{self.name}/data').kind.sql}"
        if self.kind == "ragged":
            return f"entry bigint, i bigint, value {node.kind.sql}"
        raise ValueError(f"kind {self.kind} is none of array, frame, sparse, ragged")

    def partitions(self) -> list[RowRange]:
        f = File(self.path)
        node = f.find(self.name)
        if self.kind == "frame":
            columns = list(f.columns(node).values())
            first = f.node(columns[0].links["codes"]) if columns and "codes" in columns[0].links else (columns or [None])[0]
            n, row = (first.shape[0], len(columns)) if first else (0, 1)
            grain = first.layout[2][0] if first and first.layout[0] == "chunked" else 1
        elif self.kind == "array":
            n, row = node.shape[0], int(np.prod(node.shape[1:], dtype=np.int64))
            grain = node.layout[2][0] if node.layout[0] == "chunked" else 1
        else:
            ends = f.find(f"{self.name}/indptr" if self.kind == "sparse" else f"{self.name}_index")
            values = f.find(f"{self.name}/data") if self.kind == "sparse" else node
            n, grain = ends.shape[0] - (self.kind == "sparse"), 1
            row = -(-values.shape[0] // max(n, 1))
        size = int(self.size) if self.size else max(1, PART // max(row, 1))
        size = -(-size // grain) * grain
        stop = min(n, int(self.stop)) if self.stop is not None else n
        cuts = [self.start, *range((self.start // size + 1) * size, stop, size), stop]
        return [RowRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        f = File(self.path)
        yield from getattr(self, f"_{self.kind}")(f, f.find(self.name), partition.a, partition.b)

    def _array(self, f: File, node: Node, a: int, b: int) -> Iterator[pa.RecordBatch]:
        row = max(1, int(np.prod(node.shape[1:], dtype=np.int64)))
        step = max(1, BATCH // row)
        for x in range(a, b, step):
            v = f.rows(node, x, min(x + step, b))
            at = [np.repeat(np.arange(x, x + len(v)), row)] + [np.tile(np.arange(row), len(v))] * (len(node.shape) > 1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(v.ravel())], names=[*("i", "j")[: len(at)], "value"])

    def _frame(self, f: File, node: Node, a: int, b: int) -> Iterator[pa.RecordBatch]:
        columns = f.columns(node)
        named = {n: f.rows(c := f.find(f"{self.name}/{n}/categories"), 0, c.shape[0]) for n, x in columns.items() if "codes" in x.links}
        for x in range(a, b, BATCH):
            y, out = min(x + BATCH, b), []
            for n, c in columns.items():
                if n in named:
                    code = f.rows(f.find(f"{self.name}/{n}/codes"), x, y)
                    out.append(pa.array(np.append(named[n], named[n][:1])[code] if len(named[n]) else np.full(y - x, None), mask=code < 0))
                else:
                    out.append(pa.array(f.rows(c, x, y)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x, y)), *out], names=["i", *columns])

    def _runs(self, f: File, values: list[Node], ends: np.ndarray, a: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Entry, place and values of runs that end at `ends`[1:], a bounded piece at a time."""
        for x in range(int(ends[0]), int(ends[-1]), BATCH):
            place = np.arange(x, min(x + BATCH, int(ends[-1])))
            yield a + np.searchsorted(ends, place, "right") - 1, place, [f.rows(v, x, int(place[-1]) + 1) for v in values]

    def _sparse(self, f: File, node: Node, a: int, b: int) -> Iterator[pa.RecordBatch]:
        if b > a:
            ends = f.rows(f.find(f"{self.name}/indptr"), a, b + 1)
            parts = [f.find(f"{self.name}/{n}") for n in ("indices", "data")]
            for major, _, (minor, v) in self._runs(f, parts, ends, a):
                row, col = (major, minor) if self.major == "row" else (minor, major)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(v)], names=["row", "col", "value"])

    def _ragged(self, f: File, node: Node, a: int, b: int) -> Iterator[pa.RecordBatch]:
        if b > a:
            index = f.find(f"{self.name}_index")
            ends = np.append(f.rows(index, a - 1, a) if a else 0, f.rows(index, a, b)).astype(np.int64)
            for entry, place, (v,) in self._runs(f, [node], ends, a):
                yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place - ends[entry - a]), pa.array(v)], names=["entry", "i", "value"])


def read(spark: SparkSession, path: str, kind: str, node: str, **options) -> DataFrame:
    """Rows of one dataset or group."""
    spark.dataSource.register(Hdf5)
    return spark.read.format("hdf5").options(kind=kind, node=node, **options).load(path)


def matrix(spark: SparkSession, path: str, node: str, **options) -> DataFrame:
    """row, col, value of a matrix that is kept sparse, by rows or columns, or dense; zeros of a dense one are left out."""
    found = File(path).find(node)
    if "indptr" in found.links:
        return read(spark, path, "sparse", node, major="col" if found.attributes.get("encoding-type") == "csc_matrix" else "row", **options)
    return read(spark, path, "array", node, **options).where("value <> 0").select(F.col("i").alias("row"), F.col("j").alias("col"), "value")


def read_h5ad(spark: SparkSession, path: str) -> Bundle:
    """An annotated matrix: obs and var with their columns, x with X as value and layers beside it, dense obsm as arrays of numbers."""
    f = File(path)
    obs, var = (read(spark, path, "frame", n).withColumnRenamed("i", k) for n, k in (("obs", "obs_id"), ("var", "gene_id")))
    layers = {"value": "X"} if "X" in f else {}
    layers |= {"count" if n == "counts" else n: f"layers/{n}" for n in sorted(f.find("layers").links if "layers" in f else ())}
    x = None
    for name, node in layers.items():
        part = matrix(spark, path, node).select(F.col("row").alias("obs_id"), F.col("col").alias("gene_id"), F.col("value").cast("double").alias(name))
        x = part if x is None else x.join(part, ["obs_id", "gene_id"], "full").na.fill(0.0, [*x.columns[2:], name])
    arrays = {}
    for n in sorted(f.find("obsm").links if "obsm" in f else ()):
        if len(f.find(f"obsm/{n}").shape or ()) == 2:
            rows = read(spark, path, "array", f"obsm/{n}").groupBy(F.col("i").alias("obs_id")).agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("v"))
            arrays[n] = rows.select("obs_id", F.col("v.value").alias("value"))
    return Bundle(obs, var, x, arrays)


def read_10x(spark: SparkSession, path: str) -> Bundle:
    """A feature-barcode matrix: columns are barcodes, so a run of the file is an observation."""
    f = File(path)
    features = "matrix/features" if "matrix/features" in f else "matrix"
    var = None
    for n in [c for c in ("id", "name", "feature_type", "gene_names", "genes") if f"{features}/{c}" in f]:
        part = read(spark, path, "array", f"{features}/{n}").select(F.col("i").alias("gene_id"), F.col("value").alias("symbol" if n in ("name", "gene_names") else n))
        var = part if var is None else var.join(part, "gene_id")
    obs = read(spark, path, "array", "matrix/barcodes").select(F.col("i").alias("obs_id"), F.col("value").alias("barcode"))
    x = read(spark, path, "sparse", "matrix").select(F.col("row").alias("obs_id"), F.col("col").alias("gene_id"), F.col("value").cast("double").alias("count"))
    return Bundle(obs, var, x)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """unit, t, event_id of a units table with spike_times."""
    return read(spark, path, "ragged", "units/spike_times").select(F.col("entry").alias("unit"), F.col("value").cast("double").alias("t"), F.col("i").alias("event_id"))
