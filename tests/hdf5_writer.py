"""A small writer of the HDF5 format for tests: nested dicts as groups, arrays as datasets, a few attributes."""

import struct
import zlib

import numpy as np

U = 0xFFFFFFFFFFFFFFFF


class Data:
    """A dataset: values, and if chunked the shape of chunks, with shuffle, deflate and checksum filters if asked for."""

    def __init__(self, values, chunks=None, filters=False, skip=(), compact=False, fixed=False, fan=4):
        self.values, self.chunks, self.filters, self.skip, self.compact, self.fixed, self.fan = np.asarray(values), chunks, filters, skip, compact, fixed, fan


class Group(dict):
    def __init__(self, links, **attributes):
        super().__init__(links)
        self.attributes = attributes


class Writer:
    def __init__(self):
        self.out = bytearray(96)

    def put(self, b: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += b
        return at

    def kind(self, v: np.ndarray, fixed=False) -> tuple[bytes, np.ndarray]:
        """A datatype message and the values as stored."""
        if v.dtype.kind in "OU" and not fixed:
            texts = [str(x).encode() for x in v.ravel()]
            stored, refs = b"", []
            for k, t in enumerate(texts):
                stored += struct.pack("<HHIQ", k + 1, 1, 0, len(t)) + t + b"\0" * (-len(t) % 8)
            at = self.put(b"GCOL\1\0\0\0" + struct.pack("<Q", 16 + len(stored) + 16) + stored + struct.pack("<HHIQ", 0, 0, 0, 0))
            refs = b"".join(struct.pack("<IQI", len(t), at, k + 1) for k, t in enumerate(texts))
            char = struct.pack("<B3sI", 0x13, b"\0\0\0", 1)
            return struct.pack("<B3sI", 0x19, b"\1\1\0", 16) + char, np.frombuffer(refs, "V16").reshape(v.shape)
        if v.dtype.kind in "OUS":
            b = np.array([str(x).encode() if not isinstance(x, bytes) else x for x in v.ravel()]).reshape(v.shape)
            return struct.pack("<B3sI", 0x13, b"\1\0\0", b.dtype.itemsize), b
        if v.dtype.kind == "b":
            base = struct.pack("<B3sIHH", 0x10, b"\x08\0\0", 1, 0, 8)
            return struct.pack("<B3sI", 0x18, b"\2\0\0", 1) + base + b"FALSE\0\0\0TRUE\0\0\0\0" + b"\0\1", v.astype("i1")
        size = v.dtype.itemsize
        order = 1 if v.dtype.byteorder == ">" else 0
        if v.dtype.kind in "iu":
            return struct.pack("<B3sIHH", 0x10, bytes([order | 8 * (v.dtype.kind == "i"), 0, 0]), size, 0, 8 * size), v
        return struct.pack("<B3sI", 0x11, bytes([order | 0x20, 8 * size - 1, 0]), size) + b"\0" * 12, v

    def space(self, shape) -> bytes:
        return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", s) for s in shape)

    def attribute(self, name, value) -> bytes:
        v = np.asarray(value)
        kind, stored = self.kind(v)
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        n, space = name.encode() + b"\0", self.space(v.shape)
        return struct.pack("<BxHHH", 1, len(n), len(kind), len(space)) + pad(n) + pad(kind) + pad(space) + stored.tobytes()

    def header(self, messages, split=False) -> int:
        """A version 1 header; with split its last messages lie in a continuation."""
        pack = lambda ms: b"".join(struct.pack("<HHB3x", t, len(b) + -len(b) % 8, 0) + b + b"\0" * (-len(b) % 8) for t, b in ms)
        n = len(messages)
        if split and n > 1:
            rest = pack(messages[1:])
            messages, n = [messages[0], (0x10, struct.pack("<QQ", self.put(rest), len(rest)))], n + 1
        body = pack(messages)
        return self.put(struct.pack("<BxHII4x", 1, n, 1, len(body)) + body)

    def tree(self, kind, level, entries, last, size) -> bytes:
        """A node of a version 1 tree: keys and children, then the key after the last."""
        return b"TREE" + struct.pack("<BBHQQ", kind, level, len(entries), U, U) + b"".join(k + struct.pack("<Q", c) for k, c in entries) + last

    def data(self, d: Data, attributes=None) -> int:
        kind, v = self.kind(d.values, d.fixed)
        messages = [(1, self.space(v.shape)), (3, kind)]
        width = v.dtype.itemsize
        if d.compact:
            raw = v.tobytes()
            messages.append((8, struct.pack("<BBH", 3, 0, len(raw)) + raw))
        elif not d.chunks:
            raw = v.tobytes()
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(raw) if raw else U, len(raw))))
        else:
            entries = []
            for corner in np.ndindex(*(-(-s // c) for s, c in zip(v.shape, d.chunks))):
                at = tuple(i * c for i, c in zip(corner, d.chunks))
                if at in d.skip:
                    continue
                full = np.zeros(d.chunks, v.dtype)
                part = v[tuple(slice(a, a + c) for a, c in zip(at, d.chunks))]
                full[tuple(slice(0, s) for s in part.shape)] = part
                raw = full.tobytes()
                if d.filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()
                    raw = zlib.compress(raw) + b"sum!"
                entries.append((struct.pack("<II", len(raw), 0) + b"".join(struct.pack("<Q", a) for a in at) + struct.pack("<Q", 0), self.put(raw)))
            last = struct.pack("<II", 0, 0) + struct.pack("<Q", -(-v.shape[0] // d.chunks[0]) * d.chunks[0]) + b"\0" * 8 * len(d.chunks)
            level, root = 0, U
            while entries:
                nodes = []
                for i in range(0, len(entries), d.fan):
                    after = entries[i + d.fan][0] if i + d.fan < len(entries) else last
                    nodes.append((entries[i][0], self.put(self.tree(1, level, entries[i : i + d.fan], after, len(last)))))
                root, level, entries = nodes[0][1], level + 1, nodes if len(nodes) > 1 else []
            messages.append((8, struct.pack("<BBBQ", 3, 2, len(d.chunks) + 1, root) + b"".join(struct.pack("<I", c) for c in (*d.chunks, width))))
            if d.filters:
                shuffle, deflate, check = struct.pack("<HHHH", 2, 0, 0, 1) + struct.pack("<II", width, 0), struct.pack("<HHHH", 1, 8, 0, 1) + b"deflate\0" + struct.pack("<II", 6, 0), struct.pack("<HHHH", 3, 0, 0, 0)
                messages.append((11, struct.pack("<BB6x", 1, 3) + shuffle + deflate + check))
        messages += [(12, self.attribute(n, x)) for n, x in (attributes or {}).items()]
        return self.header(messages, split=True)

    def group(self, g: dict) -> int:
        at = {n: self.group(x) if isinstance(x, dict) else self.data(x if isinstance(x, Data) else Data(x)) for n, x in g.items()}
        names, where = b"\0" * 8, {}
        for n in sorted(at):
            where[n] = len(names)
            names += n.encode() + b"\0" + b"\0" * (-(len(n) + 1) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), U, self.put(names)))
        leaves = []
        order = sorted(at)
        for i in range(0, len(order), 3):
            part = order[i : i + 3]
            leaves.append((struct.pack("<Q", where[part[0]]), self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQII16x", where[n], at[n], 0, 0) for n in part))))
        tree = self.put(self.tree(0, 0, leaves, struct.pack("<Q", 0), 8))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *((12, self.attribute(n, x)) for n, x in getattr(g, "attributes", {}).items())])


def write(path, tree: dict) -> None:
    w = Writer()
    root = w.group(tree)
    w.out[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, U, len(w.out), U) + struct.pack("<QQII16x", 0, root, 0, 0)
    with open(path, "wb") as f:
        f.write(w.out)
