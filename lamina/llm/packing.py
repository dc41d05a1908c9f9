"""Sequence packing by Karmarkar-Karp multiway differencing.

A document is its token ids and a closing id 0. Whole windows of 1,024 ids are cut off its front and are sequences of
their own, without padding. What remains, 1 to 1,023 ids, is an item. The items of an Arrow batch (up to 1,000 documents)
are shared out over k windows: each item starts as a partition with one filled window, and the two partitions of the
largest spread are merged again and again, the fullest windows of one with the emptiest of the other. k starts at the
least count that could hold the ids (by their sum, and by how many large items can share a window) and rises by one until no window exceeds the capacity, so windows are near equal and
near full, and no batch depends on another. A count is given up as soon as a window exceeds the capacity. Nothing is
shuffled; a sequence id is the partition's number and a count within it. A lost task makes the same sequences again if its
rows come in the same order: so it is for files, and for tables that written() made; write anything that a shuffle has
left in no certain order first.

Cases: null and empty texts are documents of one id (0). Equal rows are packed once each. An empty table gives an empty
result. A null doc_id stays null. Columns other than doc_id and text are not read. A document of any length is cut, so
no sequence is longer than the capacity."""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks

CAPACITY = 1024

#: Texts of these characters only are cut alike by every version of the character tables.
_PLAIN = re.compile("[\\x20-\\x7e\n\t\rÀ-ÖØ-öø-ÿ]*")


def token_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def byte_encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, as the tokenizers library gives them for the vocabulary file (a path on the executor).

    Plain Latin texts go through tiktoken over the same merges, read from the same file; all others, and those with a special
    token's name, through tokenizers itself."""
    path = path or token_path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to_byte = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        special = tuple(x["content"] for x in model["added_tokens"])
        fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(path)
        slow.no_truncation(), slow.no_padding()

        def encode(text: str) -> np.ndarray:
            if not _PLAIN.fullmatch(text) or any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def difference(sizes: np.ndarray, k: int, capacity: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(window of each item, fill of each window) by differencing sizes into k windows; None if a window exceeds the capacity."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # a node above n joins two groups of items
    # a partition: its filled windows by ascending fill, and the node in each; its other windows are empty
    parts: list = [([s], [i]) for i, s in enumerate(sizes.tolist())]
    heap = [(-s[0], i) for i, (s, _) in enumerate(parts)] if k > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        (fa, na), (fb, nb) = parts[a], parts[b]
        parts[a] = parts[b] = None
        if len(fa) < len(fb):
            fa, na, fb, nb = fb, nb, fa, na
        # the fullest of the one meet the emptiest of the other; with enough empty windows none meet
        meet = max(0, len(fa) + len(fb) - k)
        new = []
        for i in range(meet):
            left.append(na[i]), right.append(nb[meet - 1 - i])
            new.append((fa[i] + fb[meet - 1 - i], len(left) - 1))
        new += zip(fb[meet:], nb[meet:], strict=True)
        del fa[:meet], na[:meet]
        if len(new) > 16:
            rows = sorted([*zip(fa, na, strict=True), *new])
            fa, na = [f for f, _ in rows], [x for _, x in rows]
        else:
            for f, x in new:
                at = bisect_right(fa, f)
                fa.insert(at, f), na.insert(at, x)
        if capacity is not None and fa[-1] > capacity:
            return None
        parts.append((fa, na))
        heapq.heapreplace(heap, (-(fa[-1] - (fa[0] if len(fa) == k else 0)), len(parts) - 1))
    where = np.empty(n, np.int64)
    total = np.zeros(k, np.int64)
    for w, node in enumerate(parts[heap[0][1]][1], k - len(parts[heap[0][1]][1])):
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                where[x] = w
                total[w] += int(sizes[x])
            else:
                stack += (left[x], right[x])
    return where, total


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item, none over the capacity; each size is from 1 to the capacity."""
    if not len(sizes):
        return np.empty(0, np.int64)
    # a window holds at most j sizes above the (j + 1)-th part of the capacity
    k = max(-(-int(sizes.sum()) // capacity), *(-(-int((sizes * (j + 1) > capacity).sum()) // j) for j in range(1, 9)))
    while (found := difference(sizes, k, capacity)) is None:
        k += 1
    return found[0]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_encoder, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, count = encoder(), TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc, start, length, check, total, sequence, offset, items, kept = [], [], [], [], [], [], [], [], []

            def piece(row: int, ids: np.ndarray, a: int, b: int, seq: int, n: int) -> None:
                doc.append(row), start.append(a), length.append(b - a), total.append(n), sequence.append(seq), offset.append(0)
                check.append(zlib.crc32(ids[a:b].tobytes()))
                if with_ids:
                    kept.append(ids[a:b].astype(np.int32))

            for s in chunks(texts):
                for row in range(s.start, s.stop):
                    ids = np.append(encode(texts[row]) if texts[row] else np.empty(0, np.uint32), np.uint32(0)).astype("<u4")
                    n = len(ids)
                    for a in range(0, n - n % capacity, capacity):
                        piece(row, ids, a, a + capacity, base + count, n)
                        count += 1
                    if n % capacity:
                        items.append(len(doc))
                        piece(row, ids, n - n % capacity, n, -1, n)
            sizes = np.array([length[i] for i in items], np.int64)
            where = windows(sizes, capacity)
            filled: dict[int, int] = {}
            number = {w: base + count + r for r, w in enumerate(np.unique(where).tolist())}
            count += len(number)
            for i, w in zip(items, where.tolist(), strict=True):
                sequence[i], offset[i] = number[w], filled.get(w, 0)
                filled[w] = offset[i] + length[i]
            cols = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, check, total, sequence, offset))]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, " + ", ".join(f"`{n}` bigint" for n in names[1:]) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, shape)
