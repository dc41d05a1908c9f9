"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Level 1 holds the 63-bit hashes of all training words in order (the place in that order is the word's id) and their counts.
Level k holds for each context, an entry of level k - 1, its successors: pointers to where each context's successors begin
(monotone), the successors' ids within their context (monotone, as they rise with the context), a 12-bit code of each
successor's smoothed probability and one byte for the mass that each context leaves to its suffix. All sequences, counts as their
sums too, are Elias-Fano coded: low bits packed, high bits in unary with counts by word. A successor is searched within its
context: select finds the few entries of equal high bits, and bisection over their low bits finds the entry.

Probabilities. Every n-gram of the training texts is kept, whatever its count. p(w | c) = a(cw) + left(c) p(w | shorter c),
a(cw) = (1 - left(c)) n(cw) / n(c), and p(w) = (n(w) + 1) / (N + V + 1). left is estimated by leaving one out, for each order
and each range of n(c): the share of the training tokens after such contexts whose n-gram is seen but once, so would be
unknown without that token (Jelinek and Mercer's interpolation). A context that was seen once leaves everything, so a text
is not known by heart because it was learned from; one that occurs twice is. The sums run over all shards, so a score does
not depend on how many there are.

Plan. Nothing is collected but one row a shard, and no worker holds more of the model than the shard it serves.
1. Tasks cut texts into words and write them in chunks of some 12 million characters, as numbers, to files in the shared folder.
2. Each chunk sends its distinct words with their counts to shards by hash range, which write level 1; then it asks for ids.
3. Each chunk sends its distinct training bigrams, each with the words that follow it, to the shard of the first word's hash;
   a frequent first word is split over shards by the second. A shard adds them up and writes its part of levels 2 and 3, whose
   contexts lie in the same shard. A bigram that all texts have is one entry a chunk.
4. With the sums of step 3, shards code probabilities.
5. Each chunk sends the n-grams it wants to their shards; these map their file into memory, search, and send codes back. This
   goes in `ROUNDS` shares of the chunks, one after the other, so shuffles take no more of the disk than the model.
The numbers of shards follow the number of tokens (`SHARD_TOKENS`), and rows are dealt by shard number, one shard to a task.

Cases: null text is the empty text, which is its end token alone. With no training text N and V are 0, and every token has base
probability 1. A null doc_id is neither held out nor learned from. Equal rows get equal scores; empty tables give empty results;
only doc_id and text are read. Texts of any length are scored whole."""

from __future__ import annotations

import dataclasses
import functools
import json
import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, fresh_path, shuffles_freed, written

#: Codes have 12 bits and steps of 1 / 256 in log10; the last code is no probability at all.
ORDER, BITS, STEP = 3, 12, 256
NOTHING = (1 << BITS) - 1
#: Stands for the end of a text; no word can have a line break.
END = b"\n"
#: Characters of a chunk of texts; tokens to a shard of level 1 and of the higher levels.
CHUNK_TEXT, WORD_SHARD_TOKENS, SHARD_TOKENS = 12_000_000, 8_000_000, 3_000_000
#: Ranges of context counts: each count up to 8, then two to a doubling.
RANGES = 136
#: Shares of the chunks that are looked up one after the other.
ROUNDS = 2
#: A first word with more than this share of a shard's tokens is split over several shards by the second word.
HOT = 8
_ONE = np.uint64(1)


# ---- Elias-Fano ----------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits one after the other in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << bit)
        over = bit > np.uint64(64 - width)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - bit[over]))
    return out


def _unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bits = at * width
    word, bit = bits >> 6, (bits & 63).astype(np.uint64)
    low = words[word] >> bit
    high = np.where(bit > 0, words[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def _select(words: np.ndarray, before: np.ndarray, nth: np.ndarray, ones: bool) -> np.ndarray:
    """Places of the nth set (or clear) bits; before: how many there are in front of each word."""
    at = np.searchsorted(before, nth, "right") - 1
    rest = (nth - before[at]).astype(np.int64)
    word = words[at] if ones else ~words[at]
    place = at.astype(np.int64) * 64
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        right = rest >= n
        rest -= np.where(right, n, 0)
        place += np.where(right, width, 0)
        word = np.where(right, word >> np.uint64(width), low)
    return place


class EliasFano:
    """A sequence of numbers that never fall."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (max(1, universe // max(1, n))).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64)
        size = n + int(universe >> width) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        count = np.bitwise_count(high).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(count)[:-1]])
        return cls(n, width, _pack(values & np.uint64((1 << width) - 1), width), high, before.astype(np.uint32), (np.arange(len(high)) * 64 - before).astype(np.uint32))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.uint64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def load(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:5])

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at places."""
        at = np.asarray(at, np.int64)
        top = _select(self.high, self.ones, at, True) - at
        return (top.astype(np.uint64) << np.uint64(self.width)) | _unpack(self.low, at, self.width)

    def search(self, values: np.ndarray) -> np.ndarray:
        """The first place of each number, -1 where it is not in the sequence. Numbers must lie in the universe."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        top = (values >> np.uint64(self.width)).astype(np.int64)
        stop = _select(self.high, self.zeros, top, False) - top
        start = np.where(top > 0, _select(self.high, self.zeros, np.maximum(top - 1, 0), False) - top + 1, 0)
        want = values & np.uint64((1 << self.width) - 1)
        low, high = start.copy(), stop.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = _unpack(self.low, mid, self.width) < want[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
            live = live[low[live] < high[live]]
        hit = low < stop
        hit[hit] = _unpack(self.low, low[hit], self.width) == want[hit]
        return np.where(hit, low, -1)


# ---- files in the shared folder ------------------------------------------------------------------------------------


def _store(path: str):
    """(file system, path) of a path that may have a scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def put_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays under another name first, so a file under its own name is always whole."""
    store, at = _store(path)
    head = json.dumps([[x.dtype.str, len(x)] for x in arrays]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    store.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(struct.pack("<Q", len(head)) + head)
        for x in arrays:
            raw = np.ascontiguousarray(x).tobytes()
            f.write(raw + bytes(-len(raw) % 8))
    store.move(temporary, at)


def map_arrays(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory; a file of a remote store is first copied to a nameless local one."""
    from pyarrow import fs

    store, at = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        with open(at, "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, store.open_input_stream(at) as source:
            while block := source.read(1 << 24):
                f.write(block)
            f.flush()
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = struct.unpack("<Q", m[:8])[0]
    out, place = [], 8 + n
    for kind, size in json.loads(m[8 : 8 + n]):
        out.append(np.frombuffer(m, kind, size, place))
        place += -(-size * np.dtype(kind).itemsize // 8) * 8
    return out


def _exists(path: str) -> bool:
    from pyarrow import fs

    store, at = _store(path)
    return store.get_file_info(at).type == fs.FileType.File


def _delete(path: str) -> None:
    store, at = _store(path)
    store.delete_file(at)


# ---- numbers as bytes ----------------------------------------------------------------------------------------------


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers from 0 on: each in the least width, all first bytes, all second ones, and so on, compressed."""
    head, body = [], []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        head += [width, len(x)]
        body.append(x.astype(f"<u{width}").view(np.uint8).reshape(len(x), width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(head) + 1}Q", len(arrays), *head) + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<Q", raw)[0]
    head = struct.unpack_from(f"<{2 * n}Q", raw, 8)
    out, at = [], 8 + 16 * n
    for width, size in zip(head[::2], head[1::2], strict=True):
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += width * size
    return out


def code(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities: -log10 in steps; the last code is 0."""
    return np.where(p > 0, np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 0, NOTHING - 1), NOTHING).astype(np.int64)


_VALUES = np.append(10.0 ** (np.arange(NOTHING) / -STEP), 0.0)


def value(codes: np.ndarray) -> np.ndarray:
    return _VALUES[codes]


def table_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers in order, the place of each number among them); quicker than sorting where few are distinct."""
    places, own = pd.factorize(x)
    order = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return own[order], rank[places]


def range_of(n: np.ndarray) -> np.ndarray:
    """The range that each count lies in."""
    n = np.asarray(n, np.int64)
    return np.where(n <= 8, n, np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.int64) + 3)


# ---- words of texts ------------------------------------------------------------------------------------------------


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hashes of all tokens of all texts, each text's count)."""
    every: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "replace").lower().split()
        every += words
        every.append(END)
        sizes[i] = len(words) + 1
    return np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every)) >> _ONE, sizes


class Grams:
    """The distinct bigrams and trigrams of some texts, in terms of the places of words in a table of `n_own` words.

    pairs and triples are sorted: a pair is first x n_own + second, a triple is the place of its first pair x n_own + third.
    pair_at and triple_at have the place of the pair and the triple that end at a token, -1 where a text has just begun."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, n_own: int, order: int):
        n = len(tokens)
        begins = np.zeros(n, bool)
        begins[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[sizes > 0]] = True
        self.pair_at, self.triple_at = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        at = np.flatnonzero(~begins)
        self.pairs, self.pair_at[at] = np.unique(tokens[at - 1] * n_own + tokens[at], return_inverse=True)
        self.triples = np.empty(0, np.int64)
        if order > 2:
            at = at[self.pair_at[at - 1] >= 0]
            self.triples, self.triple_at[at] = np.unique(self.pair_at[at - 1] * n_own + tokens[at], return_inverse=True)
        self.first, self.second = self.pairs // max(1, n_own), self.pairs % max(1, n_own)
        self.parent, self.third = self.triples // max(1, n_own), self.triples % max(1, n_own)


_DIRECTORY = "part int, chunk bigint, path string, at bigint, size bigint, tokens bigint, learned bigint, docs array<{d}>"


@dataclasses.dataclass
class Prepared:
    """Texts as chunks of numbers: a written table with a row for each chunk, the numbers of tasks that made it and of tokens, and the folder."""

    directory: DataFrame
    parts: int
    tokens: int
    folder: str
    words: DataFrame | None = None


def prepared(docs: DataFrame, learn=None, chunk_text: int | None = None) -> Prepared:
    """Cuts the texts of docs into words and writes them in chunks; `learn` says which rows a model is to learn from."""
    spark = docs.sparkSession
    folder, chunk_text = fresh_path(spark, "texts"), chunk_text or CHUNK_TEXT
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        store, base = _store(folder)
        path, stream, at = f"texts-{part}-{uuid.uuid4().hex}", None, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal stream, at, held, size, count
            if stream is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{path}")
            own, tokens = table_of(np.concatenate([h for _, h, _, _ in held]).astype(np.int64))
            sizes, learned = np.concatenate([n for _, _, n, _ in held]), np.concatenate([x for _, _, _, x in held])
            blob = pack([np.diff(own, prepend=0), tokens, sizes, learned.astype(np.int64)])
            stream.write(blob)
            docs_of = pa.concat_arrays([d for d, _, _, _ in held])
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([part << 33 | count], pa.int64()), pa.array([path]), pa.array([at], pa.int64()), pa.array([len(blob)], pa.int64()),
                 pa.array([len(tokens)], pa.int64()), pa.array([int(sizes[learned].sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs_of)], pa.int32()), docs_of)],
                names=["part", "chunk", "path", "at", "size", "tokens", "learned", "docs"],
            )
            at, held, size, count = at + len(blob), [], 0, count + 1
            return row

        for b in batches:
            texts = b.column("text").to_pylist()
            for s in chunks(texts):
                n = sum(len(t) for t in texts[s] if t)
                if held and size + n > chunk_text:
                    yield flush()
                size += n
                some = b.slice(s.start, s.stop - s.start)
                held.append((some.column("doc_id"), *tokens_of(texts[s]), some.column("learn").to_numpy(zero_copy_only=False).astype(bool)))
        if held:
            yield flush()
        if stream is not None:
            stream.close()

    rows = docs.select("doc_id", "text", F.coalesce(learn if learn is not None else F.lit(False), F.lit(False)).alias("learn"))
    directory = written(rows.mapInArrow(run, _DIRECTORY.format(d=kind)), "chunks")
    n = directory.agg(F.max("part").alias("part"), F.sum("tokens").alias("tokens")).first()
    return Prepared(directory, (n["part"] or 0) + 1, n["tokens"] or 0, folder)


def _read(folder: str, path: str, at: int, size: int) -> list[np.ndarray]:
    """(own words' hashes, tokens as places among them, tokens of each text, which texts are learned from) of a chunk."""
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{path}") as f:
        f.seek(at)
        own, tokens, sizes, learned = unpack(f.read(size))
    return [np.cumsum(own), tokens, sizes, learned.astype(bool)]


# ---- the model -----------------------------------------------------------------------------------------------------


class Words:
    """A shard of level 1."""

    def __init__(self, arrays: list[np.ndarray]):
        self.hashes, self.counts = EliasFano.load(arrays[:5]), arrays[5]


class Levels:
    """A shard of levels 2 and 3: bigrams and all that follow them. While a model is made `more` are sums of counts and the contexts' counts, then codes."""

    def __init__(self, arrays: list[np.ndarray], words: int):
        self.words = words
        self.contexts, self.pointers, self.followers, self.pointers3, self.followers3 = (EliasFano.load(arrays[i : i + 5]) for i in range(0, 25, 5))
        self.more = arrays[25:]

    def code2(self, entries: np.ndarray) -> np.ndarray:
        """Codes of bigrams."""
        return _unpack(self.more[0], entries, BITS).astype(np.int64)

    def left(self, entries: np.ndarray) -> np.ndarray:
        """Ranges of the counts of bigrams, by which they leave something to shorter contexts."""
        return self.more[1][entries].astype(np.int64)

    def code3(self, entries: np.ndarray) -> np.ndarray:
        """Codes of trigrams."""
        return _unpack(self.more[2], entries, BITS).astype(np.int64)

    @staticmethod
    def counts_of(sums: EliasFano) -> np.ndarray:
        return np.diff(sums.get(np.arange(sums.n)).astype(np.int64), prepend=0)

    def entries(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entries of bigrams, -1 where they are unknown; rows of one first word lie together."""
        if not len(first):
            return np.empty(0, np.int64)
        start = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        place = np.repeat(self.contexts.search(first[start]), np.diff(np.append(start, len(first))))
        out = np.full(len(first), -1, np.int64)
        at = np.flatnonzero(place >= 0)
        out[at] = self.followers.search(place[at] * self.words + second[at])
        return out

    def successors(self, context: int) -> list[tuple[int, int]]:
        """(word id, code) of what follows an entry of level 2; its pointers bound them."""
        a, z = self.pointers3.get(np.array([context, context + 1])).astype(np.int64).tolist()
        at = np.arange(a, z)
        ids = self.followers3.get(at).astype(np.int64) - context * self.words
        return list(zip(ids.tolist(), self.code3(at).tolist(), strict=True))


@dataclasses.dataclass
class Trie:
    """A model: its folder, level 1's shards (the hash range of each, and the words before each), shards of the higher levels, and what contexts leave by range of count."""

    folder: str
    order: int
    span: int
    before: np.ndarray
    tokens: int
    shards: int = 0
    shard_tokens: int = SHARD_TOKENS
    left: tuple[np.ndarray, ...] = ()

    @property
    def words(self) -> int:
        return int(self.before[-1])

    def shard_of(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The shards of bigrams; counts: of the first words."""
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        salt = (second.astype(np.uint64) * a >> np.uint64(33)) % (counts * HOT // self.shard_tokens + 1).astype(np.uint64)
        x = (first.astype(np.uint64) + np.uint64(1)) * a ^ salt * b
        x = (x ^ (x >> np.uint64(32))) * b
        return ((x ^ (x >> np.uint64(29))) % np.uint64(max(1, self.shards))).astype(np.int64)

    def open_words(self, k: int) -> Words:
        return Words(map_arrays(f"{self.folder}/words-{k}"))

    def open_levels(self, k: int) -> Levels:
        return Levels(map_arrays(f"{self.folder}/levels-{k}"), self.words)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.words + 1)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of some words, for a look at a model."""
        ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            k, rest = divmod(xxhash.xxh3_64_intdigest(w) >> 1, self.span)
            if self.before[k + 1] > self.before[k]:
                level = self.open_words(k)
                at = int(level.hashes.search(np.array([rest]))[0])
                if at >= 0:
                    ids[i], counts[i] = at + self.before[k], level.counts[at]
        return ids, counts

    def probabilities(self, words: list[bytes]) -> list[float]:
        """p of each word after those before it, for a look at a model."""
        ids, counts = self.find(words)
        out = self.unigram(counts).tolist()
        low, context = list(out), (None, -1)
        for i in range(1, len(words)):
            weight, found, got = 1.0, -1, None
            if self.shards and ids[i - 1] >= 0:
                out[i] = low[i] * float(value(code(self.left[0][range_of(counts[i - 1])])))
                k = int(self.shard_of(ids[i - 1 : i], ids[i : i + 1], counts[i - 1 : i])[0])
                if ids[i] >= 0 and _exists(f"{self.folder}/levels-{k}"):
                    got = self.open_levels(k)
                    found = int(got.entries(ids[i - 1 : i], ids[i : i + 1])[0])
                    out[i] += float(value(got.code2(np.array([found])))[0]) if found >= 0 else 0.0
            level, entry = context
            if entry >= 0:
                weight = float(value(code(self.left[1][level.left(np.array([entry]))]))[0])
                own = dict(level.successors(entry)).get(int(ids[i]), NOTHING) if self.order > 2 else NOTHING
                out[i] = weight * out[i] + float(value(np.array(own)))
            context = (got, found) if self.order > 2 else (None, -1)
        return out


def _by_part(cut: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(number, rows) of each run of equal numbers."""
    edge = (np.flatnonzero(np.diff(cut)) + 1).tolist()
    for a, z in zip([0, *edge], [*edge, len(cut)], strict=True):
        if z > a:
            yield int(cut[a]), slice(a, z)


_BLOCK = "shard int, part int, chunk bigint, blob binary"


def _blocks(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds, strict=True)], names=["shard", "part", "chunk", "blob"])


def _word_blocks(p: Prepared, span: int, counted: bool) -> DataFrame:
    """Each chunk's distinct words, by shard of level 1, with their counts in training texts or to be looked up."""
    folder = p.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, chunk, path, at, size in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "path", "at", "size")), strict=True):
                own, tokens, sizes, learned = _read(folder, path, at, size)
                n = np.bincount(tokens[np.repeat(learned, sizes)], minlength=len(own)) if counted else None
                if counted:
                    own, n = own[n > 0], n[n > 0]
                yield _blocks([(k, part, chunk, pack([np.diff(own[s], prepend=k * span), *([n[s]] if counted else [])])) for k, s in _by_part(own // span)])

    return p.directory.select("part", "chunk", "path", "at", "size").mapInArrow(run, _BLOCK)


def _serve(blocks: DataFrame, shards: int, run, schema: str) -> DataFrame:
    """run over the rows of each shard, one shard to a task."""
    return blocks.repartitionById(shards, F.col("shard")).mapInArrow(run, schema)


def _train_words(p: Prepared, order: int) -> Trie:
    """Writes level 1."""
    spark = p.directory.sparkSession
    folder = fresh_path(spark, "trie")
    shards = max(2, -(-p.tokens // WORD_SHARD_TOKENS))
    span = -(-(2**63) // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        k = None
        for b in batches:
            for k, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist(), strict=True):
                own, n = unpack(blob)
                held.append((np.cumsum(own), n))
                if len(held) >= 64 or sum(len(x) for x, _ in held[1:]) > 2_000_000:
                    held = [_add_up(held)]
        if k is not None:
            own, n = _add_up(held)
            put_arrays(f"{folder}/words-{k}", [*EliasFano.of(own, span).arrays(), n.astype(np.uint32) if n.max() < 1 << 32 else n])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "n", "total"])

    with shuffles_freed(spark):
        found = {r["shard"]: r for r in _serve(_word_blocks(p, span, True), shards, run, "shard int, n bigint, total bigint").collect()}
    sizes = [found[k]["n"] if k in found else 0 for k in range(shards)]
    return Trie(folder, order, span, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), sum(r["total"] for r in found.values()))


def _add_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


_ANSWER = "part int, chunk bigint, kind int, shard int, blob binary"


def _answers(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, kinds, strict=True)], names=["part", "chunk", "kind", "shard", "blob"])


def _ask_words(p: Prepared, trie: Trie) -> None:
    """Fetches (place + 1 in its shard or 0, count) of each chunk's words; kept with the chunks as a written table."""
    shards, sizes = len(trie.before) - 1, np.diff(trie.before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = None
        for b in batches:
            out = []
            for k, part, chunk, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "chunk", "blob")), strict=True):
                own = np.cumsum(unpack(blob)[0])
                place, n = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
                if sizes[k]:
                    level = level or trie.open_words(k)
                    place = level.hashes.search(own)
                    n[place >= 0] = level.counts[place[place >= 0]]
                out.append((part, chunk, 1, k, pack([place + 1, n])))
            yield _answers(out)

    p.words = written(_serve(_word_blocks(p, trie.span, False), shards, run, _ANSWER), "words")


def _part(p: Prepared, k: int, n: int) -> Prepared:
    """The k-th of n shares of the chunks, every task's among them."""
    mine = lambda df: df.where(F.pmod(F.col("part") + F.col("chunk"), F.lit(n)) == k)
    return dataclasses.replace(p, directory=mine(p.directory), words=mine(p.words))


def _grouped(p: Prepared, more: list[DataFrame], run, schema: str) -> DataFrame:
    """run(part, chunk, answers by kind and shard, chunk's arrays, docs) for each chunk with all that was answered to it."""
    kind = p.directory.schema["docs"].dataType.simpleString()
    rows = p.directory.select("part", "chunk", F.lit(0).alias("kind"), F.lit(0).alias("shard"), F.lit(None).cast("binary").alias("blob"), "path", "at", "size", "docs")
    for x in [p.words, *more]:
        rows = rows.unionByName(x.select("*", F.lit(None).cast("string").alias("path"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast(kind).alias("docs")))
    folder = p.folder

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, got, docs = None, {}, None

        def done():
            return run(head[0], head[1], got, _read(folder, *head[2:]), docs)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("part", "chunk", "kind", "shard", "blob", "path", "at", "size")]
            for i, (part, chunk, k, shard, blob, path, at, size) in enumerate(zip(*cols, strict=True)):
                if k == 0:
                    if head is not None:
                        yield from done()
                    head, got, docs = (part, chunk, path, at, size), {}, b.column("docs").slice(i, 1).flatten()
                else:
                    got[k, shard] = blob
        if head is not None:
            yield from done()

    return rows.repartitionById(p.parts, F.col("part")).sortWithinPartitions("chunk", "kind", "shard").mapInArrow(groups, schema)


def _known(trie: Trie, own: np.ndarray, got: dict) -> tuple[np.ndarray, np.ndarray]:
    """(id or -1, count) of a chunk's words from the answers of level 1."""
    ids, counts = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
    for k, s in _by_part(own // trie.span):
        place, counts[s] = unpack(got[1, k])
        ids[s] = np.where(place > 0, place - 1 + trie.before[k], -1)
    return ids, counts


class Asked:
    """A chunk's known bigrams by shard, each with its known followers.

    pair, triple: places in Grams' tables, in the order in which they are sent; cuts, cuts3: where each shard's begin."""

    def __init__(self, trie: Trie, grams: Grams, ids: np.ndarray, counts: np.ndarray):
        known = (ids[grams.first] >= 0) & (ids[grams.second] >= 0)
        pair = np.flatnonzero(known)
        shard = trie.shard_of(ids[grams.first[pair]], ids[grams.second[pair]], counts[grams.first[pair]])
        order = np.argsort(shard.astype(np.uint16) if trie.shards < 1 << 16 else shard, kind="stable")
        self.pair, shard = pair[order], shard[order]
        self.shards, self.cuts = np.unique(shard, return_index=True)
        self.cuts = np.append(self.cuts, len(shard))
        # triples are sorted by their first pair: each pair's are a run, and the runs are taken in the pairs' order
        triple = np.flatnonzero(known[grams.parent] & (ids[grams.third] >= 0))
        runs = np.bincount(grams.parent[triple], minlength=len(grams.pairs))
        self.followers = runs[self.pair]
        ends = np.cumsum(self.followers)
        self.triple = triple[np.arange(len(triple)) + np.repeat((np.cumsum(runs) - runs)[self.pair] - (ends - self.followers), self.followers)]
        self.cuts3 = np.concatenate([[0], ends])[self.cuts]

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        for i, k in enumerate(self.shards.tolist()):
            yield k, slice(self.cuts[i], self.cuts[i + 1]), slice(self.cuts3[i], self.cuts3[i + 1])


def _gram_blocks(p: Prepared, trie: Trie, counted: bool) -> DataFrame:
    """Each chunk's bigrams and what follows them, by shard: those of training texts with counts, or all of them to be looked up."""

    def run(part: int, chunk: int, got: dict, arrays: list, docs) -> Iterator[pa.RecordBatch]:
        own, tokens, sizes, learned = arrays
        ids, counts = _known(trie, own, got)
        if counted:
            tokens, sizes = tokens[np.repeat(learned, sizes)], sizes[learned]
        grams = Grams(tokens, sizes, len(own), trie.order)
        asked = Asked(trie, grams, ids, counts)
        n2 = np.bincount(grams.pair_at[grams.pair_at >= 0], minlength=len(grams.pairs)) if counted else None
        n3 = np.bincount(grams.triple_at[grams.triple_at >= 0], minlength=len(grams.triples)) if counted else None
        for k, s, s3 in asked.slices():
            pair, triple = asked.pair[s], asked.triple[s3]
            first = grams.first[pair]
            start = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            second = np.diff(ids[grams.second[pair]], prepend=0)
            second[start] = ids[grams.second[pair[start]]]
            block = [np.diff(ids[first[start]], prepend=0), np.diff(np.append(start, len(pair))), second, asked.followers[s], ids[grams.third[triple]]]
            yield _blocks([(k, part, chunk, pack([*block, *([counts[first[start]], n2[pair], n3[triple]] if counted else [])]))])

    return _grouped(p, [], run, _BLOCK)


def _opened(blob: bytes) -> list[np.ndarray]:
    """(first, second, followers, third, ...) of a block."""
    context, sizes, second, *rest = unpack(blob)
    total = np.cumsum(second)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return [np.repeat(np.cumsum(context), sizes), total - np.repeat(before, sizes), *rest, sizes]


def _train_levels(p: Prepared, trie: Trie) -> Trie:
    """Writes levels 2 and 3: entries and counts, then, with the sums of all shards, codes."""
    spark = p.directory.sparkSession
    cores = spark.sparkContext.defaultParallelism
    trie = dataclasses.replace(trie, shards=max(1, -(-p.tokens // SHARD_TOKENS), min(cores, -(-p.tokens // 200_000))), shard_tokens=SHARD_TOKENS)
    folder, words = trie.folder, trie.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        k = None
        for b in batches:
            for k, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist(), strict=True):
                first, second, followers, third, n1, n2, n3, sizes = _opened(blob)
                held.append([first, second, n2, np.repeat(n1, sizes), followers, third, n3])
        if k is None:
            return
        first, second, n2, n1, followers, third, n3 = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        parent = np.repeat(np.arange(len(first)), followers)
        contexts, place = np.unique(first, return_inverse=True)
        key = place * words + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        entry = np.empty(len(key), np.int64)
        entry[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        key, c2, n1 = key[order][start], np.add.reduceat(n2[order], start), n1[order][start]
        key3 = entry[parent] * words + third
        order = np.argsort(key3, kind="stable")
        key3, n3 = key3[order], n3[order]
        start = np.flatnonzero(np.concatenate([[True], key3[1:] != key3[:-1]])) if len(key3) else np.empty(0, np.int64)
        key3, c3 = key3[start], np.add.reduceat(n3, start) if len(start) else n3
        sizes = np.bincount(key // words, minlength=len(contexts))
        sizes3 = np.bincount(key3 // words, minlength=len(key))
        levels = [
            EliasFano.of(contexts, words), EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]), len(key) + 1), EliasFano.of(key, len(contexts) * words),
            EliasFano.of(np.concatenate([[0], np.cumsum(sizes3)]), len(key3) + 1), EliasFano.of(key3, len(key) * words), EliasFano.of(np.cumsum(c2), int(c2.sum()) + 1), EliasFano.of(np.cumsum(c3), int(c3.sum()) + 1),
        ]
        put_arrays(f"{folder}/counts-{k}", [*(a for x in levels for a in x.arrays()), n1[np.concatenate([[0], np.cumsum(sizes)[:-1]])]])
        out = []
        for level, n, c in ((2, n1, c2), (3, c2[key3 // words], c3)):
            at = range_of(n)
            out += [(k, level, i, int(x), int(y)) for i, (x, y) in enumerate(zip(np.bincount(at, c, RANGES), np.bincount(at[c == 1], minlength=RANGES), strict=True)) if x]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=["shard", "level", "range", "tokens", "once"])

    with shuffles_freed(spark):
        sums = _serve(_gram_blocks(p, trie, True), trie.shards, count, "shard int, level int, range int, tokens bigint, once bigint")
        sums = sums.groupBy("level", "range").agg(F.sum("tokens").alias("tokens"), F.sum("once").alias("once")).collect()
    left = np.ones((2, RANGES))
    for r in sums:
        left[r["level"] - 2, r["range"]] = (r["once"] + 1) / (r["tokens"] + 1)
    trie = dataclasses.replace(trie, left=tuple(left))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                if not _exists(f"{folder}/counts-{k}"):  # no bigram falls to it
                    continue
                arrays = map_arrays(f"{folder}/counts-{k}")
                level = Levels(arrays, words)
                c2, c3 = (level.counts_of(EliasFano.load(level.more[i : i + 5])) for i in (0, 5))
                n1 = np.repeat(level.more[10], np.diff(level.pointers.get(np.arange(level.pointers.n)).astype(np.int64)))
                n2 = np.repeat(c2, np.diff(level.pointers3.get(np.arange(level.pointers3.n)).astype(np.int64)))
                codes, codes3 = code((1 - left[0][range_of(n1)]) * c2 / n1), code((1 - left[1][range_of(n2)]) * c3 / n2)
                put_arrays(f"{folder}/levels-{k}", [*arrays[:25], _pack(codes.astype(np.uint64), BITS), range_of(c2).astype(np.uint8), _pack(codes3.astype(np.uint64), BITS)])
                _delete(f"{folder}/counts-{k}")
        yield from ()

    spark.range(0, trie.shards, 1, trie.shards).mapInArrow(finish, "id bigint").write.format("noop").mode("overwrite").save()
    return trie


def _look_up(p: Prepared, trie: Trie) -> DataFrame:
    """For each chunk and shard the codes of the bigrams, the ranges of their counts, and the codes of the trigrams that the chunk has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, opened = None, False
        for b in batches:
            out = []
            for k, part, chunk, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "chunk", "blob")), strict=True):
                first, second, followers, third, _ = _opened(blob)
                if not opened:
                    level, opened = trie.open_levels(k) if _exists(f"{trie.folder}/levels-{k}") else None, True
                codes, left, codes3 = np.full(len(first), NOTHING), np.zeros(len(first), np.int64), np.full(len(third), NOTHING)
                if level is not None:
                    entry = level.entries(first, second)
                    hit = entry >= 0
                    codes[hit], left[hit] = level.code2(entry[hit]), level.left(entry[hit])
                    # what follows a bigram that was seen once has no probability of its own
                    context = np.repeat(np.where(left > 1, entry, -1), followers)
                    at = np.flatnonzero(context >= 0)
                    found = level.followers3.search(context[at] * trie.words + third[at])
                    at, found = at[found >= 0], found[found >= 0]
                    codes3[at] = level.code3(found)
                out.append((part, chunk, 2, k, pack([codes, left, codes3])))
            yield _answers(out)

    return _serve(_gram_blocks(p, trie, False), trie.shards, run, _ANSWER)


_SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(p: Prepared, trie: Trie) -> DataFrame:
    def run(part: int, chunk: int, got: dict, arrays: list, docs: pa.Array) -> Iterator[pa.RecordBatch]:
        own, tokens, sizes, _ = arrays
        ids, counts = _known(trie, own, got)
        unigram = trie.unigram(counts)
        p1 = unigram[tokens]
        out = p1
        if trie.shards:
            grams = Grams(tokens, sizes, len(own), trie.order)
            asked = Asked(trie, grams, ids, counts)
            # a bigram whose first word is unknown, and a trigram whose first two words never stood together, leave all to the shorter context
            own2 = np.zeros(len(grams.pairs))
            left2 = np.where(ids >= 0, value(code(trie.left[0][range_of(counts)])), 1.0)
            by_range = value(code(trie.left[1]))
            by_range[0] = 1.0  # the range of bigrams that are unknown
            left3, own3 = np.ones(len(grams.pairs)), np.zeros(len(grams.triples))
            for k, s, s3 in asked.slices():
                codes, left, codes3 = unpack(got[2, k])
                own2[asked.pair[s]], left3[asked.pair[s]], own3[asked.triple[s3]] = value(codes), by_range[left], value(codes3)
            p2 = own2 + left2[grams.first] * unigram[grams.second]
            at = np.flatnonzero(grams.pair_at >= 0)
            out = p1.copy()
            out[at] = p2[grams.pair_at[at]]
            at = np.flatnonzero(grams.triple_at >= 0)
            out[at] = own3[grams.triple_at[at]] + left3[grams.pair_at[at - 1]] * out[at]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [docs, pa.array(sizes), pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)), pa.array(np.full(n, trie.tokens, np.int64)),
             pa.array(np.add.reduceat(np.log10(p1), starts)), pa.array(np.add.reduceat(np.log10(out), starts))],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = p.directory.schema["docs"].dataType.elementType.simpleString()
    return _grouped(p, [_look_up(p, trie)] if trie.shards else [], run, f"doc_id {kind}, {_SCORES}")


def _train(p: Prepared, order: int) -> Trie:
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    trie = _train_words(p, order)
    if order > 1 and trie.words:
        _ask_words(p, trie)
        trie = _train_levels(p, trie)
    return trie


def train(docs: DataFrame, learn, order: int = ORDER) -> Trie:
    """A trie of the rows for which the column `learn` holds; order is at most 3."""
    return _train(prepared(docs, learn), order)


def score_documents(docs: DataFrame | Prepared, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    p = docs if isinstance(docs, Prepared) else prepared(docs)
    if p.words is None:
        _ask_words(p, trie)
    done = [written(_scores(_part(p, k, ROUNDS), trie), "scores") for k in range(ROUNDS)]
    return functools.reduce(DataFrame.unionByName, done)


def learned_rows():
    """Not held out: crc32 of the doc_id as text leaves another remainder than 2 by 7."""
    return crc_mod(7) != 2


def score_held_out(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; texts are cut into words once."""
    p = prepared(docs, learned_rows())
    out = score_documents(p, _train(p, order))
    return out.select("doc_id", F.coalesce(crc_mod(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
