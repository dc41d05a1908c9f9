"""Substring deduplication: every byte covered by a string of `length` bytes that also starts anywhere else is removed.

1. Each window of 200 bytes is given the least hash of the 64-byte grams in it. Equal windows have equal least hashes, so
   runs of windows with one least hash ("regions", some 260 bytes of text) need comparing only within that hash's group.
   Regions that occur twice in an Arrow batch are marked at once and sent on as one row, so no group can grow with the
   number of copies; the rest, without text, goes to the task of its hash. A region with the same bytes as another is
   covered whole. A region that is alone with its hash is dropped, unless the gram of that hash occurs twice in it.
2. What is left, regions that share a hash with different regions, is fetched once per distinct region (a join by
   document) and dealt by hash to shards of a few megabytes. A shard's suffix array is made by Larsson-Sadakane
   refinement: ranks of 8-byte prefixes, then of 16, 32, ... and `length`, with only the groups that still have ties
   sorted again. Kasai's relation (a neighbour's common prefix is one less along a diagonal) gives common prefixes, and
   windows whose common prefix with a neighbour reaches `length` repeat.
3. The regions of a hash with more than `shard_regions` distinct ones are split over several shards. Every two of these
   meet in a task that searches the windows of each in the suffix array of the other by bisection. With more than four
   shards to a hash (a passage that millions of texts go on from in their own way), its windows are first dealt anew by bytes
   that equal windows must share, in cells of 16 windows, then of 4, then of 1, until groups fit, so work stays in proportion.

All that is collected in one place is bounded by a document or by two shards.

Cases: null text is the empty text; texts shorter than `length` are kept whole. Of equal rows every one loses all that it
shares with the others. Empty tables give empty results. Only the columns asked for are read, and others are carried
under one struct, so their names cannot clash."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, columns_of, released, written

LENGTH, GRAM, SHARD_REGIONS, SHARD_BYTES = 200, 64, 16_384, 1 << 20
#: Most shards of one hash that are merged two by two; a hash with more is dealt anew by cells of these many windows, one after the other.
MERGED, CELLS = 4, (16, 4, 1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each `width` neighbours, by doubling."""
    k, y = 1, x
    while 2 * k <= width:
        y = f(y[:-k], y[k:])
        k *= 2
    n = len(x) - width + 1
    return f(y[:n], y[width - k : width - k + n]) if k < width else y


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place on; gram is a power of two."""
    h = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    k, m = 1, 0x9E3779B97F4A7C15
    while k < gram:
        h = h[:-k] * np.uint64(m) + h[k:]
        m = m * m % 2**64
        k *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def cells(data: bytes, key: int, cell: int, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(new hash, first window, last window) of a region's windows, dealt by how far the first gram with its hash lies from the window's start.

    Windows whose distances fall into one cell all hold the bytes between the last start and the first end that the cell allows; the new
    hash is of these bytes and the cell, so equal windows still share it, and at a cell of one it is of the window itself."""
    at = np.flatnonzero(gram_hashes(data, gram) == np.uint64(key & (2**64 - 1)))
    starts = np.arange(len(data) - length + 1)
    place = at[np.searchsorted(at, starts)]
    number = (place - starts) // cell
    cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(place) != 0)) + 1
    out = []
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(starts)], strict=True):
        p, c = int(place[a]), int(number[a])
        core = data[p - c * cell : p - (c + 1) * cell + 1 + length]
        digest = hashlib.blake2b(core, digest_size=8, key=f"{key},{c},{cell}".encode()).digest()
        out.append((int.from_bytes(digest, "little", signed=True), a, z - 1))
    return out


def window_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, least hash, whether its gram occurs more than once) of the runs of windows that share their least gram hash; gram is a power of two."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    least = _slide(h, width, np.minimum)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cut])
    n = np.diff(np.append(first, len(least)))
    # a gram is the least of some window if the largest of the least hashes around it is its own
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    twice = np.zeros(len(first), bool)
    if len(at) > len(first):  # else each run has one such gram, and no window can repeat within it
        low, high = np.searchsorted(at, first), np.searchsorted(at, first + n + width - 1)
        for i in np.flatnonzero(high - low > 1).tolist():
            twice[i] = (h[at[low[i] : high[i]]] == least[first[i]]).sum() > 1
    return first, n, least[first].view(np.int64), twice


def merged(ranges: np.ndarray) -> np.ndarray:
    """Overlapping and touching (start, stop) rows as maximal ones."""
    if len(ranges) < 2:
        return ranges
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([r[at, 0], reach[np.append(at[1:], len(r)) - 1]], 1)


def _ranges(blobs: list[bytes | None]) -> np.ndarray:
    found = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in blobs if x]
    return merged(np.concatenate(found).astype(np.int64)) if found else np.empty((0, 2), np.int64)


# ---- suffix arrays -------------------------------------------------------------------------------------------------


class SuffixArray:
    """The windows of `length` bytes of some regions in order of their bytes, and their common prefixes."""

    def __init__(self, regions: list[bytes], length: int = LENGTH):
        self.length = length
        self.text = np.frombuffer(b"".join(regions), np.uint8)
        sizes = np.array([len(r) for r in regions], np.int64)
        ends = np.cumsum(sizes)
        self.left = np.repeat(ends, sizes) - np.arange(len(self.text))  # bytes up to the region's end
        self.words = self._words()
        self.order = self._refine()
        self.common = self._kasai()

    def _words(self) -> np.ndarray:
        """The 8 bytes from each place on as one big-endian number."""
        w = np.concatenate([self.text, np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):
            w = (w[:-k] << np.uint64(8 * k)) | w[k:]
        return w[: len(self.text)]

    def _refine(self) -> np.ndarray:
        n = len(self.text)
        rank = np.zeros(n, np.int64)
        live = np.flatnonzero(self.left >= min(8, self.length))
        key = self.words[live]
        if self.length < 8:
            key = key >> np.uint64(8 * (8 - self.length))
        order = np.argsort(key)
        live, key = live[order], key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]]) if len(live) else np.empty(0, bool)
        group = np.flatnonzero(head)
        rank[live] = np.repeat(group, np.diff(np.append(group, len(live))))
        depth = min(8, self.length)
        tied = live[np.repeat(np.diff(np.append(group, len(live))) > 1, np.diff(np.append(group, len(live))))] if len(live) else live
        while depth < self.length and len(tied):
            step = min(depth, self.length - depth)
            tied = tied[self.left[tied] >= depth + step]
            major = rank[tied]
            key = major.astype(np.uint64) * np.uint64(n + 1) + rank[tied + step].astype(np.uint64)
            order = np.argsort(key)
            tied, key, major = tied[order], key[order], major[order]
            if not len(tied):
                break
            head = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.flatnonzero(head)
            sizes = np.diff(np.append(group, len(tied)))
            outer = np.flatnonzero(np.concatenate([[True], major[1:] != major[:-1]]))
            base = np.repeat(outer, np.diff(np.append(outer, len(tied))))
            rank[tied] = major + np.repeat(group, sizes) - base
            tied = tied[np.repeat(sizes > 1, sizes)]
            depth += step
        windows = np.flatnonzero(self.left >= self.length)
        return windows[np.argsort(rank[windows], kind="stable")]

    def _kasai(self) -> np.ndarray:
        """Common prefix of each window with the one before it in order; the first has 0."""
        out = np.zeros(len(self.order), np.int64)
        if len(self.order) < 2:
            return out
        cur, prev = self.order[1:], self.order[:-1]
        by_text = np.argsort(cur)
        c, p = cur[by_text], prev[by_text]
        most = np.minimum(self.left[c], self.left[p])
        head = np.concatenate([[True], (c[1:] != c[:-1] + 1) | (p[1:] != p[:-1] + 1)])
        heads = np.flatnonzero(head)
        found = np.zeros(len(heads), np.int64)
        live = np.arange(len(heads))
        while len(live):  # eight bytes at a time, only while all were equal
            a, b = c[heads[live]] + found[live], p[heads[live]] + found[live]
            diff = self.words[np.minimum(a, len(self.text) - 1)] ^ self.words[np.minimum(b, len(self.text) - 1)]
            equal = np.full(len(live), 8)
            for k in range(7, -1, -1):
                equal[(diff >> np.uint64(8 * (7 - k))) != 0] = np.minimum(equal[(diff >> np.uint64(8 * (7 - k))) != 0], k)
            found[live] += equal
            live = live[(equal == 8) & (found[live] < most[heads[live]])]
        run = np.cumsum(head) - 1
        lcp = found[run] - (np.arange(len(c)) - heads[run])
        out[by_text + 1] = np.minimum(lcp, most)
        return out

    def repeated(self) -> np.ndarray:
        """The windows that occur twice or more."""
        same = self.common >= self.length
        both = same.copy()
        both[:-1] |= same[1:]
        return self.order[both]

    def _compare(self, order: np.ndarray, other: SuffixArray, at: np.ndarray) -> np.ndarray:
        """Sign of own windows against windows of another array."""
        sign = np.zeros(len(at), np.int8)
        live = np.arange(len(at))
        places = [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])] if self.length >= 8 else []
        for k in places:
            a, b = self.words[order[live] + k], other.words[at[live] + k]
            sign[live] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            live = live[a == b]
            if not len(live):
                break
        return sign

    def found_in(self, other: SuffixArray) -> np.ndarray:
        """Own windows that occur in another array, by bisection of its order."""
        if not len(other.order) or not len(self.order):
            return self.order[:0]
        low, high = np.zeros(len(self.order), np.int64), np.full(len(self.order), len(other.order))
        hit = np.zeros(len(self.order), bool)
        live = np.arange(len(self.order))
        while len(live):
            mid = (low[live] + high[live]) // 2
            sign = self._compare(self.order[live], other, other.order[mid])
            hit[live[sign == 0]] = True
            low[live[sign > 0]] = mid[sign > 0] + 1
            high[live[sign < 0]] = mid[sign < 0]
            live = live[(sign != 0) & (low[live] < high[live])]
        return self.order[hit]


def repeats(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each region the first bytes of its windows that occur twice or more in all of them."""
    array = SuffixArray(regions, length)
    return _by_region(array.repeated(), regions)


def _by_region(places: np.ndarray, regions: list[bytes]) -> list[np.ndarray]:
    begins = np.concatenate([[0], np.cumsum([len(r) for r in regions])])
    places = np.sort(places)
    cuts = np.searchsorted(places, begins)
    return [places[cuts[i] : cuts[i + 1]] - begins[i] for i in range(len(regions))]


# ---- the plan ------------------------------------------------------------------------------------------------------

_OCCURRENCE = "key bigint, region bigint, doc_id {d}, t bigint, start int, size int, many boolean, loop boolean, marks binary"


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, row, start, size, loop, digest = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                first, n, least, inner = window_runs(data, length)
                if len(first):
                    key.append(least), start.append(first), size.append(n + length - 1), loop.append(inner)
                    row.append(np.full(len(first), i))
                    digest += [hashlib.blake2b(data[a:z], digest_size=8).digest() for a, z in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)]
            if not key:
                continue
            key, row, start, size, loop = (np.concatenate(x) for x in (key, row, start, size, loop))
            region = np.frombuffer(b"".join(digest), "<i8")
            order = np.lexsort((region, key))
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (region[order][1:] != region[order][:-1])])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            # all of a repeated region's occurrences are covered; one goes on, for other batches
            covered = order[many]
            mark_row, marks = [], []
            if len(covered):
                covered = covered[np.argsort(row[covered], kind="stable")]
                for part in np.split(covered, np.flatnonzero(np.diff(row[covered])) + 1):
                    mark_row.append(int(row[part[0]]))
                    marks.append(merged(np.stack([start[part], start[part] + size[part]], 1)).astype("<i4").tobytes())
            sent, extra = order[new], len(mark_row)
            rows = np.concatenate([row[sent], np.array(mark_row, np.int64)])
            t = b.column("t").take(pa.array(rows))
            none = np.zeros(extra, np.int64)
            keys = np.concatenate([key[sent], t.to_numpy(zero_copy_only=False)[len(sent) :].astype(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys), pa.array(np.concatenate([region[sent], none])), b.column("doc_id").take(pa.array(rows)), t,
                    pa.array(np.concatenate([start[sent], none]).astype(np.int32)), pa.array(np.concatenate([size[sent], none]).astype(np.int32)),
                    pa.array(np.concatenate([many[new], none.astype(bool)])), pa.array(np.concatenate([loop[sent], none.astype(bool)])), pa.array([None] * len(sent) + marks, pa.binary()),
                ],
                names=["key", "region", "doc_id", "t", "start", "size", "many", "loop", "marks"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(released(run), _OCCURRENCE.format(d=kind.simpleString()))


def _judged(found: DataFrame, shard_regions: int) -> DataFrame:
    """Per document: what is covered whole (blobs in `marks`, or asks of kind 0 and 1), and the regions to compare (kinds 1 and 2)."""
    by_key = Window.partitionBy("key")
    by_region = Window.partitionBy("key", "region", F.col("marks").isNull())
    found = found.repartition(F.col("key"))
    found = found.withColumn("nth", F.row_number().over(by_region.orderBy("doc_id", "t", "start")))
    found = found.withColumn("twice", F.col("marks").isNull() & ((F.count(F.lit(1)).over(by_region) > 1) | F.max("many").over(by_region)))
    real = F.col("marks").isNull()
    found = found.withColumn("n_regions", F.sum(F.when(real & (F.col("nth") == 1), 1).otherwise(0)).over(by_key))
    found = found.withColumn("open", F.max(real & ~F.col("twice")).over(by_key))
    ask = (F.col("nth") == 1) & ((F.col("n_regions") > 1) | F.col("loop")) & F.col("open")
    found = found.withColumn("kind", F.when(F.col("marks").isNotNull(), F.lit(3)).when(F.col("twice") & ask, F.lit(1)).when(ask, F.lit(2)).when(F.col("twice"), F.lit(0)))
    found = found.where(F.col("kind").isNotNull())
    parts = F.ceil(F.col("n_regions") / F.lit(shard_regions)).cast("int")
    asks = F.when(F.col("marks").isNull(), F.struct("start", "size", "kind", F.when(F.col("kind") > 0, F.col("key")).alias("key"), parts.alias("parts"), F.pmod(F.col("region"), parts).cast("int").alias("part")))
    return found.groupBy("doc_id", "t").agg(F.collect_list("marks").alias("marks"), F.collect_list(asks).alias("asks"))


def _digest(data: bytes, covered: np.ndarray) -> tuple[int, int, int, bytes]:
    """(n_bytes, n_removed, n_spans, kept bytes)."""
    at, kept = 0, []
    for a, z in covered.tolist():
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    rest = b"".join(kept)
    return len(data), len(data) - len(rest), len(covered), rest


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"


def _results(rows: list[tuple[int, int, int, bytes]], with_text: bool) -> list[pa.Array]:
    return [
        *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
        pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()),
        pa.array([r[3].decode("utf-8", "ignore") if with_text else None for r in rows], pa.string()),
    ]


def _dealt_anew(hot: DataFrame, cell: int, length: int, shard_regions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges covered whole, regions to compare, regions of hashes that are still too large) of hot hashes' regions by cells."""
    kind = hot.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, region, row, start, part = [], [], [], [], []
            for i, (k, at, data) in enumerate(zip(b.column("key").to_pylist(), b.column("start").to_pylist(), b.column("data").to_pylist(), strict=True)):
                for new, first, last in cells(data, k, cell, length):
                    key.append(new), row.append(i), start.append(at + first), part.append(data[first : last + length])
                    region.append(int.from_bytes(hashlib.blake2b(part[-1], digest_size=8).digest(), "little", signed=True))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array([np.array([a, a + len(x)], "<i4").tobytes() for a, x in zip(start, part, strict=True)], pa.binary()), b.column("key").take(take), pa.array(region, pa.int64()), b.column("doc_id").take(take), b.column("t").take(take), pa.array(start, pa.int32()), b.column("target").take(take), pa.array(part, pa.binary())],
                names=["key", "mark", "gram", "region", "doc_id", "t", "start", "target", "data"],
            )

    rows = written(hot.mapInArrow(released(split), f"key bigint, mark binary, gram bigint, region bigint, doc_id {kind}, t bigint, start int, target boolean, data binary"), "cells")
    # counted by partial sums, so a sub-region that very many texts have is one row for a task
    pick = F.xxhash64("doc_id", "t", "start")
    same = rows.groupBy("key", "region").agg(F.count("*").alias("c"), F.max("target").alias("wanted"), F.min(pick).alias("pick"))
    keys = same.groupBy("key").agg(F.count("*").alias("n"), F.max((F.col("c") == 1) & F.col("wanted")).alias("open"))
    same = written(same.join(keys, "key").select(F.col("key").alias("k2"), F.col("region").alias("r2"), "c", "pick", "n", "open").where("c > 1 or (open and n > 1)"), "cells")
    j = rows.join(same, (F.col("key") == F.col("k2")) & (F.col("region") == F.col("r2")))
    marks = j.where("c > 1 and target").select("doc_id", "t", F.col("mark").alias("found"))
    asks = j.where((F.col("n") > 1) & F.col("open") & ((F.col("c") == 1) | (pick == F.col("pick"))))
    asks = asks.select("key", "gram", "n", F.lit(0).cast("bigint").alias("block"), "doc_id", "t", "start", (F.col("target") & (F.col("c") == 1)).alias("target"), "data")
    cool = asks.where(F.col("n") <= shard_regions).select("key", "block", "doc_id", "t", "start", "target", "data")
    # a deeper cell asks for the first gram again, so these keep the hash of that
    still = asks.where(F.col("n") > shard_regions).select(F.col("gram").alias("key"), "doc_id", "t", "start", "target", "data")
    return marks, cool, still


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (bytes of cut characters are left out)."""
    out = _compared(docs, ["doc_id"], length, with_text, shard_regions)
    return out.select(F.col("c._0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text)


def keep_rest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with all their columns and rows, repeats taken out of text; n_chars follows. A text of nothing but repeats becomes empty."""
    others = [c for c in docs.columns if c != "text"]
    out = _compared(docs, others, length, True, SHARD_REGIONS)
    field = {c: F.col(f"c._{i}") for i, c in enumerate(others)}
    made = {"text": F.col("kept_text"), **({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(field["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*((made[c] if c in made else field[c]).alias(c) for c in docs.columns))


def _compared(docs: DataFrame, carry: list[str], length: int, with_text: bool, shard_regions: int) -> DataFrame:
    """A struct c of the columns in `carry` (fields _0, _1, ...), then the results."""
    spark = docs.sparkSession
    asked = _judged(_occurrences(docs, length), shard_regions).select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), "marks", "asks")
    rows = docs.select(F.struct(*(x.alias(f"_{i}") for i, x in enumerate(columns_of(docs, carry)))).alias("c"), F.col("doc_id"), F.xxhash64("text").alias("t"), "text")
    rows = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left").drop("d2", "t2")
    names = ["c", "doc_id", "t", "key", "block", "start", "target", "data", "done", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    part_schema = f"c {rows.schema['c'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, key bigint, block bigint, start int, target boolean, data binary, done binary, {_RESULT}"

    def asked_of(b: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        """For each document a row with its result, or with its bytes and covered ranges if regions are still open; and a row for each region to compare."""
        marks, asks = b.column("marks").to_pylist(), b.column("asks").to_pylist()
        row, key, block, start, target, data, done, result = [], [], [], [], [], [], [], []
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            mine = asks[i] or []
            whole = np.array([(a["start"], a["start"] + a["size"]) for a in mine if a["kind"] < 2], np.int64).reshape(-1, 2)
            covered = merged(np.concatenate([_ranges(marks[i] or []), whole]))
            open_here = False
            for a in mine:
                if a["kind"]:
                    z = a["start"] + a["size"]
                    wanted = a["kind"] == 2
                    if wanted and len(covered):
                        k = int(np.searchsorted(covered[:, 0], a["start"], "right")) - 1
                        wanted = not (k >= 0 and covered[k, 1] >= z)
                    open_here |= wanted
                    p, n = a["part"], a["parts"]
                    if n > MERGED:
                        row.append(i), key.append(a["key"]), block.append(-1), start.append(a["start"]), target.append(wanted)
                        data.append(raw[a["start"] : z]), done.append(None), result.append(None)
                        continue
                    for other in range(n):  # shards of one hash meet two by two
                        if n == 1 or other != p:
                            row.append(i), key.append(a["key"]), block.append((min(p, other) * n + max(p, other)) * 2 + (p > other)), start.append(a["start"]), target.append(wanted)
                            data.append(raw[a["start"] : z]), done.append(None), result.append(None)
            row.append(i), key.append(None), block.append(None), start.append(None), target.append(None)
            data.append(raw if open_here else None), done.append(covered.astype("<i4").tobytes() if open_here else None)
            result.append(None if open_here else _digest(raw, covered))
        blank = [None] * 4
        result = [r or blank for r in result]
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                b.column("c").take(take), b.column("doc_id").take(take), b.column("t").take(take), pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(start, pa.int32()), pa.array(target, pa.bool_()),
                pa.array(data, pa.binary()), pa.array(done, pa.binary()), *(pa.array([r[k] for r in result], pa.int64()) for k in range(3)),
                pa.array([None if r[3] is None else hashlib.sha256(r[3]).hexdigest() for r in result], pa.string()), pa.array([r[3].decode("utf-8", "ignore") if with_text and r[3] is not None else None for r in result], pa.string()),
            ],
            names=names,
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for s in chunks(texts):
                yield asked_of(whole.slice(s.start, s.stop - s.start), texts[s])

    table = written(rows.mapInArrow(released(ask), part_schema), "repeats")
    del rows, asked
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files behind the written table

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of whole groups, some megabytes each; a hash that was split comes as pairs of shards."""
        held: list[tuple] = []
        size, last = 0, None

        def out(regions: list[tuple], places: list[np.ndarray]) -> pa.RecordBatch:
            kept = [(r, p) for r, p in zip(regions, places, strict=True) if r[5] and len(p)]
            blobs = [merged(np.stack([p + r[4], p + r[4] + length], 1)).astype("<i4").tobytes() for r, p in kept]
            return pa.RecordBatch.from_arrays([pa.array([r[2] for r, _ in kept], doc_type), pa.array([r[3] for r, _ in kept], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "t", "found"])

        def flush() -> Iterator[pa.RecordBatch]:
            plain = [r for r in held if r[1] == 0]
            if plain:
                yield out(plain, repeats([r[6] for r in plain], length))
            pairs: dict[tuple, list[list]] = {}
            for r in held:
                if r[1]:
                    pairs.setdefault((r[0], r[1] // 2), [[], []])[r[1] % 2].append(r)
            for a, z in pairs.values():
                arrays = [SuffixArray([r[6] for r in side], length) for side in (a, z)]
                for mine, side, other in ((arrays[0], a, arrays[1]), (arrays[1], z, arrays[0])):
                    both = np.union1d(mine.repeated(), mine.found_in(other))
                    yield out(side, _by_region(both, [r[6] for r in side]))

        doc_type = None
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "block", "doc_id", "t", "start", "target", "data")), strict=True):
                group = (r[0], r[1] // 2)
                if group != last and size >= SHARD_BYTES:
                    yield from flush()
                    held, size = [], 0
                last = group
                held.append(r)
                size += len(r[6])
        if held:
            yield from flush()

    regions = table.where("key is not null and block >= 0").select("key", "block", "doc_id", "t", "start", "target", "data")
    covered = None
    hot = table.where("block = -1").select("key", "doc_id", "t", "start", "target", "data")
    for cell in CELLS:
        if hot.isEmpty():
            break
        marks, cool, hot = _dealt_anew(hot, cell, length, shard_regions)
        covered = marks if covered is None else covered.unionByName(marks)
        regions = regions.unionByName(cool)
    # the side bit of a pair is no part of its group
    regions = regions.repartition(F.col("key"), F.floor(F.col("block") / 2)).sortWithinPartitions("key", "block")
    found = regions.mapInArrow(released(compare), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, found binary")
    found = found if covered is None else found.unionByName(covered)
    found = found.groupBy("doc_id", "t").agg(F.collect_list("found").alias("found")).select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), "found")
    answers = table.where(F.col("key").isNull())
    pending = answers.where(F.col("done").isNotNull()).select("c", "doc_id", "t", "data", "done")
    pending = pending.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left").select("c", "data", "done", "found")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("data").to_pylist()
            for s in chunks(texts):
                b = whole.slice(s.start, s.stop - s.start)
                rows = [_digest(d, _ranges([c, *(f or [])])) for d, c, f in zip(texts[s], b.column("done").to_pylist(), b.column("found").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("c"), *_results(rows, with_text)], names=["c", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    late = pending.mapInArrow(released(finish), f"c {table.schema['c'].dataType.simpleString()}, {_RESULT}")
    early = answers.where(F.col("done").isNull()).select("c", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    return early.unionByName(late)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Covered bytes of each text by counting every window; for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        c = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                c[i : i + length] = True
        out.append(c)
    return out
