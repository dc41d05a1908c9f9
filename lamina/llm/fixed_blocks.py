"""Substring deduplication by fixed-block anchors.

A repeat is a run of words all of whose windows of `window` words also start in a document with a smaller doc_id; its words are
removed, and the smallest document keeps them. Windows are judged on the input, never on what is left.

Any window of 13 words holds one whole aligned block of 7 words (2 * 7 - 1 = 13) of the document it stands in. So:

1. Index: the non-overlapping blocks of all documents, by hash, with the smallest document that has each.
2. Probe: the hash of every rolling window of 7 words of all documents is looked up. A probe that finds a smaller document is an
   anchor; so are the blocks that such a probe has found.
3. Extend: the windows of 13 words around anchors, and only these, get a digest of 128 bits; the smallest document of each digest is
   a partial aggregate. Windows that a smaller document has too are laid over each other, which gives the maximal exact repeats.

No pair of documents is ever made: a passage that a million documents share has one row for each of them in steps 2 and 3, joined
with one row of the index, and adaptive execution may split such keys. Hashes are taken in `slices` parts one after the other, so the
shuffle files of a step hold a part of all words only. Blocks are told by 64 bits, where a clash costs only work.

Cases: a null text has no words; a null doc_id is neither smaller nor larger than any other, so its document keeps all and takes
nothing from others; rows with equal doc_id take nothing from each other, whether their texts are equal or not; texts with fewer than
13 words stay whole; an empty table gives an empty table; other columns are left out, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, written

WINDOW = 13
#: Parts of all hashes that are worked on one after the other.
SLICES = 2
#: Bytes of text that numpy works on at once.
BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20_240_612)
#: By lane: what a word's hash starts from, and multipliers of words in a window.
_FIRST = _RANDOM.integers(0, 2**63, 2, np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, (2, 256), np.uint64) | np.uint64(1)
#: Masks of the first n bytes of a word of eight, and the length from which words are hashed one by one.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a value depends on all of its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: the document of each and its number there, and where its bytes are."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        word = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before, after = np.append(False, word[:-1])[: len(word)], np.append(word[1:], False)[: len(word)]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.stop = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(self.start)) - self.first[self.doc]

    def hashes(self, lane: int) -> np.ndarray:
        """One value of 64 bits for each word, from its bytes eight by eight."""
        size = self.stop - self.start
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out = mixed(size.astype(np.uint64) + _FIRST[lane])
        out = mixed(out ^ (eight[self.start] & _MASK[np.minimum(size, 8)]))
        more = np.flatnonzero((size > 8) & (size <= _LONG))
        for at in range(8, _LONG, 8):
            more = more[size[more] > at]
            out[more] = mixed(out[more] ^ (eight[self.start[more] + at] & _MASK[np.minimum(size[more] - at, 8)]))
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.stop[i]].tobytes(), int(_FIRST[lane]))
        return out

    def windows(self, n: int, lane: int) -> np.ndarray:
        """A value for each run of n words, by its first word; runs over the end of a document have values without meaning."""
        h = self.hashes(lane)
        out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for i in range(n):
            out += h[i : i + len(out)] * _PLACE[lane][i]
        return mixed(out)

    def whole(self, n: int) -> np.ndarray:
        """The first words of all runs of n words of one document."""
        return np.flatnonzero(self.doc[: max(len(self.doc) - n + 1, 0)] == self.doc[n - 1 :]) if len(self.doc) >= n else np.zeros(0, np.int64)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BYTES of text; one text is never split."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _listed(lists: pa.Array, base: np.ndarray) -> np.ndarray:
    """The word numbers of lists of places, one list for each document."""
    return np.repeat(base[:-1], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + lists.flatten().to_numpy()


def block_hashes(docs: DataFrame, block: int, slices: int, part: int | None) -> DataFrame:
    """h, doc_id, pos: of the aligned blocks of all parts (part None, with the column slice), or of every rolling window of one part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                words = Words(b.column("text"))
                h, at = words.windows(block, 0), words.whole(block)
                slot = (h >> np.uint64(32)) % np.uint64(slices)
                at = at[words.place[at] % block == 0] if part is None else at[slot[at] == part]
                rows = [pa.array(h[at].view(np.int64)), b.column("doc_id").take(pa.array(words.doc[at])), pa.array(words.place[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(rows + [pa.array(slot[at].astype(np.int32))] * (part is None), names=["h", "doc_id", "pos", "slice"][: 3 + (part is None)])

    return docs.mapInArrow(released(run), f"h bigint, doc_id {kind}, pos int" + ", slice int" * (part is None))


def anchors(docs: DataFrame, block: int, slices: int) -> list[DataFrame]:
    """doc_id and pos of every block of words that a block or probe of another document equals, as a written table for each slice.

    What is joined is a written table or comes straight from the texts, so that adaptive execution can split a key that many have."""
    blocks = written(block_hashes(docs, block, slices, None), "blocks")
    index = written(blocks.groupBy("slice", "h").agg(F.min("doc_id").alias("first")), "index")
    found = []
    for part in range(slices):
        here = F.col("slice") == part
        probes = block_hashes(docs, block, slices, part)
        # the index has one row for each hash and a seventh of the probes at most: hashed, the probes need no sort
        hits = probes.join(index.where(here).drop("slice").hint("shuffle_hash"), "h")
        hits = written(hits.where(F.col("doc_id") > F.col("first")).drop("first"), "hits")
        met = written(hits.select("h").distinct(), "met")
        own = blocks.where(here).drop("slice").join(met.hint("shuffle_hash"), "h", "left_semi")
        found.append(written(hits.select("doc_id", "pos").union(own.select("doc_id", "pos")), "anchors"))
        dropped(hits, met)
    dropped(blocks, index)
    return found


def window_digests(live: DataFrame, window: int, block: int, slices: int) -> DataFrame:
    """k1, k2, doc_id, t, start, slice of the windows around anchors."""
    kind = live.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                words = Words(b.column("text"))
                # before each word, how many anchors there are: a window with none is not looked at
                place = _listed(b.column("pos"), words.first)
                seen = np.zeros(len(words.doc) + 1, np.int64)
                seen[1:][place[place < len(words.doc)]] = 1
                seen = np.cumsum(seen)
                at = words.whole(window)
                at = at[seen[at + window - block + 1] > seen[at]]
                k = [words.windows(window, lane)[at] for lane in (0, 1)]
                doc = pa.array(words.doc[at])
                rows = [pa.array(x.view(np.int64)) for x in k] + [b.column(c).take(doc) for c in ("doc_id", "t")]
                rows += [pa.array(words.place[at].astype(np.int32)), pa.array(((k[0] >> np.uint64(32)) % np.uint64(slices)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(rows, names=["k1", "k2", "doc_id", "t", "start", "slice"])

    return live.mapInArrow(released(run), f"k1 bigint, k2 bigint, doc_id {kind}, t bigint, start int, slice int")


def repeats(docs: DataFrame, window: int = WINDOW, slices: int = SLICES) -> DataFrame:
    """doc_id, t (the text's hash) and the first words of all windows that a smaller document has too."""
    block = (window + 1) // 2
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    near = anchors(docs, block, slices)
    places = reduce(DataFrame.union, near).groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    live = docs.withColumn("t", F.xxhash64("text")).join(places, "doc_id")
    rows = written(window_digests(live, window, block, slices), "windows")
    dropped(*near)
    found = []
    for part in range(slices):
        own = rows.where(F.col("slice") == part).drop("slice")
        first = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last"))
        first = written(first.drop("last"), "first")
        found.append(written(own.join(first.hint("shuffle_hash"), ["k1", "k2"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "t", "start"), "repeats"))
        dropped(first)
    dropped(rows)
    return reduce(DataFrame.union, found).groupBy("doc_id", "t").agg(F.collect_set("start").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, slices: int = SLICES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start and length in words of the maximal removed runs), kept (the rest, one space between words)."""
    found = repeats(docs, window, slices).select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), "starts")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    rows = rows.join(found, (F.col("doc_id") == F.col("d2")) & (F.col("t") == F.col("t2")), "left").select("doc_id", "text", "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                words = Words(b.column("text"))
                at = _listed(b.column("starts"), words.first)
                cover = np.bincount(at, minlength=len(words.doc) + 1) - np.bincount(at + window, minlength=len(words.doc) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                total = np.append(0, np.cumsum(gone))[words.first]
                # a removed run begins where the word before is kept or of another document
                inner = words.place > 0
                begin = np.flatnonzero(gone & ~(np.append(False, gone[:-1])[: len(gone)] & inner))
                end = np.flatnonzero(gone & ~(np.append(gone[1:], False)[: len(gone)] & np.append(inner[1:], False)[: len(gone)])) + 1
                span = pa.StructArray.from_arrays([pa.array(words.place[begin]), pa.array(end - begin)], ["start", "length"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first).astype(np.int32)), span)
                texts = kept_texts(words, ~gone)
                arrays = [b.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(np.diff(total).astype(np.int64)), spans, texts]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows.mapInArrow(released(run), f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<start: bigint, length: bigint>>, kept string")


def kept_texts(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document with one space between them: their bytes and, but for the last, the byte after each as a space."""
    stay = np.flatnonzero(keep)
    last = np.append(words.doc[stay][1:] != words.doc[stay][:-1], True)[: len(stay)]
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start[stay]] += 1
    np.subtract.at(edge, words.stop[stay] + ~last, 1)
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    text = words.data[mask]
    text[_SPACE[text]] = 0x20
    offsets = np.append(0, np.cumsum(mask))[words.offsets]
    return pa.LargeStringArray.from_buffers(len(words.count), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())


def oracle_sql(window: int = WINDOW) -> str:
    """The query's rows in DuckDB SQL."""
    last = window - 1
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT rn, doc_id, i, md5(array_to_string(w[i : i + {last}], ' ')) AS k FROM (SELECT rn, doc_id, w, unnest(range(1, len(w) - {last - 1})) AS i FROM d WHERE len(w) > {last} AND doc_id IS NOT NULL)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT rn, unnest(range(i, i + {window})) AS p FROM g JOIN f USING (k) WHERE doc_id > least),
e AS (SELECT rn, word, p FROM (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)),
s AS (SELECT rn, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c USING (rn, p) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (rn)"""
