"""Similarity self-join of documents by the chosen-path method, on sets of five-word shingles with Jaccard similarity.

A set's tokens for choosing paths are its 64 minhash values: two sets share each with the probability of their similarity.
In each run a few coordinates are drawn with probability 1 / (threshold x 64) each, one at least; a set goes to a bucket
for each drawn coordinate, named by its value there. Buckets of up to `leaf` sets with up to `leaf_shingles` shingles in all are
compared by brute force on the whole shingle sets; larger ones are split again, with coordinates drawn for that bucket. What is
still large at `depth` is cut into blocks, and every two blocks are compared, so nothing is capped. A pair at the threshold is found in one run with a probability of
threshold**depth at least; runs are repeated until the target recall: at 0.8, depth 2 and 0.9999 that is 10 runs.

Documents with equal sets are one class and go through as one. Pairs are not emitted: a bucket gives for each set its count
of links, and one edge to the least of those it hangs together with. As a pair may meet in several buckets, it is counted in the
first it shares, which is known from the members' lists of buckets. Sets are only fetched for buckets that count something:
pairs that agree in fewer minhash values than six standard deviations below the threshold's expectation are left out first
(a pair at the threshold is so with a probability of some 1e-8).

Counting the links of one group of n similar texts takes work in proportion to n^2, in blocks. keep_one() asks for groups only:
there a bucket's sets are searched from one linked set to the next, and a group of texts that are all similar takes one step.

The result has for each document: class_id, the smallest doc_id of the documents that are linked to it directly or through
others, its own included; n_links, the number of other classes of similarity `threshold` or more; n_copies, the documents with an equal set.

Words are runs of anything but ASCII white space, in lower case. A text of one to four words has one shingle, all its
words. Null, empty and blank texts have the empty set, which is linked to nothing; they are one class. A class whose doc_ids are
all null has a null class_id. Equal rows are copies. Empty tables give empty results. Only doc_id and text are read.
Shingles are known by 64-bit hashes, classes by 128-bit ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, dropped, released, written

WORDS, THRESHOLD, RECALL, LEAF, LEAF_SHINGLES, DEPTH, COORDINATES = 5, 0.8, 0.9999, 2048, 4_000_000, 2, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = np.random.default_rng(20).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)


def runs_for(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is missed with a probability of at most 1 - recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ h[k : len(mixed) + k]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """Minhash values."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(found), 4096):
        out = np.minimum(out, ((found[a : a + 4096, None] * _SPLIT[0] + _SPLIT[1]) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def drawn(node: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The coordinates on which a bucket (or a run, from 0 on) is split."""
    r = np.random.default_rng(node & (2**64 - 1))
    picked = np.flatnonzero(r.random(COORDINATES) < 1 / (threshold * COORDINATES))
    return picked if len(picked) else r.integers(0, COORDINATES, 1)


def children(node: int, values: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Names of the buckets below a node for rows of minhash values: (rows, drawn)."""
    at = drawn(node, threshold)
    x = (np.uint64(node * int(_MIX) & (2**64 - 1)) ^ values[:, at].astype(np.uint64)) * _MIX
    x = (x ^ (x >> np.uint64(31)) ^ at.astype(np.uint64)) * _MIX
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def class_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def profiles(docs: DataFrame, threshold: float = THRESHOLD, runs: int | None = None) -> DataFrame:
    """doc_id, t (hash of the text), c (class), w (shingles), keys (buckets of all runs), sig (minhash values), sketch (a byte of each)."""
    count = runs or runs_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            sig = np.array([signature(s) for s in sets], np.uint32).reshape(-1, COORDINATES)
            keys = np.concatenate([children(r, sig, threshold) for r in range(count)], 1) if len(sets) else np.empty((0, 1), np.int64)
            lists = [k if len(s) else [] for k, s in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("t"), pa.array([class_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())],
                names=["doc_id", "t", "c", "w", "keys", "sig", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(released(run), f"doc_id {kind}, t bigint, c binary, w int, keys array<bigint>, sig binary, sketch binary")


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Distinct (k, c, w) rows with n and total, the sets and the shingles of bucket k, where n is two or more."""
    rows = rows.distinct()
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("total")).where("n > 1").withColumnRenamed("k", "k2")
    return written(rows.join(sizes, F.col("k") == F.col("k2")).select("k", "c", "w", "n", "total"), name)


def _lists(rows: DataFrame) -> DataFrame:
    """(m, b): the distinct member lists of buckets, each at most a leaf, and a name for each."""
    lists = rows.groupBy("k").agg(F.sort_array(F.collect_list("c")).alias("m"))
    return lists.groupBy("m").agg(F.min("k").alias("b"))


def buckets(found: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, depth: int = DEPTH, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """(m, b) rows of all buckets to compare."""
    small = (F.col("n") <= leaf) & (F.col("total") <= leaf_shingles)
    level = _shared(found.select(F.explode("keys").alias("k"), "c", "w"), "paths")
    levels = [level]
    out = [_lists(level.where(small))]
    for step in range(1, depth + 1):
        large = level.where(~small)
        if large.isEmpty():
            break
        if step == depth:
            # every two blocks of about half a leaf
            blocks = F.greatest(F.ceil(F.col("n") / (leaf / 2)), F.ceil(F.col("total") / (leaf_shingles / 2))).cast("long")
            own = F.pmod(F.xxhash64("c", F.lit(step)), blocks)
            rows = large.select("k", "c", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j")).where("i <> j")
            rows = rows.select(F.xxhash64("k", F.least("i", "j"), F.greatest("i", "j")).alias("k"), "c")
            out.append(_lists(rows))
            break
        sigs = found.groupBy("c").agg(F.first("sig").alias("sig")).withColumnRenamed("c", "c2")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = b.column("k").to_numpy()
                value = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                for k in np.unique(node).tolist():
                    at = np.flatnonzero(node == k)
                    names = children(k, value[at], threshold)
                    rows = pa.array(np.repeat(at, names.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), b.column("c").take(rows), b.column("w").take(rows)], names=["k", "c", "w"])

        rows = large.join(sigs, F.col("c") == F.col("c2")).select("k", "c", "w", "sig").mapInArrow(released(split), "k bigint, c binary, w int")
        level = _shared(rows, "paths")
        levels.append(level)
        out.append(_lists(level.where(small)))
    all_lists = out[0]
    for x in out[1:]:
        all_lists = all_lists.unionByName(x)
    lists = written(all_lists.where(F.size("m") > 1), "buckets")
    dropped(*levels)
    return lists


def _first_meetings(b: int, lists: list) -> np.ndarray:
    """Which pairs of a bucket's members share no bucket of a smaller name."""
    n = len(lists)
    sizes = [len(x) for x in lists]
    keys = np.concatenate([np.asarray(x, np.int64) for x in lists])
    row = np.repeat(np.arange(n), sizes)
    smaller = keys < b
    out = ~np.eye(n, dtype=bool)
    if smaller.any():
        _, at = np.unique(keys[smaller], return_inverse=True)
        has = np.zeros((n, at.max() + 1), np.float32)
        has[row[smaller], at] = 1
        out &= (has @ has.T) < 0.5
    return out


def _alike(sketches: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs agree in enough of their minhash values that their similarity may reach the threshold."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), COORDINATES)
    if len(x) <= 64:
        same = (x[:, None] == x[None]).sum(-1)
    else:
        same = np.zeros((len(x), len(x)), np.uint8)
        for column in x.T:
            same += column[:, None] == column[None]
    # six standard deviations below what is expected at the threshold
    return same >= COORDINATES * threshold - 6 * math.sqrt(COORDINATES * threshold * (1 - threshold))


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[dict[str, list]]:
    """Rows of one value of a column at a time, from batches that are sorted by it."""
    held: dict[str, list] = {}
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in b.schema.names}
        values = cols[by]
        a = 0
        while a < len(values):
            z = a
            while z < len(values) and values[z] == values[a]:
                z += 1
            if held and held[by][0] != values[a]:
                yield held
                held = {}
            for n, x in cols.items():
                held.setdefault(n, []).extend(x[a:z])
            a = z
    if held:
        yield held


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), k := len(np.intersect1d(*sets, assume_unique=True))], [k, len(sets[1])]], np.float64)
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = count[at] > 1
    _, at = np.unique(at[often], return_inverse=True)
    row = row[often]
    out = np.zeros((n, n), np.float32)  # counts below 2**24 are exact
    if len(tokens) >= 1 << 24:
        out = out.astype(np.float64)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    wide = max(256, 8_000_000 // n)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        lo, hi = np.searchsorted(at, (a, a + wide))
        has = np.zeros((n, wide), np.float32)
        has[row[lo:hi], at[lo:hi] - a] = 1
        out += has @ has.T
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of different sets reach the threshold."""
    both = overlaps(sets)
    size = np.array([len(s) for s in sets], both.dtype)
    out = np.empty(both.shape, bool)
    for i in range(len(sets)):  # exact quotients, a row at a time
        out[i] = both[i].astype(np.float64) / (size[i] + size - both[i]).astype(np.float64) >= threshold
    np.fill_diagonal(out, False)
    return out


def hang_together(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the least one it is linked to, directly or through others: from each set found to all that are not yet, so a group of sets that are all similar takes one look."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    begins = np.cumsum(size) - size
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(len(tokens), bool)
    label, left = np.full(n, -1), np.arange(n)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        left = left[left != first]
        todo = [first]
        while todo and len(left):
            i = todo.pop()
            mine = at[begins[i] : begins[i] + size[i]]
            has[mine] = True
            pick = np.repeat(begins[left] - (np.cumsum(size[left]) - size[left]), size[left]) + np.arange(int(size[left].sum()))
            both = np.add.reduceat(has[at[pick]].astype(np.int64), np.cumsum(size[left]) - size[left])
            has[mine] = False
            near = both / (size[i] + size[left] - both) >= threshold
            label[left[near]] = first
            todo += left[near].tolist()
            left = left[~near]
    return label


def _least_linked(near: np.ndarray) -> np.ndarray:
    """For each row the least row it hangs together with."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(a, least) for all ends of edges (a, b): the least end of each connected component; least labels and their labels, until nothing changes."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "labels")
    while True:
        other = labels.select(F.col("a").alias("b2"), F.col("least").alias("l2"))
        around = both.join(other, F.col("b") == F.col("b2")).groupBy("a").agg(F.min("l2").alias("l3")).withColumnRenamed("a", "a3")
        new = labels.select("a", "least").join(around, F.col("a") == F.col("a3"), "left").select("a", F.col("least").alias("old"), F.least("least", "l3").alias("least"))
        jump = new.select(F.col("a").alias("a4"), F.col("least").alias("l4"))
        new = written(new.join(jump, F.col("least") == F.col("a4")).select("a", "old", F.least("least", "l4").alias("least")), "labels")
        dropped(labels)
        if new.where("old <> least").isEmpty():
            dropped(both)
            return new.select("a", "least")
        labels = new


def links(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, depth: int = DEPTH, leaf_shingles: int = LEAF_SHINGLES, counted: bool = True) -> DataFrame:
    """(c, root, links) rows, written, of every bucket: how many first met links a class has there (0 if they are not counted), and the least class it hangs together with."""
    lists = buckets(found, threshold, leaf, depth, leaf_shingles)
    members = lists.select("b", F.explode("m").alias("c"))
    own = members.groupBy("c").agg(F.collect_list("b").alias("bs"))
    own = own.join(found.groupBy("c").agg(F.first("sketch").alias("sketch")), "c").withColumnRenamed("c", "c2")
    rows = members.join(own, F.col("c") == F.col("c2")).select("b", "c", "bs", "sketch")

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, c, bs = [], [], []
        for g in _groups(batches, "b"):
            for i in np.flatnonzero((_first_meetings(g["b"][0], g["bs"]) & _alike(g["sketch"], threshold)).any(1)).tolist():
                b.append(g["b"][i]), c.append(g["c"][i]), bs.append(g["bs"][i])
            if len(b) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(bs, pa.list_(pa.int64()))], names=["b", "c", "bs"])
                b, c, bs = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(bs, pa.list_(pa.int64()))], names=["b", "c", "bs"])

    wanted = written(rows.repartition("b").sortWithinPartitions("b").mapInArrow(released(involved), "b bigint, c binary, bs array<bigint>"), "wanted")

    # the sets of one document of each class that is wanted
    places = found.groupBy("c").agg(F.min(F.struct("t", "doc_id")).alias("place"))
    places = wanted.select("c").distinct().join(places, "c").select("c", F.col("place.t").alias("t2"), F.col("place.doc_id").alias("d2"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(places, (F.col("t") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("d2"))).select("c", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["c", "shingles"])

    sets = texts.mapInArrow(released(to_sets), "c binary, shingles binary").withColumnRenamed("c", "c2")
    full = wanted.join(sets, F.col("c") == F.col("c2")).select("b", "c", "bs", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "b"):
            place = {x: i for i, x in reversed(list(enumerate(g["c"])))}  # equal rows of a table give a class twice
            c = sorted(place)
            sets = [np.frombuffer(g["shingles"][place[x]], np.uint64) for x in c]
            if counted:
                near = similar(sets, threshold)
                count = (near & _first_meetings(g["b"][0], [g["bs"][place[x]] for x in c])).sum(1)
                root, at = _least_linked(near), np.flatnonzero(near.any(1))
            else:
                root, count = hang_together(sets, threshold), np.zeros(len(c), np.int64)
                at = np.flatnonzero(root != np.arange(len(c)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in at], pa.binary()), pa.array([c[i] for i in root[at]], pa.binary()), pa.array(count[at].astype(np.int64))], names=["c", "root", "links"])

    met = written(full.repartition("b").sortWithinPartitions("b").mapInArrow(released(compare), "c binary, root binary, links bigint"), "links")
    dropped(lists, wanted)
    return met


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH, leaf_shingles: int = LEAF_SHINGLES, counted: bool = True) -> DataFrame:
    """doc_id, class_id, n_links (0 if links are not counted), n_copies, and t and keeper: the hash of the text, and whether this is the document of its group with the least (doc_id, t)."""
    found = written(profiles(docs, threshold, runs_for(threshold, recall, depth)), "shingles")
    met = links(docs, found, threshold, leaf, depth, leaf_shingles, counted)
    counts = met.groupBy("c").agg(F.sum("links").alias("links")).withColumnRenamed("c", "c2")
    groups = components(met.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("a", "c3")
    # a null doc_id comes after all others
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = found.groupBy("c").agg(F.count("*").alias("n_copies"), F.min(place).alias("place"))
    classes = classes.join(counts, F.col("c") == F.col("c2"), "left").join(groups, F.col("c") == F.col("c3"), "left")
    classes = written(classes.select("c", "n_copies", "place", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("least", "c").alias("g")), "classes")
    dropped(met)
    least = classes.groupBy("g").agg(F.min("place").alias("keep")).withColumnRenamed("g", "g2")
    classes = classes.join(least, F.col("g") == F.col("g2")).select(F.col("c").alias("c4"), "n_copies", "n_links", "keep")
    out = found.select("doc_id", "t", "c").join(classes, F.col("c") == F.col("c4"))
    keeper = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("t") == F.col("keep.t"))
    return out.select("doc_id", F.col("keep.doc_id").alias("class_id"), "n_links", "n_copies", "t", keeper.alias("keeper"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group, all columns as they are."""
    d, t, n = "_lamina_d", "_lamina_t", "_lamina_n"
    kept = join_documents(docs, threshold, counted=False).where("keeper").select(F.col("doc_id").alias(d), F.col("t").alias(t))
    counts = written(kept.groupBy(d, t).agg(F.count("*").alias(n)), "kept")
    out = docs.join(counts, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)))
    if not counts.where(F.col(n) > 1).isEmpty():  # equal rows: only here are texts dealt once more
        out = out.dropDuplicates([d, t])
    return out.select(*columns_of(docs))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The query's rows in DuckDB SQL, by counting common shingles of all pairs."""
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT rn, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')))) END AS s FROM w),
k AS MATERIALIZED (SELECT *, md5(array_to_string(s, chr(10))) AS c FROM s),
cls AS MATERIALIZED (SELECT c, any_value(s) AS s, len(any_value(s)) AS n, count(*) AS n_copies, min(doc_id) AS first_doc FROM k GROUP BY c),
x AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM cls),
p AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= {threshold}),
r AS (SELECT a AS c, b AS o FROM p UNION SELECT r.c, p.b FROM r JOIN p ON r.o = p.a)
SELECT doc_id, least(first_doc, coalesce((SELECT min(first_doc) FROM r JOIN cls z ON z.c = r.o WHERE r.c = k.c), first_doc)) AS class_id,
       (SELECT count(*) FROM p WHERE p.a = k.c)::BIGINT AS n_links, n_copies::BIGINT AS n_copies
FROM k JOIN cls USING (c)"""
