"""Similarity join, substring deduplication, language model and pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import language_model, near_join, suffix_dedup

from .conftest import prose


def near_texts():
    """Groups of copies, near copies around the threshold, and texts of their own."""
    r = random.Random(5)
    out = []
    for g in range(8):
        base = prose(60, 100 + g).split()
        for k in range(6):
            words = list(base)
            for _ in range(k if g % 2 else 0):
                words[r.randrange(len(words))] = f"new{r.randrange(99)}"
            out.append(" ".join(words))
    return out + [prose(40, 200 + i) for i in range(20)]


def brute_links(docs):
    c = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    return sorted(c.sql(near_join.oracle_sql()).fetchall(), key=str)


@pytest.mark.parametrize(("leaf", "depth", "shingles"), [(4096, 2, 10**6), (4, 2, 10**6), (2, 1, 10**6), (4096, 2, 200)])
def test_links_match_brute_force(make, edge_texts, leaf, depth, shingles):
    docs = make([*near_texts(), *edge_texts])
    want = brute_links(docs)
    got = near_join.join_documents(docs, recall=0.999999, leaf=leaf, depth=depth, leaf_shingles=shingles)
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links", "n_copies").collect()), key=str) == want
    if min(leaf, shingles) < 1000 and depth == 2:
        groups = near_join.join_documents(docs, recall=0.999999, leaf=leaf, depth=depth, leaf_shingles=shingles, counted=False)
        assert sorted(map(tuple, groups.select("doc_id", "class_id", "n_copies").collect()), key=str) == [(a, b, d) for a, b, _, d in want]


def test_groups_of_a_bucket():
    r = np.random.default_rng(4)
    for n in (1, 2, 30):
        base = [np.unique(r.integers(0, 400, 60).astype(np.uint64)) for _ in range(3)]
        sets = [np.unique(np.concatenate([x[r.random(len(x)) > 0.06], r.integers(500, 900, 2).astype(np.uint64)])) for x in (base[i % 3] for i in range(n))]
        sets[-1] = np.arange(1000, 1005, dtype=np.uint64)
        near = np.array([[a is not b and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets])
        assert (near_join.similar(sets, 0.8) == near).all()
        assert (near_join.hang_together(sets, 0.8) == near_join._least_linked(near)).all()


def test_recall_of_random_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    runs = near_join.runs_for()
    assert runs == 10
    missed = 0
    for _ in range(400):
        both = r.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        keys = [{k for i in range(runs) for k in near_join.children(i, near_join.signature(x)[None])[0].tolist()} for x in (a, b)]
        missed += not keys[0] & keys[1]
    assert missed == 0


def test_keep_one(make, edge_texts):
    texts = [*near_texts(), *edge_texts]
    docs = make([*texts, texts[0]], [*range(len(texts)), 0]).union(make([texts[0]], [0])).union(make([texts[1]], [None]))
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    classes = {r["class_id"] for r in near_join.join_documents(docs).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == classes
    assert near_join.join_documents(make([])).count() == 0 and near_join.keep_one(make([])).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1, 5), (5, 9), (9, 1), (100, 50)] + [(1000, 1001 + i) for i in range(30)] + [(r.randrange(3000, 3100), r.randrange(3000, 3100)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, near_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for x in parent}


def repeat_texts():
    shared, long = prose(60, 7), prose(150, 8)
    tails = [f"{shared[:260]}{prose(12, 300 + i)}" for i in range(25)] + [f"{prose(12, 400 + i)}{shared[:260]}" for i in range(15)]
    tails += [f"{shared[:250]}x{i % 7}{long[20 * i : 20 * i + 120]}" for i in range(20)] + [prose(9, i) + "lo " * (80 + i % 3) for i in range(9)]
    return tails + [f"{prose(30, 1)} {shared} {prose(30, 2)}", f"{shared} {prose(20, 3)}", f"{prose(50, 4)}{long[:450]}", long, long, long[:-3] + "é.", prose(100, 5), ("ab" * 150) + prose(10, 6), "é" * 250, f"{long[100:330]}"]


@pytest.mark.parametrize("regions", [16_384, 12, 2, 1])
def test_repeats_match_brute_force(make, edge_texts, regions):
    """Small shards send hashes through pairs of shards, and those with more than four through cells."""
    long = prose(20_000, 1)
    texts = [*repeat_texts(), *edge_texts, *([long[5000:60_000] + "x" + long[3000:4000], "\u00e9" + long[70_000:70_400]] if regions > 100 else [])]
    docs = make(texts, [None, *range(1, len(texts))])
    raw = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, shard_regions=regions, with_text=True).collect()}
    assert len(got) == len(texts)
    for i, (data, covered) in enumerate(zip(raw, suffix_dedup.brute_force(raw), strict=True)):
        r = got[i or None]
        rest = bytes(np.frombuffer(data, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), int(covered.sum()), spans, hashlib.sha256(rest).hexdigest()), i
        assert r["kept_text"] == rest.decode("utf-8", "ignore")


def test_cells_deal_equal_windows_alike():
    text = (prose(60, 1) + " lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo lo " + prose(60, 2)).encode()
    for cell in (16, 4, 1):
        seen: dict[bytes, int] = {}
        for shift in (0, 7):
            data = b"x" * shift + text
            first, n, key, _ = suffix_dedup.window_runs(data)
            for a, k, h in zip(first.tolist(), n.tolist(), key.tolist()):
                part = data[a : a + k + 199]
                dealt = suffix_dedup.cells(part, h, cell)
                assert [w for _, x, y in dealt for w in range(x, y + 1)] == list(range(k)) and all(y - x < cell for _, x, y in dealt)
                for new, x, y in dealt:
                    for w in range(x, y + 1):
                        assert seen.setdefault(part[w : w + 200], new) == new
        if cell == 1:
            assert len(set(seen.values())) == len(seen)


def test_equal_rows_lose_what_they_share(make):
    text = prose(80, 1)
    out = suffix_dedup.remove_repeats(make([text, text, "x"], [1, 1, 1])).collect()
    assert sorted(r["n_removed"] for r in out) == [0, len(text), len(text)]
    assert suffix_dedup.remove_repeats(make([])).count() == 0 and suffix_dedup.keep_rest(make([])).count() == 0


def test_keep_rest(make):
    docs = make([*repeat_texts(), None])
    kept = suffix_dedup.keep_rest(docs)
    assert kept.columns == docs.columns
    rows, n = {r["doc_id"]: r for r in kept.collect()}, len(repeat_texts()) - 10
    assert len(rows) == docs.count() and rows[n + 6]["text"] == repeat_texts()[n + 6] and rows[n + 6]["a.b"] == "dot" and rows[n + 3]["text"] == "" and rows[n + 3]["n_chars"] == 0


@pytest.mark.parametrize("length", [8, 13, 40])
def test_suffix_arrays(length):
    r = random.Random(length)
    base = ["".join(r.choices("abc ", k=200)).encode() for _ in range(3)]
    regions = []
    for _ in range(30):
        x = bytearray(r.choice(base))
        x[r.randrange(200)] = 120
        a = r.randrange(100)
        regions.append(bytes(x[a : a + r.randint(10, 100)]))
    count = Counter(t[i : i + length] for t in regions for i in range(len(t) - length + 1))
    for t, found in zip(regions, suffix_dedup.repeats(regions, length), strict=True):
        assert found.tolist() == [i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
    array = suffix_dedup.SuffixArray(regions, length)
    text = array.text.tobytes()
    windows = [text[i : i + length] for i in array.order]
    assert windows == sorted(windows)
    for k in range(1, len(windows)):
        a, b = (text[i : i + array.left[i]] for i in array.order[k - 1 : k + 1])
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert array.common[k] == same
    one, two = suffix_dedup.SuffixArray(regions[:15], length), suffix_dedup.SuffixArray(regions[15:], length)
    other = {t[i : i + length] for t in regions[15:] for i in range(len(t) - length + 1)}
    assert [f.tolist() for f in suffix_dedup._by_region(one.found_in(two), regions[:15])] == [[i for i in range(len(t) - length + 1) if t[i : i + length] in other] for t in regions[:15]]


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 100), (3000, 2**63 - 1), (500, 501), (800, 300)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, universe, n)).astype(np.uint64)
    e = language_model.EliasFano.of(v, universe)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([v[:200], r.integers(0, universe, 200).astype(np.uint64)])
    want = np.searchsorted(v, q)
    hit = want < n
    hit[hit] = v[want[hit]] == q[hit]
    assert (e.search(q) == np.where(hit, want, -1)).all()


def plain_scores(rows, order):
    tokens = {i: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + ["\n"] for i, t in rows}
    learned = [t for i, t in tokens.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    n = [Counter(tuple(t[i : i + k + 1]) for t in learned for i in range(len(t) - k)) for k in range(order)]
    total, distinct = sum(n[0].values()), len(n[0])
    bucket = lambda x: x if x <= 8 else int(2 * math.log2(x)) + 3
    left = [None]
    for k in range(1, order):
        every, once = Counter(), Counter()
        for g, c in n[k].items():
            every[bucket(n[k - 1][g[:-1]])] += c
            once[bucket(n[k - 1][g[:-1]])] += c == 1
        left.append({b: (once[b] + 1) / (every[b] + 1) for b in every})

    def p(g):
        if len(g) == 1:
            return (n[0].get(g, 0) + 1) / (total + distinct + 1)
        k, low = len(g) - 1, p(g[1:])
        if g[:-1] not in n[k - 1]:
            return low
        weight = left[k].get(bucket(n[k - 1][g[:-1]]), 1)
        return (1 - weight) * n[k].get(g, 0) / n[k - 1][g[:-1]] + weight * low

    return {i: (len(t), sum((x,) in n[0] for x in t), total, sum(math.log10(p((x,))) for x in t), sum(math.log10(p(tuple(t[max(0, j - order + 1) : j + 1]))) for j in range(len(t)))) for i, t in tokens.items()}


@pytest.mark.parametrize(("order", "chunk", "shard"), [(1, 10**6, 10**6), (2, 10**6, 10**6), (3, 10**6, 10**6), (3, 3000, 700), (3, 1, 10**6)])
def test_scores_match_the_plain_model(make, edge_texts, monkeypatch, order, chunk, shard):
    """Whatever the numbers of chunks and shards, the scores are those of the plain model; a text of 20,000 words is among them."""
    monkeypatch.setattr(language_model, "CHUNK_TEXT", chunk)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", shard)
    monkeypatch.setattr(language_model, "WORD_SHARD_TOKENS", shard)
    texts = [*edge_texts, *[prose(80, i) for i in range(60)], "Ünknown ÉLAN words"]
    ids = [None, *range(1, len(texts))]
    want = plain_scores(list(zip(ids, texts, strict=True)), order)
    got = language_model.score_held_out(make(texts, ids), order).collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, n) and abs(r["score"] - score) < 3 / language_model.STEP * n


def test_scores_of_nothing(make):
    assert language_model.score_held_out(make([])).count() == 0
    alone = language_model.score_documents(make(["a b"]), language_model.train(make([]), F.lit(True))).collect()[0]
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"], alone["base_score"], alone["score"]) == (3, 0, 0, 0.0, 0.0)


def test_equal_rows_get_equal_scores_of_another_model(make):
    trie = language_model.train(make([prose(50, i) for i in range(20)]), F.lit(True))
    got = language_model.score_documents(make([prose(50, 3), prose(50, 3), "x y", None], [1, 1, 2, None]), trie).collect()
    same = [r["score"] for r in got if r["doc_id"] == 1]
    assert len(got) == 4 and same[0] == same[1] and {r["n_tokens"] for r in got} == {51, 3, 1}


def test_rare_grams_are_kept(make):
    # every n-gram occurs once or twice
    trie = language_model.train(make(["ab cd ef gh", "ab cd xy"]), F.lit(True))
    words = [b"ab", b"cd", b"ef", b"gh", b"xy"]
    ids = dict(zip(words, trie.find(words)[0].tolist(), strict=True))
    assert min(ids.values()) >= 0 and trie.find([b"zz"])[0].tolist() == [-1]
    for first, second, after in ((b"ab", b"cd", {b"ef", b"xy"}), (b"cd", b"ef", {b"gh"}), (b"cd", b"xy", set()), (b"ef", b"gh", set())):
        a, b = np.array([ids[first]]), np.array([ids[second]])
        level = trie.open_levels(int(trie.shard_of(a, b, trie.find([first])[1])[0]))
        entry = int(level.entries(a, b)[0])
        assert entry >= 0 and after <= {w for w in words if ids[w] in dict(level.successors(entry))}


def test_a_text_is_not_known_by_heart_unless_it_occurs_twice(make):
    words = [f"w{i}" for i in range(4000)]
    once, twice = [prose(60, i, words) for i in range(80)], [prose(60, 500 + i, words) for i in range(20)]
    got = language_model.score_documents(make([*once, *twice]), language_model.train(make([*once, *twice, *twice]), F.lit(True))).collect()
    per = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert min(per[i] for i in range(80, 100)) > max(per[i] for i in range(80)) + 1


def test_probabilities_sum_to_one(make):
    texts = [prose(200, i, ["a", "b", "c", "d"]) for i in range(10)]
    trie = language_model.train(make(texts), F.lit(True))
    words = [w.encode() for w in sorted(set(" ".join(texts).split()))] + [b"zzz", language_model.END]
    for before in ([b"a", b"b"], [b"a"], [b"zzz", b"b"], [b"zzz"], [b"a", b"zzz"]):
        total = sum(trie.probabilities([*before, w])[-1] for w in words)
        assert abs(total - 1) < 1e-2, before


def test_numbers_as_bytes():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, most, n) for most, n in ((1, 0), (2, 5), (300, 7), (70_000, 9), (2**40, 11), (2**62, 3))]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(language_model.unpack(language_model.pack(arrays)), arrays, strict=True))
    p = np.array([1.0, 0.5, 1e-9, 0.0])
    assert np.allclose(language_model.value(language_model.code(p)), p, rtol=5e-3) and language_model.value(language_model.code(p))[3] == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = cp.written(stage(spark, docs, sf_dir), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        sizes.append(len(after))
        if name == "near_duplicates":
            classes = near_join.join_documents(spark.createDataFrame(list(before.items()), "doc_id bigint, text string")).collect()
            assert set(after) == {r["class_id"] for r in classes} and all(after[i] == before[i] for i in after)
        if name == "repeats":
            raw = [(t or "").encode() for t in before.values()]
            want = [bytes(np.frombuffer(d, np.uint8)[~c]).decode("utf-8", "ignore") for d, c in zip(raw, suffix_dedup.brute_force(raw), strict=True)]
            assert after == dict(zip(before, want, strict=True))
    assert sizes[1] >= 0.95 * sizes[0] and sizes[2] >= 0.7 * sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()} and texts
    assert cp.run(spark, sf_dir).count() == packed.count()


def test_pipeline_takes_nulls_equal_rows_and_odd_columns(spark, make, edge_texts, tmp_path):
    import corpus_pipeline as cp

    texts = [*edge_texts, *[prose(60, i) for i in range(40)], prose(60, 3), None]
    ids = [None, *range(1, len(texts) - 1), 5]
    docs = make(texts, ids).union(make([prose(60, 7)], [20])).union(make([prose(60, 7)], [20]))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang")))
    for folder, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        out = rows
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == docs.columns
        pieces = cp.run(spark, f"{tmp_path}/{folder}").collect()
        assert (len(pieces) > 30) == (folder == "some")
        texts_left = {r["doc_id"] for r in pieces}
        assert texts_left <= {None, *ids, 20} and 1 not in texts_left
