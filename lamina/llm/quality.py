"""Quality rules: counts of each text, and cross-document line frequency by host.

A line is normalised (lower case, white space collapsed, trimmed) and hashed. For each host (source; null is a host of
its own) the distinct documents with that line are counted. A line is boilerplate of its host if more than
max(`least_docs`, `share` x the host's distinct documents) of them have it. It is removed from every document of the host but
the one with the smallest doc_id, so what a page was copied from stays. A document whose base rules fail, or that has
fewer than `least_words` words left, is rejected; the words of removed lines do not count as left.

A document is a doc_id with a text, so equal rows are one document and copies under several doc_ids are several. With
`copies_count` off, distinct texts are counted instead, and copies are left to deduplication.

Cases: null and empty texts have no words and fail the base rules. Lines without a word are never removed. Equal rows get
equal verdicts. Empty tables give empty results. Only doc_id, text and source are read. A line that a third of all
documents share is counted by partial sums; texts of any length are read whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns_of, map_rows, released, written

LEAST_DOCS, SHARE, LEAST_WORDS = 20, 0.05, 10
WINDOW = 5
_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_BLANK = "".join(map(chr, [32, *range(9, 14)]))


def line_key(line: str) -> int:
    """64-bit hash of a line's normal form."""
    normal = b" ".join(line.lower().encode("utf-8", "replace").split())
    return int.from_bytes(hashlib.blake2b(normal, digest_size=8).digest(), "little", signed=True)


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window which occurs twice or more."""
    if len(words) <= n:
        return 0
    h = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        mixed = (mixed ^ h[k : len(mixed) + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(mixed) + n, np.int64)
    where = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, where, 1)
    np.add.at(twice, where + n, -1)
    return int((np.cumsum(twice)[: len(h)] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


_PROFILE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h: bigint, n: int>>"


def profiles(docs: DataFrame) -> DataFrame:
    """Per document its counts, a hash of its text, and each distinct line's hash with the words that the document has in such lines."""
    lines_type = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in chunks(texts):
                counts, lines = [], []
                for t in texts[s]:
                    counts.append(base_counts(t))
                    found: dict[int, int] = {}
                    for line in (t or "").split("\n"):
                        if line.strip(_BLANK):
                            k = line_key(line)
                            found[k] = found.get(k, 0) + len(line.encode("utf-8", "replace").split())
                    lines.append([{"h": h, "n": n} for h, n in found.items()])
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("host"), part.column("t"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(lines, lines_type)],
                    names=["doc_id", "host", "t", *names, "lines"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.xxhash64("text").alias("t"), "text")
    return cut.mapInArrow(released(run), f"doc_id {kind}, host string, t bigint, {_PROFILE}")


def boilerplate(found: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, copies_count: bool = True) -> DataFrame:
    """host, h and the smallest doc_id of each line above the limits."""
    # documents by host and by line are counted in two steps: a line that all have is spread by document first, then added up from partial sums
    one = ["t"] + ["doc_id"] * copies_count
    hosts = found.groupBy("host", *one).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    lines = found.select("host", "t", "doc_id", F.explode("lines.h").alias("h"))
    lines = lines.groupBy("host", "h", *one).agg(F.min("doc_id").alias("first_doc"))
    lines = lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("first_doc").alias("first_doc")).where(F.col("n") > least_docs)
    limits = hosts.select(F.col("host").alias("host2"), F.greatest(F.lit(float(least_docs)), F.col("texts") * share).alias("most"))
    return lines.join(limits, F.col("host").eqNullSafe(F.col("host2"))).where(F.col("n") > F.col("most")).select("host", "h", "first_doc")


def verdicts(found: DataFrame, bad: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds base_failed, removed_words, removed_lines (hashes) and kept to profiles that are a written table."""
    bad = bad.select(F.col("host").alias("host2"), F.col("h").alias("h2"), "first_doc")
    hits = found.select("doc_id", "t", "host", F.explode("lines").alias("line"))
    hits = hits.join(bad, F.col("host").eqNullSafe(F.col("host2")) & (F.col("line.h") == F.col("h2")))
    hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    # equal rows have equal lines: each line once for a document
    hits = hits.groupBy("doc_id", "t", "host").agg(F.collect_set("line").alias("gone"))
    hits = hits.select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), F.col("host").alias("host2"), "gone")
    out = found.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")) & F.col("host").eqNullSafe(F.col("host2")), "left")
    n = F.coalesce(F.aggregate("gone", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        *found.columns, F.coalesce(F.col("gone.h"), F.array().cast("array<bigint>")).alias("removed_lines"), n.alias("removed_words"), failed.alias("base_failed"),
        (~failed & (F.col("n_words") - n >= least_words)).alias("kept"),
    )


def judge_documents(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, least_words: int = LEAST_WORDS, copies_count: bool = True) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept, and the hash `t` and lines to remove."""
    found = written(profiles(docs), "quality")
    return verdicts(found, boilerplate(found, least_docs, share, copies_count), least_words).drop("lines")


def keep_documents(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, least_words: int = LEAST_WORDS, copies_count: bool = True) -> DataFrame:
    """The kept rows of docs with all their columns; boilerplate lines are taken out of text, and n_chars follows."""
    d, t, h, lines = "_lamina_d", "_lamina_t", "_lamina_h", "_lamina_lines"
    judged = judge_documents(docs, least_docs, share, least_words, copies_count).where("kept")
    judged = judged.select(F.col("doc_id").alias(d), F.col("t").alias(t), F.col("host").alias(h), F.col("removed_lines").alias(lines)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)) & F.col("source").cast("string").eqNullSafe(F.col(h))
    rows = docs.join(judged, same).select(*columns_of(docs), lines)
    names = docs.columns
    place = names.index("text")
    sizes_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b.column("text").to_pylist(), b.column(lines).to_pylist()
            for i, g in enumerate(gone):
                if g:
                    drop = set(g)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if not x.strip(_BLANK) or line_key(x) not in drop)
            b = b.select(names).set_column(place, "text", pa.array(texts, pa.string()))
            if sizes_at is not None:
                sizes = [old if not g else len(t) for old, g, t in zip(b.column("n_chars").to_pylist(), gone, texts, strict=True)]
                b = b.set_column(sizes_at, "n_chars", pa.array(sizes, b.schema.field(sizes_at).type))
            yield b

    return map_rows(rows, run, len(names))


def oracle_sql(least_docs: int = LEAST_DOCS, share: float = SHARE, least_words: int = LEAST_WORDS, copies_count: bool = True) -> str:
    """The query's rows in DuckDB SQL."""
    one = "row(doc_id, body)" if copies_count else "coalesce(body, chr(0))"
    word = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source AS host, text AS body, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
l AS (SELECT rn, doc_id, host, body, line, array_to_string(regexp_extract_all(lower(line), {word}), ' ') AS h, len(regexp_extract_all(line, {word})) AS n
      FROM (SELECT rn, doc_id, host, body, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {word})),
g AS (SELECT rn, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
c AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS k FROM g) WHERE k > 1),
rep AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + 5)) AS p FROM c) GROUP BY rn),
dup AS (SELECT rn, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rn),
hosts AS (SELECT host, count(DISTINCT {one}) AS texts FROM d GROUP BY host),
bad AS (SELECT f.host, h, first_doc FROM (SELECT host, h, count(DISTINCT {one}) AS n, min(doc_id) AS first_doc FROM l GROUP BY host, h) f
        JOIN hosts ON f.host IS NOT DISTINCT FROM hosts.host WHERE f.n > greatest({least_docs}, {share} * texts)),
gone AS (SELECT rn, sum(l.n) AS n FROM l JOIN bad ON l.host IS NOT DISTINCT FROM bad.host AND l.h = bad.h WHERE l.doc_id IS DISTINCT FROM first_doc GROUP BY rn),
b AS (SELECT d.rn, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN dup USING (rn) LEFT JOIN rep USING (rn) LEFT JOIN gone USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= {least_words} AS kept
FROM b"""
