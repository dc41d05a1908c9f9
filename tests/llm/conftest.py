import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, t bigint, c string, kept boolean, n_bytes int, `a.b` string"


def rows_of(texts, ids=None, lang=None, source="s"):
    """Rows of documents with extra columns whose names clash with those that operators use inside."""
    ids = ids or list(range(len(texts)))
    return [(i, t, lang[k] if lang else "en", source, len(t) if t is not None else None, 5, "x", True, 7, "dot") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, ids=None, lang=None, source="s"):
        return spark.createDataFrame(rows_of(texts, ids, lang, source), SCHEMA)

    return build


def prose(n, seed, words=None):
    r = random.Random(seed)
    words = words or [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "rt", "ll") for c in ("a", "ei", "um", "or")]
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank, one word, ties, accents, odd characters, a very long text, and a repeating one."""
    long = prose(20_000, 1)
    return [None, "", " \n\t ", "word", "word", "It's Élan\r\nÉlan  vital 123", "\u2028naïve\u00a0😀 ½ Σ", "<|endoftext|> x", prose(300, 2), prose(300, 2), long, "ab" * 700, "aaaa " * 100]
