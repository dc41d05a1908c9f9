"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Network. The bytes of a text (UTF-8, ASCII letters in lower case) are cut into rows of 96; in each row one gated
recurrent layer reads forwards and one backwards, from a zero state, and a softmax over both states labels every byte
with language probabilities. The log-probabilities of all bytes of all rows of a text, letters and others alike, are
averaged, and a softmax over that mean, sharpened by the square root of the text's length (at most 16), pools them to
the document's probabilities.

Training. Backpropagation through time with Adam, on the driver, over a bounded sample: at most `per_language` distinct
texts of each language, those of least hash, and from each a stretch of 96 bytes at a place given by the hash; of more
than `languages` values of lang those with the most distinct texts are learned. Nothing else of lang, source or doc_id
enters a prediction. Weights have a fixed size of some 10 KB and go to executors with the function.

Cases: null texts and texts without a letter are `und` with score 0. With no training rows at all every text is `und`.
Rows with a null doc_id have held_out null-safe false and are not learned from. Equal texts get equal predictions;
empty tables give empty results; only doc_id, text and lang are read. Texts of any length are read whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, map_texts

ROW, HIDDEN = 96, 12
PER_LANGUAGE, LANGUAGES, EPOCHS, BATCH, RATE = 1500, 1000, 6, 64, 0.02
#: Least number of steps of training, so that a small table is gone through more often than EPOCHS times.
LEAST_STEPS = 400
#: Most rows that go through the network at once.
WIDE = 4096


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def init(languages: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """wx: by direction and byte the inputs of the gates (update, reset, new); wh: from the states; wo: to the labels."""
    r = np.random.default_rng(seed)
    return {
        "wx": r.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
        "wh": (r.normal(0, 1, (2, 3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
        "bn": np.zeros((2, hidden), np.float32),
        "wo": r.normal(0, 0.1, (languages, 2 * hidden)).astype(np.float32),
        "bo": np.zeros(languages, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.add(x, 1, out=x)
    return np.multiply(x, 0.5, out=x)


def _states(m: dict, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, 2 * hidden, n) for byte rows (n, steps); keep gets what training needs of each step."""
    n, steps = rows.shape
    h = m["wh"].shape[2]
    out = np.empty((steps, 2 * h, n), np.float32)
    state = np.zeros((2, h, n), np.float32)
    gates, rec = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
    tables = [np.ascontiguousarray(m["wx"][d].T) for d in (0, 1)]
    for t in range(steps):
        for d in (0, 1):
            np.take(tables[d], rows[:, t if d == 0 else steps - 1 - t], axis=1, out=gates[d], mode="clip")
            np.matmul(m["wh"][d], state[d], out=rec[d])
        zr = _sigmoid(gates[:, : 2 * h] + rec[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        inner = rec[:, 2 * h :] + m["bn"][:, :, None]
        new = np.tanh(gates[:, 2 * h :] + r * inner)
        before = state
        state = new + z * (before - new)
        if keep is not None:
            keep.append((before, z.copy(), r.copy(), new, inner))
        out[t, :h] = state[0]
        out[steps - 1 - t, h:] = state[1]
    return out


def _log_softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = x - x.max(axis, keepdims=True)
    return x - np.log(np.exp(x).sum(axis, keepdims=True))


def position_scores(m: dict, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities (steps, languages, n) of every byte."""
    return _log_softmax(np.matmul(m["wo"], _states(m, rows)) + m["bo"][:, None], 1)


def gradient(m: dict, rows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradient, by backpropagation through time."""
    n, steps = rows.shape
    h = m["wh"].shape[2]
    keep: list = []
    states = _states(m, rows, keep)
    logp = _log_softmax(np.matmul(m["wo"], states) + m["bo"][:, None], 1)
    hot = np.zeros((m["wo"].shape[0], n), np.float32)
    hot[y, np.arange(n)] = 1
    loss = float(-(logp * hot).sum() / (n * steps))
    back = (np.exp(logp) - hot) / (n * steps)
    g = {k: np.zeros_like(v) for k, v in m.items()}
    g["wo"] = np.einsum("tln,thn->lh", back, states)
    g["bo"] = back.sum((0, 2))
    dstates = np.matmul(m["wo"].T, back)
    carry = np.zeros((2, h, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, new, inner = keep[t]
        carry = carry + np.stack([dstates[t, :h], dstates[steps - 1 - t, h:]])
        dnew = carry * (1 - z) * (1 - new * new)
        dz = carry * (before - new) * z * (1 - z)
        dr = dnew * inner * r * (1 - r)
        dinner = dnew * r
        g["bn"] += dinner.sum(2)
        dgates, drec = np.concatenate([dz, dr, dnew], 1), np.concatenate([dz, dr, dinner], 1)
        carry = carry * z
        for d in (0, 1):
            np.add.at(g["wx"][d], rows[:, t if d == 0 else steps - 1 - t], dgates[d].T)
            g["wh"][d] += drec[d] @ before[d].T
            carry[d] += m["wh"][d].T @ drec[d]
    return loss, g


def fit(rows: np.ndarray, y: np.ndarray, languages: int, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam with a falling rate over shuffled batches; each epoch cuts the rows at random to other lengths too, so short texts are known as well."""
    m = init(languages, seed=seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    a_round = -(-len(rows) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // a_round))
    total = epochs * a_round
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            pick = order[a : a + BATCH]
            length = int(r.choice((16, 32, ROW)))
            begin = int(r.integers(0, ROW - length + 1))
            _, g = gradient(m, rows[pick, begin : begin + length], y[pick])
            step += 1
            rate = RATE * min(1, 1.1 - step / total)
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] * g[k]
                m[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def rows_of(data: bytes) -> np.ndarray:
    """The rows of one text; the last one goes back into the text, or is filled with spaces where the text is shorter than a row."""
    b = np.frombuffer(data.lower(), np.uint8)
    if len(b) <= ROW:
        return np.concatenate([b, np.full(ROW - len(b), 32, np.uint8)])[None]
    whole = b[: len(b) // ROW * ROW].reshape(-1, ROW)
    return whole if len(b) % ROW == 0 else np.concatenate([whole, b[None, -ROW:]])


def training_sample(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> list[tuple[str, bytes]]:
    """At most per_language (language, stretch of a text's bytes) of each language, those of least hash; copies of a text are one.

    Two scans: the first counts the distinct texts of each language, which says below what hash about twice as many as are
    asked for lie; the second fetches these. What reaches the driver is bounded by 2 x per_language rows a language,
    whatever the number of copies, as equal (language, hash) rows are one before anything is sorted or sent."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    n = F.approx_count_distinct("h")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(n.alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return []
    # a hash as a share of its range, over the share that is wanted of the language: below 1 for about twice as many as are asked for
    u = F.lit(None).cast("double")
    for lang, size in counts.items():
        u = F.when(F.col("lang") == lang, (F.col("h") / 2.0**64 + 0.5) * max(1.0, size / (2 * per_language))).otherwise(u)
    stretch = F.substring(F.col("text"), (F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - ROW)) + 1).cast("int"), F.lit(ROW))
    found = rows.select("lang", "h", u.alias("u"), stretch.alias("s")).where("u <= 1")
    found = found.groupBy("lang", "h").agg(F.min("u").alias("u"), F.min("s").alias("s"))
    found = found.orderBy("u", "lang", "h").limit(2 * per_language * len(counts)).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in found:
        if taken[r["lang"]] < per_language and has_letter(r["s"]):
            taken[r["lang"]] += 1
            out.append((r["lang"], r["s"].encode("utf-8", "replace")))
    return out


class Model:
    """Weights and language names."""

    def __init__(self, weights: dict[str, np.ndarray] | None, names: list[str]):
        self.weights, self.names = weights, names

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """(language or `und`, its probability) for each text."""
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if self.weights is None:
            return lang, score
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        rows = [rows_of(texts[i].encode("utf-8", "replace")) for i in known]
        if not rows:
            return lang, score
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        every = np.concatenate(rows)
        total = np.zeros((len(rows), len(self.names)))
        for a in range(0, len(every), WIDE):
            part = position_scores(self.weights, every[a : a + WIDE]).mean(0).T
            np.add.at(total, owner[a : a + WIDE], part)
        mean = total / np.bincount(owner)[:, None]
        sharp = np.minimum(16, np.sqrt([max(1, len(texts[i])) for i in known]))[:, None]
        p = np.exp(_log_softmax(mean * sharp, 1))
        for i, row in zip(known, p, strict=True):
            k = int(row.argmax())
            lang[i], score[i] = self.names[k], row[k]
        return lang, score


def train(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """A model of the rows for which the column `learn` holds."""
    sample = training_sample(docs, learn, per_language)
    names = sorted({lang for lang, _ in sample})
    if not names:
        return Model(None, [])
    at = {n: i for i, n in enumerate(names)}
    rows = np.concatenate([rows_of(s)[:1] for _, s in sample])
    return Model(fit(rows, np.array([at[lang] for lang, _ in sample]), len(names), epochs), names)


def learned_rows():
    """Not held out: crc32 of the doc_id as text is no multiple of 5."""
    return crc_mod(5) != 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            lang, score = model.predict(texts)
            return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

        return work

    out = map_texts(docs, make, "lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a probability of at least `least`."""

    def run(batches):
        for b in batches:
            lang, score = model.predict(b.column("text").to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return map_rows(docs, run)
