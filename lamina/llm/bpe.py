"""BPE encoding and decoding by forced-boundary splitting, for vocabularies with word ends.

Two neighbouring bytes that occur side by side inside no token of the vocabulary can never be merged across, so the
encoder cuts between them, encodes each fragment by itself and joins the ids. The pairs are found once from the
vocabulary (a table of 256 x 256 flags). A fragment of n bytes takes O(n log n): candidate merges lie in a heap, the
symbols in a linked list. Short fragments and words are remembered, up to a bounded number and a bounded size of each.

Before that, text is normalised and cut into words as the vocabulary file asks: NFC, lower case by character, and the
pattern of the file. The names of special tokens in the text become their ids. Decoding joins token strings with spaces,
as the file names no decoder.

Cases: null and empty texts have no ids and decode to the empty text. Equal rows give equal values, an empty table an
empty result. Columns other than doc_id and text are not read. Texts of any length are encoded whole."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .packing import byte_symbols, token_path

#: The pattern of the vocabulary file, and what it comes to for texts of plain Latin characters.
_PLAIN = re.compile("[\\x20-\\x7e\n\t\rÀ-ÖØ-öø-ÿ]*")
_LATIN = "a-zß-öø-ÿ"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\\s0-9{_LATIN}]+")
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ANY_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{_SPACE}\\p{{L}}\\p{{N}}]+"

END = "</w>"
#: Up to this length a fragment is scanned anew for each merge, which is quicker than a heap.
SHORT = 48
#: Characters of remembered words, ids and token strings that an encoder holds at most, and the longest word it remembers.
HELD, LONGEST = 64 << 20, 256


class WordBpe:
    """An encoder for a vocabulary file of the tokenizers library whose model is BPE with word ends."""

    def __init__(self, path: str | None = None, remembered: int = 500_000, held: int = HELD):
        import regex

        self.path = path or token_path("word_bpe_49k.json")
        self.library, self.classes = None, {}
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.symbol = byte_symbols()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.first, self.final = ([self.vocab[self.symbol[b] + end] for b in range(256)] for end in ("", END))
        self.joins = self._joins()
        self.apart = frozenset(zip(*(x.tolist() for x in np.nonzero(~self.joins))))
        self.special_cut = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or "(?!)")
        self.any_words = regex.compile(_ANY_WORDS)
        self.remembered, self.most_held, self.held = remembered, held, 0
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}
        self.words: dict[str, tuple[str, str]] = {}

    def _joins(self) -> np.ndarray:
        """Which pairs of bytes occur side by side inside some token."""
        to_byte = {c: b for b, c in self.symbol.items()}
        out = np.zeros((256, 256), bool)
        for t in self.vocab:
            raw = [to_byte[c] for c in t.removesuffix(END)]
            out[raw[:-1], raw[1:]] = True
        return out

    def _merge(self, piece: bytes, last: bool) -> list[int]:
        """Merges of lowest rank first, leftmost first among equals, within one fragment."""
        ids, rank = [*map(self.first.__getitem__, piece)], self.merges.get
        if last:
            ids[-1] = self.final[piece[-1]]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        while len(ids) > 1:
            found = list(map(rank, zip(ids, ids[1:])))
            best = min(filter(None, found), default=None)
            if best is None:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list) -> list[int]:
        """The same merges by a heap of rank * n + place; an entry counts only if its two symbols still stand there and merge with that rank."""
        n, rank = len(ids), self.merges.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [m[0] * n + i for i, m in enumerate(map(rank, zip(ids, ids[1:]))) if m]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] is None or j >= n:
                continue
            m = rank((ids[i], ids[j]))
            if m is None or m[0] != r:
                continue
            ids[i], ids[j], k = m[1], None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if m := rank((ids[i], ids[k])):
                    heapq.heappush(heap, m[0] * n + i)
            if (h := before[i]) >= 0 and (m := rank((ids[h], ids[i]))):
                heapq.heappush(heap, m[0] * n + h)
        return [x for x in ids if x is not None]

    def _room(self, kept: dict, size: int) -> bool:
        """Whether `size` more characters may be remembered; a full memory is emptied first."""
        if size > LONGEST * 16:
            return False
        if len(kept) >= self.remembered or self.held + size > self.most_held:
            self.fragments.clear(), self.words.clear()
            self.held = 0
        self.held += size
        return True

    def split(self, word: bytes) -> list[bytes]:
        """The fragments of a word: cut wherever no token could join the two bytes."""
        apart = self.apart
        cuts = [i + 1 for i, pair in enumerate(zip(word, word[1:])) if pair in apart]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def encode_word(self, word: str) -> list[int]:
        parts, ids = self.split(word.encode("utf-8", "replace")), []
        if len(parts) == 1:
            return self._merge(parts[0], True)  # the word itself is remembered
        for k, p in enumerate(parts):
            key = (p, k == len(parts) - 1)
            if (found := self.fragments.get(key)) is None:
                found = self._merge(*key)
                if len(p) <= LONGEST and self._room(self.fragments, 8 * len(p)):
                    self.fragments[key] = found
            ids += found
        return ids

    def cut_words(self, text: str) -> list[str]:
        """Normalised text as words."""
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORDS.findall(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in text):
            text = self._library().normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no rule for a final sigma
        shape = "".join(self._like(c) if unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.any_words.finditer(shape)]

    def _library(self):
        """The library's own normaliser and word cutter, for texts with characters that Python's tables lack."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def _like(self, c: str) -> str:
        """A character of the same class as c, for characters so new that libraries' tables differ: the class that the vocabulary's own library gives it."""
        if c not in self.classes:
            joined = [len(self._library().pre_tokenizer.pre_tokenize_str(x + c + x)) == 1 for x in "a!"]
            self.classes[c] = "a" if joined[0] else "\ue000" if joined[1] else "0"
        return self.classes[c]

    def _known(self, word: str) -> tuple[str, str]:
        ids = self.encode_word(word)
        out = (" ".join(map(str, ids)), " ".join(self.token[i] for i in ids))
        if len(word) <= LONGEST and self._room(self.words, len(word) + len(out[0]) + len(out[1])):
            self.words[word] = out
        return out

    def encode_as_text(self, text: str | None) -> tuple[str, str]:
        """(ids joined by spaces, decoded text)."""
        ids, shown, at = [], [], 0
        text = text or ""
        get, known = self.words.get, self._known
        for m in [*self.special_cut.finditer(text), None]:
            pairs = [get(w) or known(w) for w in self.cut_words(text[at : m.start() if m else len(text)])]
            ids += [p[0] for p in pairs]
            shown += [p[1] for p in pairs]
            if m:
                ids.append(str(self.special[m[0]]))
                shown.append(m[0])
                at = m.end()
        return " ".join(ids), " ".join(shown)

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_as_text(text)[0]
        return [int(x) for x in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without a decoder; ids that no token has are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_LOADED: dict[str | None, WordBpe] = {}


def encoder(path: str | None = None) -> WordBpe:
    """The encoder of this process for a file; made once."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and if asked for the ids and the decoded text."""

    def make():
        bpe = encoder(path)

        def work(texts: list) -> dict:
            out = [bpe.encode_as_text(t) for t in texts]
            return {
                "n_tokens": pa.array([a.count(" ") + 1 if a else 0 for a, _ in out], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(a.encode()).hexdigest() for a, _ in out]),
                "decoded_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in out]),
                "ids": pa.array([[int(x) for x in a.split(" ")] if a else [] for a, _ in out] if with_ids else [None] * len(out), pa.list_(pa.int32())),
                "decoded": pa.array([b for _, b in out] if with_ids else [None] * len(out), pa.string()),
            }

        return work

    out = map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return out if with_ids else out.drop("ids", "decoded")
