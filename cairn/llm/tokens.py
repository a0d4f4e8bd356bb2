"""Token ids of whole texts by the tokenizers library, at the speed of array lookups.

The tokenizer drops white space and encodes each word by itself, so a text's ids are those of its words in order.
Words are found and hashed with array operations; the ids of words met before come from a table, and new words are
encoded by the library. Pieces between spaces that hold anything but printable ASCII and Latin-1 letters go through
the unchanged tokenizer.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[0xDF:0x100] = _LETTER
_CLASS[0xF7] = _OTHER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
#: The endings that the pre-tokenizer splits off together with an apostrophe before them.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_PRIME = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_ENCODERS: dict[str, Encoder] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of a prime and of its inverse, modulo 2^64."""
    have = next(iter(_POWERS), 0)
    if have < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            both = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64)
                for x in (_PRIME, pow(_PRIME, -1, 1 << 64))
            )
        _POWERS.clear()
        _POWERS[size] = both
    return next(iter(_POWERS.values()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def encoder(path: str) -> Encoder:
    """One per Python worker, so that the table of words outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Encodes texts to arrays of ids; the table holds ``max_words`` words at most and then starts anew."""

    def __init__(self, path: str, max_words: int = 1_500_000) -> None:
        self._whole = Tokenizer.from_file(path)
        self._model = Tokenizer.from_file(path)
        self._model.normalizer = normalizers.Sequence([])
        self._model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self._whole.get_vocab()
        self.vocab_size = max(vocab.values(), default=0) + 1
        self._ends = np.zeros(self.vocab_size, bool)
        self._ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._max = max_words
        self._clear()

    def _clear(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._n = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None], chars: int = 1_000_000) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null has none."""
        group: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            plain = _PLAIN.fullmatch(text) is not None and "<|" not in text
            if not plain or len(text) > chars:
                yield from self._encode(group)
                group, size = [], 0
                yield self._mixed(text, chars)
                continue
            group.append(text)
            size += len(text)
            if size > chars:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _mixed(self, text: str, chars: int) -> np.ndarray:
        out = [np.zeros(0, np.uint32)]
        for part in _parts(text, chars):
            odd = lambda p: "<|" in p or _PLAIN.fullmatch(p) is None
            for is_odd, pieces in itertools.groupby(part.split(" "), key=odd):
                if is_odd:
                    found = self._whole.encode_batch_fast(list(pieces), add_special_tokens=False)
                    out += [np.array(e.ids, np.uint32) for e in found]
                else:
                    out += self._encode([" ".join(pieces)])
        return np.concatenate(out)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = "\n".join(texts).lower().encode("latin-1")
        data = np.frombuffer(joined, np.uint8)
        starts, ends = _words(data)
        text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        first_word = np.searchsorted(starts, text_starts)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        unique, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        where = self._find(unique, joined, starts[first], ends[first])
        at, n = self._at[where][which], self._n[where][which]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.arange(before[-1]) + np.repeat(at - before[:-1], n)]
        cuts = before[first_word]
        return [ids[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def _find(self, hashes: np.ndarray, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the table for the sorted hashes; words that it lacks are added."""
        if len(self._hashes) + len(hashes) > self._max:
            self._clear()
        where = np.searchsorted(self._hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = where < len(self._hashes)
        new[inside] = self._hashes[where[inside]] != hashes[inside]
        if new.any():
            words = [joined[a:b].decode("latin-1") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ids = list(itertools.chain.from_iterable(self._learn(words[k : k + 32]) for k in range(0, len(words), 32)))
            n = np.array([len(x) for x in ids])
            at = len(self._ids) + np.concatenate([[0], np.cumsum(n)[:-1]])
            place = where[new]
            self._ids = np.concatenate([self._ids, *ids]).astype(np.uint32)
            self._hashes = np.insert(self._hashes, place, hashes[new])
            self._at = np.insert(self._at, place, at)
            self._n = np.insert(self._n, place, n)
            where = np.searchsorted(self._hashes, hashes)
        return where

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        ids = np.array(self._model.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return [np.array(self._whole.encode(w, add_special_tokens=False).ids, np.uint32) for w in words]
        return [ids[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokenizer's words in lower-case plain text."""
    kind = _CLASS[data]
    before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
    start = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
    for p in np.flatnonzero((data == ord("'")) & (before != _OTHER)).tolist():
        if not start[p]:  # the ending of another word ate it
            continue
        tail = data[p + 1 : p + 3].tobytes()
        ending = next((e for e in _ENDINGS if tail.startswith(e)), None)
        if ending:
            start[p + 1] = False
            after = p + 1 + len(ending)
            if after < len(data) and kind[after] == _LETTER:
                start[after] = True
    edge = start | ((kind == _SPACE) & (before != _SPACE))
    edges = np.append(np.flatnonzero(edge), len(data))
    is_start = start[edges[:-1]]
    return edges[:-1][is_start], edges[1:][is_start]


def _parts(text: str, chars: int) -> Iterator[str]:
    """The text cut at spaces into parts of about ``chars`` characters."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + chars)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1
