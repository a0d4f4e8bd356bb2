"""Hashed character n-grams of whole texts, and linear scores over them, as array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from cairn.llm.common import batches_by_chars

BITS, ORDERS = 16, (1, 2, 3)
SIZE = 1 << BITS
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool]]:
    """For each text the hashed n-grams of its lower-case letters (all else is a space), and whether it has a letter."""
    texts = [(t or "").lower() for t in texts]
    is_letter = letters()
    for lo, hi in batches_by_chars(texts, 1_000_000):
        group = texts[lo:hi]
        points = np.frombuffer(" ".join(group).encode("utf-32-le", "replace"), np.uint32)
        kept = is_letter[points]
        points = np.where(kept, points, 32).astype(np.uint64)
        hashed = []
        with np.errstate(over="ignore"):
            for n in ORDERS:
                h = np.full(max(0, len(points) - n + 1), np.uint64(n * 7919))
                for k in range(n):
                    h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                hashed.append((h >> np.uint64(64 - BITS) if n > 1 else h >> np.uint64(64 - BITS)).astype(np.int32))
        at = 0
        for t in group:
            end = at + len(t)
            own = [h[at : max(at, end - n + 1)][kept[at : max(at, end - n + 1)]] for n, h in zip(ORDERS, hashed, strict=True)]
            yield np.concatenate(own), bool(kept[at:end].any())
            at = end + 1


def scores(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean over a text's n-grams of the rows of ``table``, and whether it has a letter; 0 for texts without."""
    out, any_letter = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), bool)
    for i, (g, has) in enumerate(grams(texts)):
        any_letter[i] = has
        if len(g):
            out[i] = table[g].mean(axis=0, dtype=np.float64)
    return out, any_letter


def counts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse relative frequencies."""
    index, n = np.unique(g, return_counts=True)
    return index.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)
