"""Sets of word shingles, told apart by 64-bit hashes.  Lower-casing and splitting touch ASCII only."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle; words, or sets, that a task remembers.
WORDS, KNOWN = 5, 1 << 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


def shingles(text: str | None, words: int = WORDS, hashes: dict | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 7)], np.uint64)
    of = np.array(list(map((_Hashes() if hashes is None else hashes).__getitem__, parts)), np.uint64)
    n = len(parts) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = (4, 5)) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (least[0] + least[1]) * both >= least[0] * (len(a) + len(b))


def node_of(every: np.ndarray) -> int:
    """What stands for a set: a 64-bit hash of it, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(every.tobytes(), 1)).view(np.int64))
