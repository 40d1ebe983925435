"""Word shingle sets of whole texts as sorted 64-bit hashes (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_MEMO = 150_000  # words whose hash a worker remembers

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles of ``WORDS`` words, ascending. A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``;
    with fewer words the whole sequence is one shingle; without words the set is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    w = np.fromiter(map(_HASHES.__getitem__, words), U, n)
    width = min(n, WORDS)
    acc = np.full(n - width + 1, U(width))
    for i in range(width):
        acc = mix(acc + w[i : n - width + 1 + i])
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def set_fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set (0 for the empty one)."""
    if len(shingles) == 0:
        return 0
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], U).view(np.int64)[0])
