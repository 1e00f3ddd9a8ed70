"""Sets of word shingles as sorted arrays of 64-bit hashes, and their MinHash signatures.

Words are lower-cased (A-Z only) stretches without ASCII white space. A set holds the distinct shingles
of five words; a text of one to four words has its whole sequence as its only shingle; a null text or one
without a word has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from candorlake.llm.common import keeps

WIDTH = 5
#: Words that a worker remembers the hash of.
MEMO_ENTRIES = 200_000
_ODD = np.array([int(xxhash.xxh64_intdigest(f"place {i}")) | 1 for i in range(WIDTH + 1)], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


keeps("shingles", _words.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(_words) > MEMO_ENTRIES:
        _words.clear()
    out = []
    for text in texts:
        words = (text or b"").lower().split()
        n = len(words)
        hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
        if n >= width:
            grams = hashes[: n - width + 1] * _ODD[0]
            for i in range(1, width):
                grams += hashes[i : n - width + 1 + i] * _ODD[i]
            out.append(np.unique(_mixed(grams)))
        elif n:
            out.append(_mixed((hashes * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + n * _ODD[width:]))
        else:
            out.append(hashes)
    return out


def coordinate_hashes(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``size`` hash functions, the same on every machine."""
    made = [xxhash.xxh64_intdigest(f"coordinate {i}") for i in range(2 * size)]
    return np.array(made[:size], dtype=np.uint64) | np.uint64(1), np.array(made[size:], dtype=np.uint64)


def signatures(sets: list[np.ndarray], size: int) -> Iterator[np.ndarray | None]:
    """MinHash signatures of ``size`` 32-bit coordinates; None for an empty set."""
    full = [s for s in sets if len(s)]
    if full:
        every = np.concatenate(full)
        starts = np.cumsum([0] + [len(s) for s in full[:-1]])
        out = np.empty((len(full), size), dtype=np.uint32)
        for k, (a, b) in enumerate(zip(*coordinate_hashes(size))):
            out[:, k] = np.minimum.reduceat((every * a + b) >> np.uint64(32), starts)
    rows = iter(out if full else ())
    for s in sets:
        yield next(rows) if len(s) else None
