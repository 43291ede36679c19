"""NumPy helpers: word bounds, hashes of phrases and of byte spans, and winnowed anchors of fixed-length windows.

A phrase's hash is made of the 64-bit hashes of its words, two runs at a time with multiply-xor steps, so that it depends on nothing but their sequence.

A byte span's hash is a polynomial over a fixed random byte table modulo 2**64, so that any span of a text comes from two prefix sums. Equal spans
have equal hashes, but there are different ones, as a Thue-Morse string and its complement, that always agree: it may choose anchors and
group candidates, and decides nothing.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
#: Texts are worked on in pieces of this many bytes, which bounds memory for very long ones.
PIECE = 1 << 22
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    out = left * U(_BASE)
    out += right
    out ^= out >> U(31)
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(29)
    return out


def phrase_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Of each run of so many words, by its first word: from hashes of runs of half as many, which may overlap."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out, covered = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), 1
    while covered < size:
        step = min(covered, size - covered)
        out = _joined(out[:-step], out[step:])
        covered += step
    return out


class SpanHasher:
    """Hashes of any spans [start, end) of one byte string."""

    def __init__(self, data: bytes):
        view = np.frombuffer(data, np.uint8)
        self.powers, inverse = _power_tables(len(view) + 1)
        self.prefix = np.zeros(len(view) + 1, np.uint64)
        np.cumsum(_TABLE[view] * inverse[: len(view)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.powers[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Of the spans of so many bytes, by their start; mixed once, which is enough to choose anchors by."""
        out = (self.prefix[size:] - self.prefix[:-size]) * self.powers[: len(self.prefix) - size]
        out ^= out >> U(31)
        out *= U(0xBF58476D1CE4E5B9)
        return out


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words within b" ".join(words)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width values, in three passes whatever the width."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


_POSITION = U((1 << 24) - 1)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of width grams, the index of its anchor: its gram of least hash, leftmost on ties.

    The choice depends on the window's content alone, so that equal windows have equal anchors at equal
    offsets. There may be at most 2**24 grams.
    """
    order = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(order, width) & _POSITION).astype(np.int64)


def pieces(n: int, size: int, overlap: int):
    """Bounds of pieces that share overlap units, so that each window of overlap + 1 units is in one piece."""
    start = 0
    while True:
        yield start, min(n, start + size + overlap)
        start += size
        if start + overlap >= n:
            return


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

