"""Vectorised text work in numpy: many texts as one code-point array, hashes of any segments, memoised segments.

Texts are joined with a separator into one array of code points. A prefix sum of keyed terms T(c) * B**i modulo
2**64 gives the hash of any segment [s, e) as (P[e] - P[s]) * B**-s, finished by a mixer; all segments of a block are
hashed at once, whatever their lengths. Hashes have 64 bits: n distinct segments collide with probability n*n/2**65.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Code points of a block; a longer text makes a block of its own.
BLOCK_CHARS = 500_000
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the last table of each base is kept."""
    old = _powers.get(base)
    if old is None or len(old) < n:
        steps = np.full(max(n, BLOCK_CHARS + 2), base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * BLOCK_CHARS:
            return table
        _powers[base] = old = table
    return old[:n]


_TERMS = mix(np.arange(1, 0x3001, dtype=np.uint64) * np.uint64(_B))


class Block:
    """Several texts as one array of code points. Text k is [starts[k], ends[k]); a newline stands between texts."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.text = "\n".join(texts)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._prefix: np.ndarray | None = None

    def lowered_ascii(self) -> Block:
        """Lower-cases A-Z only, in place."""
        up = (self.codes >= 65) & (self.codes <= 90)
        self.codes = self.codes + (up.astype(np.uint32) << np.uint32(5))
        return self

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the segments [s, e)."""
        n = len(self.codes)
        if self._prefix is None:
            small = self.codes < len(_TERMS)
            terms = _TERMS[np.where(small, self.codes, 0)]
            if not small.all():
                terms = np.where(small, terms, mix((self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_B)))
            self._prefix = np.empty(n + 1, dtype=np.uint64)
            self._prefix[0] = 0
            np.cumsum(terms * _power_table(_B, n), out=self._prefix[1:])
        raw = (self._prefix[e] - self._prefix[s]) * _power_table(_B_INV, n + 1)[s]
        return mix(raw + (e - s).astype(np.uint64) * _M2)

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where mask holds; the newline between texts must be outside the mask."""
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
        return edge[::2], edge[1::2]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs without ASCII white space."""
        c = self.codes
        return self.runs((c != 32) & ((c < 9) | (c > 13)))

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text in which each position lies."""
        return np.searchsorted(self.ends, positions, side="left")


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of at most `limit` code points (or one longer text), with the index of their first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


class Memo:
    """Maps segment hashes to short integer arrays that `compute` makes once for each new segment. Emptied when full."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 500_000, dtype=np.int32):
        self.compute, self.most, self.dtype = compute, most, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int32)
        self.flat = np.empty(0, dtype=self.dtype)

    def rows(self, block: Block, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Row of each segment in the memo's arrays `at` and `size`, valid until the next call."""
        keys, first, inverse = np.unique(block.hashes(s, e), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most and len(self.keys):
            self._clear()
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if fresh.any():
            text = block.text
            made = self.compute([text[a:b] for a, b in zip(s[first[fresh]].tolist(), e[first[fresh]].tolist(), strict=True)])
            size = np.fromiter(map(len, made), dtype=np.int32, count=len(made))
            at = len(self.flat) + np.cumsum(size) - size
            if isinstance(made[0], np.ndarray):
                flat = np.concatenate(made).astype(self.dtype, copy=False)
            else:
                flat = np.fromiter(itertools.chain.from_iterable(made), dtype=self.dtype, count=int(size.sum()))
            keys_all = np.concatenate((self.keys, keys[fresh]))
            order = np.argsort(keys_all, kind="stable")
            self.keys = keys_all[order]
            self.at = np.concatenate((self.at, at))[order]
            self.size = np.concatenate((self.size, size))[order]
            self.flat = np.concatenate((self.flat, flat))
            place = np.searchsorted(self.keys, keys)
        return place[inverse]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments' arrays, one after the other, and the length of each."""
        size = self.size[rows].astype(np.int64)
        total = int(size.sum())
        if not total:
            return np.empty(0, dtype=self.dtype), size
        begin = np.cumsum(size) - size
        return self.flat[np.arange(total) + np.repeat(self.at[rows] - begin, size)], size
