"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on one *block*: the UTF-8 bytes of several whole texts laid
end to end, plus the byte offsets between them.  Blocks are cut between texts,
never inside one, so a long text simply makes a larger block.

A word's hash is the sum of its bytes, each times a pseudo-random multiplier of
its place in the word; no two words meet by their structure, as they could under
powers of one base modulo 2**64.  Windows of words have a Rabin-Karp hash modulo
the prime 2**61 - 1, taken by doubling, and a second one of that first kind.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x0A3C59AC2B7F9E15


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Hand free memory back to the system: a Python worker outlives its stage, idle beside those of the next ones."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def by_batch(run: Callable) -> Callable:
    """``run``, a generator over batches that keeps nothing from one to the next, with memory given back after each."""

    def one(batches):
        for batch in batches:
            yield from run(iter((batch,)))
            del batch
            give_back()

    return one


def by_group(run: Callable) -> Callable:
    """``run``, a function of a group (with or without its key), with memory given back after each."""

    def one(table):
        out = run(table)
        give_back()
        return out

    def keyed(key, table):
        out = run(key, table)
        give_back()
        return out

    def both(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return {1: one, 2: keyed, 3: both}[run.__code__.co_argcount]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Multipliers of the first places in a word; those of later ones are made when needed.
_PLACES = 4096


def _multipliers(at: np.ndarray) -> np.ndarray:
    return mix(at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


_FIRST = _multipliers(np.arange(_PLACES))
_VALUES = np.arange(1, 257, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = _VALUES[_LOWER]
#: Bytes of letters and digits; all of a character beyond ASCII counts as a letter.
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    n, kind = len(column), np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    off = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each; a longer text stands alone."""
    i, n = 0, off.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a block: byte ranges, the texts' word offsets, and 64-bit hashes.

    ``alnum=False``: maximal runs of bytes other than 0x20 and 0x09-0x0D.
    ``alnum=True``: maximal runs of letters and digits.
    ``lower`` folds A-Z (with ``alnum`` also the capitals U+00C0-U+00DE).
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False, alnum: bool = False):
        n = raw.size
        self.off, self.n_texts = off, off.size - 1
        gap = (_NOT_ALNUM if alnum else SPACE)[raw]
        edge = np.empty(n + 1, bool)
        edge[0] = True
        edge[1:] = gap
        edge[off[off < n]] = True
        self.starts = np.flatnonzero(edge[:n] & ~gap)
        edge[:n] = gap
        edge[n] = True
        edge[off] = True
        self.ends = np.flatnonzero(edge[1:] & ~gap) + 1
        self.word_off = np.searchsorted(self.starts, off)
        if alnum and lower:
            raw = raw.copy()
            after = np.flatnonzero(raw[:-1] == 0xC3) + 1
            after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
            raw[after] += 0x20
        kind = np.int32 if n < 1 << 31 else np.int64
        at = np.zeros(n, kind)
        at[self.starts] = self.starts
        np.maximum.accumulate(at, out=at)
        np.subtract(np.arange(n, dtype=kind), at, out=at)  # place in the word
        self._sums = np.zeros(n + 1, np.uint64)
        late = np.flatnonzero(at >= _PLACES)
        far = _multipliers(at[late])
        at[late] = 0
        terms = _FIRST[at]
        terms[late] = far
        terms *= (_LOWER_VALUES if lower else _VALUES)[raw]
        terms[gap] = 0
        np.cumsum(terms, out=self._sums[1:])
        self.hash = self.prefix_hash(self.ends)

    def prefix_hash(self, to: np.ndarray) -> np.ndarray:
        """Hash of each word's bytes before ``to``."""
        return mix(self._sums[to] - self._sums[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.word_off)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts())


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """``a * b`` modulo the prime, of values below it."""
    low, high = np.uint64(b & 0x7FFFFFFF), np.uint64(b >> 31)
    a0, a1 = a & np.uint64(0x7FFFFFFF), a >> np.uint64(31)
    middle = a1 * low + a0 * high
    a1 *= high
    a1 <<= np.uint64(1)
    a0 *= low
    a1 += a0
    a1 += middle >> np.uint64(30)
    middle &= np.uint64(0x3FFFFFFF)
    middle <<= np.uint64(31)
    a1 += middle
    return _reduced(a1)


def _reduced(a: np.ndarray) -> np.ndarray:
    a = (a & _PRIME) + (a >> np.uint64(61))
    a -= _PRIME * (a >= _PRIME)
    return a


def rabin_karp(hashes: np.ndarray, width: int) -> np.ndarray:
    """``sum(h[i + k] * B**(width - 1 - k))`` modulo 2**61 - 1 for every run of ``width`` entries, by doubling."""
    part, size = _reduced(hashes), 1  # runs of 1, 2, 4 ... entries
    out, done = None, 0
    while True:
        if width & size:  # these entries, then those that out holds
            n = hashes.size - size - done + 1
            out = part if out is None else _reduced(_times(part[:n], pow(_BASE, done, int(_PRIME))) + out[size : size + n])
            done += size
        if done == width:
            return out
        part = _reduced(_times(part[:-size], pow(_BASE, size, int(_PRIME))) + part[size:])
        size *= 2


def window_keys(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of ``width`` consecutive entries (across text borders too): the Rabin-Karp
    hash, its 61 bits filled up with bits of the second; and a sum under multipliers of the place."""
    n = hashes.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    second = np.zeros(n, np.uint64)
    for k, m in enumerate(_multipliers(np.arange(width) + 1)):
        second += hashes[k : k + n] * m
    second = mix(second)
    return mix(rabin_karp(hashes, width) << np.uint64(3) | second & np.uint64(7)), second


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The first hash of :func:`window_keys`."""
    return window_keys(hashes, width)[0]


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run of entries from ``first`` to before ``last``; runs don't overlap."""
    n = last - first
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[at + np.repeat(first, n)] * _multipliers(at))))
    ends = np.cumsum(n)
    return mix(sums[ends] - sums[ends - n])


def window_starts(word_off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each window that stays inside its text; number of windows of each text."""
    per_text = np.maximum(np.diff(word_off) - width + 1, 0)
    first = np.cumsum(per_text) - per_text
    at = np.arange(int(per_text.sum())) + np.repeat(word_off[:-1] - first, per_text)
    return at, per_text


def narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest whole bytes (1, 2, 4 or 8) that hold the largest."""
    top = int(values.max()) if values.size else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`narrow` for ``n`` values."""
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n if n else 1]
    return np.frombuffer(data, kind).astype(np.int64)
