"""Words, hashes and ragged arrays over the UTF-8 bytes of whole Arrow text columns.

A chunk is a run of whole rows of about ``CHUNK_BYTES``; one longer text is a chunk
of its own. A chunk is one byte array in which each text is followed by a tail, so
that words and lines never cross texts. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
U = np.uint64

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept only up to a few chunks."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Give the memory of a finished task back to the system: Python workers outlive their tasks."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def sparing(task):
    """A task over record batches that releases its memory at its end."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


BYTE_VALUES = _byte_values()


def table(members: bytes | range, inverse: bool = False) -> np.ndarray:
    """A yes/no table over byte values."""
    out = np.zeros(256, np.bool_)
    out[list(members)] = True
    return ~out if inverse else out


#: ``[^\x20\x09-\x0D]+`` on bytes: all separators are ASCII.
SPACED_WORD = table(bytes([0x20, *range(0x09, 0x0E)]), inverse=True)


def row_runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive chunks of at most ``limit`` bytes, one row at least."""
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to - at
        at = to


class Chunk:
    """The bytes of some texts, each followed by ``tail``."""

    def __init__(self, column: pa.Array, tail: str = "\n"):
        kind = pa.large_string()
        texts = pc.fill_null(column.cast(kind), pa.scalar("", kind))
        whole = pc.binary_join_element_wise(texts, pa.scalar("", kind), pa.scalar(tail, kind))
        if isinstance(whole, pa.ChunkedArray):
            whole = whole.combine_chunks()
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = whole.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.rows = len(column)
        self._sums: np.ndarray | None = None

    def words(self, is_word: np.ndarray = SPACED_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends, and the first word of each text (one more than texts)."""
        inside = np.zeros(len(self.bytes) + 1, bool)
        np.take(is_word, self.bytes, out=inside[1:], mode="clip")
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: equal bytes give equal hashes."""
        if self._sums is None:
            sums = np.zeros(len(self.bytes) + 1, U)
            np.take(BYTE_VALUES, self.bytes, out=sums[1:], mode="clip")
            np.multiply(sums[1:], powers(MULTIPLIER, len(self.bytes)), out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            self._sums = sums
        value = (self._sums[ends] - self._sums[starts]) * powers(INVERSE, len(self.bytes) + 1)[starts]
        return mix(value + (ends - starts).astype(U))


def order_of(keys: np.ndarray) -> np.ndarray:
    """Positions that bring equal keys together (in ascending order of keys, then of position).

    Sorting packed (key, position) numbers is several times faster than an argsort. The low
    bits of the keys make room for the positions; where that joins unequal keys, the slow
    way is taken.
    """
    n = len(keys)
    bits = max(1, n.bit_length())
    if bits <= 24:
        mask = U((1 << bits) - 1)
        packed = keys & ~mask
        packed |= np.arange(n, dtype=U)
        packed.sort()
        order = (packed & mask).view(np.int64)
        packed &= ~mask
        joined = packed[1:] == packed[:-1]
        np.take(keys, order, out=packed, mode="clip")
        if not (joined & (packed[1:] != packed[:-1])).any():
            return order
    return np.argsort(keys, kind="stable")


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place of each group in that order, group of each key), groups by ascending key."""
    order = order_of(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    del ranked
    which = np.empty(len(keys), np.int64)
    number = np.cumsum(new)
    number -= 1
    which[order] = number
    return order, np.flatnonzero(new), which


def per_row(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``firsts``; 0 for empty rows."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for every (start, length), one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
