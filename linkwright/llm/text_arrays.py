"""Words and hashes of a whole Arrow batch of texts as numpy arrays.

The helpers work on the UTF-8 bytes that Arrow hands to a task, so that no
Python string is made per word. Batches are cut into slices of a few MB, which
bounds the memory of a task; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Bytes that separate words in every "words" contract: space, and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all non-ASCII bytes; the rest separates words when punctuation must not matter.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        table = _powers[kind] = np.multiply.accumulate(steps)
    return table


@dataclass
class Slice:
    """Consecutive texts of a batch: ``data[offsets[i]:offsets[i + 1]]`` holds text i of the slice."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a slice in order; those of text i are at ``bounds[i]:bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    def hashes(self) -> np.ndarray:
        return self.hash_of(self.starts, self.ends)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans that lie inside words."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * _power("down", len(self.sums) + 1)[starts])


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of at most ``limit`` bytes, or one text. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(part: Slice, inside: np.ndarray, lower: np.ndarray = LOWER) -> Words:
    """Maximal runs of bytes for which ``inside`` holds, with prefix sums for their hashes."""
    n = len(part.data)
    is_in = inside[part.data]
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = is_in[:-1]
        after[:-1] = is_in[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    starts = np.flatnonzero(is_in & ~before)
    ends = np.flatnonzero(is_in & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[lower[part.data]] * _power("up", n + 1)[:n], out=sums[1:])
    return Words(starts, ends, np.searchsorted(starts, part.offsets), sums)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values in a sorted array begin, and its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
