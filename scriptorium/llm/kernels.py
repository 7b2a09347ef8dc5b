"""Array kernels over the UTF-8 bytes of a batch of texts.

Every kernel works on flat arrays for a whole block of texts, so its cost is some passes over the
bytes. Blocks hold about ``BLOCK_BYTES`` of text (a longer text is a block of its own), which
bounds memory whatever the number of rows in an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32

#: An odd multiplier and its inverse modulo 2^64, and a value for each byte.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: One odd multiplier for each place in a shingle.
_PLACE = np.random.default_rng(7_919).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the multiplier and of its inverse, grown as longer blocks come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, BLOCK_BYTES + 1)
            with np.errstate(over="ignore"):
                for name, by in (("up", _BASE), ("down", _BACK)):
                    made = np.full(n, by & (1 << 64) - 1, np.uint64)
                    made[0] = 1
                    setattr(cls, name, np.cumprod(made, dtype=np.uint64))


class Block(NamedTuple):
    """Some texts: their bytes end to end, where each begins (one more entry for the end), their rows."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """The words of a block: byte ranges in it, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array) -> Iterator[Block]:
    """Cut a column into blocks of whole texts."""
    data, offsets = flat(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def lowered(block: Block) -> Block:
    """A-Z in lower case, nothing else changed."""
    return block._replace(data=_LOW[block.data])


def words(block: Block) -> Words:
    """Maximal runs of other bytes than space and tab to carriage return; none crosses a text."""
    n = len(block.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64))
    solid = ~_GAP[block.data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = block.offsets[(block.offsets > 0) & (block.offsets < n)]
    opens[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hashes(block: Block) -> np.ndarray:
    """Entry i: the hash of the first i bytes, from which range_hashes takes any range."""
    n = len(block.data)
    Powers.reach(n + 1)
    made = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[block.data] * Powers.up[:n], out=made[1:])
    return made


def range_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (prefixes[ends] - prefixes[starts]) * Powers.down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_hashes(block: Block, found: Words) -> np.ndarray:
    return range_hashes(prefix_hashes(block), found.starts, found.ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within each text, and where each text's begin.

    A text with fewer words, but some, has its whole sequence as one.
    """
    counts = np.diff(bounds)
    n = len(hashes)
    with np.errstate(over="ignore"):
        made = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size if n >= size else 0):
            made += hashes[j : n - size + 1 + j] * _PLACE[j]
        runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        to = np.concatenate([[0], np.cumsum(runs)])
        text = np.repeat(np.arange(len(counts)), runs)
        at = bounds[text] + (np.arange(to[-1]) - to[text])
        out = np.zeros(to[-1], np.uint64)
        full = counts[text] >= size
        out[full] = made[at[full]]
        for k in np.flatnonzero(~full):
            run = hashes[bounds[text[k]] : bounds[text[k] + 1]]
            out[k] = (run * _PLACE[: len(run)]).sum(dtype=np.uint64) + np.uint64(len(run)) * _PLACE[-1]
    return mixed(out), to


def members(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each value the index of its equal in a sorted array, or -1."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between tasks, and so would their heaps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives memory back when its partition is done."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that edges (u, v) connect it with."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
