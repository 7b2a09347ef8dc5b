"""Edit distances of many pairs at a time, by bits of columns (Myers, Hyyro) in numpy.

A pair's table is cut into blocks of 64 rows. A block's column needs the block's last one and the carry of the block
above, so at step t each block b of each pair makes its column t - b: one vector of whole numbers holds all blocks of
all pairs of a batch. A block that has not begun meets no equal rows and no carry, which leaves it as it is; pairs
stand by falling end, so those still at work are the vectors' beginnings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Blocks of a batch, bytes of what a batch looks up or keeps; larger pairs are left to the caller.
_BLOCKS, _BYTES = 1 << 13, 1 << 26
#: Short columns of one pair that cost as much as a step of a batch.
_STEP = 18
#: Pairs below which the way back is gone one by one.
_FEW = 24
_ONE, _TOP = np.uint64(1), np.uint64(63)


def words_coded(ref: Sequence[str], hyp: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers from 0; -1 for what the reference has not."""
    codes: dict[str, int] = {}
    r = np.array([codes.setdefault(w, len(codes)) for w in ref], np.int64)
    return r, np.array([codes.get(w, -1) for w in hyp], np.int64)


def characters_coded(ref: str, hyp: str) -> tuple[np.ndarray, np.ndarray]:
    known, r = np.unique(np.frombuffer(ref.encode("utf-32-le"), np.uint32), return_inverse=True)
    h = np.frombuffer(hyp.encode("utf-32-le"), np.uint32)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return r.astype(np.int64), np.where(known[at] == h, at, -1)


def _batches(sizes: list[tuple[int, int, int]]) -> Iterator[list[int]]:
    """Places of pairs (blocks, steps, bytes) that are counted together, those of like length."""
    held, blocks, size = [], 0, 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k][1]):
        b, _, s = sizes[k]
        if held and (blocks + b > _BLOCKS or size + s > _BYTES or 2 * sizes[k][1] < sizes[held[0]][1]):
            yield held
            held, blocks, size = [], 0, 0
        held.append(k)
        blocks, size = blocks + b, size + s
    if held:
        yield held


def counted(refs: Sequence, hyps: Sequence, code: Callable, alone: Callable, back: bool) -> list[tuple[int, ...]]:
    """(distance,) or, with ``back``, (distance, substitutions, insertions, deletions) of each pair, none of which has
    an empty side. ``alone`` is asked for a pair whose table is too large to keep."""
    out: list = [None] * len(refs)
    places, sizes = [], []
    for k, (r, h) in enumerate(zip(refs, hyps, strict=True)):
        blocks = -(-len(r) // 64)
        size = 8 * blocks * ((len(set(r)) + 1) + (2 * (len(h) + blocks) if back else 0)) + 16 * len(h)
        if size > _BYTES:
            out[k] = alone(r, h)
        else:
            places.append(k)
            sizes.append((blocks, len(h) + blocks - 1, size))
    for held in _batches(sizes):
        # a few long pairs do better one by one
        if sum(sizes[k][1] * (1 + sizes[k][0] / 14) for k in held) < _STEP * sizes[held[0]][1]:
            for k in held:
                out[places[k]] = alone(refs[places[k]], hyps[places[k]])
            continue
        pairs = [code(refs[places[k]], hyps[places[k]]) for k in held]
        for k, found in zip(held, _together(pairs, back), strict=True):
            out[places[k]] = found
    return out


def _together(pairs: list[tuple[np.ndarray, np.ndarray]], back: bool) -> list[tuple[int, ...]]:
    """One batch, pairs by falling number of steps."""
    n, m = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    blocks = (n + 63) // 64
    steps = m + blocks - 1
    first = np.cumsum(blocks) - blocks
    # rows of masks by pair and code, the first of each pair empty
    width = np.array([(p[0].max() + 2) for p in pairs]) * blocks
    base = np.cumsum(width) - width
    masks = np.zeros(width.sum(), np.uint64)
    row = np.concatenate([np.arange(x) for x in n])
    np.bitwise_or.at(masks, np.concatenate([b + (p[0] + 1) * k for p, b, k in zip(pairs, base, blocks, strict=True)]) + row // 64, _ONE << (row % 64).astype(np.uint64))
    # the rows that a pair's columns ask for, after empty ones for the blocks that wait
    asked = np.concatenate([np.concatenate([np.full(k - 1, b), b + (p[1] + 1) * k]) for p, b, k in zip(pairs, base, blocks, strict=True)])
    block = np.concatenate([np.arange(k) for k in blocks])
    at = np.repeat(np.cumsum(steps) - steps + blocks - 1, blocks) - block

    total, last, shift = len(block), first + blocks - 1, ((n - 1) % 64).astype(np.uint64)
    working = np.searchsorted(-steps, -np.arange(steps[0]), "left")
    score = n.astype(np.int64)
    kept = np.empty((2, steps[0] if back else 0, total), np.uint64)
    held = [np.full(total, ~np.uint64(0)), *(np.zeros(total, np.uint64) for _ in range(7)), np.empty(total, np.int64), block, at]
    carried = np.zeros((2, total + 1), np.uint64)
    live = 0
    for t in range(steps[0]):
        if working[t] != live:
            live = working[t]
            size = last[live - 1] + 1
            rise, fall, eq, x, low, more, less, moved, ix, of, place = (a[:size] for a in held)
            (up, down), (next_up, next_down) = carried[:, :size], carried[:, 1 : size + 1]
            begins, ends, bits, scored = first[:live], last[:live], shift[:live], score[:live]
            up[begins], down[begins] = 1, 0
        np.take(asked, place, out=ix, mode="clip")
        np.add(ix, of, out=ix)
        np.take(masks, ix, out=eq, mode="clip")
        np.add(place, 1, out=place)
        np.bitwise_or(eq, fall, out=low)
        np.bitwise_or(eq, down, out=eq)
        np.bitwise_and(eq, rise, out=x)
        np.add(x, rise, out=x)
        np.bitwise_xor(x, rise, out=x)
        np.bitwise_or(x, eq, out=x)
        np.bitwise_or(x, rise, out=more)
        np.invert(more, out=more)
        np.bitwise_or(more, fall, out=more)
        np.bitwise_and(rise, x, out=less)
        if back:
            np.bitwise_or(x, fall, out=kept[0, t, :size])
            kept[1, t, :size] = more
        scored += (more[ends] >> bits & _ONE).view(np.int64)
        scored -= (less[ends] >> bits & _ONE).view(np.int64)
        np.left_shift(more, _ONE, out=moved)
        np.bitwise_or(moved, up, out=moved)
        np.right_shift(more, _TOP, out=next_up)
        np.left_shift(less, _ONE, out=x)
        np.bitwise_or(x, down, out=x)
        np.right_shift(less, _TOP, out=next_down)
        up[begins], down[begins] = 1, 0
        np.bitwise_and(moved, low, out=fall)
        np.bitwise_or(low, moved, out=rise)
        np.invert(rise, out=rise)
        np.bitwise_or(rise, x, out=rise)
    if not back:
        return [(int(d),) for d in score]
    substituted = _substituted(pairs, n, m, first, *kept)
    inserted = (score - substituted + m - n) // 2
    return list(zip(*(x.tolist() for x in (score, substituted, inserted, score - substituted - inserted)), strict=True))


def _substituted(pairs, n: np.ndarray, m: np.ndarray, first: np.ndarray, same: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Substitutions on the way back of each pair: ``same`` tells where a cell equals its diagonal neighbour, ``right``
    where it is one more than its left one."""
    ref, hyp = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
    out = np.zeros(len(pairs), np.int64)
    who, i, j = np.arange(len(pairs)), n.copy(), m.copy()
    r, h, f = np.cumsum(n) - n - 1, np.cumsum(m) - m - 1, first
    while len(who) >= _FEW:
        equal = ref[r + i] == hyp[h + j]
        block, bit = (i - 1) >> 6, ((i - 1) & 63).astype(np.uint64)
        cell = (j - 1 + block, f + block)
        changed = ~equal & (same[cell] >> bit & _ONE == 0)
        aside = ~equal & ~changed
        left = aside & (right[cell] >> bit & _ONE == 1)
        out[who] += changed
        i, j = i - ~left, j - (~aside | left)
        go = (i > 0) & (j > 0)
        if not go.all():
            who, i, j, r, h, f = (x[go] for x in (who, i, j, r, h, f))
    for k, y, x, f in zip(who.tolist(), i.tolist(), j.tolist(), f.tolist(), strict=True):
        a, b = (side.tolist() for side in pairs[k])
        while x and y:
            if a[y - 1] == b[x - 1]:
                x, y = x - 1, y - 1
                continue
            block, bit = (y - 1) >> 6, (y - 1) & 63
            cell = (x - 1 + block, f + block)
            if not int(same[cell]) >> bit & 1:
                x, y = x - 1, y - 1
                out[k] += 1
            elif int(right[cell]) >> bit & 1:
                x -= 1
            else:
                y -= 1
    return out
