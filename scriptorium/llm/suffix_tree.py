"""Language-model scoring by a probabilistic suffix tree over words, and the unigram base beside it.

The model. Texts are lower-cased (A-Z) and read as words with one end after them. The tree's root gives
every word its unigram probability; a context is the last one to ``depth`` words (a text begins after
ends). A context is a state of the tree if it stands ``MIN_COUNT`` times or more in the training texts
and its next-symbol distribution diverges from that of the context one word shorter: over its own
occurrences, each predicted from all the others (left out one at a time), the mean log ratio of the two
is above ``GAIN``. For a symbol that was drawn independently of the context this is negative, whatever
the counts; for one that follows it, it is the Kullback-Leibler divergence less what its estimate
costs. There is no bound on the number of states: they grow with the corpus, and how deep the tree is
anywhere follows from the counts there.

Distributions are smoothed towards the next shorter state's (Witten-Bell), down to the root. A symbol is
scored by the longest suffix of what stands before it that is a state; the score of a text is the sum
of its log10 probabilities, the end included.

The base. Words of all training texts, and an end for each text, are counted exactly. A token counted
c times has (c + 1) / (N + V + 1). At the root, words outside the broadcast list share what the listed
ones and the end leave, in equal parts: one for each such word seen, and one for all unknown ones.

How it runs. One pass over the texts counts words, in buckets of hashes that grow in number with the
input. The ``LISTED`` most frequent ones are broadcast (20 MB at most) and travel as short numbers; others
travel as their hashes. A last pass writes each token's context, next word and text as packed columns to
the bucket of its shortest context that does not stand too often for one task. In a bucket all longer
contexts are whole: it counts them, tests them, and returns for each block of texts what its states add to
the root's scores. The tree never leaves its buckets.

Contexts that stand more than ``HOT_COUNT`` times are states by the same tests, but nothing gathers their
occurrences. A second pass counts contexts of frequent words, and those above the bound are listed (the list is
broadcast: at most depth * tokens / HOT_COUNT names, and HOT_COUNT rises with the corpus so that these are
never more than depth * 2^20). A third pass sends distinct events, a context and its next word with its
count, to buckets by event. There, as counts add up, the contexts' sizes are summed first and then their
gains, one length after the other. The events' probabilities go to the buckets in which longer contexts
need them. Where the bound lies changes who does the work, not the scores.

Defined results: null counts as empty; an empty text has one token, the end. With no training rows N
and V are 0, the tree is its root, and an end is as likely as any word. Repeated rows are separate
texts, in training and in results; a null id is held out or not by the empty text's crc32. Very long
texts are read to their end; equal counts are ordered by hash. An empty table gives an empty result;
other columns never take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels
from scriptorium.llm.quality_model import held_out
from scriptorium.llm.shared import durable

#: The longest context, unless another is asked for.
DEPTH = 3
MIN_COUNT = 2
#: Nats a symbol by which a state's predictions have to be better than its parent's.
GAIN = 0.02
#: Occurrences of a context that one task takes, and listed contexts of each length at most.
HOT_COUNT, MOST_HOT = 1_000_000, 1 << 20
#: Words looked up by broadcast. Numbers of words: their places in the list; the end's; in buckets those after it
#: stand for other words, which have their hashes as negative numbers elsewhere.
LISTED = 1 << 20
ID_BITS = 21
OTHER, END = 1 << 20, (1 << ID_BITS) - 1
#: Text for each bucket of words and of contexts.
BUCKET_BYTES = 12 << 20
#: Entries, and texts, that a task holds before it sends them.
HELD = 800_000
HELD_TEXTS = 32_000
#: Tokens of a bucket that are worked on at a time.
PART = 300_000


def learns(key: str):
    return ~held_out(F.col(key), 7, 2)


_COUNTS = "kind string, bucket long, h binary, n binary"


def counts(docs: DataFrame, text: str, buckets: int, model=None) -> DataFrame:
    """Packed counts of the training texts: of words by bucket of their hash, and of ends; with a model, of the
    contexts of two words and more that consist of frequent words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = model.value if model else None
        table = _Counts("context" if root else "word", lambda h: bucket_of(h, buckets))
        texts = 0
        for batch in batches:
            for block in kernels.blocks(batch.column(0)):
                low = kernels.lowered(block)
                found = kernels.words(low)
                hashes = kernels.word_hashes(low, found)
                texts += block.n
                if root is None:
                    yield from table.add(hashes)
                    continue
                rows, _ = contexts(root.ids(hashes), found.bounds, root.depth)
                rows = rows[:, root.is_hot(rows[1])]
                for k in range(2, root.depth + 1):
                    rows = rows[:, root.is_hot(rows[k])]
                    yield from table.add(names_of(rows[: k + 1])[-1])
        yield from table.flush()
        if texts and root is None:
            yield pa.RecordBatch.from_arrays([pa.array(["end"]), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.array([texts], np.int64).tobytes()], pa.binary())], names=["kind", "bucket", "h", "n"])

    return docs.select(text).mapInArrow(kernels.trimmed(made), _COUNTS)


class _Counts:
    """Counts of 64-bit values, merged as blocks come in and sent once they are many."""

    def __init__(self, kind: str, bucket):
        self.kind, self.bucket = kind, bucket
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen, times = np.unique(values, return_counts=True)
        self.parts.append((seen, times))
        self.held += len(seen)
        if self.held > 2 * HELD:
            self.parts = [_merged(self.parts)]
            self.held = len(self.parts[0][0])
            if self.held > HELD:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """One packed row for each bucket."""
        if not self.held:
            return
        h, n = _merged(self.parts)
        self.parts, self.held = [], 0
        bucket = self.bucket(h)
        order = np.argsort(bucket, kind="stable")
        h, n, bucket = h[order], n[order], bucket[order]
        names, starts = np.unique(bucket, return_index=True)
        cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True))
        columns = [pa.array([self.kind] * len(cut)), pa.array(names), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (h, n))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "h", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values in order and their summed counts."""
    h = np.concatenate([h for h, _ in parts]).astype(np.uint64, copy=False)
    n = np.concatenate([n for _, n in parts])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[starts], np.add.reduceat(n, starts) if len(h) else n


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; buckets are ranges of hashes, so sorted hashes are in order of buckets."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def summed(packed: DataFrame) -> DataFrame:
    """One row for each bucket of words, and one for ends."""

    def joined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, bucket = (k.as_py() for k in key)
        parts, held, waiting = [], 0, 0
        for batch in batches:
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                parts.append((np.frombuffer(a.as_py(), np.uint64) if a.is_valid else np.zeros(1, np.uint64), np.frombuffer(b.as_py(), np.int64)))
                waiting += len(parts[-1][0])
                if waiting > max(HELD, held):
                    parts = [_merged(parts)]
                    held, waiting = len(parts[0][0]), 0
        h, n = _merged(parts)
        kernels.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([bucket]), *(pa.array([x.tobytes()], pa.binary()) for x in (h, n))], names=["kind", "bucket", "h", "n"])

    return packed.groupBy("kind", "bucket").applyInArrow(joined, _COUNTS)


class Root:
    """The unigram distribution: listed words by falling count, the end, and all other words alike; and which
    contexts stand too often for one task (``hot``: names of those of two words and more)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, n: int, v: int, depth: int, bound: int):
        order = np.argsort(hashes)
        self.hashes, self.rank, self.counts = hashes[order], order.astype(np.int32), counts
        self.texts, self.depth = texts, depth
        total = n + v + 1 + (texts == 0)
        rest = total - int((counts + 1).sum()) - (texts + 1)
        self.log_total = math.log10(n + v + 1)
        self.p_rare = rest / total / (v - len(hashes) - (texts > 0) + 1)
        self.p_end = (texts + 1) / total
        self.total = total
        self.n_hot, self.end_is_hot = int((counts > bound).sum()), texts > bound
        self.hot = np.zeros(0, np.uint64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words: their places in the list, or negative ones that hold 63 bits of their hashes."""
        at = kernels.members(hashes, self.hashes)
        other = -1 - (hashes >> np.uint64(1)).astype(np.int64)
        return np.where(at >= 0, self.rank[at], other) if len(self.rank) else other

    def p(self, ids: np.ndarray) -> np.ndarray:
        """The probability of each number's word."""
        made = np.full(len(ids), self.p_rare)
        listed = (ids >= 0) & (ids < len(self.counts))
        made[listed] = (self.counts[ids[listed]] + 1) / self.total
        made[ids == END] = self.p_end
        return made

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        """Whether words stand too often, as contexts of their own."""
        return (ids >= 0) & (ids < self.n_hot) | ((ids == END) & self.end_is_hot)

    def hot_lengths(self, rows: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Up to which length the contexts of each token stand too often; longer ones never stand more often."""
        made = self.is_hot(rows[1]).astype(np.int8)
        for k in range(2, self.depth + 1):
            at = np.flatnonzero(made == k - 1)
            made[at] += kernels.members(names[k - 1][at], self.hot) >= 0
        return made


def contexts(ids: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token of some texts, ends included: its number in row 0 and those of the ``depth`` before it,
    the nearest first; and where each text's tokens begin."""
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    # as many ends before each text and one after it
    wide = np.full(len(ids) + n * (depth + 1), END, np.int64)
    wide[np.arange(len(ids)) + np.repeat((np.arange(n) + 1) * depth + np.arange(n), lengths)] = ids
    to = bounds + np.arange(n + 1)
    at = np.arange(to[-1]) + np.repeat((np.arange(n) + 1) * depth, lengths + 1)
    return np.stack([wide[at - k] for k in range(depth + 1)]), to


def names_of(rows: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of each length, from one word on."""
    name, out = np.zeros(rows.shape[1], np.uint64), []
    for k in range(1, len(rows)):
        with np.errstate(over="ignore"):
            name = kernels.mixed(name ^ kernels.mixed(rows[k].astype(np.int64).view(np.uint64) + np.uint64(k << 24)))
        out.append(name)
    return out


def event_names(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Hashes of contexts and the words that follow them."""
    with np.errstate(over="ignore"):
        return kernels.mixed(names ^ kernels.mixed(words.astype(np.int64).view(np.uint64) + np.uint64(0xE7)))


def placed(rows: np.ndarray, root: Root) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: up to which length its contexts stand too often; the hash by which it is placed, of the
    shortest other context, or of the event if there is none; and the hash of the event in the longest
    context that stands too often (0 without one)."""
    names = names_of(rows)
    hot = root.hot_lengths(rows, names)
    event, name = np.zeros(rows.shape[1], np.uint64), names[0].copy()
    for k in range(1, root.depth + 1):
        at = np.flatnonzero(hot == k)
        event[at] = event_names(rows[0, at], names[k - 1][at])
        name[at] = names[k][at] if k < root.depth else event[at]
    return hot, name, event


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _opened(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def packed_rows(rows: np.ndarray, places: np.ndarray) -> list[bytes]:
    """Tokens as compressed planes of the bytes of their numbers, their texts with the flag, and the numbers
    of words that are not listed."""
    other = rows < 0
    small = np.where(other, OTHER, rows)
    planes = np.concatenate([(x >> shift & 255).astype(np.uint8) for x in small for shift in (0, 8, 16)])
    return [_press(planes.tobytes()), _press(places.astype(np.uint16).tobytes()), _press(rows[other].tobytes())]


def unpacked_rows(packed: list[tuple[bytes, bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of several pieces, words that are not listed numbered from END + 1 on in the bucket; places, the
    number of tokens of each piece, and the full numbers of those words."""
    rows, places, extra = [], [], []
    for h, d, n in packed:
        places.append(_opened(d, np.uint16))
        planes = _opened(h, np.uint8).reshape(depth + 1, 3, len(places[-1])).astype(np.int32)
        rows.append(planes[:, 0] | planes[:, 1] << 8 | planes[:, 2] << 16)
        extra.append(_opened(n, np.int64))
    others, number = np.unique(np.concatenate(extra), return_inverse=True)
    at = 0
    for made, own in zip(rows, extra, strict=True):
        made[made == OTHER] = END + 1 + number[at : at + len(own)]
        at += len(own)
    return np.concatenate(rows, axis=1), np.concatenate(places), np.array([len(x) for x in places]), others


def full_numbers(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Numbers of a bucket as they are outside of it."""
    made = ids.astype(np.int64)
    made[ids > END] = others[ids[ids > END] - END - 1]
    return made


def smoothed(n: np.ndarray, size: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities in a state of so many occurrences and different words, by those of its parent."""
    return (n + kinds * p) / np.maximum(size + kinds, 1)


def left_out_gains(n: np.ndarray, size: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of an occurrence of events that stand n times: the log ratio of its probability by all the others to its
    parent's. Leaving it out also takes its kind away if it was the only one."""
    left, kinds_left = size - 1, kinds - (n == 1)
    out = np.where(left > 0, (n - 1 + kinds_left * p) / np.maximum(left + kinds_left, 1), p)
    return np.log(np.where(n > 0, out, p) / p)


def added_by_states(rows: np.ndarray, taught: np.ndarray, hot: np.ndarray, start: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What the tree adds to the root's log10 probability of each token.

    ``rows`` are as from contexts(), and hold all tokens of each context longer than ``hot``; those taught are
    counted. ``start`` are the probabilities up to that length. Levels are gone through from the shortest on.
    """
    rows = rows.astype(np.int64)
    p = start.copy()
    bits = int(rows.max(initial=0)).bit_length()
    context = np.zeros(rows.shape[1], np.int64)
    for k in range(1, len(rows)):
        # contexts as numbers from 0: those of a level are the last level's, split by one word more
        _, context = np.unique(context << bits | rows[k], return_inverse=True)
        events, event = np.unique(context << bits | rows[0], return_inverse=True)
        own = np.bincount(event, weights=taught, minlength=len(events))
        of = events >> bits
        size = np.bincount(of, weights=own)
        kinds = np.bincount(of, weights=own > 0)
        n, t, m = own[event], kinds[context], size[context]
        cold = hot < k
        gain = np.where(taught & cold, left_out_gains(n, m, t, p), 0.0)
        total = np.bincount(context, weights=gain, minlength=len(size))
        state = (size >= MIN_COUNT) & (total > GAIN * size)
        p = np.where(state[context] & cold, smoothed(n, m, t, p), p)
    return np.log10(p / base)


# ---- contexts that stand too often


_EVENTS = "bucket long, x binary, w binary, n binary, e binary, b binary"


def hot_events(docs: DataFrame, text: str, model, buckets: int) -> DataFrame:
    """Packed rows for buckets of events: distinct events of the longest such contexts (next words, contexts' words
    and -1 after them, counts in training texts), and which buckets of tokens ask for which events."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = model.value
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def sent() -> pa.RecordBatch:
            rows, event, taught, to = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((to, event))
            rows, event, taught, to = rows[:, order], event[order], taught[order], to[order]
            first = np.flatnonzero(np.concatenate([[True], event[1:] != event[:-1]]))
            asked = np.flatnonzero(np.concatenate([[True], (event[1:] != event[:-1]) | (to[1:] != to[:-1])]))
            n, rows = np.add.reduceat(taught, first), rows[:, first]
            # by the event with the last word alone, so that an event and its parents share a bucket
            bucket = bucket_of(event_names(rows[0], names_of(rows[:2])[0]), buckets)
            of = np.repeat(bucket, np.diff(np.append(first, len(event))))[asked]
            event, to = event[asked], to[asked]
            out = []
            order, ask = np.argsort(bucket, kind="stable"), np.argsort(of, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            parts = zip(names.tolist(), np.split(order, starts[1:]), np.split(ask, np.searchsorted(of[ask], names)[1:]), strict=True)
            for name, a, b in parts:
                x, w = rows[0, a], rows[1:, a].astype(np.int32)
                out.append((name, _press(x.tobytes()), _press(w.tobytes()), _press(n[a].tobytes()), _press(event[b].tobytes()), _press(to[b].astype(np.int32).tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(6)], names=["bucket", "x", "w", "n", "e", "b"])

        for batch in batches:
            flags = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in kernels.blocks(batch.column(1)):
                low = kernels.lowered(block)
                found = kernels.words(low)
                rows, bounds = contexts(root.ids(kernels.word_hashes(low, found)), found.bounds, root.depth)
                taught = np.repeat(flags[block.first : block.first + block.n], np.diff(bounds))
                some = root.is_hot(rows[1])
                rows, taught = rows[:, some], taught[some]
                hot, name, event = placed(rows, root)
                for k in range(2, root.depth + 1):
                    rows[k, hot < k] = -1
                held.append((rows, event, taught, bucket_of(name, buckets)))
                count += rows.shape[1]
                if count > HELD:
                    yield sent()
                    count = 0
        if count:
            yield sent()

    return docs.select("__learns", text).mapInArrow(kernels.trimmed(made), _EVENTS)


def merged_events(packed: DataFrame) -> DataFrame:
    """One row for each bucket of events: each event once, its counts summed, and each question once."""

    def joined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events: list[tuple[np.ndarray, ...]] = []
        asked: list[np.ndarray] = []
        rows = waiting = 0

        def merge() -> None:
            nonlocal rows, waiting
            x, w, n = (np.concatenate(part, axis=-1) for part in zip(*events, strict=True))
            order = np.lexsort((*w[::-1], x))
            x, w, n = x[order], w[:, order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (w[:, 1:] != w[:, :-1]).any(axis=0)]))
            events[:] = [(x[first], w[:, first], np.add.reduceat(n, first))]
            pairs = np.unique(np.concatenate(asked, axis=1), axis=1) if len(asked) > 1 else asked[0]
            asked[:] = [pairs]
            rows, waiting = len(first) + pairs.shape[1], 0

        for batch in batches:
            for x, w, n, e, b in zip(*batch.columns[1:], strict=True):
                x, n, e, b = (_opened(v.as_py(), t) for v, t in ((x, np.int64), (n, np.int64), (e, np.uint64), (b, np.int32)))
                events.append((x, _opened(w.as_py(), np.int32).reshape(-1, len(x)), n))
                asked.append(np.stack([b.astype(np.uint64), e]))
                waiting += len(x) + len(e)
                if waiting > max(HELD, rows):
                    merge()
        merge()
        (x, w, n), (b, e) = events[0], asked[0]
        out = [key[0].as_py(), *(v.tobytes() for v in (x, w, n, e, b.astype(np.int32)))]
        kernels.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if i else pa.int64()) for i, v in enumerate(out)], names=["bucket", "x", "w", "n", "e", "b"])

    return packed.groupBy("bucket").applyInArrow(joined, _EVENTS)


class HotStates:
    """What is known of listed contexts, by name: sizes, kinds, and whether they are states (so far)."""

    def __init__(self, names: np.ndarray, size: np.ndarray, kinds: np.ndarray):
        order = np.argsort(names)
        self.names, self.size, self.kinds = names[order], size[order], kinds[order]
        self.state = np.zeros(len(names), bool)

    def levels(self, x: np.ndarray, w: np.ndarray, n: np.ndarray, root: Root) -> Iterator[tuple[np.ndarray, ...]]:
        """From the shortest contexts on: which events of a bucket have one of that length, its name, the events'
        counts there, the first of each, their places here, and probabilities, which the states of that length
        then change. Contexts that are not known have no place."""
        rows = np.concatenate([x[None, :], w.astype(np.int64)])
        names, self.p = names_of(rows), root.p(x)
        for k in range(1, len(rows)):
            at = np.flatnonzero(rows[k] >= 0)
            name = names[k - 1][at]
            _, first, index = np.unique(event_names(x[at], name), return_index=True, return_inverse=True)
            own = np.bincount(index, weights=n[at], minlength=len(first))[index]
            place = kernels.members(name, self.names)
            yield at, name, own, first, place
            if len(self.names):
                used = self.state[place] & (place >= 0)
                self.p[at] = np.where(used, smoothed(own, self.size[place], self.kinds[place], self.p[at]), self.p[at])


def _bucket_events(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    for x, w, n, e, b in zip(*batch.columns, strict=True):
        x, n, e, b = (np.frombuffer(v.as_py(), t) for v, t in ((x, np.int64), (n, np.int64), (e, np.uint64), (b, np.int32)))
        yield x, np.frombuffer(w.as_py(), np.int32).reshape(depth, -1), n, e, b


def _sums(held: DataFrame, context, model, known: HotStates | None, level: int) -> dict[int, tuple[float, float]]:
    """By context's name: size and kinds (without known states), or the gain of a length's contexts. The names
    are those of listed contexts, so their number is bounded."""
    states = context.broadcast(known)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held_states = model.value, states.value or HotStates(*[np.zeros(0, np.uint64)] * 3)
        for batch in batches:
            for x, w, n, _, _ in _bucket_events(batch, root.depth):
                for k, (at, name, own, first, place) in enumerate(held_states.levels(x, w, n, root), 1):
                    if states.value is None:
                        a, b = own[first], (own[first] > 0).astype(float)
                    elif k == level:
                        a = own[first] * left_out_gains(own[first], held_states.size[place[first]], held_states.kinds[place[first]], held_states.p[at][first])
                        b = np.zeros(len(a))
                    else:
                        continue
                    names, index = np.unique(name[first], return_inverse=True)
                    columns = [names.view(np.int64), *(np.bincount(index, weights=v, minlength=len(names)).astype(float) for v in (a, b))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "a", "b"])

    found = held.select("x", "w", "n", "e", "b").mapInArrow(kernels.trimmed(made), "name long, a double, b double")
    table = found.groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    return {k: (a, b) for k, a, b in zip(*(table[c].to_pylist() for c in ("name", "a", "b")), strict=True)}


def hot_states(held: DataFrame, context, model, depth: int) -> HotStates:
    """Sizes first, then the gains of one length after the other, as a length's depend on the last one's states."""
    sizes = _sums(held, context, model, None, 0)
    names = np.array(sorted(sizes), np.int64)
    known = HotStates(names.view(np.uint64), *(np.array([sizes[k][i] for k in names.tolist()], float) for i in (0, 1)))
    for level in range(1, depth + 1):
        gains = _sums(held, context, model, known, level)
        total = np.array([gains.get(k, (0.0, 0.0))[0] for k in known.names.view(np.int64).tolist()])
        known.state |= (known.size >= MIN_COUNT) & (total > GAIN * known.size)
    return known


def answers(held: DataFrame, context, model, known: HotStates, buckets: int) -> DataFrame:
    """bucket, h, n: for buckets of tokens the events that they asked for and their probabilities."""
    states = context.broadcast(known)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = model.value
        for batch in batches:
            for x, w, n, e, b in _bucket_events(batch, root.depth):
                events = np.zeros(len(x), np.uint64)
                for at, name, _, _, _ in states.value.levels(x, w, n, root):
                    events[at] = event_names(x[at], name)
                order = np.argsort(events)
                place = order[kernels.members(e, events[order])]
                p = states.value.p[place].astype(np.float32)
                names, starts = np.unique(b, return_index=True)  # questions are in order of buckets
                cut = [[v.tobytes() for v in np.split(c, starts[1:])] for c in (e, p)]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64) + buckets), *(pa.array(c, pa.binary()) for c in cut)], names=["bucket", "h", "n"])

    return held.select("x", "w", "n", "e", "b").mapInArrow(kernels.trimmed(made), "bucket long, h binary, n binary")


_SENT = "bucket long, source long, h binary, d binary, n binary, uid long, key {kind}, flag boolean, tokens long, known long, base double, score double"
_FIELDS = ["bucket", "source", "h", "d", "n", "uid", "key", "flag", "tokens", "known", "base", "score"]


def scored(docs: DataFrame, key: str, text: str, model, kind: str, buckets: int) -> DataFrame:
    """A row for each text with what the broadcast words tell of it; packed entries of its other words
    for their buckets (hashes, text ordinals within the source, times); and, in the buckets after those,
    its tokens with their contexts. A source is some texts of one task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = model.value
        task = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = done = 0
        first = task
        key_type = None

        def batch_of(names: np.ndarray, packed: list[list[bytes | None]]) -> pa.RecordBatch:
            columns = [pa.array(names, pa.int64()), pa.array([first] * len(names), pa.int64())]
            columns += [pa.array([r[i] for r in packed], pa.binary()) for i in range(3)]
            columns += [pa.nulls(len(names), t) for t in (pa.int64(), key_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=_FIELDS)

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                h, d, n = (np.concatenate([x[i] for x in held]) for i in range(3))
                held.clear()
                order = np.argsort(h, kind="stable")
                h, d, n = h[order], d[order], n[order]
                names, starts = np.unique(bucket_of(h, buckets), return_index=True)
                yield batch_of(names, [[x.tobytes() for x in part] for part in zip(*(np.split(x, starts[1:]) for x in (h, d, n)), strict=True)])
            if runs:
                rows, to, places = (np.concatenate([x[i] for x in runs], axis=-1) for i in range(3))
                runs.clear()
                short = [np.where(x < 0, OTHER, x) for x in rows[1:3]]
                order = np.argsort(to << (2 * ID_BITS) | short[0] << ID_BITS | short[-1], kind="stable")
                rows, to, places = rows[:, order], to[order], places[order]
                names, starts = np.unique(to, return_index=True)
                cut = [*starts.tolist(), len(to)]
                for at in range(0, len(names), 512):
                    yield batch_of(names[at : at + 512] + buckets, [packed_rows(rows[:, a:b], places[a:b]) for a, b in zip(cut[at : at + 512], cut[at + 1 : at + 513], strict=False)])

        for batch in (b.slice(i, HELD_TEXTS // 2) for b in batches for i in range(0, b.num_rows, HELD_TEXTS // 2)):
            key_type = batch.column(0).type
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in kernels.blocks(batch.column(2)):
                low = kernels.lowered(block)
                found = kernels.words(low)
                hashes = kernels.word_hashes(low, found)
                tokens = np.diff(found.bounds)
                ids = root.ids(hashes)
                hit = ids >= 0
                of = np.repeat(np.arange(block.n), tokens)
                known = np.bincount(of[hit], minlength=block.n)
                base = np.bincount(of[hit], weights=np.log10(root.counts[ids[hit]] + 1), minlength=block.n) + math.log10(root.texts + 1)
                score = np.bincount(of, weights=np.log10(root.p(ids)), minlength=block.n) + math.log10(root.p_end)
                at, n = task + done - first, block.n
                rest, owner = hashes[~hit], of[~hit]
                if len(rest):
                    order = np.lexsort((rest, owner))
                    rest, owner = rest[order], owner[order]
                    starts = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])]))
                    times = np.diff(np.concatenate([starts, [len(rest)]]))
                    held.append((rest[starts], (owner[starts] + at).astype(np.uint32), times.astype(np.uint32)))
                rows, bounds = contexts(ids, found.bounds, root.depth)
                place = np.repeat((np.arange(n) + at) << 1 | flags[block.first : block.first + n], np.diff(bounds))
                runs.append((rows, bucket_of(placed(rows, root)[1], buckets), place))
                count += rows.shape[1] + len(rest)
                uids = np.arange(n) + task + done
                columns = [pa.array(-1 - uids % (4 * buckets)), pa.array([first] * n, pa.int64()), *[pa.nulls(n, pa.binary())] * 3, pa.array(uids)]
                columns += [batch.column(0).slice(block.first, n), batch.column(1).slice(block.first, n), pa.array(tokens + 1), pa.array(known + (root.texts > 0)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=_FIELDS)
                done += n
                if count > HELD or task + done - first >= HELD_TEXTS // 2:
                    yield from sent()
                    count, first = 0, task + done
        yield from sent()

    return docs.select(key, "__learns", text).mapInArrow(kernels.trimmed(made), _SENT.format(kind=kind))


_SUMS = "source long, d binary, s binary, k binary, uid long, key {kind}, flag boolean, tokens long, known long, base double, score double"


def _of_words(left: pa.Table, right: pa.Table) -> list[tuple]:
    """(source, texts, what their words add to the base, how many are known) for one bucket of words."""
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if right.num_rows:
        held = (np.frombuffer(right["h"][0].as_py(), np.uint64), np.frombuffer(right["n"][0].as_py(), np.int64))
    logs = np.log10(held[1] + 1)
    out = []
    for source, h, d, times in zip(*(left[x] for x in ("source", "h", "d", "n")), strict=True):
        at = kernels.members(np.frombuffer(h.as_py(), np.uint64), held[0])
        hit = at >= 0
        texts, index = np.unique(np.frombuffer(d.as_py(), np.uint32)[hit], return_inverse=True)
        times = np.frombuffer(times.as_py(), np.uint32)[hit].astype(float)
        sums = np.bincount(index, weights=times * logs[at[hit]], minlength=len(texts))
        known = np.bincount(index, weights=times, minlength=len(texts)).astype(np.int64)
        out.append((source.as_py(), texts.tobytes(), sums.tobytes(), known.tobytes()))
    return out


def _of_contexts(left: pa.Table, right: pa.Table, root: Root) -> list[tuple]:
    """(source, texts, what the states add to their scores, None) for one bucket of contexts; on the right the
    probabilities of events in contexts that stand too often for one task.

    A bucket is gone through in parts of about ``PART`` tokens, cut by the hash that dealt them to buckets.
    """
    rows, places, sizes, others = unpacked_rows([tuple(x.as_py() for x in row) for row in zip(left["h"], left["d"], left["n"], strict=True)], root.depth)
    known, p = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_py(), t) for x in right[c])]) for c, t in (("h", np.uint64), ("n", np.float32)))
    order = np.argsort(known)
    known, p = known[order], p[order].astype(float)
    source = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    parts = -(-len(places) // PART)
    part = np.empty(len(places), np.int32)
    for i in range(0, len(places), PART):
        part[i : i + PART] = (placed(rows[:, i : i + PART], root)[1] & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)
    more = np.zeros(len(places), np.float32)
    for i in range(parts):
        at = np.flatnonzero(part == i)
        here = rows[:, at]
        base = root.p(here[0])
        hot, start = np.zeros(len(at), np.int8), base.copy()
        some = np.flatnonzero(root.is_hot(here[1]))
        if len(some):
            full = here[:, some].astype(np.int64)
            full[0] = full_numbers(here[0, some], others)
            hot[some], _, event = placed(full, root)
            found = kernels.members(event, known)
            if (found < 0).any():
                raise RuntimeError("events came without their probabilities")
            start[some] = p[found]
        more[at] = added_by_states(here, (places[at] & 1).astype(bool), hot, start, base)
    del rows, part
    changed = np.flatnonzero(more)
    pair, index = np.unique(source[changed].astype(np.int64) << 16 | places[changed] >> 1, return_inverse=True)
    sums = np.bincount(index, weights=more[changed], minlength=len(pair)).astype(np.float32)
    ids = left["source"].to_pylist()
    names, starts = np.unique(pair >> 16, return_index=True)
    texts = (pair & 0xFFFF).astype(np.uint16)
    return [(ids[i], _press(np.diff(t, prepend=np.uint16(0)).tobytes()), _press(x.tobytes()), None) for i, t, x in zip(names.tolist(), np.split(texts, starts[1:]), np.split(sums, starts[1:]), strict=False)]


def looked_up(sent: DataFrame, totals: DataFrame, model, kind: str, buckets: int) -> DataFrame:
    """In each bucket: what it adds to each text's base or score, packed by source. Texts pass through."""
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if n and left["uid"][0].is_valid:
            return pa.table([left["source"], *[pa.nulls(n, pa.binary())] * 3, *(left[x] for x in names[4:])], names=names)
        out = _of_contexts(left, right, model.value) if n and left["bucket"][0].as_py() >= buckets else _of_words(left, right)
        kernels.give_back()
        packed = [pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(4)]
        return pa.table([*packed, *(pa.nulls(len(out), left[x].type) for x in names[4:])], names=names)

    return sent.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(joined, _SUMS.format(kind=kind))


def added(parts: DataFrame, kind: str, log_all: float) -> DataFrame:
    """The rows of texts, with what all buckets add to them."""

    def joined(table: pa.Table) -> pa.Table:
        texts = table.filter(pc.is_valid(table["uid"]))
        packed = table.filter(pc.is_null(table["uid"]))
        at = texts["uid"].to_numpy() - table["source"][0].as_py()
        size, opened = at.max(initial=-1) + 1, zstandard.ZstdDecompressor()
        base, known, score = np.zeros(size), np.zeros(size, np.int64), np.zeros(size)
        for d, s, k in zip(*(packed[x] for x in ("d", "s", "k")), strict=True):
            if k.is_valid:
                d = np.frombuffer(d.as_py(), np.uint32)
                base[d] += np.frombuffer(s.as_py())
                known[d] += np.frombuffer(k.as_py(), np.int64)
            else:
                d, s = (opened.decompress(x.as_py()) for x in (d, s))
                score[np.cumsum(np.frombuffer(d, np.uint16), dtype=np.int64)] += np.frombuffer(s, np.float32)
        tokens = texts["tokens"].to_numpy()
        columns = [texts["key"], texts["flag"], texts["tokens"], pa.array(texts["known"].to_numpy() + known[at]), pa.array(texts["base"].to_numpy() + base[at] - tokens * log_all), pa.array(texts["score"].to_numpy() + score[at])]
        return pa.table(columns, names=["key", "flag", "tokens", "known", "base", "score"])

    return parts.groupBy("source").applyInArrow(joined, f"key {kind}, flag boolean, tokens long, known long, base double, score double")


def _facts(totals: DataFrame, most: int) -> DataFrame:
    """For each bucket of words its number of words and tokens, and its most frequent words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column(0), batch.column(1), strict=True):
                h, n = np.frombuffer(h.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                top = np.argsort(-n, kind="stable")[:most]
                top = top[n[top] >= MIN_COUNT]
                word, times = np.concatenate([[0], h[top]]), np.concatenate([[n.sum()], n[top]])
                words = np.concatenate([[len(h)], np.zeros(len(top), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(times), pa.array(words)], names=["h", "n", "words"])

    return totals.select("h", "n").mapInArrow(made, "h long, n long, words long")


def suffix_tree_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score for each row. ``depth``: words of the
    longest context, 1 or more."""
    if depth < 1:
        raise ValueError("contexts of one word at least are needed")
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias(key), learns(key).alias("__learns"), F.col(text).alias(text))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    totals = durable(summed(counts(rows.where("__learns"), text, buckets)))
    words = totals.where("kind = 'word'").select("bucket", "h", "n")
    ends = totals.where("kind = 'end'").select("n").collect()  # one row
    texts = int(np.frombuffer(ends[0].n, np.int64)[0]) if ends else 0
    facts = durable(_facts(words, 64 + 2 * LISTED // buckets))
    n, v = facts.where("words > 0").agg(F.sum("n"), F.sum("words")).first()
    n, v = (n or 0) + texts, (v or 0) + (texts > 0)
    bound = max(HOT_COUNT, n // MOST_HOT)
    # at most LISTED words, whatever the corpus holds
    top = facts.where("words = 0").select("h", "n").orderBy(F.col("n").desc(), "h").limit(LISTED).toArrow()
    root = Root(top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), texts, n, v, depth, bound)
    model = context.broadcast(root)
    right = words
    if root.n_hot or root.end_is_hot:
        listed = above(summed(counts(rows.where("__learns"), text, buckets, model)), bound).toArrow()  # at most depth * n / bound
        root.hot = np.sort(listed["h"].to_numpy().view(np.uint64))
        model = context.broadcast(root)
        held = durable(merged_events(hot_events(rows, text, model, buckets)))
        right = words.unionByName(answers(held, context, model, hot_states(held, context, model, depth), buckets))
    kind = docs.schema[key].dataType.simpleString()
    parts = looked_up(scored(rows, key, text, model, kind, buckets), right, model, kind, buckets)
    done = added(parts, kind, math.log10(n + v + 1))
    return done.select(
        F.col("key").alias(key),
        (~F.col("flag")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def above(packed: DataFrame, bound: int) -> DataFrame:
    """h: the counted values that stand more often than the bound."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column(0), batch.column(1), strict=True):
                h, n = np.frombuffer(h.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[n > bound])], names=["h"])

    return packed.select("h", "n").mapInArrow(made, "h long")
