"""Byte-level BPE by replaying the merges over the whole corpus's words, and decoding.

1. Each task cuts its texts into words (pre-tokens) and numbers the distinct ones of about
   ``BLOCK_CHARS`` of text, a source. Words that are tokens as a whole have their id already; the others
   go to a bucket by their hash. What stays of the texts is the sequence of numbers, packed.
2. A bucket holds each of its words once, from however many texts. They are laid end to end as bytes,
   and an inverted index maps each merge, named by its rank, to the positions where its pair stands.
   Ranks are applied in order; a merge touches only its two neighbours, whose new pairs enter the
   index. Words never meet, since no pair crosses a border. If a merge makes a pair of lower rank than
   its own, that rank comes next, so the result is the one of merging each word's lowest pair first.
3. The ids of its words come back to each source, which reads its texts' ids off by number, and
   decodes them.

Words are replayed once for the corpus, and buckets grow in number with it, not in size. Sources are
named by a hash of their texts, so what a repeated task sends never meets another's.

Defined results: a null or empty text has no ids, and the digests of no bytes. Very long texts are
sources of their own, and a long word is replayed like any other. Of equal pairs in a word the first is
merged first, and the numbers of words that stand equally often follow their order. Repeated rows get equal results,
an empty table an empty one; other columns of the input never take part. A missing rank file raises;
a byte without a rank of its own raises a KeyError. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels

#: Text of a source, and text for each bucket of words.
BLOCK_CHARS = 12 << 20
BUCKET_BYTES = 24 << 20


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks; executors read it too."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merges of a rank file: for each pair of token ids, the rank of the token they make.

    The rank of a pair is the rank of its joined bytes, as in the files' own libraries, so each way
    to split a token into two others is a pair.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.of_pair = {
            (ranks[token[:i]] << 32) + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        pairs = np.array(sorted(self.of_pair), np.int64)
        self.pairs, self.made = pairs, np.array([self.of_pair[p] for p in pairs.tolist()], np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.made[at], -1)


class Replay:
    """One replay of all merges over the bytes of many words.

    ``index`` maps a rank to the positions that held its pair when they were entered; an entry
    counts only while its position still holds the pair. Long lists of positions are merged as
    arrays, short ones one by one; both see the same arrays.
    """

    LONG = 24

    def __init__(self, words: list[bytes], merges: Merges):
        self.merges = merges
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        self.ends = ends
        self.token = merges.byte_ids[data]
        self.after = np.arange(1, n + 1, dtype=np.int64)
        self.before = np.arange(-1, n - 1, dtype=np.int64)
        borders = ends[ends > 0]
        self.after[borders - 1] = -1
        self.before[borders[borders < n]] = -1
        self.rank = np.full(n, -1, np.int64)
        heads = np.flatnonzero(self.after >= 0)
        table = merges.ranks_of(np.repeat(merges.byte_ids, 256), np.tile(merges.byte_ids, 256))
        self.rank[heads] = table[data[heads].astype(np.int64) * 256 + data[heads + 1]]
        self.index: dict[int, list] = {}
        self.due: list[int] = []
        self.enter(np.flatnonzero(self.rank >= 0))
        # scalar reads and writes go through views of the same memory
        self.token_, self.after_, self.before_, self.rank_ = map(memoryview, (self.token, self.after, self.before, self.rank))

    def enter(self, places: np.ndarray) -> None:
        """Put positions into the index under their ranks."""
        if not len(places):
            return
        ranks = self.rank[places]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(places)]
        for rank, start, stop in zip(ranks[starts].tolist(), starts, stops, strict=True):
            self.list_of(rank).append(places[start:stop])

    def list_of(self, rank: int) -> list:
        if (held := self.index.get(rank)) is None:
            held = self.index[rank] = []
            heapq.heappush(self.due, rank)
        return held

    def run(self) -> list[list[int]]:
        while self.due:
            rank = heapq.heappop(self.due)
            held = self.index.pop(rank)
            singles = [p for p in held if type(p) is int]
            if len(singles) == len(held) and len(singles) < self.LONG:
                self.one_by_one(rank, sorted(set(singles)))
                continue
            places = np.unique(np.concatenate([*(p for p in held if type(p) is not int), np.array(singles, np.int64)]))
            places = places[self.rank[places] == rank]
            if len(places) < self.LONG or not self.together(rank, places):
                self.one_by_one(rank, places.tolist())
        alive = self.token >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], self.ends])].tolist()
        ids = self.token[alive].tolist()
        return [ids[a:b] for a, b in pairwise(upto)]

    def together(self, rank: int, places: np.ndarray) -> bool:
        """Merge at all places at once; False, and nothing done, if the order of merges matters.

        It does where two places share a token, or where a new pair ranks below this one.
        """
        right = self.after[places]
        if (right[:-1] == places[1:]).any():
            return False
        following, previous = self.after[right], self.before[places]
        # a neighbour may be merged in the same step: then its token is this rank's as well
        merged_left = np.zeros(len(places), bool)
        merged_left[1:] = right[:-1] == previous[1:]
        merged_right = np.zeros(len(places), bool)
        merged_right[:-1] = following[:-1] == places[1:]
        left_token = np.where(merged_left, rank, self.token[previous])
        right_token = np.where(merged_right, rank, self.token[following])
        left_rank = np.where(previous >= 0, self.merges.ranks_of(left_token, np.full(len(places), rank)), -1)
        right_rank = np.where(following >= 0, self.merges.ranks_of(np.full(len(places), rank), right_token), -1)
        # before its right neighbour is merged too, a place meets that neighbour's first token
        early = np.where(following >= 0, self.merges.ranks_of(np.full(len(places), rank), self.token[following]), -1)
        if any(((r >= 0) & (r < rank)).any() for r in (left_rank, right_rank, early)):
            return False
        self.token[places] = rank
        self.token[right] = -1
        self.rank[right] = -1
        self.after[places] = following
        inner = following >= 0
        self.before[following[inner]] = places[inner]
        follows = merged_left.nonzero()[0]
        self.before[places[follows]] = places[follows - 1]
        self.after[places[follows - 1]] = places[follows]
        self.rank[places] = right_rank
        lefts = (previous >= 0) & ~merged_left
        self.rank[previous[lefts]] = left_rank[lefts]
        touched = np.concatenate([places, previous[lefts]])
        self.enter(touched[self.rank[touched] >= 0])
        return True

    def one_by_one(self, rank: int, places: list[int]) -> None:
        """Merge leftmost first; where a pair of lower rank comes up, it is replayed first."""
        token, after, before, held, of_pair = self.token_, self.after_, self.before_, self.rank_, self.merges.of_pair
        for i, at in enumerate(places):
            if held[at] != rank:
                continue
            right = after[at]
            token[at] = rank
            token[right] = held[right] = -1
            following, previous = after[right], before[at]
            after[at] = following
            made = -1
            if following >= 0:
                before[following] = at
                made = of_pair.get((rank << 32) + token[following], -1)
                if made >= 0:
                    self.list_of(made).append(at)
            held[at] = made
            lower = 0 <= made < rank
            if previous >= 0:
                made = of_pair.get((token[previous] << 32) + rank, -1)
                held[previous] = made
                if made >= 0:
                    self.list_of(made).append(previous)
                    lower |= made < rank
            if lower:
                self.list_of(rank).extend(places[i + 1 :])
                return


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each word."""
    return Replay(words, merges).run()


class Codec:
    """Encodes and decodes by one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.merges = Merges(self.ranks)
        self.split = regex.compile(pattern).findall

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; those that are no token themselves are replayed together."""
        made = [[self.ranks[w]] if w in self.ranks else None for w in words]
        rest = [i for i, ids in enumerate(made) if ids is None]
        for i, ids in zip(rest, replay([words[i] for i in rest], self.merges), strict=True):
            made[i] = ids
        return made

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each of some texts, for use without Spark."""
        split = [self.split(t) for t in texts]
        words = list(set(chain.from_iterable(split)))
        ids_of = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True)).__getitem__
        return [list(chain.from_iterable(map(ids_of, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed planes of their bytes, as many as the largest one needs."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T[:width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    made = np.zeros(planes.shape[1], np.int64)
    for i, plane in enumerate(planes):
        made |= plane.astype(np.int64) << (8 * i)
    return made


def steps(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as the first one and the differences, which np.cumsum undoes."""
    return np.diff(rising, prepend=0)


def joined_words(words: list[bytes]) -> bytes:
    """Words as one compressed string, their lengths first."""
    lengths = np.array([len(w) for w in words], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words)], np.uint32).tobytes() + lengths.tobytes() + b"".join(words))


def parted_words(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    return [data[a:b] for a, b in pairwise([4 * (n + 1), *ends.tolist()])]


#: Kinds of rows: a document, a source's sequence of words, words of a source for a bucket or their ids.
DOCUMENT, SEQUENCE, WORDS = 0, 1, 2
_SENT = "bucket long, kind int, source long, key {kind}, uid long, n long, numbers binary, data binary"
_NAMES = ["bucket", "kind", "source", "key", "uid", "n", "numbers", "data"]


class _Source:
    """Some texts of one task: their distinct words by number, and their sequences of numbers."""

    def __init__(self, salt: str):
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.sequence: list[np.ndarray] = []
        self.rows: list[tuple[pa.Array, int, int]] = []
        self.chars = 0
        self.digest = xxhash.xxh3_64(salt)

    def add(self, key: pa.Array, uid: int, text: str, tool: Codec) -> None:
        words = tool.split(text)
        self.sequence.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.rows.append((key, uid, len(words)))
        self.digest.update(text)
        self.chars += len(text)

    def packed(self, tool: Codec, buckets: int, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        name = self.digest.intdigest() - (1 << 63)
        sequence = np.concatenate(self.sequence)
        # numbers by falling frequency take fewest bytes; words that stand once follow in their order, so
        # that the sequence need only say that there is one
        times = np.bincount(sequence, minlength=len(self.number))
        order = np.argsort(-np.where(times == 1, 0, times), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(1, len(order) + 1)
        repeated = int((times > 1).sum())
        number[number > repeated] = 0
        sequence = number[sequence]
        by_bucket: dict[int, tuple[list[int], list[bytes]]] = defaultdict(lambda: ([], []))
        known: list[tuple[int, int]] = []
        found = list(self.number)
        for place, i in enumerate(order.tolist()):
            data = found[i].encode()
            if (rank := tool.ranks.get(data)) is not None:
                known.append((place, rank))
            else:
                numbers, words = by_bucket[xxhash.xxh3_64_intdigest(data) % buckets]
                numbers.append(place)
                words.append(data)
        numbers, ranks = (np.array(x, np.int64) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64),) * 2
        keys = pa.concat_arrays([k for k, _, _ in self.rows])
        passing = 4 * buckets  # groups for rows that only pass through the buckets' exchange
        for at in range(0, len(self.rows), 10_000):
            rows = self.rows[at : at + 10_000]
            uids, n = pa.array([u for _, u, _ in rows], pa.int64()), len(rows)
            columns = [pa.array([-1 - u % passing for _, u, _ in rows], pa.int64()), pa.array([DOCUMENT] * n, pa.int32()), pa.array([name] * n, pa.int64()), keys.slice(at, n), uids, pa.array([k for _, _, k in rows], pa.int64()), *[pa.nulls(n, pa.binary())] * 2]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        # the numbers of words known here travel with the sequence
        packed = [(-1 - name % passing, SEQUENCE, squeezed(sequence), squeezed(np.concatenate([[repeated], steps(numbers), ranks])))]
        packed += [(b, WORDS, squeezed(steps(np.array(numbers))), joined_words(words)) for b, (numbers, words) in by_bucket.items()]
        for at in range(0, len(packed), 256):
            part = packed[at : at + 256]
            n = len(part)
            columns = [pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int32()), pa.array([name] * n, pa.int64()), pa.nulls(n, key_type), *[pa.nulls(n, pa.int64())] * 2, *(pa.array([p[i] for p in part], pa.binary()) for i in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def numbered(docs: DataFrame, path: str, pattern: str, key: str, text: str, buckets: int, block_chars: int) -> DataFrame:
    """Rows of the three kinds for all documents."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        task = TaskContext.get().partitionId()
        uid, key_type, source = task << 40, None, _Source(f"{task}:0")
        for batch in batches:
            key_type = batch.column(0).type
            for i, value in enumerate(batch.column(1)):
                source.add(batch.column(0).slice(i, 1), uid, value.as_py() or "", tool)
                uid += 1
                if source.chars >= block_chars or len(source.rows) >= 100_000:
                    yield from source.packed(tool, buckets, key_type)
                    source = _Source(f"{task}:{uid}")
        if source.rows:
            yield from source.packed(tool, buckets, key_type)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(kernels.trimmed(made), _SENT.format(kind=kind))


def replayed(sent: DataFrame, path: str, pattern: str, kind: str) -> DataFrame:
    """In each bucket the ids of its words, for each source that asked; other rows as they came."""

    def joined(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.drop_columns("bucket")
        tool = codec(path, pattern)
        asked = [parted_words(x.as_py()) for x in table["data"]]
        place: dict[bytes, int] = defaultdict(count().__next__)
        asked = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in asked]
        ids = replay(list(place), tool.merges)
        lengths = np.array([len(i) for i in ids], np.int64)
        starts, flat = np.cumsum(lengths) - lengths, np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
        del ids
        data = [squeezed(np.concatenate([lengths[at], flat[ragged(starts[at], lengths[at])]])) for at in asked]
        kernels.give_back()
        n = table.num_rows
        columns = [*(table[c] for c in ("kind", "source", "key", "uid", "n", "numbers")), pa.array(data, pa.binary())]
        return pa.table(columns, names=_NAMES[1:]) if n else table.drop_columns("bucket")

    return sent.groupBy("bucket").applyInArrow(joined, _SENT.format(kind=kind).removeprefix("bucket long, "))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def ids_of_source(table: pa.Table) -> tuple[pa.Table, Callable[[int, int], np.ndarray]]:
    """The documents of a source in order, and the ids of any run of its words: only the distinct words'
    ids and the words' numbers are held, never the ids of all texts."""
    kind = table["kind"]
    docs = table.filter(pc.equal(kind, DOCUMENT)).sort_by("uid")
    whole = table.filter(pc.equal(kind, SEQUENCE))
    sequence, known = (expanded(whole[c][0].as_py()) for c in ("numbers", "data"))
    repeated, known = int(known[0]), known[1:]
    once = sequence == 0
    sequence -= 1
    sequence[once] = repeated + np.arange(once.sum())
    numbers, flat = [np.cumsum(known[: len(known) // 2])], [known[len(known) // 2 :]]
    lengths = [np.ones(len(flat[0]), np.int64)]
    words = table.filter(pc.equal(kind, WORDS))
    for asked, answer in zip(words["numbers"], words["data"], strict=True):
        asked, answer = expanded(asked.as_py()), expanded(answer.as_py())
        numbers.append(np.cumsum(asked))
        lengths.append(answer[: len(asked)])
        flat.append(answer[len(asked) :])
    numbers, lengths, flat = map(np.concatenate, (numbers, lengths, flat))
    starts, flat = np.cumsum(lengths) - lengths, flat.astype(np.int32)
    place = np.full(max(numbers.max(initial=-1), sequence.max(initial=-1)) + 1, -1, np.int32)
    place[numbers] = np.arange(len(numbers))
    at = place[sequence]
    if (at < 0).any():
        raise RuntimeError("words of a source came without their ids")
    return docs, lambda a, b: flat[ragged(starts[at[a:b]], lengths[at[a:b]])]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, n_tokens, the digests of ids and decoded bytes, and the ids if they are wanted."""
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def coded(table: pa.Table) -> pa.Table:
        tool = codec(path, pattern)
        rows, ids_of = ids_of_source(table)
        digests: tuple[list[str], list[str]] = ([], [])
        sizes, kept = [], []
        for a, b in pairwise([0, *np.cumsum(rows["n"].to_numpy()).tolist()]):
            found = ids_of(a, b)
            ids = found.tolist()
            sizes.append(len(ids))
            digests[0].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            digests[1].append(hashlib.sha256(tool.decode(ids)).hexdigest())
            if with_ids:
                kept.append(found)
        columns = [rows["key"], pa.array(sizes, pa.int64()), *(pa.array(x, pa.string()) for x in digests)]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(kept))))
        kernels.give_back()
        return pa.table(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    done = replayed(numbered(docs, path, pattern, key, text, buckets, block_chars), path, pattern, kind)
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return done.groupBy("source").applyInArrow(coded, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of encoded rows; bytes that are no UTF-8 become replacement characters."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            made = [tool.decode(i.as_py() or []).decode("utf-8", "replace") for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(texts, f"`{key}` {kind}, text string")
