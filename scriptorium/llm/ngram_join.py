"""N-gram Jaccard join by T-occurrence search, with DivideSkip inside candidate families.

Documents with the same set of 5-word shingles form a class, and only classes are compared. Two
sets of n and m shingles are linked when 7 * overlap >= 3 * (n + m), which is a similarity of 0.75.

1. Postings. Two linked sets share at least l of the n // 4 + l shingles of each that come first in a
   common order, l = 1 + n // 32 of the smaller set: one shared shingle is no sign yet. The order is: shingles that are not frequent by hash,
   then frequent ones from rare to common. Which are frequent is estimated from a part of the
   documents and kept to a bounded list; the order decides how much work there is, never what is
   found. Each task sends its postings as packed arrays, one for each bucket of shingles.
2. Families. Pairs within a short posting list are counted, over all buckets, and those that share
   their l shingles are candidates. Long lists are not paired: in one sorted by size, neighbours whose
   sizes allow a link are chained, and any two that could be linked lie on one chain. Frequent
   shingles have no lists: their classes are tied to a node for the shingle on the map side. Connected
   components of all these edges give the families: every link lies inside one.
3. Search. The sets of the members, and of no other documents, are made again and brought together
   by family. In a family each class asks a T-occurrence search: short inverted lists are merged by
   counting, long ones are probed by binary search (or counted, where most members stand in them),
   and the classes that reach the overlap are linked and counted.
4. A family too large for one task sends each set as its difference from one member, the pivot: the
   shingles that it lacks and those that it has besides. With p shingles in the pivot, of which the
   sets lack l and k, two sets share p - l - k and as many more as their differences have in common,
   so the same search runs on the differences and is exact; near copies differ in few shingles. The
   family is cut into blocks by the size of its differences, and each block meets every block once.
5. Components of the links over classes give each document the smallest doc_id it can reach.

Only shingle hashes of 64 bits are compared; a class is named by 128 bits of its set's digest. Lists
of postings hold a class once, however many copies it has, and no task gathers the documents of a
class or the pairs of a list.

Defined results: a null or empty text has no shingles and is alone, component_id being its own
doc_id; null doc_ids are ignored by the smallest id unless a component has no other. Repeated rows
are members of one class. Very long texts are read to their end, one at a time. An empty table gives an
empty result; other columns never take part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels
from scriptorium.llm.shared import bitmap_of, durable, keep_rows, release, unpack

SHINGLE = 5
#: One document in so many is counted to tell which shingles are frequent; the list's length.
ORDER_SAMPLE = 8
FREQUENT = 1_000_000
FREQUENT_FROM = 3
#: Text for each bucket of postings, and shingles for each block of a family.
BUCKET_BYTES = 12 << 20
BLOCK_SHINGLES = 1_000_000
#: Bytes of pivots that are broadcast; more are joined by family.
PIVOT_BYTES = 32 << 20
#: Longest posting list whose pairs are counted.
PAIRED = 64
#: Edges that are connected in one task, 16 bytes each; beyond that by joins.
MERGED = 2_000_000
#: Postings that a task holds before it sends them.
HELD_POSTINGS = 400_000
#: DivideSkip's tuning constant: more lists are probed as it falls.
MU = 0.0085


def needed(n: int) -> int:
    """The overlap without which a set of n shingles is linked with none."""
    return (3 * n + 3) // 4


def evidence(n):
    """How many shingles of their prefixes two sets share, if they are linked and n is the smaller size."""
    return 1 + n // 32


class Rule(NamedTuple):
    """Shingles of so many words; sets are linked when 100 * overlap >= percent * union."""

    words: int = SHINGLE
    percent: int = 75

    def overlap(self, total):
        """The least overlap of linked sets that have so many shingles together."""
        return -(-self.percent * total // (100 + self.percent))

    def near(self, n, m):
        """Whether sizes allow a link."""
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


RULE = Rule()


def linked(overlap: int, n: int, m: int, rule: Rule = RULE) -> bool:
    return overlap >= rule.overlap(n + m)


def sets_of(block: kernels.Block, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    low = kernels.lowered(block)
    found = kernels.words(low)
    hashes, to = kernels.shingles(kernels.word_hashes(low, found), found.bounds, size)
    return [np.unique(hashes[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short_id(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def order_key(shingles: np.ndarray) -> np.ndarray:
    """The 40 bits of a shingle by which it is looked up in the order's list: a rare one that meets a
    frequent one in them is placed late as well, for all sets alike."""
    return shingles >> np.uint64(24)


def frequent_shingles(docs: DataFrame, text: str, sample: int, least: int, most: int, size: int) -> np.ndarray:
    """Keys of at most ``most`` shingles, from rare to common, that stand in several of the sampled texts.

    Whole sets are counted: were only prefixes, their frequent shingles would make way for others just
    as frequent. Sets are told apart by 8 bits of theirs, so the copies of a text count once, and counts
    over some hundreds level off. They are taken by bucket, so no task's share grows with the input.
    """
    bits = max(8, (size // BUCKET_BYTES).bit_length())
    shift = np.uint64(40 - bits)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            seen = np.unique(np.concatenate(held))
            held.clear()
            keys, sets = seen >> np.uint64(8), (seen & np.uint64(255)).astype(np.uint8)
            buckets, starts = np.unique(keys >> shift, return_index=True)
            cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))
            low = (keys & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (low, sets))], names=["bucket", "s", "b"])

        for batch in batches:
            for block in kernels.blocks(batch.column(0)):
                held += (order_key(s) << np.uint64(8) | np.bitwise_xor.reduce(s) & np.uint64(255) for s in sets_of(block) if len(s))
                if sum(map(len, held)) > 4 * HELD_POSTINGS:
                    yield out()
        if held:
            yield out()

    def counted(table: pa.Table) -> pa.Table:
        s, b = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]).astype(np.uint64) for c, t in (("s", np.uint32), ("b", np.uint8)))
        keys, times = np.unique(np.unique(s << np.uint64(8) | b) >> np.uint64(8), return_counts=True)
        keys, times = keys[times >= least].astype(np.int64), times[times >= least]
        kernels.give_back()
        return pa.table([keys | (table["bucket"][0].as_py() << int(shift)), times], names=["s", "n"])

    drawn = docs.where(F.pmod(F.xxhash64(text), F.lit(sample)) == 0).select(text)
    counts = drawn.mapInArrow(kernels.trimmed(sampled), "bucket long, s binary, b binary").groupBy("bucket").applyInArrow(counted, "s long, n long")
    top = counts.orderBy(F.col("n").desc(), "s").limit(most).toArrow()
    return top["s"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


class Order:
    """The common order of shingles."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")  # places in the list, from rare to common
        self.sorted = frequent[self.rank]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of a set, given sorted by hash: rare shingles, then frequent ones."""
        n = len(shingles) // 4 + evidence(len(shingles))
        keys = order_key(shingles)
        maybe = self.maybe[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)]
        if not maybe.any():
            return shingles[:n], shingles[:0]
        at = kernels.members(keys[maybe], self.sorted)
        common = np.zeros(len(shingles), bool)
        common[np.flatnonzero(maybe)[at >= 0]] = True
        rare = shingles[~common]
        if len(rare) >= n:
            return rare[:n], rare[:0]
        late = shingles[common][np.argsort(self.rank[at[at >= 0]], kind="stable")]
        return rare, late[: n - len(rare)]


def hubs(shingles: np.ndarray, n: int) -> np.ndarray:
    """Nodes that stand for a frequent shingle and a bracket of sizes: a class is tied to that of its
    own size and the next, so that classes near enough in size have one in common."""
    bracket = int(math.log(n) / math.log(4 / 3))
    with np.errstate(over="ignore"):
        return np.concatenate([kernels.mixed(shingles + np.uint64(b + 1)) for b in (bracket, bracket + 1)]).view(np.int64)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges: each node with its tree's smallest, but for those themselves."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = kernels.components(index[: len(u)], index[len(u) :], len(nodes))
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


#: Kinds of rows that are no postings: documents, and forests made on the map side.
DOCUMENT, FOREST = -1, -2
_POSTINGS = "bucket long, s binary, c binary, n binary, key {kind}, size long, class binary, sha string"


#: A posting on its way: 32 bits of the shingle after those that name the bucket, 48 of the class's short
#: id, the size up to 65,535. Each says a little less than it could, so that candidates may be too
#: many and never too few; they are only candidates.
SENT = (np.uint32, np.uint32, np.uint16, np.uint16)


def shortened(s: np.ndarray, c: np.ndarray, n: np.ndarray, buckets: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The bucket of each posting, and what is sent of it."""
    scaled = (s >> np.uint64(32)) * np.uint64(buckets)
    low = ((s & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
    after = (scaled + low) & np.uint64(0xFFFFFFFF)
    bucket = ((scaled + low) >> np.uint64(32)).astype(np.int64)
    return bucket, (after.astype(np.uint32), (c & 0xFFFFFFFF).astype(np.uint32), ((c >> 32) & 0xFFFF).astype(np.uint16), np.minimum(n, 65_535).astype(np.uint16))


def near_id(c):
    """The 48 bits of a short id by which candidates are named."""
    return c & 0xFFFF_FFFF_FFFF


def postings(docs: DataFrame, key: str, text: str, frequent, buckets: int) -> DataFrame:
    """Rows of three kinds, told by the bucket: packed postings of rare shingles (0 and up: shingles,
    classes' short ids, sizes), packed forests of classes and hubs, whose frequent shingles thus never
    meet in one list, and a row for each document (key, size, class, digest of the text)."""
    kind = docs.schema[key].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(np.frombuffer(frequent.value, np.uint64))
        held: list[tuple[np.ndarray, int, int]] = []
        tied: list[tuple[np.ndarray, int]] = []
        seen: set[int] = set()
        count, key_type = 0, None
        names_ = ["bucket", "s", "c", "n", "key", "size", "class", "sha"]

        def trees() -> pa.RecordBatch:
            u, v = forest(np.concatenate([h for h, _ in tied]), np.repeat(np.array([c for _, c in tied], np.int64), [len(h) for h, _ in tied]))
            tied.clear()
            columns = [pa.array([FOREST], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (u, v)), *(pa.nulls(1, t) for t in (pa.binary(), key_type, pa.int64(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=names_)

        def packed() -> pa.RecordBatch:
            s = np.concatenate([h[0] for h in held])
            sizes = [len(h[0]) for h in held]
            c = np.repeat(np.array([h[1] for h in held], np.int64), sizes)
            n = np.repeat(np.array([h[2] for h in held], np.int64), sizes)
            held.clear()
            bucket, parts = shortened(s, c, n, buckets)
            by = np.argsort(bucket, kind="stable")
            bucket, (after, low, high, n) = bucket[by], (x[by] for x in parts)
            names, starts = np.unique(bucket, return_index=True)
            cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(after)], strict=True))
            blank = len(cut)
            columns = [pa.array(names)]
            columns += [pa.array(x, pa.binary()) for x in ([after[a:b].tobytes() for a, b in cut], [low[a:b].tobytes() + high[a:b].tobytes() for a, b in cut], [n[a:b].tobytes() for a, b in cut])]
            columns += [pa.nulls(blank, t) for t in (key_type, pa.int64(), pa.binary(), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names_)

        for batch in batches:
            key_type = batch.column(0).type
            for block in kernels.blocks(batch.column(1)):
                raw, edges = memoryview(block.data.tobytes()), block.offsets.tolist()
                names, sizes, shas = [], [], []
                for i, shingles in enumerate(sets_of(block)):
                    name = class_of(shingles) if len(shingles) else None
                    names.append(name)
                    sizes.append(len(shingles))
                    shas.append(hashlib.sha256(raw[edges[i] : edges[i + 1]]).hexdigest())
                    if name and (short := short_id(name)) not in seen:
                        seen.add(short)
                        rare, frequent_ = order.prefix(shingles)
                        if len(rare):
                            held.append((rare, near_id(short), len(shingles)))
                        if len(frequent_):
                            tied.append((hubs(frequent_, len(shingles)), near_id(short)))
                        count += len(rare) + 2 * len(frequent_)
                n = block.n
                columns = [pa.array(np.full(n, DOCUMENT)), *[pa.nulls(n, pa.binary())] * 3, batch.column(0).slice(block.first, n)]
                columns += [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names_)
                if count > HELD_POSTINGS:
                    count = 0
                    if held:
                        yield packed()
                    if tied:
                        yield trees()
                    if len(seen) > HELD_POSTINGS:
                        seen.clear()
        if held:
            yield packed()
        if tied:
            yield trees()

    return docs.select(key, text).mapInArrow(kernels.trimmed(made), _POSTINGS.format(kind=kind))


def candidates(s: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """What one bucket's lists tell: u, v of edges that are certain, and u, v, shared, needed of pairs that
    have to be counted over all buckets."""
    order = np.argsort(s, kind="stable")
    s, c, n = s[order], c[order], n[order]
    twin = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    s, c, n = s[twin], c[twin], n[twin].astype(np.int64)
    order = np.lexsort((c, n, s))
    s, c, n = s[order], c[order], n[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])  # tasks may each have sent a class
    s, c, n = s[once], c[once], n[once]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(s)]]))
    long_ = np.repeat(lengths > PAIRED, lengths)
    near = (s[1:] == s[:-1]) & (4 * n[:-1] >= 3 * n[1:]) & long_[:-1] if len(s) else np.zeros(0, bool)
    edges = [(c[:-1][near], c[1:][near])]
    s, c, n = s[~long_], c[~long_], n[~long_]
    pairs = []
    for k in range(1, min(PAIRED, len(s))):
        at = np.flatnonzero((s[k:] == s[:-k]) & (4 * n[:-k] >= 3 * n[k:]))
        if not len(at) and k > lengths.max(initial=0):
            break
        pairs.append((np.minimum(c[at], c[at + k]), np.maximum(c[at], c[at + k]), evidence(n[at])))
    u, v, least = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((v, u))
    u, v, least = u[order], v[order], least[order]
    starts = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
    shared = np.diff(np.concatenate([starts, [len(u)]]))
    u, v, least = u[starts], v[starts], least[starts]
    sure = shared >= least
    edges.append((u[sure], v[sure]))
    tree = forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))
    return *tree, u[~sure], v[~sure], shared[~sure].astype(np.int32), least[~sure].astype(np.int32)


_FOREST = "pairs long, u binary, v binary, shared binary, needed binary, key {kind}, size long, class binary, sha string"


def _ids(sent: pa.Buffer) -> np.ndarray:
    """Short ids of 48 bits, sent as their low 32 bits and then their high 16."""
    n = sent.size // 6
    return np.frombuffer(sent, np.uint32, n).astype(np.int64) | (np.frombuffer(sent, np.uint16, n, 4 * n).astype(np.int64) << 32)


def forests(sent: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Rows of documents and map-side forests as they came; for each bucket a packed forest of certain
    edges, and packed pairs to be counted (their bucket is in the column pairs)."""
    names = [x.split()[0] for x in _FOREST.split(", ")]

    def joined(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            n = table.num_rows
            return pa.table([pa.nulls(n, pa.int64()), table["s"], table["c"], *[pa.nulls(n, pa.binary())] * 2, *(table[x] for x in names[5:])], names=names)
        s, n = (np.concatenate([np.frombuffer(b.as_buffer(), t) for b in table[x]]) for x, t in (("s", np.uint32), ("n", np.uint16)))
        u, v, *pairs = candidates(s, np.concatenate([_ids(b.as_buffer()) for b in table["c"]]), n)
        rows = [(None, u.tobytes(), v.tobytes(), None, None)]
        to = kernels.mixed(pairs[0].view(np.uint64) ^ kernels.mixed(pairs[1].view(np.uint64))) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        held, starts = np.unique(to[order], return_index=True)
        for bucket, at in zip(held.tolist(), np.split(order, starts[1:]), strict=False):
            rows.append((bucket, *(x[at].tobytes() for x in pairs)))
        columns = [pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(5)]
        kernels.give_back()
        return pa.table([*columns, *(pa.nulls(len(rows), table[x].type) for x in names[5:])], names=names)

    return sent.groupBy("bucket").applyInArrow(joined, _FOREST.format(kind=kind))


def counted_pairs(packed: DataFrame) -> DataFrame:
    """u, v: a packed forest for each bucket of pairs, of those that share what they need in all."""

    def joined(table: pa.Table) -> pa.Table:
        u, v, shared, least = (np.frombuffer(b"".join(table[x].to_pylist()), t) for x, t in (("u", np.int64), ("v", np.int64), ("shared", np.int32), ("needed", np.int32)))
        order = np.lexsort((v, u))
        u, v, shared, least = u[order], v[order], shared[order], least[order]
        starts = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        enough = np.add.reduceat(shared, starts) >= least[starts]
        tree = forest(u[starts][enough], v[starts][enough])
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in tree], names=["u", "v"])

    return packed.select("pairs", "u", "v", "shared", "needed").groupBy("pairs").applyInArrow(joined, "u binary, v binary")


def _pairs(packed: DataFrame) -> DataFrame:
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, v in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (u, v)], names=["u", "v"])

    return packed.select("u", "v").mapInArrow(unpacked, "u long, v long")


def families_of(packed: DataFrame) -> DataFrame:
    """u, v of the components of packed forests (u, v): counted first, then merged in one task if there are
    at most MERGED edges, and by joins if there are more."""
    packed = durable(packed)
    if (packed.agg(F.sum(F.octet_length("u"))).first()[0] or 0) > 8 * MERGED:
        return connect(_pairs(packed))

    def merged(table: pa.Table) -> pa.Table:
        u, v = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table[c]]) for c in ("u", "v"))
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in forest(u, v)], names=["u", "v"])

    return durable(_pairs(packed.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(merged, "u binary, v binary")))


def connect(edges: DataFrame) -> DataFrame:
    """u, v for each node u that is not its component's smallest, v: the smallest.

    At most MERGED distinct edges are connected in one task. While there are more, large-star and small-star
    steps follow each other, each a grouping and a join on the node. A star that no other edge touches is
    a whole component and is set aside, so only open ones go on, which soon are few: every step costs the
    driver some plans, stages and broadcasts, whatever its edges. Each step's edges are checkpointed and only
    as many as the nodes and edges of the last.
    """
    greater = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges, done = durable(greater(edges)), []
    # a task holds names as objects of their own
    most = MERGED if dict(edges.dtypes)["u"] == "bigint" else MERGED // 4
    while edges.count() > most:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        # large star: every larger neighbour is tied to the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u != v").distinct())
        # small star: a node and its smaller neighbours are tied to the smallest of them
        lowest = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = durable(greater(small.unionByName(lowest.select("u", F.col("m").alias("v")))))
        # open are stars that share a node, and those whose centre is tied to a smaller one
        chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        shared = edges.join(edges.groupBy("u").count().where("count > 1"), "u", "left_semi")
        open_ = durable(chained.select(F.col("u").alias("v")).unionByName(chained.select("v")).unionByName(shared.select("v")).distinct())
        done.append(durable(edges.join(open_, "v", "left_anti").select("u", "v")))
        edges = durable(edges.join(open_, "v", "left_semi").select("u", "v"))
        release(edges.sparkSession)
    found = _connected(edges)
    for settled in done:
        found = found.unionByName(settled)
    return found


def _connected(edges: DataFrame) -> DataFrame:
    """What connect() returns, by one task, which gets a forest from each part of the edges."""
    kind = dict(edges.dtypes)["u"]

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            tree = forest(*(table[c].to_numpy() for c in ("u", "v")))
            yield pa.RecordBatch.from_arrays([pa.array([pa.array(x, table[c].type)], pa.list_(table[c].type)) for c, x in zip(("u", "v"), tree, strict=True)], names=["u", "v"])

    def merged(table: pa.Table) -> pa.Table:
        tree = forest(*(pc.list_flatten(table[c]).to_numpy() for c in ("u", "v")))
        kernels.give_back()
        return pa.table([pa.array(x, table[c].type.value_type) for c, x in zip(("u", "v"), tree, strict=True)], names=["u", "v"])

    trees = edges.select("u", "v").mapInArrow(kernels.trimmed(planted), f"u array<{kind}>, v array<{kind}>")
    return durable(trees.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(merged, f"u {kind}, v {kind}"))


class Family:
    """Sets of classes, the inverted lists of the shingles they share, the components found so far.

    With a pivot of p shingles, the sets are differences from it and ``lacks`` tells how many of the
    pivot's shingles each class has not; ``sizes`` are those of the classes in any case.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None, lacks: np.ndarray | None = None, p: int = 0, rule: Rule = RULE):
        held = np.array([len(s) for s in sets])
        self.sizes = held if sizes is None else sizes
        self.lacks = np.zeros(len(sets), np.int64) if lacks is None else lacks
        self.p, self.rule = p, rule
        shingle = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), held)
        order = np.argsort(shingle, kind="stable")  # owners rise within each list
        shingle, self.owner = shingle[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate([starts, [len(shingle)]]))
        index = np.empty(len(shingle), np.int32)
        index[order] = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        shared = lengths > 1
        self.starts, self.lengths = starts, lengths
        # of each class the lists with another member in them
        self.lists = [x[shared[x]] for x in np.split(index, np.cumsum(held)[:-1])]
        self.label = np.arange(len(sets))

    def join(self, query: int, classes: np.ndarray) -> None:
        """Put a class and those linked with it into one component, labelled by its first member."""
        labels = np.append(self.label[classes], self.label[query])
        if (labels != labels[0]).any():
            self.label[np.isin(self.label, labels)] = labels.min()

    def members_of(self, lst: int) -> np.ndarray:
        return self.owner[self.starts[lst] : self.starts[lst] + self.lengths[lst]]

    def counted(self, lists: np.ndarray) -> np.ndarray:
        """In how many of some lists each class stands."""
        if not len(lists):
            return np.zeros(len(self.sizes), np.int64)
        return np.bincount(np.concatenate([self.members_of(x) for x in lists.tolist()]), minlength=len(self.sizes))

    def search(self, query: int, among: np.ndarray | None = None) -> np.ndarray:
        """The classes linked with the query (of those among, if given), found by DivideSkip."""
        n = int(self.sizes[query])
        near = self.rule.near(n, self.sizes) & (among if among is not None else True)
        near[query] = False
        classes = np.flatnonzero(near)
        lists = self.lists[query]
        bound = self.rule.overlap(n + self.sizes[classes]) - self.p + self.lacks[query] + self.lacks[classes]
        least = int(bound.min(initial=len(lists) + 1))
        if len(lists) < least:
            return classes[:0]
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        n_long = 0
        if least > 1:
            n_long = min(least - 1, int(least / (MU * math.log2(int(self.lengths[lists[-1]])) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        counts = self.counted(short)[classes]
        enough = counts >= bound - n_long
        classes, counts, bound = classes[enough], counts[enough], bound[enough]
        if len(long_) * len(classes) > int(self.lengths[long_].sum()):  # most members stand in most lists
            counts = counts + self.counted(long_)[classes]
            long_ = long_[:0]
        for probed, x in enumerate(long_[::-1].tolist()):
            open_ = counts + (n_long - probed) >= bound
            classes, counts, bound = classes[open_], counts[open_], bound[open_]
            if not len(classes):
                break
            counts = counts + (kernels.members(classes, self.members_of(x)) >= 0)
        return classes[counts >= bound]


def count_groups(grouped: DataFrame, rule: Rule = RULE) -> DataFrame:
    """All links within each value of ``task``, as spanning trees (u, v) and as counts (u, n).

    n is the number of documents that the class is linked with in the task, its copies left out. Where
    a block meets another (``met``), links between the two are looked for, else those inside.
    """

    def counted(table: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes | None, int | None]] = []
        families: dict[int, dict[bytes, tuple[np.ndarray, ...]]] = {}
        numbers = ("size", "lacks", "p", "members", "block", "met")
        for family, name, s, *rest in zip(*(table[x] for x in ("family", "class", "s", *numbers)), strict=True):
            families.setdefault(family.as_py(), {})[name.as_py()] = (np.frombuffer(s.as_buffer(), np.uint64), *(x.as_py() for x in rest))
        for held in families.values():
            if len(held) < 2:
                continue
            names = sorted(held)
            sizes, lacks, p, copies, block, others = (np.array([held[x][k] for x in names], np.int64) for k in range(1, 7))
            family = Family([held[x][0] for x in names], sizes, lacks, int(p[0]), rule)
            n = np.zeros(len(names), np.int64)
            one, first = bool(block[0] == others[0]), block == block.min()
            for i in range(len(names)) if one else np.flatnonzero(first).tolist():
                met = family.search(i, None if one else ~first)
                n[i] += copies[met].sum()
                if not one:
                    n[met] += copies[i]
                family.join(i, met)
            out += [(x, names[r], None) for i, (x, r) in enumerate(zip(names, family.label.tolist(), strict=True)) if r != i]
            out += [(x, None, int(k)) for x, k in zip(names, n, strict=True) if k]
        kernels.give_back()
        kinds = (pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["u", "v", "n"])

    return grouped.groupBy("task").applyInArrow(counted, "u binary, v binary, n long")


def member_sets(docs: DataFrame, text: str, bitmap: bytes, size: int = SHINGLE) -> DataFrame:
    """c, class, s for the classes whose short id the bitmap lets through; once from each task at most."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = unpack(bitmap), set()
        mask = len(wanted) - 1
        for batch in batches:
            for block in kernels.blocks(batch.column(0)):
                rows = []
                for shingles in sets_of(block, size):
                    if len(shingles) and (name := class_of(shingles)) not in seen and wanted[short_id(name) & mask]:
                        rows.append((short_id(name), name, shingles.tobytes()))
                        seen.add(name)
                if len(seen) > HELD_POSTINGS:
                    seen.clear()
                kinds = (("c", pa.int64()), ("class", pa.binary()), ("s", pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[x for x, _ in kinds])

    return docs.select(text).mapInArrow(kernels.trimmed(made), "c long, class binary, s binary")


def differences(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """The sets of members of large families as differences from their family's pivot."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lacks, sizes = [], [], []
            for s, ps in zip(batch.column(2), batch.column(4), strict=True):
                a, b = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(ps.as_py(), np.uint64)
                missing = np.setdiff1d(b, a, assume_unique=True)
                out.append(np.concatenate([missing, np.setdiff1d(a, b, assume_unique=True)]).tobytes())
                lacks.append(len(missing))
                sizes.append(len(b))
            columns = [*batch.columns[:2], pa.array(out, pa.binary()), batch.column(3), pa.array(lacks, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["family", "class", "s", "members", "lacks", "p"])

    near = members.join(pivots, "family").select("family", "class", "s", "members", "ps")
    return near.mapInArrow(kernels.trimmed(made), "family long, class binary, s binary, members long, lacks long, p long")


def pivots_of(large: DataFrame) -> DataFrame:
    """family, class: of each family one member whose size is in the middle. Another one would change
    how much is sent, not what is found."""
    middle = large.groupBy("family").agg(F.percentile_approx("size", 0.5).alias("middle"))
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("middle")).alias("far"), "class"))
    return large.join(middle, "family").groupBy("family").agg(nearest.alias("p")).select("family", F.col("p.class").alias("class"))


def links(docs: DataFrame, text: str, classes: DataFrame, families: DataFrame, block_shingles: int, rule: Rule = RULE) -> tuple[DataFrame, DataFrame]:
    """u, v over classes: for each class that is not its component's label, the label; and u, n, the
    number of documents of other classes that each class is linked with."""
    placed = durable(classes.join(families, F.col("c").bitwiseAND(F.lit(0xFFFF_FFFF_FFFF)) == families["u"], "left").withColumn("family", F.coalesce("v", F.col("c").bitwiseAND(F.lit(0xFFFF_FFFF_FFFF)))))
    sizes = durable(placed.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1"))
    total = sizes.agg(F.sum("shingles")).first()[0]
    inside = durable(placed.join(sizes, "family").select("c", "class", "family", "size", "members", "shingles"))
    if not total:
        none = inside.select(F.col("class").alias("u"), F.col("class").alias("v"))
        return none, inside.select(F.col("class").alias("u"), F.col("size").alias("n"))

    def sets(some: DataFrame) -> DataFrame:
        # copies are sent by each task that has one, so they are dropped before families come together
        made = member_sets(docs, text, bitmap_of(some, "c"), rule.words).dropDuplicates(["class"]).drop("c")
        return made.join(some.drop("c"), "class")

    whole = F.col("shingles") <= block_shingles
    zero = F.lit(0).cast("long")
    groups = 8 * math.ceil(total / block_shingles)
    columns = ["family", "class", "s", "size", "lacks", "p", "members", "block", "met"]
    small = sets(inside.where(whole)).select("family", "class", "s", "size", zero.alias("lacks"), zero.alias("p"), "members", zero.alias("block"), zero.alias("met"))
    found = durable(count_groups(small.withColumn("task", F.pmod(F.xxhash64("family"), F.lit(groups))), rule))
    release(docs.sparkSession)
    large = inside.where(~whole)
    if large.isEmpty():
        return found.where("v is not null").select("u", "v"), found.where("n is not null").select("u", "n")
    chosen = durable(pivots_of(large))
    pivots = durable(sets(large.join(chosen.drop("family"), "class", "left_semi").select("c", "class", "family")).select("family", F.col("s").alias("ps")))
    bound = (pivots.agg(F.sum(F.octet_length("ps") + 16)).first()[0] or 0) <= PIVOT_BYTES
    cut = durable(differences(sets(large), F.broadcast(pivots) if bound else pivots).join(large.select("class", "size"), "class"))
    release(docs.sparkSession)
    blocks = durable(cut.groupBy("family").agg(F.ceil((F.sum(F.octet_length("s")) / 8 + F.count(F.lit(1))) / block_shingles).cast("long").alias("blocks")))
    # each block meets every block of its family once, itself included
    held = cut.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    both = held.withColumn("met", F.explode(F.sequence(zero, F.col("blocks") - 1))).select(*columns)
    pair = F.xxhash64("family", F.least("block", "met"), F.greatest("block", "met"))
    found = found.unionByName(durable(count_groups(both.withColumn("task", pair), rule)))
    release(docs.sparkSession)
    return connect(found.where("v is not null").select("u", "v")), found.where("n is not null").groupBy("u").agg(F.sum("n").alias("n"))


def ngram_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
    order_sample: int = ORDER_SAMPLE,
) -> DataFrame:
    """key, n_shingles, component_id, class_id and component_class (hex, null for an empty set),
    class_size, text_sha256 and n_links for each row: the number of other rows it is linked with, copies
    included."""
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    frequent = context.broadcast(frequent_shingles(docs, text, order_sample, FREQUENT_FROM, FREQUENT, size).tobytes())
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    sent = postings(docs, key, text, frequent, buckets)
    # what only passes through is dealt out evenly, so that none of its groups grows with the input
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4 * buckets))
    sent = sent.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - dealt).otherwise(F.col("bucket")))
    rows = durable(forests(sent, kind, max(8, buckets // 16)))
    del sent
    release(docs.sparkSession)
    listed = rows.where("size is not null").select("key", "size", "class", "sha")
    counted = counted_pairs(rows.where("pairs is not null"))
    families = families_of(rows.where("pairs is null and u is not null").select("u", "v").unionByName(counted))
    return judged(docs, key, text, listed, families, block_shingles)


def judged(docs: DataFrame, key: str, text: str, listed: DataFrame, families: DataFrame, block_shingles: int = BLOCK_SHINGLES, rule: Rule = RULE) -> DataFrame:
    """What ngram_join() returns, from a row (key, size, class, sha) for each document and families that
    hold every link: all links inside them are found on whole sets."""
    classes = durable(_classes(listed))
    found, linked_rows = links(docs, text, classes, families, block_shingles, rule)
    release(docs.sparkSession)
    labels = found.select(F.col("u").alias("class"), F.col("v").alias("label"))
    named = durable(classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")))
    smallest = durable(named.groupBy("label").agg(F.min("least").alias("component_id")))
    named = named.join(linked_rows.select(F.col("u").alias("class"), "n"), "class", "left").withColumn("n_links", F.col("members") - 1 + F.coalesce("n", F.lit(0)))
    table = durable(named.join(smallest, "label").select("class", "label", "component_id", "members", "n_links"))
    joined = listed.join(table, "class", "left")
    return joined.select(
        F.col("key").alias(key),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        F.lower(F.hex("class")).alias("class_id"),
        F.lower(F.hex("label")).alias("component_class"),
        F.coalesce("members", F.lit(1)).alias("class_size"),
        F.col("sha").alias("text_sha256"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _classes(listed: DataFrame) -> DataFrame:
    """class, c (short id), size, least (smallest key), members."""
    grouped = listed.where("size > 0").groupBy("class").agg(F.first("size").alias("size"), F.min("key").alias("least"), F.count(F.lit(1)).alias("members"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([short_id(x.as_py()) for x in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, short], names=[*batch.schema.names, "c"])

    kind = dict(grouped.dtypes)["least"]
    return grouped.mapInArrow(named, f"class binary, size long, least {kind}, members long, c long")


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; all columns are kept."""
    judged = ngram_join(docs, key, text)
    stays = F.col(key).eqNullSafe(F.col("component_id"))
    # rows without shingles are linked with nothing: all of them stay
    alone = judged.where("n_shingles = 0").groupBy(F.col(key).alias("__key"), F.col("text_sha256").alias("__sha")).agg(F.lit(1).alias("__twins"))
    best = judged.where(stays & (F.col("n_shingles") > 0)).groupBy("component_class", F.col(key).alias("__key"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__twins"))
    # texts that differ but share the smallest id of a component: the first by digest stays
    one = best.groupBy("component_class", "__key").agg(F.min(F.struct("__sha", "__twins")).alias("b")).select("__key", "b.__sha", "b.__twins")
    return keep_rows(docs, durable(one.unionByName(alone.select("__key", "__sha", F.col("__twins").cast("long").alias("__twins")))), key, text)
