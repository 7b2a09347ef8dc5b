"""Near-duplicate detection by MinHash: one permutation, optimal densification, banded buckets, stars.

A document's set are the distinct shingles of three words; documents with the same set are one class, and
only classes are compared. Two sets are linked when their overlap is 85 hundredths of their union or more.

1. Signatures. One hash permutes all shingles, and its first bits deal them to ``BINS`` bins; a bin's
   value is its smallest hash. A bin that got none takes over the value of another: each empty bin goes
   through all bins in an order of its own, the same for all sets, up to the first that has one. So any
   bin of two sets agrees with a chance of their similarity, however few shingles they have.
2. Bands. The bins are read in bands of ``ROWS``. Classes that agree in a whole band meet in its bucket.
   At a similarity of 0.85 a pair meets in none of the 64 buckets with a chance of 1.5e-9, and of less
   above it; at 0.5 it meets in one with 0.22.
3. Stars. A bucket of m classes gives m - 1 candidate edges, from its smallest class to each other. Each
   task makes stars of what it holds and sends their centres on, so that a bucket which a third of all
   documents share is met by a row from each task. Stars of all buckets are merged into families.
4. Confirmation. Two classes that met in a bucket are in one family by its star, whether or not either
   is linked with the centre. Within families all links are looked for on the full sets, by the search
   of the n-gram join (block against block in large families, on differences from a pivot), so none
   is lost to a centre that is similar to neither, and none is taken from a signature.
5. Components of the links over classes give each document the smallest doc_id it can reach.

Only signatures' buckets and the sets of families with several classes are shuffled, packed as arrays.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing:
component_id is its own doc_id, and it is kept. A text of fewer than three words is one shingle. Null
doc_ids are passed over by the smallest id unless a component has no other; ids are compared null-safely
for ``kept``. Repeated rows are members of one class, and all rows with the component's id are kept. Very
long texts are read to their end. An empty table gives an empty result; other columns never take part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels
from scriptorium.llm.ngram_join import BLOCK_SHINGLES, Rule, class_of, families_of, forest, judged, near_id, sets_of, short_id
from scriptorium.llm.shared import durable, release

RULE = Rule(3, 85)
BINS, ROWS = 512, 8
BANDS = BINS // ROWS
#: Sets whose signatures are made at a time; entries that a task holds before it makes stars of them.
SETS = 512
HELD = 1_000_000
#: Text for each group of buckets.
BUCKET_BYTES = 12 << 20

_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: For each bin the order in which it goes through the others: the smallest number comes first.
_ORDER = np.random.default_rng(17).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)
_PLACES = np.random.default_rng(29).integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(31).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The bins of some sets, none of them empty, given as sorted hashes: one row of BINS values for each."""
    hashes = np.concatenate(sets)
    bins = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * BINS + (hashes >> _SHIFT).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]  # hashes rise, so a bin's first is its smallest
    made, filled = np.zeros(len(sets) * BINS, np.uint64), np.zeros(len(sets) * BINS, bool)
    made[bins[first]], filled[bins[first]] = hashes[first], True
    made, filled = made.reshape(-1, BINS), filled.reshape(-1, BINS)
    for i in np.flatnonzero(~filled.all(axis=1)).tolist():
        full, empty = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        made[i, empty] = made[i, full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return made


def buckets_of(signature: np.ndarray) -> np.ndarray:
    """The names of the buckets of each row's bands."""
    with np.errstate(over="ignore"):
        bands = (signature.reshape(-1, BANDS, ROWS) * _PLACES).sum(axis=2, dtype=np.uint64)
        return kernels.mixed(bands + _BAND)


def stars(names: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The buckets' names, their smallest classes, and the edges u, v from each of those to the others."""
    order = np.lexsort((classes, names))
    names, classes = names[order], classes[order]
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    centre = classes[np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))]
    edge = classes != centre
    return names[first], classes[first], centre[edge], classes[edge]


_FIELDS = ["bucket", "names", "classes", "u", "v", "key", "size", "class", "sha"]
_SENT = "bucket long, names binary, classes binary, u binary, v binary, key {kind}, size long, class binary, sha string"


def banded(docs: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """Rows of three kinds: documents (key, size, class, sha), packed buckets by group of buckets (names and
    the smallest class that the task has seen), and packed stars (u, v)."""
    kind = docs.schema[key].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[bytes] = set()
        count, key_type = 0, None

        def row(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            types = dict.fromkeys(_FIELDS, pa.binary()) | {"bucket": pa.int64(), "key": key_type, "size": pa.int64(), "sha": pa.string()}
            return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, types[x])) for x in _FIELDS], names=_FIELDS)

        def packed() -> Iterator[pa.RecordBatch]:
            names, classes, u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            u, v = forest(u, v)
            yield row({"u": pa.array([u.tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())}, 1)
            # names rise, and groups are ranges of them
            group = (((names >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
            to, starts = np.unique(group, return_index=True)
            parts = [[x.tobytes() for x in np.split(a, starts[1:])] for a in (names, classes)]
            yield row({"bucket": pa.array(to), "names": pa.array(parts[0], pa.binary()), "classes": pa.array(parts[1], pa.binary())}, len(to))

        for batch in batches:
            key_type = batch.column(0).type
            for block in kernels.blocks(batch.column(1)):
                raw, edges = memoryview(block.data.tobytes()), block.offsets.tolist()
                sets = sets_of(block, RULE.words)
                names = [class_of(s) if len(s) else None for s in sets]
                new = {name: s for name, s in zip(names, sets, strict=True) if name and name not in seen}
                seen |= new.keys()
                fresh = list(new.items())
                for at in range(0, len(fresh), SETS):
                    part = fresh[at : at + SETS]
                    ids = near_id(np.array([short_id(name) for name, _ in part], np.int64))
                    held.append((buckets_of(signatures([s for _, s in part])).ravel(), np.repeat(ids, BANDS)))
                    count += len(part) * BANDS
                    if count > HELD:
                        yield from packed()
                        count = 0
                yield row(
                    {
                        "key": batch.column(0).slice(block.first, block.n),
                        "size": pa.array([len(s) for s in sets], pa.int64()),
                        "class": pa.array(names, pa.binary()),
                        "sha": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)], pa.string()),
                    },
                    block.n,
                )
                if len(seen) > HELD:  # classes may be sent again
                    seen.clear()
        if held:
            yield from packed()

    return docs.select(key, text).mapInArrow(kernels.trimmed(made), _SENT.format(kind=kind))


def bucket_stars(sent: DataFrame) -> DataFrame:
    """u, v: the stars of each group of buckets, as a packed forest."""

    def joined(table: pa.Table) -> pa.Table:
        names, classes = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in (("names", np.uint64), ("classes", np.int64)))
        tree = forest(*stars(names, classes)[2:])
        kernels.give_back()
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in tree], names=["u", "v"])

    return sent.select("bucket", "names", "classes").groupBy("bucket").applyInArrow(joined, "u binary, v binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """What ngram_join() returns, by this module's rule, and kept: whether the row has its component's id."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    sent = durable(banded(docs, key, text, max(8, math.ceil(size / BUCKET_BYTES))))
    listed = sent.where("size is not null").select("key", "size", "class", "sha")
    candidates = sent.where("u is not null").select("u", "v").unionByName(bucket_stars(sent.where("names is not null")))
    families = families_of(candidates)
    release(docs.sparkSession)
    found = judged(docs, key, text, listed, families, block_shingles, RULE)
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (SELECT doc, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, greatest(2, len(w) - 1))]) END AS s FROM texts),
parts AS (SELECT doc, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.doc AS a, b.doc AS b FROM parts a JOIN parts b ON a.s = b.s AND a.doc != b.doc AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc, b.doc HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
reached AS (SELECT doc, doc AS other FROM texts UNION SELECT r.doc, l.b FROM reached r JOIN links l ON l.a = r.other),
smallest AS (SELECT r.doc, min(t.doc_id) AS component_id FROM reached r JOIN texts t ON t.doc = r.other GROUP BY r.doc),
counts AS (SELECT a AS doc, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept, coalesce(n_links, 0) AS n_links
FROM sets JOIN smallest USING (doc) LEFT JOIN counts USING (doc)
"""
