"""Source divergence audit by joint count histograms.

A term is a run of letters, and of characters beyond ASCII, with A-Z lower-cased. A language keeps the
terms that stand in ``LEAST_DOCS`` of its documents or more. A group (language, source), and a language
as a whole, gives a kept term the share p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), where
N is the sum of the counts of the V kept terms. Two groups are as far apart as the sum of abs(p - q).

1. Counts. Tasks count terms by group over whole texts, merge their counts while they read, and send
   each term once for each group as long as it is held. The rows are dealt by language and term, so
   that one exchange serves the counts by group, the count by language, and the document frequency;
   what passes it is a count from each task, so a hot source or term is met by as many rows as tasks.
2. Joint histograms. For two sources the value depends on a term's two counts alone. So tasks tally,
   for each pair of sources, how many terms have the counts (c, d); terms are read in batches, and only
   distinct combinations leave a task. Cells with a zero are implied and never tallied: the (c, 0) are
   the source's own histogram less the tallied (c, d), and the (0, 0) are what is left of the V terms.
3. Values. f is evaluated once for each combination and taken times its multiplicity.

All arithmetic is in whole numbers; a share is divided in two steps, which holds up to 9e13 occurrences
in a group. The ranks of a group are found by a window that keeps its first rows on the map side. The
result has a row for each ordered pair of sources in a language, as the audit is of all pairs.

Defined results: null text, language and source count as empty; an empty language or source is one
like the others. A group without terms has all counts 0, hence equal shares. A language with no kept
term has the value 0 for each pair, and no terms. Ties rank by the item's UTF-8 bytes. Repeated rows are
separate documents; very long texts are read to their end; an empty table gives an empty result; other
columns never take part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import kernels
from scriptorium.llm.shared import durable

LEAST_DOCS = 30
SCALE, PRIOR, MOST_TERMS = 1_000_000_000, 5, 50
#: Counts that a task holds before it merges them, and before it sends them.
MERGED, HELD = 400_000, 800_000

#: Letters in lower case and bytes beyond ASCII as they are; all others become spaces.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)

_COUNTS = "lang string, source string, term string, n long, df long"
_TALLY = "lang string, a string, b string, ca long, cb long, m long"


def terms(block: kernels.Block) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a block, each as its place among the distinct ones, and where each text's begin."""
    folded = block._replace(data=_FOLD[block.data])
    found = kernels.words(folded)
    letters = folded.data[folded.data != 32]
    ends = np.concatenate([[0], np.cumsum(found.ends - found.starts)]).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(found.starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()))
    return strings.dictionary_encode(), found.bounds


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts rows by some keys, the first counting most, and where equal rows begin in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


class _TermCounts:
    """What a task has counted: (group and term, n, df), terms by their numbers in a vocabulary."""

    def __init__(self, between: int):
        self.between = between  # rows that come between two merges at least
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.merged = 0

    def add(self, block: kernels.Block, group: np.ndarray) -> None:
        found, bounds = terms(block)
        index = np.fromiter(map(self.numbers.__getitem__, found.dictionary.to_pylist()), np.int64, len(found.dictionary))[found.indices.to_numpy()]
        of = np.repeat(np.arange(block.n), np.diff(bounds))
        seen, times = np.unique(of << 32 | index, return_counts=True)
        self.parts.append((group[seen >> 32] << 32 | seen & 0xFFFF_FFFF, times, np.ones(len(seen), np.int64)))
        self.rows += len(seen)

    def merge(self) -> None:
        keys, n, df = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order, starts = runs(keys)
        self.parts = [(keys[order][starts], *(np.add.reduceat(x[order], starts) if len(starts) else x for x in (n, df)))]
        self.rows = self.merged = len(starts)

    def sent(self, most: int) -> Iterator[pa.RecordBatch]:
        """Merge what is held, if enough has come since, and send it if that leaves more than ``most`` rows."""
        if most and self.rows < self.between + 2 * self.merged or not self.parts:
            return
        self.merge()
        if self.rows <= most:
            return
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        named, (keys, n, df) = pa.array(list(self.numbers), pa.string()), self.parts[0]
        for i in range(0, len(keys), 50_000):
            of, term, *counts = (pa.array(x[i : i + 50_000]) for x in (keys >> 32, keys & 0xFFFF_FFFF, n, df))
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), named.take(term), *counts], names=["lang", "source", "term", "n", "df"])
        self.clear()

    def marks(self) -> pa.RecordBatch:
        """A row without a term for each group."""
        n = len(self.groups)
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        zero = pa.array(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * n, pa.string()), zero, zero], names=["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, df: counts by task, and a row with an empty term for each group."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _TermCounts(MERGED)
        for batch in batches:
            names = zip(*(pc.fill_null(batch.column(i), "").to_pylist() for i in (1, 2)), strict=True)
            group = np.array([held.groups.setdefault(g, len(held.groups)) for g in names], np.int64)
            for block in kernels.blocks(batch.column(0)):
                held.add(block, group[block.first : block.first + block.n])
                yield from held.sent(HELD)
        yield from held.sent(0)
        yield held.marks()

    rows = docs.select(F.col(text).cast("string"), F.col(lang).cast("string"), F.col(source).cast("string"))
    return rows.mapInArrow(kernels.trimmed(made), _COUNTS)


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """lang, term, total and held (source, n in order of sources) of the kept terms, and under the empty
    term all groups. Both groupings have the parts of the one exchange."""
    dealt = counts.repartition(F.col("lang"), F.col("term"))
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = by_source.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("held")
    )
    return whole.where((F.col("df") >= least) | (F.col("term") == "")).drop("df")


class _Tally:
    """Combinations of counts by pair of sources, merged as terms come in."""

    def __init__(self, between: int):
        self.between = between
        self.names: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.merged = 0

    def add(self, batch: pa.RecordBatch) -> None:
        held = batch.column(1)
        sizes = np.diff(held.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        source, n = held.flatten().flatten()
        langs, sources = batch.column(0).dictionary_encode(), source.dictionary_encode()
        # (language, source) as one number, the same for all batches of the task
        pair = langs.indices.to_numpy().astype(np.int64)[row] * len(sources.dictionary) + sources.indices.to_numpy()
        seen, index = np.unique(pair, return_inverse=True)
        lang, known = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        code = np.array([self.names.setdefault((lang[p // len(known)], known[p % len(known)]), len(self.names)) for p in seen.tolist()], np.int64)[index]
        n = n.to_numpy()
        for k in range(1, int(sizes.max(initial=0))):
            at = np.flatnonzero(row[k:] == row[:-k])
            self.parts.append((code[at], code[at + k], n[at], n[at + k], np.ones(len(at), np.int64)))
            self.rows += len(at)
            if self.rows > self.between + 2 * self.merged:
                self.merge()

    def merge(self) -> None:
        *keys, m = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order, starts = runs(*keys)
        self.parts = [(*(k[order][starts] for k in keys), np.add.reduceat(m[order], starts) if len(starts) else m)]
        self.rows = self.merged = len(starts)

    def sent(self, most: int) -> Iterator[pa.RecordBatch]:
        """All that is held, if it is more than ``most`` rows after merging."""
        if self.rows > most:
            self.merge()
        if self.rows > most:
            langs, sources = (pa.array([x[i] for x in self.names], pa.string()) for i in (0, 1))
            whole, self.parts, self.rows, self.merged = self.parts[0], [], 0, 0
            for i in range(0, len(whole[0]), 50_000):
                a, b, ca, cb, m = (pa.array(x[i : i + 50_000]) for x in whole)
                yield pa.RecordBatch.from_arrays([langs.take(a), sources.take(a), sources.take(b), ca, cb, m], names=["lang", "a", "b", "ca", "cb", "m"])


def joint_histograms(kept: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m: how many terms have the counts ca and cb, neither of them 0, in two sources
    a < b."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(MERGED)
        for batch in batches:
            tally.add(batch)
            yield from tally.sent(HELD)
        yield from tally.sent(0)

    found = kept.select("lang", "held").mapInArrow(kernels.trimmed(made), _TALLY)
    return found.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def share(n: Column, all_: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (all + PRIOR * kinds)) in long arithmetic: the scale is taken in two
    factors, so that nothing on the way is greater than 100,000 times the counts."""
    first, second = 100_000, SCALE // 100_000
    of = F.greatest(all_ + PRIOR * kinds, F.lit(1))
    scaled = (n + PRIOR) * first
    return 1 + _div(scaled, of) * second + _div((scaled % of) * second, of)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def cells(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m, the pairs' n_a and n_b, and v: the whole joint histogram of each pair of
    sources a < b of a language, zero cells included.

    A tallied (c, d) stands in neither (c, 0) nor (0, d), which take all others that have c or d; the
    terms with neither are counted in the same way.
    """
    zero = F.lit(0).cast("long")
    own = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source"), F.col("h.n").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    one, other = (sizes.select("lang", F.col("source").alias(x), F.col("n").alias(f"n_{x}"), *(["v"] if x == "a" else [])) for x in "ab")
    pairs = one.join(other, "lang").where("a < b")
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    tallied = joint_histograms(kept)
    ca, cb, c, m = F.col("ca"), F.col("cb"), F.col("c"), F.col("m")
    both = tallied.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))))
    names = pairs.select("lang", "a", "b")
    first = names.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.inline(F.array(cell(c, zero, m), cell(zero, zero, -m))))
    second = names.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(zero, c, m), cell(zero, zero, -m))))
    rest = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("v").alias("m"))
    summed = both.unionByName(first).unionByName(second).unionByName(rest).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    return summed.join(pairs, ["lang", "a", "b"])


def ranked(values: DataFrame, part: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: how far each other source of the language is;
    part ``term``: the terms that the source uses more than its language, up to ``most_terms``."""
    found = durable(kept_terms(term_counts(docs, text, lang, source), least_docs))
    kept = found.where("term != ''")
    each = kept.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "term", "total", F.col("h.source").alias("source"), F.col("h.n").alias("n"))
    groups = found.where("term = ''").select("lang", F.explode("held.source").alias("source"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "n_lang")]
    sizes = durable(groups.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", *filled))

    p, q = (share(F.col(f"c{x}"), F.col(f"n_{x}"), F.col("v")) for x in "ab")
    apart = F.when(F.col("v") > 0, F.abs(p - q) * F.col("m")).otherwise(F.lit(0).cast("long"))
    values = durable(cells(kept, sizes).groupBy("lang", "a", "b").agg(F.sum(apart).alias("value")))
    pairs = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(values.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    more = share(F.col("n"), F.col("n_own"), F.col("v")) - share(F.col("total"), F.col("n_lang"), F.col("v"))
    used = each.join(sizes.withColumnRenamed("n", "n_own"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")
    return ranked(pairs, "pair").unionByName(ranked(used, "term").where(F.col("rank") <= most_terms))


ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM texts)
),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
counted AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM texts),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
sizes AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang, coalesce(n_own, 0) AS n_own
  FROM groups LEFT JOIN (SELECT lang, source, sum(n) AS n_own FROM counted GROUP BY ALL) USING (lang, source) LEFT JOIN langs USING (lang)
),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + {PRIOR})) // (n_own + {PRIOR} * v) AS p,
         1 + ({SCALE}::HUGEINT * (total + {PRIOR})) // (n_lang + {PRIOR} * v) AS q
  FROM sizes JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(d.value), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  GROUP BY ALL
),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= {MOST_TERMS}
"""
