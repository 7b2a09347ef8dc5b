"""Forms that sound like queries, in blocks: all of them, or the best of each query.

Queries and forms meet by the codes of their words. The forms of one code are cut into blocks by a hash
of the form and its queries likewise, as many as their numbers ask for, so no task gets a code that a
large share of all words has. In a block each query is compared with all forms at once, by arrays: the
lengths and letters of two strings bound how similar they can be, and only forms that could still be
among the best have their common subsequence computed, one addition of machine words for each letter.

Where only the ``most`` best are wanted a block returns so many entries for each query, and no others.
That loses none: entries that come before one in its block come before it in the whole result, for
their best confidence over all blocks is no less. For the same reason a form stands for the ``most``
first of its entries only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.phonetic import double_metaphone
from scriptorium.operators.order import spread

#: Weight and least confidence of the code combinations, in the order they are tried.
COMBINATIONS = (("p", "p", 0.8, 0.35), ("p", "a", 0.7, 0.35), ("a", "p", 0.7, 0.35), ("a", "a", 0.6, 0.3))
WEIGHTS, LEAST = (np.array([c[k] for c in COMBINATIONS]) for k in (2, 3))
#: Forms and queries of a block.
FORMS, QUERIES = 20_000, 2_000
#: Letters of a query that fit a machine word, with one bit for the carry.
WORD_BITS = 63
#: Candidates whose subsequence is computed at a time.
CHUNK = 512
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")

_coded = lru_cache(1 << 16)(double_metaphone)


def codes_of(text: str) -> list[tuple[int, str, str]]:
    """(place, primary, alternate) of the words with two letters or more."""
    out = []
    for i, word in enumerate(SPACE.split(text)):
        letters = re.sub("[^a-zA-Z]", "", word)
        if len(letters) >= 2:
            out.append((i, *_coded(letters)))
    return out


def coded(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``words``, array of (place, p, a), and ``codes``, the distinct codes among them."""
    kind = pa.list_(pa.struct([("place", pa.int32()), ("p", pa.string()), ("a", pa.string())]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes_of(t) if t else [] for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            words = pa.array([[{"place": i, "p": p, "a": a} for i, p, a in ws] for ws in found], kind)
            codes = pa.array([sorted({c for _, *cs in ws for c in cs if c}) for ws in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, words, codes], names=[*batch.schema.names, "words", "codes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(made, f"{schema}, words array<struct<place:int,p:string,a:string>>, codes array<string>")


def letters_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, one row each, filled up with -1; and their lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.int32)
    made = np.full((len(strings), max(1, int(lengths.max(initial=0)))), -1, np.int32)
    made[np.arange(made.shape[1]) < lengths[:, None]] = flat
    return made, lengths


def subsequences(query: str, letters: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a query and each row of code points, by bits."""
    known, place = np.unique(np.frombuffer(query.encode("utf-32-le"), np.int32), return_inverse=True)
    at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
    hit = known[at] == letters
    if len(query) > WORD_BITS:
        masks = [sum(1 << i for i in np.flatnonzero(place == k).tolist()) for k in range(len(known))]
        out = []
        for row, there in zip(at.tolist(), hit.tolist(), strict=True):
            full = state = (1 << len(query)) - 1
            for k, h in zip(row, there, strict=True):
                met = state & masks[k] if h else 0
                state = (state + met) | (state - met)
            out.append(len(query) - (state & full).bit_count())
        return np.array(out, np.int64)
    bits = np.zeros(len(known), np.uint64)
    np.bitwise_or.at(bits, place, np.uint64(1) << np.arange(len(query), dtype=np.uint64))
    masks = np.where(hit, bits[at], np.uint64(0))
    full = np.uint64((1 << len(query)) - 1)
    state = np.full(len(letters), full)
    for j in range(letters.shape[1]):
        met = state & masks[:, j]
        state = (state + met) | (state - met)
    return len(query) - np.bitwise_count(state & full).astype(np.int64)


class FormBlock:
    """The forms of a block that have a code, as arrays."""

    def __init__(self, table: pa.Table):
        self.forms = table["form"].to_pylist()
        self.entries = table["entries"].to_pylist() if "entries" in table.column_names else None
        self.letters, self.lengths = letters_of(self.forms)
        words = table["words"].to_pylist()
        self.number: dict[str, int] = {}
        # the codes of each form, as numbers from 1; 0 where it has no more words
        width = max((len(w) for w in words), default=0)
        self.codes = {k: np.zeros((len(words), max(1, width)), np.int32) for k in "pa"}
        for i, ws in enumerate(words):
            for j, w in enumerate(ws):
                for k in "pa":
                    if w[k]:
                        self.codes[k][i, j] = self.number.setdefault(w[k], len(self.number) + 1)
        # how often each form has each of the block's commoner letters
        seen, times = np.unique(self.letters[self.letters >= 0], return_counts=True)
        self.alphabet = np.sort(seen[np.argsort(-times, kind="stable")[:64]])
        self.counts = np.stack([(self.letters == c).sum(axis=1) for c in self.alphabet], axis=1) if len(seen) else np.zeros((len(words), 0), np.int64)

    def first_meeting(self, words: list[dict], code: str) -> tuple[np.ndarray, np.ndarray]:
        """For each form the combination by which its first meeting with a query's words is made, or -1; and
        whether that is by this block's code."""
        combo, here = np.full(len(self.forms), -1), np.zeros(len(self.forms), bool)
        for word in reversed(words):
            for k in reversed(range(len(COMBINATIONS))):
                mine, theirs, _, _ = COMBINATIONS[k]
                if word[mine] and (number := self.number.get(word[mine])):
                    met = (self.codes[theirs] == number).any(axis=1)
                    combo[met] = k
                    here[met] = word[mine] == code
        return combo, here

    def bounds(self, query: str, at: np.ndarray) -> np.ndarray:
        """The greatest similarity that lengths and letters allow: letters without a column may all agree."""
        chars = np.frombuffer(query.encode("utf-32-le"), np.int32)
        own = (self.alphabet[:, None] == chars).sum(axis=1)
        listed = np.minimum(self.counts[at], own).sum(axis=1)
        rest = np.minimum(self.lengths[at] - self.counts[at].sum(axis=1), len(query) - own.sum())
        return 2.0 * (listed + rest) / (len(query) + self.lengths[at])

    def matches(self, query: str, words: list[dict], code: str, most: int | None) -> list[tuple[int, float]]:
        """(form's place, confidence) of the forms above their least confidence whose first meeting is here;
        with ``most``, at least those of the best entries."""
        combo, here = self.first_meeting(words, code)
        at = np.flatnonzero(here)
        weight, least = WEIGHTS[combo[at]], LEAST[combo[at]]
        bound = weight * self.bounds(query, at)
        able = bound > least
        at, weight, least, bound = at[able], weight[able], least[able], bound[able]
        order = np.argsort(-bound, kind="stable")
        out: list[tuple[int, float]] = []
        best: dict = {}
        floor = -1.0
        for i in range(0, len(order), CHUNK):
            part = order[i : i + CHUNK]
            if bound[part[0]] < floor:
                break
            part = part[bound[part] >= floor]
            size = len(query) + self.lengths[at[part]]
            confidence = weight[part] * (2.0 * subsequences(query, self.letters[at[part]]) / size)
            good = (confidence > least[part]) & (confidence >= floor)
            found = list(zip(at[part][good].tolist(), confidence[good].tolist(), strict=True))
            out += found
            if most is not None:
                for f, c in found:
                    for e in self.entries[f]:
                        if c > best.get(e, -1.0):
                            best[e] = c
                if len(best) >= most:
                    floor = float(np.partition(np.fromiter(best.values(), float, len(best)), -most)[-most])
        return out


def by_blocks(queries: DataFrame, forms: DataFrame, most: int | None, entry_type: str) -> DataFrame:
    """query, form, confidence; with ``most`` also entry_id, the best entries of each query in each block."""
    wanted = forms.select("code", "form", "words", *(["entries"] if most else []))
    # how many blocks a code has, by counts that partial aggregation makes
    counts = lambda rows, size, name: rows.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = counts(wanted, FORMS, "fs").join(counts(queries, QUERIES, "qs"), "code")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "code").withColumn("q_block", F.pmod(F.xxhash64("query"), F.col("qs"))).withColumn("f_block", every("fs"))
    right = wanted.join(sizes, "code").withColumn("f_block", F.pmod(F.xxhash64("form"), F.col("fs")).cast("int")).withColumn("q_block", every("qs"))
    key = ["code", "f_block", "q_block"]
    left = left.select(F.col("code"), F.col("f_block"), F.col("q_block").cast("int").alias("q_block"), "query", "q", "words")
    right = right.select(*key, *wanted.columns[1:])
    kind = pa.string()

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        names = ["query", "form", "confidence", *(["entry_id"] if most else [])]
        if a.num_rows and b.num_rows:
            block, code = FormBlock(b), b["code"][0].as_py()
            for query, q, words in zip(*(a[c].to_pylist() for c in ("query", "q", "words")), strict=True):
                found = block.matches(q, words, code, most)
                if not most:
                    out += [(query, block.forms[f], c) for f, c in found]
                    continue
                best: dict = {}
                for f, c in found:
                    for e in block.entries[f]:
                        if e not in best or (-c, block.forms[f]) < best[e]:
                            best[e] = (-c, block.forms[f])
                out += [(query, form, -c, e) for e, (c, form) in sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:most]]
        entries = b["entries"].type.value_type if most else None
        types = [kind, kind, pa.float64(), *([entries] if most else [])]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    schema = "query string, form string, confidence double" + (f", entry_id {entry_type}" if most else "")
    return spread(left, *key).groupBy(*key).cogroup(spread(right, *key).groupBy(*key)).applyInArrow(joined, schema)


def by_sound(queries: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """query, entry_id, form, confidence, match_type: entries with a form that has a word which sounds like a
    query word. The first combination of codes by which a query and a form meet, by query word and then in
    order, sets the weight, even if the confidence then misses its least value.

    With ``most``, the best entries of each query and perhaps some more; of equal confidence those of the
    smallest id, by the form that comes first. Null and empty queries and forms meet nothing.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).where("q != ''").distinct()
    q = coded(q, "q").select(F.explode("codes").alias("code"), "query", "q", "words")
    listed = rows.where("kind != '' and form != '' and entry_id is not null").select("form", "entry_id").distinct()
    names = listed.select("form").distinct()
    if most:
        first = Window.partitionBy("form").orderBy("entry_id")
        few = listed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
        names = few.groupBy("form").agg(F.sort_array(F.collect_list("entry_id")).alias("entries"))
    forms = coded(names, "form").withColumn("code", F.explode("codes"))
    found = by_blocks(q, forms, most, dict(rows.dtypes)["entry_id"])
    found = found if most else found.join(listed, "form")
    return found.select("query", "entry_id", "form", "confidence", F.lit("metaphone").alias("match_type"))
