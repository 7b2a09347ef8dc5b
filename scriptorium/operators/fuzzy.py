"""Exact, phonetic and edit-distance matching of queries against dictionary forms.

Forms are rows (entry_id, form, kind, ord). Phonetic candidates come from an equality join on codes.
Edit candidates come from an equality join as well: two strings at distance d <= 3, cut into four
pieces, share one unchanged piece at a place that moved by three at most - so pieces are the join
keys and the distance is computed for those pairs only, not for all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.phonetic import metaphone
from scriptorium.functions.text import stripped
from scriptorium.operators.phonetic_join import COMBINATIONS, by_sound

MOST_EDITS = 3
EDIT_WEIGHTS = {"canonical": 0.6, "alias": 0.55}
EDIT_LEAST = 0.3


def forms(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """entry_id, form (lower case), kind, ord."""
    own = entries.select(F.col("id").alias("entry_id"), F.lower("canonical").alias("form"), F.lit("canonical").alias("kind"), F.lit(0).alias("ord"))
    other = aliases.select("entry_id", F.lower("alias").alias("form"), F.lit("alias").alias("kind"), F.lit(1).alias("ord"))
    return own.unionByName(other).where("form != ''").distinct()


def exact(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, entry_id, form, confidence, match_type: equal forms; of equal ones the last entry wins."""
    found = queries.join(rows, F.lower(F.trim("query")) == F.col("form"))
    last = Window.partitionBy("query", "kind").orderBy(F.col("entry_id").desc())
    one = found.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    canonical = F.col("kind") == "canonical"
    return one.select("query", "entry_id", "form", F.when(canonical, 1.0).otherwise(0.98).alias("confidence"), F.when(canonical, "exact").otherwise("exact_alias").alias("match_type"))


def _pieces(size: Column, n: int) -> Column:
    """A string of some length cut into n pieces of nearly equal length: (i, at, len), places from 0."""
    cut = lambda i: F.floor(size * i / n).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("i"), cut(i).alias("at"), (cut(i + 1) - cut(i)).alias("len")) for i in range(n)])


def edit_pairs(queries: DataFrame, rows: DataFrame, most: int = MOST_EDITS) -> DataFrame:
    """query, entry_id, form, kind, distance for all pairs with 1 <= distance <= most.

    Forms are cut into most + 1 pieces, of which one stands unchanged in the query. Keys are a form's
    length, the piece's number and the piece; a query asks for each length that is near enough, and for
    the places that a piece can have moved to: the edits before piece i are at most i, those after it at
    most most - i, for else another piece stands unchanged as well. Forms too short for pieces are joined
    by length instead.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).where("q != ''").distinct()
    names = rows.select("form").distinct()
    size = F.length("form")
    cut = names.where(size > most).select("form", size.alias("size"), F.inline(_pieces(size, most + 1)))
    cut = cut.select("form", "size", "i", F.substr("form", F.col("at") + 1, F.col("len")).alias("piece"))
    mine = F.length("q")
    asked = q.withColumn("size", F.explode(F.sequence(F.greatest(mine - most, F.lit(most + 1)), F.greatest(mine + most, F.lit(most + 1)))))
    asked = asked.select("query", "q", "size", F.inline(_pieces(F.col("size"), most + 1)))
    longer = mine - F.col("size")
    low = F.greatest(F.col("at") - F.col("i"), F.col("at") + longer - (most - F.col("i")), F.lit(0))
    high = F.least(F.col("at") + F.col("i"), F.col("at") + longer + (most - F.col("i")), mine - F.col("len"))
    asked = asked.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("place", F.explode(F.sequence("low", "high")))
    asked = asked.select("query", "q", "size", "i", F.substr("q", F.col("place") + 1, F.col("len")).alias("piece")).distinct()
    near = asked.join(cut, ["size", "i", "piece"]).select("query", "q", "form").distinct()
    short = names.where(F.length("form") <= most).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2 * most))))
    near = near.unionByName(q.where(F.length("q") <= 2 * most).withColumn("k", F.length("q")).join(short, "k").select("query", "q", "form"))
    distance = F.levenshtein("q", "form", most)
    found = near.withColumn("distance", distance).where(F.col("distance").between(1, most))
    return found.join(rows, "form").select("query", "entry_id", "form", "kind", "distance")


def by_edits(queries: DataFrame, rows: DataFrame) -> DataFrame:
    pairs = edit_pairs(queries, rows)
    weight = F.when(F.col("kind") == "canonical", EDIT_WEIGHTS["canonical"]).otherwise(EDIT_WEIGHTS["alias"])
    size = F.greatest(F.length(F.trim("query")), F.length("form"))
    scored = pairs.withColumn("confidence", weight * (1 - F.col("distance") / size)).where(F.col("confidence") > EDIT_LEAST)
    return scored.select("query", "entry_id", "form", "confidence", F.lit("edit_distance").alias("match_type"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths, by bits: one addition for each letter.

    A query stands beside many forms, so the places of its letters are kept from row to row.
    """
    masks: dict[str, dict[str, int]] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None or not x or not y:
            out.append(None if x is None or y is None else 0.0)
            continue
        if (of := masks.get(x)) is None:
            of = masks[x] = {}
            for i, c in enumerate(x):
                of[c] = of.get(c, 0) | 1 << i
        row = full = (1 << len(x)) - 1
        for c in y:
            met = row & of.get(c, 0)
            row = (row + met) | (row - met)
        out.append(2.0 * (len(x) - (row & full).bit_count()) / (len(x) + len(y)))
    return pd.Series(out, dtype="float64")


def _codes(rows: DataFrame, text: str) -> DataFrame:
    words = rows.withColumn("__w", F.explode(F.split(text, r"\s+"))).withColumn("__w", F.regexp_replace("__w", "[^a-zA-Z]", "")).where("length(__w) >= 2")
    return words.withColumn("__m", metaphone("__w"))


def candidates(queries: DataFrame, rows: DataFrame, most: int = 10) -> DataFrame:
    """The best candidate of each entry over all strategies, and of these the best for each query."""
    most = max(0, min(most, 100))
    ways = [exact(queries, rows), by_sound(queries, rows, max(1, most)), by_edits(queries, rows)]
    every = [w.withColumn("way", F.lit(i)) for i, w in enumerate(ways)]
    union = every[0].unionByName(every[1]).unionByName(every[2])
    best = Window.partitionBy("query", "entry_id").orderBy(F.col("confidence").desc(), "way", "form")
    top = Window.partitionBy("query").orderBy(F.col("confidence").desc(), "way", "entry_id")
    one = union.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return one.withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).drop("__n", "way")


def best_match(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    return candidates(queries, rows, 1).where(F.col("confidence") >= max(0.0, min(1.0, threshold)))


CAPITALIZED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
WORD = r"\b[A-Za-z]+\b"


def placed_spans(texts: DataFrame, pattern: str, keep: Callable[[str, re.Match], bool], key: str, text: str) -> DataFrame:
    """key, span, start: where a pattern stands and a test holds, by one pass over each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = re.compile(pattern).finditer
        for batch in batches:
            hits = [(i, m.group(), m.start()) for i, t in enumerate(batch.column(1).to_pylist()) if t for m in search(t) if keep(t, m)]
            of = pa.array([i for i, _, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array([s for _, s, _ in hits], pa.string()), pa.array([n for _, _, n in hits], pa.int64())], names=[key, "span", "start"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(found, f"`{key}` {kind}, span string, start long")


def _inside(text: str, found: re.Match) -> bool:
    """Whether a span begins neither its text nor a sentence."""
    at = found.start() - 1
    while at > 0 and text[at] in " \t\n":
        at -= 1
    return at >= 0 and text[at] not in ".!?"


def spans_of(text: str) -> Iterator[tuple[str, int, bool]]:
    """span, start, capital: the capitalized spans of a text, and its words of three letters or more."""
    for m in re.finditer(CAPITALIZED, text):
        if _inside(text, m):
            yield m.group(), m.start(), True
    for m in re.finditer(WORD, text):
        if len(m.group()) >= 3:
            yield m.group(), m.start(), False


def capitalized_spans(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span, start: runs of capitalized words that do not begin a text or a sentence."""
    return placed_spans(texts, CAPITALIZED, _inside, key, text)


def sounding_words(texts: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span, start: words of three letters or more that have a code of some form's words."""
    found = placed_spans(texts, WORD, lambda _, m: len(m.group()) >= 3, key, text)
    words = found.select("span").distinct().withColumn("m", metaphone("span")).select("span", F.explode(F.array("m.p", "m.a")).alias("code"))
    heard = _codes(rows, "form").select(F.explode(F.array("__m.p", "__m.a")).alias("code")).where("code != ''").distinct()
    return found.join(words.join(heard, "code", "left_semi").select("span").distinct(), "span", "left_semi").select(key, "span", "start")


def match_spans(texts: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, span, start, end, candidates: spans that name an entry, with their best candidates in order.

    Capitalized spans need any candidate; words that merely sound like a form need one of ``least``, and
    give way to a capitalized span of the same place. Distinct spans are matched once for all texts.
    """
    capital = capitalized_spans(texts, key, text).withColumn("strict", F.lit(False))
    sounding = sounding_words(texts, rows, key, text).withColumn("strict", F.lit(True))
    spans = capital.unionByName(sounding).groupBy(key, "span", "start").agg(F.min("strict").alias("strict"))
    best = candidates(spans.select(F.col("span").alias("query")).distinct(), rows)
    each = F.struct("place", "entry_id", "form", "confidence", "match_type")
    listed = best.groupBy(F.col("query").alias("span")).agg(F.sort_array(F.collect_list(each)).alias("candidates"))
    met = spans.join(listed, "span").where(~F.col("strict") | (F.col("candidates")[0]["confidence"] >= least))
    return met.select(key, "span", "start", (F.col("start") + F.length("span")).alias("end"), "candidates")


def anchored(corrections: DataFrame, terms: DataFrame, key: str = "id", least: float = 0.5) -> DataFrame:
    """key, valid: whether a correction (key, original, corrected) to a dictionary term (term, in lower
    case) has a word in the original that is spelt or sounds like one of its words.

    Corrections that are empty, or to no term, or to words without a code, are valid.
    """
    low = F.lower(stripped(F.col("corrected")))
    asked = corrections.where("original != '' and corrected != ''").select(key, "original", low.alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    said = asked.select(key, F.explode(F.split(F.lower("original"), r"\s+")).alias("o")).withColumn("o", F.regexp_replace("o", r"""^[.,!?;:"']+|[.,!?;:"']+$""", "")).where("o != ''").distinct()
    wanted = asked.select(key, F.explode(F.split("term", r"\s+")).alias("c")).where("c != ''").distinct()
    coded = lambda rows, c: rows.select(c).distinct().withColumn(f"m_{c}", metaphone(c))
    wanted = wanted.join(coded(wanted, "c"), "c")
    # the words of one correction meet each other, never those of another
    pairs = said.join(coded(said, "o"), "o").join(wanted, key)
    spelt = 1 - F.levenshtein("o", "c") / F.greatest(F.length("o"), F.length("c")) >= least
    sounds = (F.col("m_c.p") != "") & ((F.col("m_o.p") == F.col("m_c.p")) | (F.col("m_o.a") == F.col("m_c.p")))
    held = pairs.groupBy(key).agg(F.max(spelt | sounds).alias("held"))
    mute = wanted.groupBy(key).agg(F.max(F.col("m_c.p") != "").alias("coded"))
    judged = asked.select(key).join(held, key, "left").join(mute, key, "left").select(key, (F.coalesce("held", F.lit(False)) | ~F.coalesce("coded", F.lit(False))).alias("valid"))
    return corrections.select(key).join(judged, key, "left").select(key, F.coalesce("valid", F.lit(True)).alias("valid"))


def heard_by_sound(entities: DataFrame, least: float = 0.6) -> DataFrame:
    """form, word: of entities (form, words) those that a heard word of three letters or more sounds like
    with the confidence, and the first such word. Each form is its own only entry."""
    pairs = entities.select("form", F.explode("words").alias("word")).where(F.length("word") >= 3).distinct()
    share = 2 * F.least(F.length("word"), F.length("form")) / (F.length("word") + F.length("form"))
    # no combination of codes weighs more than the first, so shorter words cannot reach it
    near = pairs.where(share * COMBINATIONS[0][2] >= least - 1e-9).withColumn("s", similarity(F.col("word"), F.col("form")))
    near = near.where(F.col("s") * COMBINATIONS[0][2] >= least - 1e-9)
    letters = lambda c: F.regexp_replace(c, "[^a-zA-Z]", "")
    mine = near.select("word").distinct().withColumn("m", metaphone(letters("word")))
    theirs = near.select("form").distinct().select("form", F.explode(F.split("form", r"\s+")).alias("t")).withColumn("t", letters("t")).where("length(t) >= 2").withColumn("n", metaphone("t"))
    met = near.join(mine, "word").join(theirs, "form")
    hits = [(F.col(f"m.{a}") != "") & (F.col(f"m.{a}") == F.col(f"n.{b}")) for a, b, _, _ in COMBINATIONS]
    combo = F.coalesce(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)])
    first = met.withColumn("combo", combo).where("combo is not null").groupBy("form", "word", "s").agg(F.min("combo").alias("combo"))
    weight = F.element_at(F.array(*[F.lit(c[2]) for c in COMBINATIONS]), F.col("combo") + 1)
    return first.where(weight * F.col("s") >= least - 1e-9).groupBy("form").agg(F.min("word").alias("word"))
