"""The plan of correction passes over tables of proposals.

What a model proposes for a batch of segments is a table here; the plan decides what of it takes effect. The
first pass takes a proposal if it keeps the words that were heard with confidence and if at least one of its
changes is anchored in what was heard. The second pass runs for transcripts that the first one changed, the
last pass for all. Names that earlier batches of a transcript corrected are known to the later ones.

Everything is joined and aggregated by transcript and segment; a transcript's batches meet only the bounded
list of names that a prompt may hold.

Defined results: proposals for a segment that their batch does not hold are passed over; of several for one
segment the last that is taken counts. A fix for a segment that does not exist counts as a change of its
transcript and changes no text. Null texts stay null where nothing changes them. Empty tables change nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import gate_correction, stripped
from scriptorium.operators.fuzzy import anchored
from scriptorium.operators.intervals import duration_batches

#: Names and variants that a prompt lists, variants that are remembered.
PROMPT_NAMES, PROMPT_VARIANTS, MOST_VARIANTS = 20, 5, 10
#: Fixed value: the line before the names of earlier batches.
KNOWN_NAMES = "Known entities from earlier segments:"
#: What later passes add to a change and put before its reason.
MARKS = {"second": (" (pass2)", "consistency: "), "last": (" (kicker)", "kicker: ")}
_CHANGE = "array<struct<original:string,corrected:string,reason:string>>"


class Corrected(NamedTuple):
    """What correct() returns.

    segments: transcript, segment, text, applied, source, changes (one line each). changes: transcript, segment,
    pass, pos, original, corrected, reason. results: transcript, passes_completed, total_changes,
    segments_changed. names: transcript, canonical, variant, batch, place, nth, a row for each variant that is
    remembered.
    """

    segments: DataFrame
    changes: DataFrame
    results: DataFrame
    names: DataFrame


def batched(segments: DataFrame) -> DataFrame:
    """transcript, segment, batch: the batch that each segment goes to a model in."""
    return duration_batches(segments)


def first_pass(batches: DataFrame, proposals: DataFrame, words: DataFrame, terms: DataFrame | None = None, strict: bool = True, confident: float = 0.85) -> DataFrame:
    """transcript, segment, batch, place, corrected, changes of the proposals that take effect.

    batches: transcript, segment, batch. words: transcript, segment, ws (word, confidence); a segment without them
    has none. proposals: transcript, batch, place, segment, corrected, changes. With terms, changes to one of them have to be spelt or sound like what was heard.
    ``place`` is that of the segment's first accepted proposal, the rest is that of its last.
    """
    asked = proposals.withColumn("segment", F.col("segment").cast("long")).join(batches, ["transcript", "segment", "batch"], "left_semi")
    if strict:
        heard = words.select("transcript", F.col("segment").cast("long").alias("segment"), "ws")
        none = F.array().cast("array<struct<word:string,confidence:double>>")
        asked = asked.join(heard, ["transcript", "segment"], "left").where(gate_correction(F.coalesce("ws", none), F.col("corrected"), confident)).drop("ws")
    asked = asked.withColumn("changes", F.coalesce("changes", F.array().cast(_CHANGE)))
    if terms is not None:
        key = F.concat_ws(":", "transcript", "batch", "place", "n")
        each = asked.select("transcript", "batch", "place", F.posexplode("changes").alias("n", "c")).select(key.alias("id"), "transcript", "batch", "place", "n", "c")
        sound = anchored(each.select("id", "c.original", "c.corrected"), terms).where("valid")
        kept = each.join(sound, "id", "left_semi").groupBy("transcript", "batch", "place").agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("kept"))
        judged = asked.join(kept, ["transcript", "batch", "place"], "left")
        good = F.coalesce(F.transform("kept", lambda x: x["c"]), F.array().cast(_CHANGE))
        asked = judged.where((F.size("changes") == 0) | F.col("kept").isNotNull()).withColumn("changes", good).drop("kept")
    last = F.max_by(F.struct("corrected", "changes"), "place")
    one = asked.groupBy("transcript", "batch", "segment").agg(F.min("place").alias("place"), last.alias("x"))
    return one.select("transcript", "segment", "batch", "place", "x.corrected", "x.changes")


def heard_names(taken: DataFrame) -> DataFrame:
    """transcript, canonical, variant, batch, place, nth: names that corrections put in place of something else,
    with the first different forms (in any case) of what stood there, up to MOST_VARIANTS."""
    each = taken.select("transcript", "batch", "place", F.posexplode("changes").alias("n", "c"))
    named = each.select("transcript", F.struct("batch", "place", "n").alias("at"), stripped(F.col("c.corrected")).alias("canonical"), stripped(F.col("c.original")).alias("variant"))
    named = named.where(F.col("canonical").rlike(r"^\p{Lu}") & (F.col("canonical") != F.col("variant")))
    first = named.groupBy("transcript", "canonical", F.lower("variant").alias("low")).agg(F.min(F.struct("at", "variant")).alias("x"))
    order = Window.partitionBy("transcript", "canonical").orderBy("x.at")
    numbered = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MOST_VARIANTS)
    return numbered.select("transcript", "canonical", "x.variant", "x.at.batch", "x.at.place", F.col("x.at.n").alias("pos"), "nth")


def known_names(batches: DataFrame, names: DataFrame) -> DataFrame:
    """transcript, batch, block: what a prompt tells of the names of earlier batches; empty if there are none.

    Only the first names of a transcript, and the first variants of each, can ever be told, so each batch meets
    a bounded list and no other batch.
    """
    at = F.struct("batch", "place", "pos")
    firsts = names.groupBy("transcript", "canonical").agg(F.min(at).alias("at"))
    few = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("transcript").orderBy("at"))).where(F.col("rank") <= PROMPT_NAMES)
    told = names.where(F.col("nth") <= PROMPT_VARIANTS).join(few.select("transcript", "canonical", "rank"), ["transcript", "canonical"])
    each = batches.select("transcript", "batch").distinct()
    earlier = each.join(told.withColumnRenamed("batch", "since"), "transcript", "left").where(F.col("since").isNull() | (F.col("since") < F.col("batch")))
    forms = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("nth", "variant")))), lambda x: x["variant"])
    line = F.concat(F.lit('  - "'), F.col("canonical"), F.lit('" (may appear as: '), F.array_join(forms, ", "), F.lit(")"))
    lines = earlier.where("rank is not null").groupBy("transcript", "batch", "canonical", "rank").agg(line.alias("line"))
    blocks = lines.groupBy("transcript", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    text = F.concat(F.lit(f"\n{KNOWN_NAMES}\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return each.join(blocks, ["transcript", "batch"], "left").select("transcript", "batch", F.coalesce(text, F.lit("")).alias("block"))


def _later(segments: DataFrame, fixes: DataFrame, mark: str, source: str) -> DataFrame:
    """Segments with the last fix of each, its change listed after the earlier ones."""
    last = fixes.groupBy("transcript", "segment").agg(F.max_by(F.struct("original", "corrected"), "pos").alias("fix"))
    line = F.concat(F.coalesce("fix.original", F.lit("")), F.lit(" -> "), F.coalesce("fix.corrected", F.lit("")), F.lit(mark))
    met = F.col("fix").isNotNull()
    return (
        segments.join(last, ["transcript", "segment"], "left")
        .withColumn("changes", F.when(met, F.concat("changes", F.array(line))).otherwise(F.col("changes")))
        .withColumn("text", F.when(met, F.col("fix.corrected")).otherwise(F.col("text")))
        .withColumn("source", F.when(met & (F.col("source") == "none"), source).otherwise(F.col("source")))
        .withColumn("applied", F.col("applied") | met)
        .drop("fix")
    )


def correct(
    segments: DataFrame,
    proposals: DataFrame,
    words: DataFrame,
    second: DataFrame | None = None,
    last: DataFrame | None = None,
    terms: DataFrame | None = None,
    strict: bool = True,
    confident: float = 0.85,
    source: str = "model",
) -> Corrected:
    """Run the passes for which there are tables. segments: transcript, segment, start, end, text; words: transcript,
    segment, ws; second and last: transcript, pos, segment, original, corrected,
    reason. ``source`` is what corrected segments are marked with."""
    placed = segments.select("transcript", F.col("segment").cast("long").alias("segment"), "text")
    taken = first_pass(batched(segments), proposals, words, terms, strict, confident)
    lines = F.transform("taken.changes", lambda c: F.concat(F.coalesce(c["original"], F.lit("")), F.lit(" -> "), F.coalesce(c["corrected"], F.lit(""))))
    met = F.col("taken").isNotNull()
    done = placed.join(taken.select("transcript", "segment", F.struct("corrected", "changes").alias("taken")), ["transcript", "segment"], "left").select(
        "transcript",
        "segment",
        F.when(met, F.col("taken.corrected")).otherwise(F.col("text")).alias("text"),
        met.alias("applied"),
        F.when(met, source).otherwise(F.lit("none")).alias("source"),
        F.when(met, lines).otherwise(F.array().cast("array<string>")).alias("changes"),
    )
    touched = taken.select("transcript").distinct()
    every = taken.select("transcript", "segment", F.lit(1).alias("pass"), F.posexplode("changes").alias("pos", "c"))
    changes = every.select("transcript", "segment", "pass", F.col("pos").cast("long").alias("pos"), "c.*")
    changed = taken.select("transcript", "segment")
    for number, (name, fixes) in enumerate((("second", second), ("last", last)), 2):
        if fixes is None:
            continue
        mark, why = MARKS[name]
        fixes = fixes.withColumn("segment", F.col("segment").cast("long"))
        fixes = fixes.join(touched if name == "second" else placed.select("transcript").distinct(), "transcript", "left_semi")
        done = _later(done, fixes, mark, source)
        reason: Column = F.concat(F.lit(why), F.coalesce("reason", F.lit("")))
        changes = changes.unionByName(fixes.select("transcript", "segment", F.lit(number).alias("pass"), F.col("pos").cast("long").alias("pos"), "original", "corrected", reason.alias("reason")))
        changed = changed.unionByName(fixes.select("transcript", "segment"))
    counts = changes.groupBy("transcript").agg(F.count(F.lit(1)).alias("total_changes"))
    kinds = changed.distinct().groupBy("transcript").agg(F.count(F.lit(1)).alias("segments_changed"))
    ran = touched.withColumn("passes_completed", F.lit(2 if second is not None else 1))
    whole = placed.select("transcript").distinct().join(ran, "transcript", "left").join(counts, "transcript", "left").join(kinds, "transcript", "left")
    zero = F.lit(0).cast("long")
    results = whole.select("transcript", F.coalesce("passes_completed", F.lit(1)).alias("passes_completed"), F.coalesce("total_changes", zero).alias("total_changes"), F.coalesce("segments_changed", zero).alias("segments_changed"))
    return Corrected(done, changes, results, heard_names(taken))
