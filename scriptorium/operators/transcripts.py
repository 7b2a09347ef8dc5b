"""Transcripts: context windows, rolling buffers, low-confidence spans, corrections applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_windows(segments: DataFrame, reach: int, key: str = "transcript") -> DataFrame:
    """Adds before and after: the texts of up to reach segments on either side, blank ones left out."""
    reach = max(0, min(100, reach))
    order = Window.partitionBy(key).orderBy("segment")
    text = F.when(F.trim("text") != "", F.trim("text"))
    joined = lambda a, b: F.array_join(F.collect_list(text).over(order.rowsBetween(a, b)), " ")
    if not reach:
        return segments.withColumns({"before": F.lit(""), "after": F.lit("")})
    return segments.withColumns({"before": joined(-reach, -1), "after": joined(1, reach)})


def rolling_context(segments: DataFrame, n_words: int = 100, most_chars: int = 500, key: str = "transcript") -> DataFrame:
    """Adds context: the last words of all earlier segments, cut to the last characters.

    A segment that is not blank has a word at least, so the last ``n_words`` segments of that kind hold
    all that matter, and the frame is bounded by them however many blank ones lie between.
    """
    spoken = F.trim("text") != ""
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    numbered = segments.withColumn("__spoken", F.count(F.when(spoken, 1)).over(before))
    frame = Window.partitionBy(key).orderBy("__spoken").rangeBetween(-n_words, -1)
    said = F.filter(F.flatten(F.collect_list(F.when(spoken, F.split(F.trim("text"), r"\s+"))).over(frame)), lambda w: w != "")
    last = F.when(F.size(said) > n_words, F.slice(said, -n_words, n_words)).otherwise(said)
    return numbered.withColumn("context", F.trim(F.right(F.array_join(last, " "), F.lit(most_chars)))).drop("__spoken")


def mark_spans(words: Column, threshold: float = 0.7) -> Column:
    """The words in one line, runs of doubtful ones inside [? ?].

    A word is doubtful if its confidence is low; so is a very short capitalized one beside a low
    one; and a capitalized word before a doubtful capitalized word.
    """
    low = lambda w: w["confidence"] < threshold
    name = lambda w: F.trim(w["word"])
    capital = lambda w: name(w).rlike(r"^\p{Lu}")

    def tagged(w: Column, i: Column) -> Column:
        beside = F.coalesce(low(F.get(words, i - 1)), F.lit(False)) | F.coalesce(low(F.get(words, i + 1)), F.lit(False))
        short = (F.length(name(w)) == 1) & capital(w) & ~name(w).isin("I", "A") | (F.length(name(w)) == 2) & capital(w)
        return F.struct(w["word"].alias("word"), capital(w).alias("capital"), (low(w) | (short & beside)).alias("mark"))

    def spread(done: Column, w: Column) -> Column:
        """From the right: a mark goes on to the capitalized word before it."""
        after = F.get(done, 0)
        marked = w["mark"] | (F.coalesce(after["mark"] & after["capital"], F.lit(False)) & w["capital"])
        return F.concat(F.array(F.struct(w["word"].alias("word"), w["capital"].alias("capital"), marked.alias("mark"))), done)

    none = F.array().cast("array<struct<word:string,capital:boolean,mark:boolean>>")
    marks = F.aggregate(F.reverse(F.transform(words, tagged)), none, spread)

    def written(all_: Column) -> Column:
        opens = lambda w, i: w["mark"] & ~F.coalesce(F.get(all_, i - 1)["mark"], F.lit(False))
        closes = lambda w, i: w["mark"] & ~F.coalesce(F.get(all_, i + 1)["mark"], F.lit(False))
        return F.array_join(F.transform(all_, lambda w, i: F.concat(F.when(opens(w, i), "[?").otherwise(""), w["word"], F.when(closes(w, i), "?]").otherwise(""))), " ")

    return F.element_at(F.transform(F.array(marks), written), 1)


def doubtful_words(words: Column, threshold: float = 0.9) -> Column:
    return F.transform(F.filter(words, lambda w: w["confidence"] < threshold), lambda w: F.struct(w["word"].alias("word"), F.bround(w["confidence"], 2).alias("confidence")))


def confident_words(words: DataFrame, threshold: float) -> DataFrame:
    return words.where(F.col("confidence") >= threshold)


def out_of_order(segments: DataFrame, key: str = "transcript") -> DataFrame:
    """Segments that begin after the next one does."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("segment"))
    return segments.withColumn("next_start", following).where("start > next_start")


def apply_fixes(segments: DataFrame, fixes: DataFrame, key: str = "transcript") -> DataFrame:
    """Segments with the text of their last fix (by pos), if they have one, and whether they were changed."""
    last = fixes.groupBy(key, "segment").agg(F.max_by("corrected", "pos").alias("corrected"))
    done = segments.join(last, [key, "segment"], "left")
    return done.withColumn("changed", F.col("corrected").isNotNull()).withColumn("text", F.coalesce("corrected", "text")).drop("corrected")


def entity_variants(entities: DataFrame, most: int = 10) -> DataFrame:
    """canonical, variants: the first distinct forms, in any case, in order of pos."""
    first = entities.groupBy("canonical", F.lower("variant").alias("low")).agg(F.min(F.struct("pos", "variant")).alias("v"))
    listed = F.sort_array(F.collect_list(F.struct("v.pos", "v.variant")))
    return first.groupBy("canonical").agg(F.slice(F.transform(listed, lambda x: x["variant"]), 1, most).alias("variants"))


def deduplicated_entities(entities: DataFrame, ignore_case: bool = True) -> DataFrame:
    """For each name the entity with the highest confidence, the first of equals (by pos)."""
    name = F.lower(F.trim("text")) if ignore_case else F.trim("text")
    w = Window.partitionBy("__name").orderBy(F.col("confidence").desc(), "pos")
    return entities.withColumn("__name", name).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__name")


def learnable(corrections: DataFrame) -> DataFrame:
    """Corrected strings worth learning: names, several words, or a reason that says so; first of each."""
    reason = F.lower(F.coalesce("reason", F.lit(""))).rlike("name|proper|entity|company|product|person")
    worth = F.col("corrected").rlike(r"^\p{Lu}") | F.col("corrected").contains(" ") | reason
    w = Window.partitionBy(F.lower("corrected")).orderBy("pos")
    return corrections.where(worth).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered_transcript(segments: DataFrame, most: int = 10_000, key: str = "transcript") -> DataFrame:
    """key, body: one line for each segment with its number; null for a transcript of more than ``most``."""
    line = F.concat(F.lit("["), F.col("segment").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    listed = F.sort_array(F.collect_list(F.struct("segment", line.alias("line"))))
    return segments.groupBy(key).agg(F.when(F.count(F.lit(1)) <= most, F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("body"))
