"""Renderers: time stamps, subtitles, markdown, text, JSON.

A rendered transcript is one string, so its segments are gathered by transcript: groups are single
recordings, bounded by their length, never the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.dictionary import TIERS
from scriptorium.operators.order import numbered

MARKDOWN_SPECIALS = r"([\\`*_{}\[\]()#+\-.!|>~])"


def total_ms(seconds: Column) -> Column:
    """Whole milliseconds, half to even; null, negative and non-finite count as 0."""
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    whole = F.floor(F.when(bad, 0.0).otherwise(seconds))
    part = F.bround((F.when(bad, 0.0).otherwise(seconds) - whole) * 1000, 0)
    return (whole * 1000 + part).cast("long")


def time_text(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds after the mark."""
    ms = total_ms(seconds)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_time(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS within the first hour."""
    s = F.floor(total_ms(seconds) / 1000)
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN_SPECIALS, r"\\$1")


def _gathered(rows: DataFrame, line: Column, between: str, before: str = "", after: str = "") -> DataFrame:
    """transcript, body: the lines in segment order."""
    listed = F.sort_array(F.collect_list(F.struct("segment", line.alias("line"))))
    body = F.array_join(F.transform(listed, lambda x: x["line"]), between)
    return rows.groupBy("transcript").agg(F.concat(F.lit(before), body, F.lit(after)).alias("body"))


def _spoken(segments: DataFrame) -> DataFrame:
    return segments.where(F.trim("text") != "")


def to_srt(segments: DataFrame) -> DataFrame:
    """Numbered cues of the segments that are not blank."""
    flat = F.trim(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))
    number = F.row_number().over(Window.partitionBy("transcript").orderBy("segment"))
    cues = _spoken(segments).withColumn("number", number)
    line = F.concat_ws("\n", F.col("number").cast("string"), F.concat(time_text(F.col("start"), ","), F.lit(" --> "), time_text(F.col("end"), ",")), flat)
    return _gathered(cues, line, "\n\n", after="\n")


def to_vtt(segments: DataFrame) -> DataFrame:
    escaped = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " ")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    line = F.concat_ws("\n", F.concat(time_text(F.col("start")), F.lit(" --> "), time_text(F.col("end"))), F.trim(escaped))
    return _gathered(_spoken(segments), line, "\n\n", before="WEBVTT\n\n", after="\n")


def to_markdown(segments: DataFrame) -> DataFrame:
    speaker = F.when(F.trim("speaker") != "", F.concat(F.lit("**"), escape_markdown(F.trim("speaker")), F.lit(":** "))).otherwise("")
    line = F.concat(F.lit("["), short_time(F.col("start")), F.lit("] "), speaker, escape_markdown(F.trim("text")))
    return _gathered(_spoken(segments), line, "\n\n", before="# Transcript\n\n", after="\n")


def to_text(segments: DataFrame) -> DataFrame:
    return _gathered(_spoken(segments), F.trim("text"), "\n")


def to_json_lines(segments: DataFrame) -> DataFrame:
    """transcript, body: a JSON array of the segments."""
    listed = F.sort_array(F.collect_list(F.struct("segment", "start", "end", "speaker", "text")))
    return segments.groupBy("transcript").agg(F.to_json(listed).alias("body"))


FORMATS = {"json": to_json_lines, "srt": to_srt, "vtt": to_vtt, "md": to_markdown, "markdown": to_markdown, "txt": to_text, "text": to_text}


def render(segments: DataFrame, name: str) -> DataFrame:
    """By extension, with or without its dot, in any case."""
    key = name.lower().lstrip(".")
    if key not in FORMATS:
        raise ValueError(f"unknown format: {name}; one of {', '.join(FORMATS)}")
    return FORMATS[key](segments)


def kept_for_export(entries: DataFrame, max_tier: str | None = None, context: str | None = None) -> DataFrame:
    """Entries of the tier or a higher one, and with the context, in any case; an unknown tier cuts nothing."""
    kept = entries.where(F.col("tier") <= max_tier) if max_tier in TIERS else entries
    return kept.where(F.exists("contexts", lambda c: F.lower(c) == context.lower())) if context else kept


def export_entries(entries: DataFrame, folder: str, max_tier: str | None = None, context: str | None = None) -> DataFrame:
    """Entries in export order (tier, canonical in any case, id) with their place and JSON.

    entries: nested, with aliases (alias), contexts, and pronunciations (ipa), display, source and notes if there are
    any. Lists are always there, optional texts only where they are not empty. The folder takes the sorted rows.
    """
    kept = kept_for_export(entries, max_tier, context)
    listed = lambda name, field: F.coalesce(F.transform(name, lambda x: x[field]), F.array().cast("array<string>")) if name in kept.columns else F.array().cast("array<string>")
    texts = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("display", "source", "notes") if c in kept.columns]
    sounds = F.filter(listed("pronunciations", "ipa"), lambda x: x != "")
    body = F.struct("canonical", "type", "tier", "boost_weight", listed("aliases", "alias").alias("aliases"), sounds.alias("pronunciations"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), *texts)
    rows = kept.select("id", "canonical", "tier", F.to_json(body).alias("json"))
    return numbered(rows, [F.col("tier"), F.lower("canonical"), F.col("id")], folder)


def export_envelope(exported: DataFrame, at: str, max_tier: str | None = None, context: str | None = None) -> DataFrame:
    """json: one row that says what an export holds; its entries are the lines beside it."""
    filters = F.struct(F.lit(max_tier).alias("tier"), F.lit(context).alias("context"))
    return exported.agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(at).alias("exported_at"), filters.alias("filters"), "count")).alias("json"))


def write_export(entries: DataFrame, folder: str, at: str, max_tier: str | None = None, context: str | None = None) -> None:
    """A folder with ``entries``, JSON lines whose files and lines are in export order, and ``envelope``."""
    exported = export_entries(entries, f"{folder}/sorted", max_tier, context)
    ordered = exported.repartitionByRange("place").sortWithinPartitions("place")
    ordered.select("json").write.text(f"{folder}/entries")
    export_envelope(exported, at, max_tier, context).write.text(f"{folder}/envelope")
