"""Session logs by kind of event: lines written with each kind's own fields, and read back as typed tables.

A line is JSON of any shape, so it is parsed once into a VARIANT: fields that no table asks for stay in it,
kinds that are not known are kept under their names, and lines that are no JSON object are counted by
session instead of being lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXTS, _OBJECT = "array<string>", "variant"
#: The kinds of events and their fields, beside ``event`` and ``ts``. A number after a type is that of
#: the decimals that are written. The lowest words are pairs of a word and its probability.
FIELDS: dict[str, dict[str, str]] = {
    "session_start": {"audio_file": "string", "timestamp": "string"},
    "config": {},
    "audio_prepared": {"duration_seconds": "double 2", "chunks": "bigint", "enhancement": _OBJECT},
    "chunk_transcribed": {"chunk_id": "bigint", "start_time": "double 2", "duration": "double 2", "word_count": "bigint", "low_conf_count": "bigint", "low_conf_pct": "double 1", "avg_confidence": "double 3", "lowest_conf_words": "array<array<string>>"},
    "chunk_timing": {"chunk_index": "bigint", "total_chunks": "bigint", "chunk_duration_seconds": "double 3", "transcription_seconds": "double 3", "chunk_rtf": "double 4", "word_count": "bigint", "speech_rate": "double 2", "processing_rate": "double 2", "avg_confidence": "double 4", "memory_gb": "double 2"},
    "segment_created": {"segment_id": "bigint", "text_preview": "string", "word_count": "bigint"},
    "correction_attempted": {"segment_id": "bigint", "original_preview": "string", "low_conf_regions": "bigint"},
    "correction_applied": {"segment_id": "bigint", "change_count": "bigint", "changes": "array<struct<original:string,corrected:string,reason:string>>", "corrected_preview": "string"},
    "correction_rejected": {"segment_id": "bigint", "reason": "string", "violations": _TEXTS, "details": _OBJECT},
    "vocabulary_used": {"domain": "string", "term_count": "bigint", "terms_matched": _TEXTS},
    "learning_candidates": {"total_candidates": "bigint", "accepted": _TEXTS, "rejected_hallucinated": _TEXTS},
    "pass_complete": {"pass_number": "bigint", "model": "string", "segments_modified": "bigint", "api_tokens": "bigint"},
    "error": {"error_type": "string", "message": "string", "details": _OBJECT},
    "transcription_complete": {"elapsed_seconds": "double 2", "rtf": "double 2", "chunks": "bigint", "segments": "bigint"},
    "session_complete": {"duration_seconds": "double", "total_words": "bigint", "total_segments": "bigint", "chunks_processed": "bigint", "avg_confidence": "double 3", "low_conf_words": "bigint", "low_conf_pct": "double 1", "corrections_applied": "bigint", "corrections_rejected": "bigint", "diff_gating_rejections": "bigint", "correction_acceptance_rate": "double"},
    "serialization_error": {"error": "string", "original_event_type": "string"},
}
#: A probability under this is low; lengths of previews and of lists.
LOW, PREVIEW, LOWEST, MOST_VIOLATIONS = 0.7, 100, 5, 10


def preview(text: Column) -> Column:
    return F.when(F.length(text) > PREVIEW, F.concat(F.left(text, F.lit(PREVIEW)), F.lit("..."))).otherwise(text)


def of_words(words: Column) -> dict[str, Column]:
    """The measures of a chunk's words (word, probability; 1 where it is missing)."""
    sure = F.transform(words, lambda w, i: F.struct(F.coalesce(w["probability"], F.lit(1.0)).alias("p"), i.alias("i"), w["word"].alias("word")))
    low, n = F.size(F.filter(sure, lambda w: w["p"] < LOW)), F.size(words)
    total = F.aggregate(sure, F.lit(0.0), lambda a, w: a + w["p"])
    pair = lambda w: F.array(w["word"].cast("variant"), w["p"].cast("variant"))
    share = lambda a: F.coalesce(F.try_divide(a, n), F.lit(0.0))
    return {"word_count": n, "low_conf_count": low, "low_conf_pct": share(low * 100.0), "avg_confidence": share(total), "lowest_conf_words": F.transform(F.slice(F.array_sort(sure), 1, LOWEST), pair)}


def of_times(length: Column, compute: Column, words: Column) -> dict[str, Column]:
    """The rates of a chunk: compute over its length, words over its length, words over compute; 0 of nothing."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {"chunk_duration_seconds": length, "transcription_seconds": compute, "chunk_rtf": ratio(compute, length), "word_count": words, "speech_rate": ratio(words, length), "processing_rate": ratio(words, compute)}


def of_changes(changes: Column, corrected: Column) -> dict[str, Column]:
    return {"change_count": F.size(changes), "changes": changes, "corrected_preview": preview(corrected)}


def lines(rows: DataFrame, kind: str, fields: dict[str, Column], session: str = "session", at: str = "ts") -> DataFrame:
    """session, line: one line of the kind for each row; fields that are null or not given are left out.

    Only config has fields of any name. Lists of violations are cut to the first ten.
    """
    if kind not in FIELDS:
        raise ValueError(f"unknown kind of event: {kind}")
    known = FIELDS[kind]
    if unknown := set(fields) - set(known) if known else set():
        raise ValueError(f"{kind} has no fields {sorted(unknown)}")

    def written(name: str, value: Column) -> Column:
        kind_, _, digits = known.get(name, "").partition(" ")
        if digits:
            value = F.bround(value.cast("double"), int(digits))
        if name == "violations":
            value = F.slice(value, 1, MOST_VIOLATIONS)
        return value.alias(name)

    body = F.struct(F.lit(kind).alias("event"), F.col(at).cast("string").alias("ts"), *[written(n, c) for n, c in fields.items()])
    return rows.select(F.col(session).alias("session"), F.to_json(body).alias("line"))


def parsed(logs: DataFrame) -> DataFrame:
    """session, event, ts, body of lines (session, line); blank lines are none. A line that is no JSON object, or
    whose object names no event, has a null event, and no body if it is no JSON at all."""
    told = logs.where(F.trim("line") != "").select("session", F.try_parse_json("line").alias("body"))
    field = lambda name: F.when(F.schema_of_variant("body").startswith("OBJECT"), F.try_variant_get("body", f"$.{name}", "string"))
    return told.select("session", field("event").alias("event"), field("ts").alias("ts"), "body")


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """session, ts and the kind's fields with their types; a field that is missing or of another type is null."""
    typed = [F.try_variant_get("body", f"$.{name}", of.split(" ")[0]).alias(name) for name, of in FIELDS[kind].items()]
    return events.where(F.col("event") == kind).select("session", "ts", *typed, *([] if FIELDS[kind] else ["body"]))


def told(events: DataFrame) -> DataFrame:
    """session, kind, field, txt, num: every field that an event of a known kind tells, by one pass over the lines:
    texts as they are, numbers, the lengths of lists, and 1 for an object."""

    def value(name: str, of: str) -> Column:
        found = F.try_variant_get("body", f"$.{name}", of.split(" ")[0])
        number = F.size(found) if of.startswith("array") else F.when(found.isNotNull(), 1) if of == _OBJECT else found
        text = of == "string"
        return F.struct(F.lit(name).alias("field"), (found if text else F.lit(None)).cast("string").alias("txt"), (F.lit(None) if text else number).cast("double").alias("num"))

    of_kinds = [F.when(F.col("event") == kind, F.array(*[value(n, of) for n, of in fields.items()])) for kind, fields in FIELDS.items() if fields]
    each = events.select("session", F.col("event").alias("kind"), F.explode(F.coalesce(*of_kinds)).alias("f"))
    return each.select("session", "kind", "f.field", "f.txt", "f.num").where("txt is not null or num is not null")


def account(events: DataFrame) -> DataFrame:
    """session, lines, malformed, unknown: how many lines there are, are no events, are of a kind not known."""
    return events.groupBy("session").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("event").isNull()).alias("malformed"),
        F.count_if(F.col("event").isNotNull() & ~F.col("event").isin(list(FIELDS))).alias("unknown"),
    )


def lowest_words(chunks: DataFrame) -> DataFrame:
    """session, word, probability of the words that chunk events list."""
    each = chunks.select("session", F.explode("lowest_conf_words").alias("w"))
    return each.select("session", F.lower(F.col("w")[0]).alias("word"), F.col("w")[1].try_cast("double").alias("probability")).where("word is not null")
