"""Queries over session logs whose lines are written by kind and read back from their text.

Every event of the table is written as a line of one of the kinds; some lines are cut off, some are JSON but no
events, some of a kind that is not known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import events as V
from scriptorium.plans.registry import query, table

#: For each kind its fields' values: an expression in Spark, and what is read back, in SQL (a number or a text;
#: of lists their length). Fields made from words, times and changes follow below.
_GIVEN = {
    "session_start": {"audio_file": ("concat('a', user_id, '.wav')", "'a' || user_id || '.wav'"), "timestamp": ("cast(event_id as string)", "event_id::VARCHAR")},
    "audio_prepared": {"duration_seconds": ("abs(value)", "round_even(abs(value), 2)"), "chunks": ("event_id % 9", "event_id % 9"), "enhancement": ("named_struct('gain', 2)", "1")},
    "correction_attempted": {"segment_id": ("event_id", "event_id"), "original_preview": ("event_type", "event_type"), "low_conf_regions": ("user_id % 4", "user_id % 4")},
    "correction_rejected": {"segment_id": ("event_id", "event_id"), "reason": ("event_type", "event_type"), "violations": ("transform(sequence(1, cast(event_id % 23 + 1 as int)), i -> cast(i as string))", "least(10, event_id % 23 + 1)"), "details": ("if(user_id % 2 = 0, named_struct('n', 1), null)", "CASE WHEN user_id % 2 = 0 THEN 1 END")},
    "vocabulary_used": {"domain": ("event_type", "event_type"), "term_count": ("user_id", "user_id"), "terms_matched": ("array(event_type, 'b')", "2")},
    "learning_candidates": {"total_candidates": ("event_id % 50", "event_id % 50"), "accepted": ("array('x')", "1"), "rejected_hallucinated": ("array_repeat('y', cast(event_id % 3 as int))", "event_id % 3")},
    "pass_complete": {"pass_number": ("event_id % 3 + 1", "event_id % 3 + 1"), "model": ("event_type", "event_type"), "segments_modified": ("user_id", "user_id"), "api_tokens": ("if(user_id % 2 = 0, event_id, null)", "CASE WHEN user_id % 2 = 0 THEN event_id END")},
    "error": {"error_type": ("event_type", "event_type"), "message": ("concat('\"', event_id, '\"')", "'\"' || event_id || '\"'"), "details": ("named_struct('a', array(1))", "1")},
    "transcription_complete": {"elapsed_seconds": ("abs(value) * 3", "round_even(abs(value) * 3, 2)"), "chunks": ("event_id % 7", "event_id % 7"), "segments": ("event_id", "event_id")},
    "session_complete": {"total_words": ("event_id * 1000000", "event_id * 1000000"), "low_conf_pct": ("abs(value)", "round_even(abs(value), 1)"), "corrections_applied": ("user_id", "user_id"), "correction_acceptance_rate": ("if(user_id % 2 = 0, 50.0D, null)", "CASE WHEN user_id % 2 = 0 THEN 50.0 END")},
    "serialization_error": {"error": ("event_type", "event_type"), "original_event_type": ("'config'", "'config'")},
}
#: A chunk has as many words as the event's number says modulo 4, all of one probability; times and changes follow.
_MADE = {
    "chunk_transcribed": {"chunk_id": "event_id", "word_count": "event_id % 4", "low_conf_count": "CASE WHEN user_id % 3 = 0 THEN event_id % 4 ELSE 0 END", "low_conf_pct": "CASE WHEN user_id % 3 = 0 AND event_id % 4 > 0 THEN 100 ELSE 0 END", "avg_confidence": "CASE WHEN event_id % 4 = 0 THEN 0 WHEN user_id % 3 = 0 THEN 0.5 ELSE 0.75 END", "lowest_conf_words": "event_id % 4"},
    "chunk_timing": {"chunk_index": "event_id", "chunk_duration_seconds": "event_id % 5", "transcription_seconds": "2.0", "chunk_rtf": "CASE WHEN event_id % 5 > 0 THEN round_even(2.0::DOUBLE / (event_id % 5), 4) ELSE 0 END", "word_count": "user_id", "speech_rate": "CASE WHEN event_id % 5 > 0 THEN round_even(user_id::DOUBLE / (event_id % 5), 2) ELSE 0 END", "processing_rate": "round_even(user_id / 2.0::DOUBLE, 2)"},
    "segment_created": {"segment_id": "event_id", "text_preview": "CASE WHEN event_id % 2 = 0 THEN repeat('x', 100) || '...' ELSE event_type END", "word_count": "user_id"},
    "correction_applied": {"segment_id": "event_id", "change_count": "event_id % 3", "changes": "event_id % 3", "corrected_preview": "CASE WHEN event_id % 2 = 0 THEN repeat('x', 100) || '...' ELSE event_type END"},
}
_KINDS = [*V.FIELDS, "odd"]


def _made(kind):
    """The fields that the operators make of words, times, texts and changes."""
    i, long_ = F.col("event_id"), F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 120)).otherwise(F.col("event_type"))
    if kind == "chunk_transcribed":
        word = F.struct(F.lit("W").alias("word"), F.when(F.col("user_id") % 3 == 0, 0.5).otherwise(0.75).alias("probability"))
        return {"chunk_id": i, **V.of_words(F.array_repeat(word, (i % 4).cast("int")))}
    if kind == "chunk_timing":
        return {"chunk_index": i, **V.of_times((i % 5).cast("double"), F.lit(2.0), F.col("user_id"))}
    if kind == "segment_created":
        return {"segment_id": i, "text_preview": V.preview(long_), "word_count": F.col("user_id")}
    change = F.struct(F.lit("a").alias("original"), F.lit("b").alias("corrected"), F.lit("c").alias("reason"))
    return {"segment_id": i, **V.of_changes(F.array_repeat(change, (i % 3).cast("int")), long_)}


def _lines(spark, sf_dir) -> DataFrame:
    """session (user and event, so that rows can be told), line."""
    rows = table(spark, sf_dir, "events").withColumn("session", F.concat_ws("/", "user_id", "event_id"))
    of = lambda k: rows.where(F.col("event_id") % len(_KINDS) == k)
    written = []
    for k, kind in enumerate(_KINDS):
        if kind == "odd":
            written.append(of(k).select("session", F.to_json(F.struct(F.lit("odd").alias("event"))).alias("line")))
            continue
        fields = _made(kind) if kind in _MADE else {n: F.expr(s) for n, (s, _) in _GIVEN.get(kind, {}).items()}
        written.append(V.lines(of(k), kind, fields or {"any": F.col("event_type")}))
    whole = reduce(DataFrame.unionByName, written)
    i = F.split_part("session", F.lit("/"), F.lit(2)).cast("long")
    cut = F.when(i % 19 == 3, F.left("line", F.lit(9))).when(i % 19 == 4, F.concat(F.lit("["), "line", F.lit("]"))).when(i % 19 == 5, F.lit(" ")).otherwise(F.col("line"))
    return whole.withColumn("line", cut)


def _expected():
    sound = "event_id % 19 NOT IN (3, 4, 5)"
    parts = []
    for k, kind in enumerate(_KINDS):
        fields = _MADE.get(kind) or {n: s for n, (_, s) in _GIVEN.get(kind, {}).items()}
        for name, sql in fields.items():
            text = V.FIELDS[kind][name] == "string"
            number = "NULL::DOUBLE" if text else f"({sql})::DOUBLE"
            parts.append(f"SELECT event_id, '{kind}' AS kind, '{name}' AS field, {f'({sql})::VARCHAR' if text else 'NULL::VARCHAR'} AS txt, {number} AS num FROM events WHERE event_id % {len(_KINDS)} = {k} AND {sound}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE txt IS NOT NULL OR num IS NOT NULL"


@query("typed_events", _expected())
def typed_events(spark, sf_dir):
    """Every field of every event that the lines tell, by name: texts, numbers, and the lengths of lists."""
    whole = V.told(V.parsed(_lines(spark, sf_dir)))
    return whole.select(F.split_part("session", F.lit("/"), F.lit(2)).cast("long").alias("event_id"), "kind", "field", "txt", "num")


@query("log_account", f"SELECT user_id, count(*) AS lines, count(*) FILTER (event_id % 19 IN (3, 4)) AS malformed, count(*) FILTER (event_id % 19 NOT IN (3, 4) AND event_id % {len(_KINDS)} = {len(_KINDS) - 1}) AS unknown FROM events WHERE event_id % 19 <> 5 GROUP BY 1")
def log_account(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("session", F.split_part("session", F.lit("/"), F.lit(1)).cast("long"))
    return V.account(V.parsed(lines)).withColumnRenamed("session", "user_id")
