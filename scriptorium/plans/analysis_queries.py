"""Queries over transcripts, intervals, logs, texts and learning queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import intervals as I
from scriptorium.operators import learning as L
from scriptorium.operators import logs as G
from scriptorium.operators import order as O
from scriptorium.operators import prompts as P
from scriptorium.operators import render as N
from scriptorium.operators import transcripts as T
from scriptorium.plans.registry import query, table
from scriptorium.sources import relations as S

# ---- intervals -------------------------------------------------------------------------------

#: Events a month apart lie within minutes, so that intervals meet.
_DENSE = 'dense AS (SELECT grp, id, start / 2000 AS start, start / 2000 + ("end" - start) / 10 AS "end" FROM intervals)'


def dense(spark, sf_dir):
    rows = S.intervals(spark, sf_dir)
    return rows.select("grp", "id", (F.col("start") / 2000).alias("start"), (F.col("start") / 2000 + (F.col("end") - F.col("start")) / 10).alias("end"))


def _six(df, *columns):
    return df.select(*columns, F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_SIX = 'round(start, 6) AS start, round("end", 6) AS "end"'
_ISLANDS = ('SELECT grp, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY grp, island')


@query("vad_gap_merge", S.with_relations("intervals", f'WITH {_DENSE}, marked AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY grp ORDER BY start, "end") < 0.5 THEN 0 ELSE 1 END AS fresh FROM dense), m AS ({_ISLANDS}) SELECT grp, n, {_SIX} FROM m'))
def vad_gap_merge(spark, sf_dir):
    return _six(I.merge_gaps(dense(spark, sf_dir)), "grp", "n")


@query("pad_merge", S.with_relations("intervals", f'WITH {_DENSE}, wide AS (SELECT grp, greatest(0.0::DOUBLE, start - 0.15::DOUBLE) AS start, "end" + 0.15::DOUBLE AS "end" FROM dense), '
       'marked AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY grp ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM wide), ' + f"m AS ({_ISLANDS}) SELECT grp, n, {_SIX} FROM m"))
def pad_merge(spark, sf_dir):
    return _six(I.pad_and_merge(dense(spark, sf_dir)), "grp", "n")


@query("session_gaps", S.with_relations("intervals", "WITH marked AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 14400 THEN 0 ELSE 1 END AS fresh FROM intervals WINDOW w AS (PARTITION BY grp ORDER BY start, id)) "
       "SELECT grp, session, count(*) AS n, round(max(start) - min(start), 3) AS length FROM (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY start, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM marked) GROUP BY grp, session"))
def session_gaps(spark, sf_dir):
    found = I.sessions(S.intervals(spark, sf_dir), "grp", "start", 14_400.0)
    return found.select("grp", F.col("session").cast("long").alias("session"), "n", F.round(F.col("last") - F.col("first"), 3).alias("length"))


_GREEDY = f'''WITH RECURSIVE {S.SQL["intervals"]}, {_DENSE},
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY start, "end") AS n FROM dense),
fold AS (
  SELECT grp, n, 0 AS pos, start, "end" FROM o WHERE n = 1
  UNION ALL
  SELECT o.grp, o.n, CASE WHEN j THEN pos ELSE pos + 1 END, CASE WHEN j THEN cs ELSE o.start END, o."end"
  FROM (SELECT o.*, f.pos, f.start AS cs, f."end" AS ce,
    o.start - f."end" <= 2.0 AND o."end" - f.start <= 60.0 AND (f."end" - f.start < 20.0 OR o."end" - o.start < 20.0 OR f."end" - f.start < 15.0 OR o."end" - o.start < 3.0) AS j
    FROM fold f JOIN o ON o.grp = f.grp AND o.n = f.n + 1) o),
merged AS (SELECT grp, pos, min(start) AS start, arg_max("end", n) AS "end" FROM fold GROUP BY grp, pos)'''


@query("greedy_merge", _GREEDY + f" SELECT grp, pos, {_SIX} FROM merged")
def greedy_merge(spark, sf_dir):
    return _six(I.merge_small(dense(spark, sf_dir), floor=False), "grp", "pos")


@query("greedy_merge_floor", _GREEDY + f''',
m AS (SELECT *, count(*) OVER (PARTITION BY grp) AS total FROM merged),
pass AS (
  SELECT grp, pos, total, CASE WHEN total > 1 AND "end" - start < 10 THEN 0 ELSE 1 END AS done, 1 AS g, start AS s, start, "end" FROM m WHERE pos = 0
  UNION ALL
  SELECT m.grp, m.pos, m.total,
    CASE WHEN m."end" - coalesce(w, m.start) < 10 AND (done > 0 OR m.pos < m.total - 1) THEN done ELSE done + 1 END,
    CASE WHEN m."end" - coalesce(w, m.start) < 10 AND done > 0 THEN done ELSE done + 1 END,
    coalesce(w, m.start), m.start, m."end"
  FROM (SELECT m.*, p.done, CASE WHEN p.done = 0 THEN p.s END AS w FROM pass p JOIN m ON m.grp = p.grp AND m.pos = p.pos + 1) m)
SELECT grp, (g - 1)::INT AS pos, round(min(s), 6) AS start, round(arg_max("end", pos), 6) AS "end" FROM pass GROUP BY grp, g''')
def greedy_merge_floor(spark, sf_dir):
    return _six(I.merge_small(dense(spark, sf_dir)), "grp", "pos")


@query("merge_segments", f'''WITH RECURSIVE {S.SQL["intervals"]}, {_DENSE},
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY start, id) AS n FROM dense),
fold AS (
  SELECT grp, n, id, true AS kept, "end" AS upto FROM o WHERE n = 1
  UNION ALL
  SELECT grp, n, id, k, CASE WHEN k THEN "end" ELSE upto END FROM (
    SELECT o.*, f.upto, o."end" - o.start <= 0 OR greatest(0.0::DOUBLE, f.upto - o.start) <= 0.5::DOUBLE * (o."end" - o.start) AS k FROM fold f JOIN o ON o.grp = f.grp AND o.n = f.n + 1))
SELECT grp, id, (row_number() OVER (PARTITION BY grp ORDER BY n) - 1)::INT AS segment FROM fold WHERE kept''')
def merge_segments(spark, sf_dir):
    return I.drop_overlapping(dense(spark, sf_dir)).select("grp", "id", "segment")


@query("duration_batches", f'''WITH RECURSIVE {S.SQL["segments"]},
o AS (SELECT *, "end" - start AS d, row_number() OVER (PARTITION BY transcript ORDER BY segment) AS n FROM segments),
fold AS (
  SELECT transcript, segment, n, 0 AS batch, 1 AS size, d AS length FROM o WHERE n = 1
  UNION ALL
  SELECT transcript, segment, n, CASE WHEN c THEN batch + 1 ELSE batch END, CASE WHEN c THEN 1 ELSE size + 1 END, CASE WHEN c THEN d ELSE length + d END FROM (
    SELECT o.*, f.batch, f.size, f.length, (f.length + o.d > 30 OR f.size >= 10) AND f.size >= 3 AS c FROM fold f JOIN o ON o.transcript = f.transcript AND o.n = f.n + 1))
SELECT transcript, segment, batch FROM fold''')
def duration_batches(spark, sf_dir):
    return I.duration_batches(S.segments(spark, sf_dir))


@query("chunk_split", S.with_relations("intervals", f'WITH {_DENSE}, c AS (SELECT *, CASE WHEN (id % 10) / 10 > 0.35 THEN 3.0 ELSE 6.0 END::DOUBLE AS cap, "end" - start AS length FROM dense), '
       "s AS (SELECT *, unnest(generate_series(0, CASE WHEN length <= cap THEN 0 ELSE ceil((length - cap) / (cap - 2))::BIGINT END)) AS part FROM c WHERE length > 0) "
       'SELECT id, part::INT AS part, round(start + part * (cap - 2), 6) AS start, round(least("end", start + part * (cap - 2) + cap), 6) AS "end" FROM s'))
def chunk_split(spark, sf_dir):
    found = I.split_long(dense(spark, sf_dir), (F.col("id") % 10) / 10, easy=6.0, hard=3.0)
    return found.select("id", "part", F.round("part_start", 6).alias("start"), F.round("part_end", 6).alias("end"))


#: Recordings end a little before the last speech does; one in seven has none that was found.
_RECORDINGS = 'recordings AS (SELECT grp, max("end") - 0.05::DOUBLE AS total FROM dense GROUP BY grp)'
_HEARD = f"""{_DENSE}, {_RECORDINGS}, found AS (SELECT * FROM dense WHERE grp % 7 <> 6),
a AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY grp ORDER BY start, "end") < 0.5 THEN 0 ELSE 1 END AS fresh FROM found),
closed AS ({_ISLANDS.replace("marked", "a")}),
wide AS (SELECT grp, greatest(0.0::DOUBLE, start - 0.15::DOUBLE) AS start, least("end" + 0.15::DOUBLE, total) AS "end" FROM closed JOIN recordings USING (grp)),
b AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY grp ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM wide),
heard AS (SELECT grp, start, "end" FROM ({_ISLANDS.replace("marked", "b")}) UNION ALL SELECT grp, 0.0::DOUBLE, total FROM recordings ANTI JOIN found USING (grp))"""


def _heard(spark, sf_dir):
    rows = dense(spark, sf_dir)
    recordings = rows.groupBy("grp").agg((F.max("end") - 0.05).alias("total"))
    return I.speech_segments(rows.where("grp % 7 != 6"), recordings), recordings


@query("speech_segments", S.with_relations("intervals", f"WITH {_HEARD} SELECT grp, {_SIX} FROM heard"))
def speech_segments(spark, sf_dir):
    return _six(_heard(spark, sf_dir)[0], "grp")


@query("chunks", f"""WITH RECURSIVE {S.SQL["intervals"]}, {_HEARD},
o AS (SELECT *, (floor(start)::BIGINT % 10) / 10.0::DOUBLE AS difficulty, row_number() OVER w AS n, count(*) OVER (PARTITION BY grp) AS m FROM heard JOIN recordings USING (grp) WINDOW w AS (PARTITION BY grp ORDER BY start, "end")),
fold AS (
  SELECT grp, 0::BIGINT AS n, NULL::DOUBLE AS upto, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e, 0.0::DOUBLE AS cap, 0.0::DOUBLE AS difficulty, 0.0::DOUBLE AS total, false AS kept FROM recordings
  UNION ALL
  SELECT grp, n, CASE WHEN kept THEN last + (least(floor(e * 16000), floor(total * 16000)) - floor(last * 16000)) / 16000 ELSE upto END, s, e, cap, difficulty, total, kept FROM (
    SELECT *, s + CASE WHEN e - s <= cap THEN 0 ELSE ceil((e - s - cap) / (cap - 2)) END * (cap - 2) AS last, e - s > 0 AS kept FROM (
      SELECT o.grp, o.n, f.upto, o.total, o.difficulty, CASE WHEN o.difficulty > 0.35::DOUBLE THEN 3.0::DOUBLE ELSE 6.0::DOUBLE END AS cap,
        CASE WHEN o.n > 1 AND (f.upto IS NULL OR greatest(0.0::DOUBLE, o.start - 0.25::DOUBLE) >= f.upto - 0.1::DOUBLE) THEN greatest(0.0::DOUBLE, o.start - 0.25::DOUBLE) ELSE o.start END AS s,
        CASE WHEN o.n < o.m THEN least(o.total, o."end" + 0.25::DOUBLE) ELSE o."end" END AS e
      FROM fold f JOIN o ON o.grp = f.grp AND o.n = f.n + 1))),
parts AS (SELECT *, unnest(range(CASE WHEN e - s <= cap THEN 1 ELSE ceil((e - s - cap) / (cap - 2))::BIGINT + 1 END)) AS part FROM fold WHERE kept),
pieces AS (SELECT *, s + part * (cap - 2) AS start, least(s + part * (cap - 2) + cap, e) AS stop FROM parts)
SELECT grp, (row_number() OVER (PARTITION BY grp ORDER BY n, part) - 1)::INT AS chunk, round(start, 6) AS start, round((least(floor(stop * 16000), floor(total * 16000)) - floor(start * 16000)) / 16000, 7) AS length, difficulty
FROM pieces""")
def chunks(spark, sf_dir):
    heard, recordings = _heard(spark, sf_dir)
    rows = heard.join(recordings, "grp").withColumn("difficulty", F.floor("start") % 10 / 10)
    return I.chunks(rows, cap=6.0, hard=3.0).select("grp", "chunk", F.round("start", 6).alias("start"), F.round("length", 7).alias("length"), "difficulty")


@query("chunk_difficulty_by_speech", """SELECT vec_id, CASE WHEN len(p) = 0 THEN round(least(1.0, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) - 0.2) / 0.2), 6)
  ELSE round(least(1.0, greatest(0.0, (1 - list_sum(p) / len(p)) * 0.5 + (list_sum(list_transform(p, lambda x: x * x)) / len(p) - (list_sum(p) / len(p)) ** 2) * 0.5)), 6) END AS difficulty
FROM (SELECT *, CASE WHEN vec_id % 5 = 0 THEN []::DOUBLE[] ELSE list_transform(embedding, lambda x: least(1.0::DOUBLE, abs(x::DOUBLE) * 4)) END AS p FROM embeddings)""")
def chunk_difficulty_by_speech(spark, sf_dir):
    samples = F.col("embedding").cast("array<double>")
    speech = F.when(F.col("vec_id") % 5 != 0, F.transform(samples, lambda x: F.least(F.lit(1.0), F.abs(x) * 4)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(I.difficulty_of(samples, speech), 6).alias("difficulty"))


@query("chunk_difficulty", "SELECT vec_id, round(least(1.0, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) - 0.2) / 0.2), 6) AS difficulty FROM embeddings")
def chunk_difficulty(spark, sf_dir):
    samples = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(I.difficulty_of(samples), 6).alias("difficulty"))


@query("parse_result", "SELECT event_id, round(greatest(0.0, value - 20), 6) AS start, round(greatest(greatest(0.0, value - 20), value - 22), 6) AS \"end\", round(exp(greatest(-10.0, least(0.0, -value / 10))), 6) AS confidence FROM events")
def parse_result(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("event_id", I.parsed_segment(F.col("value") - 20, F.col("value") - 22, -F.col("value") / 10).alias("s"))
    return found.select("event_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("start", "end", "confidence")])


# ---- transcripts -----------------------------------------------------------------------------

_NESTED_WORDS = "spoken AS (SELECT transcript, segment, list({'word': word, 'confidence': confidence} ORDER BY pos) AS ws FROM words GROUP BY 1, 2)"


def spoken(spark, sf_dir):
    each = F.struct("pos", "word", "confidence")
    listed = S.words(spark, sf_dir).groupBy("transcript", "segment").agg(F.sort_array(F.collect_list(each)).alias("ws"))
    return listed.withColumn("ws", F.transform("ws", lambda w: F.struct(w["word"].alias("word"), w["confidence"].alias("confidence"))))


@query("segments", S.with_relations("segments", 'SELECT transcript, segment, speaker, n_words, round(start, 3) AS start, round("end", 3) AS "end" FROM segments'))
def segments(spark, sf_dir):
    return S.segments(spark, sf_dir).select("transcript", "segment", "speaker", "n_words", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("context_window", S.with_relations("segments", "SELECT transcript, segment, coalesce(string_agg(trim(text), ' ' ORDER BY segment) OVER (PARTITION BY transcript ORDER BY segment ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, "
       "coalesce(string_agg(trim(text), ' ' ORDER BY segment) OVER (PARTITION BY transcript ORDER BY segment ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM segments"))
def context_window(spark, sf_dir):
    return T.context_windows(S.segments(spark, sf_dir), 2).select("transcript", "segment", "before", "after")


def _rolling_sql(chars):
    return S.with_relations("segments", r"WITH said AS (SELECT transcript, segment, list_filter(string_split_regex(coalesce(string_agg(trim(text), ' ' ORDER BY segment) OVER (PARTITION BY transcript ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '\s+'), lambda w: w <> '') AS ws FROM segments) "
        rf"SELECT transcript, segment, trim(right(array_to_string(ws[greatest(1, len(ws) - 99):], ' '), {chars})) AS context FROM said")


@query("rolling_context", _rolling_sql(500))
def rolling_context(spark, sf_dir):
    return T.rolling_context(S.segments(spark, sf_dir)).select("transcript", "segment", "context")


@query("rolling_context_short", _rolling_sql(400))
def rolling_context_short(spark, sf_dir):
    return T.rolling_context(S.segments(spark, sf_dir), most_chars=400).select("transcript", "segment", "context")


_CAP = r"regexp_matches({0}, '^\p{{Lu}}')"
@query("low_conf_spans", S.with_relations("segments words", rf"""WITH t AS (SELECT *, {_CAP.format('word')} AS capital, confidence < 0.7 AS low FROM words),
  u AS (SELECT *, low OR ((length(word) = 1 AND capital AND word NOT IN ('I', 'A') OR length(word) = 2 AND capital) AND (coalesce(lag(low) OVER w, false) OR coalesce(lead(low) OVER w, false))) AS m0 FROM t WINDOW w AS (PARTITION BY transcript, segment ORDER BY pos)),
  -- a mark spreads left through capitalized words: the nearest unbroken capitalized run to the right that has a mark
  v AS (SELECT *, sum(CASE WHEN capital THEN 0 ELSE 1 END) OVER (PARTITION BY transcript, segment ORDER BY pos) AS run FROM u),
  x AS (SELECT *, m0 OR (capital AND coalesce(bool_or(m0 AND capital) OVER (PARTITION BY transcript, segment, run, capital ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)) AS mark FROM v),
  y AS (SELECT *, mark AND NOT coalesce(lag(mark) OVER w, false) AS opens, mark AND NOT coalesce(lead(mark) OVER w, false) AS closes FROM x WINDOW w AS (PARTITION BY transcript, segment ORDER BY pos))
  SELECT transcript, segment, string_agg(CASE WHEN opens THEN '[?' ELSE '' END || word || CASE WHEN closes THEN '?]' ELSE '' END, ' ' ORDER BY pos) AS marked FROM y GROUP BY 1, 2"""))
def low_conf_spans(spark, sf_dir):
    return spoken(spark, sf_dir).select("transcript", "segment", T.mark_spans(F.col("ws")).alias("marked"))


@query("doubtful_words", S.with_relations("segments words", "SELECT transcript, segment, word, round_even(confidence, 2)::DOUBLE AS confidence FROM words WHERE confidence < 0.9"))
def doubtful_words(spark, sf_dir):
    return spoken(spark, sf_dir).select("transcript", "segment", F.inline(T.doubtful_words(F.col("ws"))))


@query("confident_words", S.with_relations("segments words", "SELECT transcript, segment, pos, word FROM words WHERE confidence >= 0.95"))
def confident_words(spark, sf_dir):
    return T.confident_words(S.words(spark, sf_dir), 0.95).select("transcript", "segment", F.col("pos").cast("long").alias("pos"), "word")


@query("segment_confidence", S.with_relations("segments words", "SELECT transcript, segment, round(avg(confidence), 6) AS confidence FROM words GROUP BY 1, 2"))
def segment_confidence(spark, sf_dir):
    return S.words(spark, sf_dir).groupBy("transcript", "segment").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


@query("out_of_order", S.with_relations("segments", 'WITH s AS (SELECT transcript, segment, "end" - start AS start FROM segments) SELECT transcript, segment FROM (SELECT *, lead(start) OVER (PARTITION BY transcript ORDER BY segment) AS nxt FROM s) WHERE start > nxt'))
def out_of_order(spark, sf_dir):
    return T.out_of_order(S.segments(spark, sf_dir).withColumn("start", F.col("end") - F.col("start"))).select("transcript", "segment")


@query("apply_fixes", S.with_relations("segments", "WITH f AS (SELECT transcript, (segment // 2) * 2 AS segment, arg_max(lower(text), segment) AS corrected FROM segments WHERE transcript % 3 = 0 GROUP BY 1, 2) SELECT s.transcript, s.segment, coalesce(corrected, text) AS text, corrected IS NOT NULL AS changed FROM segments s LEFT JOIN f USING (transcript, segment)"))
def apply_fixes(spark, sf_dir):
    rows = S.segments(spark, sf_dir)
    fixes = rows.where("transcript % 3 = 0").select("transcript", (F.floor(F.col("segment") / 2) * 2).alias("segment"), F.lower("text").alias("corrected"), F.col("segment").alias("pos"))
    return T.apply_fixes(rows, fixes).select("transcript", "segment", "text", "changed")


_MS = "(floor({0}) * 1000 + round_even(({0} - floor({0})) * 1000, 0))::BIGINT"
def _clock(x, mark):
    ms = _MS.format(x)
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query("time_format", f"SELECT event_id, {_clock('abs(value) * 37', ',')} AS srt, {_clock('abs(value) * 37', '.')} AS vtt FROM events")
def time_format(spark, sf_dir):
    seconds = F.abs("value") * 37
    return table(spark, sf_dir, "events").select("event_id", N.time_text(seconds, ",").alias("srt"), N.time_text(seconds).alias("vtt"))


@query("render_srt", S.with_relations("segments", f"SELECT transcript, string_agg(n || chr(10) || {_clock('start', ',')} || ' --> ' || {_clock(chr(34) + 'end' + chr(34), ',')} || chr(10) || trim(replace(replace(text, chr(13), ''), chr(10), ' ')), chr(10) || chr(10) ORDER BY segment) || chr(10) AS body "
       "FROM (SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY segment) AS n FROM segments WHERE trim(text) <> '') GROUP BY 1"))
def render_srt(spark, sf_dir):
    return N.render(S.segments(spark, sf_dir), ".SRT")


@query("render_vtt", S.with_relations("segments", f"SELECT transcript, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('start', '.')} || ' --> ' || {_clock(chr(34) + 'end' + chr(34), '.')} || chr(10) || trim(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ')), chr(10) || chr(10) ORDER BY segment) || chr(10) AS body "
       "FROM segments WHERE trim(text) <> '' GROUP BY 1"))
def render_vtt(spark, sf_dir):
    return N.render(S.segments(spark, sf_dir), "vtt")


_MD = r"regexp_replace({0}, '([\\`*_{{}}\[\]()#+\-.!|>~])', '\\\1', 'g')"
_HMS = "CASE WHEN {0} // 3600000 > 0 THEN printf('%02d:%02d:%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60) ELSE printf('%02d:%02d', {0} // 60000 % 60, {0} // 1000 % 60) END".format(_MS.format("start"))
@query("render_markdown", S.with_relations("segments", f"SELECT transcript, '# Transcript' || chr(10) || chr(10) || string_agg('[' || {_HMS} || '] **' || {_MD.format('trim(speaker)')} || ':** ' || {_MD.format('trim(text)')}, chr(10) || chr(10) ORDER BY segment) || chr(10) AS body FROM segments WHERE trim(text) <> '' GROUP BY 1"))
def render_markdown(spark, sf_dir):
    return N.render(S.segments(spark, sf_dir), "md")


@query("render_text", S.with_relations("segments", "SELECT transcript, string_agg(trim(text), chr(10) ORDER BY segment) AS body FROM segments WHERE trim(text) <> '' GROUP BY 1"))
def render_text(spark, sf_dir):
    return N.render(S.segments(spark, sf_dir), "txt")


@query("estimate_tokens", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS n FROM documents")
def estimate_tokens(spark, sf_dir):
    return S.texts(spark, sf_dir).select("doc_id", P.estimate_tokens(F.col("text")).cast("long").alias("n"))


# ---- logs ------------------------------------------------------------------------------------

_SESSIONS = ("s AS (SELECT session, count(*) FILTER (WHERE event = 'chunk_transcribed') AS chunks, coalesce(sum(n) FILTER (WHERE event = 'chunk_transcribed'), 0)::BIGINT AS words, count(*) FILTER (WHERE event = 'segment_created') AS segments, "
             "coalesce(sum(n) FILTER (WHERE event = 'correction_applied'), 0)::BIGINT AS applied, count(*) FILTER (WHERE event = 'correction_rejected') AS rejected, avg(value) FILTER (WHERE event = 'chunk_transcribed') AS avg_value FROM log_events GROUP BY 1)")


@query("log_sessions", S.with_relations("log_events", f"WITH {_SESSIONS} SELECT session, chunks, words, segments, applied, rejected, round(avg_value, 6) AS avg_value FROM s"))
def log_sessions(spark, sf_dir):
    return G.sessions(S.log_events(spark, sf_dir)).drop("acceptance").withColumn("avg_value", F.round("avg_value", 6))


@query("acceptance_rate", S.with_relations("log_events", f"WITH {_SESSIONS} SELECT session, applied * 1000 // (applied + rejected) AS per_mille, round(applied * 100.0 / (applied + rejected), 1)::DOUBLE AS percent FROM s WHERE applied + rejected > 0"))
def acceptance_rate(spark, sf_dir):
    found = G.sessions(S.log_events(spark, sf_dir))
    whole = F.col("applied") + F.col("rejected")
    return found.where(whole > 0).select("session", F.floor(F.col("applied") * 1000 / whole).alias("per_mille"), G.rate(F.col("applied"), whole).alias("percent"))


@query("log_analysis", S.with_relations("log_events", f"WITH {_SESSIONS} SELECT count(*) AS sessions, sum(words)::BIGINT AS words, sum(applied)::BIGINT AS applied, sum(rejected)::BIGINT AS rejected, round(avg(avg_value), 6) AS avg_value FROM s"))
def log_analysis(spark, sf_dir):
    return G.analysis(G.sessions(S.log_events(spark, sf_dir))).withColumn("avg_value", F.round("avg_value", 6))


@query("low_conf_words", S.with_relations("segments words", "SELECT lower(word) AS word, count(*) AS n FROM words WHERE confidence < 0.3 GROUP BY 1 ORDER BY n DESC, word LIMIT 20"))
def low_conf_words(spark, sf_dir):
    return G.frequent_doubts(S.words(spark, sf_dir), 0.3, 20)


@query("log_chunk_once", S.with_relations("log_events", "SELECT event, count(*) AS n FROM (SELECT DISTINCT session, n, event FROM log_events WHERE event = 'chunk_transcribed' UNION ALL SELECT session, n, event FROM log_events WHERE event <> 'chunk_transcribed') GROUP BY 1"))
def log_chunk_once(spark, sf_dir):
    events = S.log_events(spark, sf_dir).withColumnRenamed("n", "start_time")
    return G.once(events).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("session_detail", S.with_relations("log_events", "SELECT session, event, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_id) AS k FROM log_events WHERE event = 'correction_rejected') WHERE k = 1"))
def session_detail(spark, sf_dir):
    return G.first_completion(S.log_events(spark, sf_dir).where("event = 'correction_rejected'")).select("session", "event", "event_id")


@query("newest_sessions", S.with_relations("log_events", "SELECT session, count(*) AS n FROM log_events WHERE session IN (SELECT DISTINCT session FROM log_events ORDER BY session DESC LIMIT 10) GROUP BY 1"))
def newest_sessions(spark, sf_dir):
    return G.newest(S.log_events(spark, sf_dir), 10).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("word_stats", S.with_relations("segments words", "SELECT transcript, segment, count(*) AS n, count(*) FILTER (WHERE confidence < 0.7) AS n_low, min(confidence) AS lowest FROM words GROUP BY 1, 2"))
def word_stats(spark, sf_dir):
    found = spoken(spark, sf_dir).select("transcript", "segment", G.word_stats(F.col("ws")).alias("s"))
    return found.select("transcript", "segment", F.col("s.n").cast("long").alias("n"), F.col("s.n_low").cast("long").alias("n_low"), F.element_at("s.lowest", 1)["confidence"].alias("lowest"))


@query("speed_ratios", "SELECT event_id, round(CASE WHEN value > 0 THEN (event_id % 50) / value ELSE 0 END, 6) AS rtf, round(CASE WHEN event_id % 50 > 0 THEN value / (event_id % 50) ELSE 0 END, 6) AS speedup FROM events")
def speed_ratios(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("event_id", G.speed((F.col("event_id") % 50).cast("double"), F.col("value")).alias("s"))
    return found.select("event_id", F.round("s.rtf", 6).alias("rtf"), F.round("s.speedup", 6).alias("speedup"))


@query("bench_summary", "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS avg_wall, round(coalesce(stddev_samp(value), 0), 6) AS stdev_wall, round(avg((event_id % 7)::DOUBLE / (event_id % 11)) FILTER (WHERE event_id % 11 > 0), 6) AS macro_wer, round(sum(event_id % 7) / sum(event_id % 11), 6) AS micro_wer FROM events GROUP BY 1")
def bench_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("wall"), F.col("user_id").alias("recorded"), (F.col("event_id") % 7).alias("errors"), (F.col("event_id") % 11).alias("n_ref"))
    return G.bench_summary(runs).select("name", "n", *[F.round(c, 6).alias(c) for c in ("avg_wall", "stdev_wall", "macro_wer", "micro_wer")])


@query("event_lines", S.with_relations("log_events", "SELECT session, count(*) AS n, sum(n)::BIGINT AS words FROM log_events WHERE event = 'chunk_transcribed' GROUP BY 1"))
def event_lines(spark, sf_dir):
    """Events written as lines and read back."""
    rows = S.log_events(spark, sf_dir).where("event = 'chunk_transcribed'").withColumn("ts", F.lit("2001-11-01"))
    lines = G.event_lines(rows, "chunk_transcribed", {"word_count": F.col("n"), "avg_confidence": F.col("value")})
    return G.read_lines(lines).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))


# ---- texts -----------------------------------------------------------------------------------

def _norm(x):
    done = f"lower({x})"
    for pattern, by in ((r"[^\p{L}\p{N}_\s'']", " "), (r"^''+\s*", ""), (r"\s*''+$", ""), (r"\s''+\s", " "), (r"\s+''\s+", " "), (r"\s+", " ")):
        done = f"regexp_replace({done}, '{pattern}', '{by}', 'g')"
    return f"trim({done})"


@query("normalize_text", f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return S.texts(spark, sf_dir).select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


def _pairs(spark, sf_dir):
    """Each document with the next one of its language: pairs of ids first, then their texts."""
    texts = S.texts(spark, sf_dir).select("doc_id", "lang", X.normalize_text(F.col("text"), compose=False).alias("ref"))
    pairs = O.followers(S.texts(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id").where("next is not null")
    first = pairs.join(texts.drop("lang"), "doc_id")
    second = texts.select(F.col("doc_id").alias("next"), F.col("ref").alias("hyp"))
    # comparing costs far more than reading, so the last join is also what deals the pairs to tasks
    return O.spread(first, "next").join(O.spread(second, "next"), "next").drop("next")


_PAIRS = f"pairs AS (SELECT * FROM (SELECT doc_id, lang, ref, lead(ref) OVER (PARTITION BY lang ORDER BY doc_id) AS hyp FROM (SELECT doc_id, lang, array_to_string(string_split({_norm('text')}, ' '), ' ') AS ref FROM documents)) WHERE hyp IS NOT NULL)"


@query("wer_pairs")
def wer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", X.word_errors(F.col("ref"), F.col("hyp"), most=None).alias("e")).select("doc_id", "e.*")


@query("wer_counts", f"WITH {_PAIRS} SELECT doc_id, len(string_split(ref, ' ')) AS n_ref, len(string_split(hyp, ' ')) AS n_hyp FROM pairs WHERE ref <> '' AND hyp <> ''")
def wer_counts(spark, sf_dir):
    size = lambda c: F.size(X.tokens(F.col(c))).cast("long")
    return _pairs(spark, sf_dir).where("ref != '' and hyp != ''").select("doc_id", size("ref").alias("n_ref"), size("hyp").alias("n_hyp"))


#: The edit table of each pair, cell by cell: a cell is made from the one before it, the one above it and that
#: one's left neighbour; of equal costs substitution comes first, then insertion.
_NAMES = """
WITH RECURSIVE pairs AS (
  SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ') AS r,
         string_split(lower(CASE p_partkey % 5 WHEN 0 THEN p_type || ' ' || p_name WHEN 1 THEN p_name || ' new ' || p_brand WHEN 2 THEN 'the ' || p_brand || ' ' || p_type || ' of ' || p_name WHEN 3 THEN p_name || ' ' || p_brand || ' ' || p_type ELSE p_brand END), ' ') AS h
  FROM part
),
cells AS (
  SELECT id, r, h, 0 AS k, [{'d': 0, 's': 0, 'n': 0, 'x': 0}] AS t FROM pairs
  UNION ALL
  SELECT id, r, h, k + 1, list_append(t, CASE
    WHEN i = 0 THEN {'d': j, 's': 0, 'n': j, 'x': 0}
    WHEN j = 0 THEN {'d': i, 's': 0, 'n': 0, 'x': i}
    WHEN r[i] = h[j] THEN t[k + 1 - w]
    WHEN t[k + 1 - w].d <= t[k + 1].d AND t[k + 1 - w].d <= t[k + 2 - w].d THEN {'d': t[k + 1 - w].d + 1, 's': t[k + 1 - w].s + 1, 'n': t[k + 1 - w].n, 'x': t[k + 1 - w].x}
    WHEN t[k + 1].d <= t[k + 2 - w].d THEN {'d': t[k + 1].d + 1, 's': t[k + 1].s, 'n': t[k + 1].n + 1, 'x': t[k + 1].x}
    ELSE {'d': t[k + 2 - w].d + 1, 's': t[k + 2 - w].s, 'n': t[k + 2 - w].n, 'x': t[k + 2 - w].x + 1} END)
  FROM (SELECT *, len(h) + 1 AS w, ((k + 1) // (len(h) + 1))::INT AS i, ((k + 1) % (len(h) + 1))::INT AS j FROM cells WHERE k + 1 < (len(r) + 1) * (len(h) + 1))
)
SELECT id, t[-1].d::DOUBLE / len(r) AS wer, t[-1].s::BIGINT AS substitutions, t[-1].n::BIGINT AS insertions, t[-1].x::BIGINT AS deletions, len(r) AS n_ref, len(h) AS n_hyp
FROM cells WHERE k + 1 = (len(r) + 1) * (len(h) + 1)
"""


@query("wer_names", _NAMES)
def wer_names(spark, sf_dir):
    """How parts are called, against their full names: short pairs, whose whole edit tables SQL can state."""
    name, brand, kind = (F.col(c) for c in ("p_name", "p_brand", "p_type"))
    said = F.element_at(
        F.array(F.concat_ws(" ", kind, name), F.concat_ws(" ", name, F.lit("new"), brand), F.concat_ws(" ", F.lit("the"), brand, kind, F.lit("of"), name), F.concat_ws(" ", name, brand, kind), brand),
        (F.col("p_partkey") % 5 + 1).cast("int"),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", name, brand, kind)).alias("ref"), F.lower(said).alias("hyp"))
    return rows.select("id", X.word_errors(F.col("ref"), F.col("hyp"), most=None).alias("e")).select("id", "e.*")


@query("wer_averages")
def wer_averages(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("lang", X.word_errors(F.col("ref"), F.col("hyp"), most=None).alias("e")).select("lang", "e.*")
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return rows.groupBy("lang").agg(F.round(F.avg(F.when(F.col("n_ref") > 0, F.col("wer"))), 6).alias("macro"), F.round(F.try_divide(F.sum(errors), F.sum("n_ref")), 6).alias("micro"))


@query("cer_pairs")
def cer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.round(X.character_error_rate(F.col("ref"), F.col("hyp")), 6).alias("cer"))


_HTML = "coalesce(html, '')"
for _p, _b in ((r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n"), (r"<[^>]+>", "")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {'chr(10)' if _b else chr(39) * 2}, 'g')"
for _p, _b in X.ENTITIES:
    _HTML = f"replace({_HTML}, '{_p.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query("html_clean", f"""WITH l AS (SELECT page_id, list_filter(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: NOT (length(x) < 100 AND regexp_matches(lower(x), 'home|fiction|poetry|essays|letters|miscellany|about|copyright|h[.]p[.] lovecraft|return to|written|first published'))) AS ls FROM pages),
  p AS (SELECT page_id, ls, list_position(list_transform(ls, lambda x: length(x) > 50), true) AS place FROM l)
  SELECT page_id, md5(trim(regexp_replace(array_to_string(CASE WHEN place > 0 THEN ls[place:] ELSE [] END, ' '), '\\s+', ' ', 'g'))) AS digest FROM p""")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.clean_html(F.col("html"))).alias("digest"))


#: Books with either pair of markers, with one marker alone, and with none.
_BOOK = ("CASE doc_id % 5 WHEN 0 THEN 'Front' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK ***' || chr(10) || text || chr(10) || '*** END OF THE PROJECT GUTENBERG EBOOK ***' || chr(10) || 'License' "
         "WHEN 1 THEN 'Front' || chr(10) || '*** START OF THIS PROJECT GUTENBERG EBOOK' || chr(10) || text || chr(10) || '*** END OF THIS PROJECT GUTENBERG EBOOK' "
         "WHEN 2 THEN text || '*** START OF THE PROJECT GUTENBERG' WHEN 3 THEN '***START OF' || chr(10) || text || '*** END OF THE PROJECT GUTENBERG' || text ELSE text END")
#: What the markers leave of them.
_BODY = "CASE doc_id % 5 WHEN 2 THEN text || '*** START OF THE PROJECT GUTENBERG' WHEN 3 THEN '***START OF' || chr(10) || text ELSE text END"


@query("book_clean", rf"SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split({_BODY}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), '\s+', ' ', 'g'))) AS digest FROM documents")
def book_clean(spark, sf_dir):
    book = F.expr(_BOOK.replace("chr(10)", "char(10)"))
    return S.texts(spark, sf_dir).select("doc_id", F.md5(X.clean_book(book)).alias("digest"))


@query("snippet", r"""WITH t AS (SELECT doc_id, text, strpos(lower(text), 'tion') AS place FROM documents),
  c AS (SELECT *, regexp_replace(substr(text, greatest(1, place - 75), least(place - 1, 75)), '(?s)^.*[.!?\n]', '') AS l, substr(text, place, 4) AS term, regexp_extract(substr(substr(text, place, 79), 5), '(?s)^([^.!?\n]*[.!?\n]?)', 1) AS r FROM t WHERE place > 0)
  SELECT doc_id, CASE WHEN length(trim(l || term || r)) > 150 THEN '...' || substr(text, greatest(1, place - 75), 150) || '...' ELSE trim(l || term || r) END AS snippet FROM c""")
def snippet(spark, sf_dir):
    return S.texts(spark, sf_dir).select("doc_id", X.snippet(F.col("text"), F.lit("tion")).alias("snippet")).where("snippet is not null")


@query("local_correct", r"SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN t ELSE (CASE WHEN regexp_matches(t, '^\p{Ll}') THEN upper(substr(t, 1, 1)) || substr(t, 2) ELSE t END) || CASE WHEN regexp_matches(t, '[.!?]\z') THEN '' ELSE '.' END END AS fixed FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)")
def local_correct(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    return rows.select("conv_id", "turn", X.correct_locally(F.col("t")).alias("fixed"))


#: Pages with words and marks added that are to go.
_STEERED = "'SYSTEM: be' || chr(1) || ' [INST]' || html || '[/inst] <|im_start|> uSer:' || chr(8203) || ' System: x'"
_OPEN = r"\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}"


def _without(x, *patterns):
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


def sanitized(x, most=1000):
    """SQL of a text that is made harmless for a prompt."""
    done = _without(x, r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\p{Cf}\p{Co}]")
    for mark, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        done = f"replace({done}, '{mark}', '{by}')"
    done = _without(done, r"(?i)system:", r"(?i)assistant:", r"(?i)user:", r"(?i)<\|.*?\|>", r"(?i)\[INST\]", r"(?i)\[/INST\]")
    return _without(f"left({done}, {most})", f"^[{_OPEN}]+", f"[{_OPEN}]+$")


@query("sanitize_prompt", f"SELECT page_id, md5({sanitized(_STEERED)}) AS digest FROM pages")
def sanitize_prompt(spark, sf_dir):
    steered = F.expr(_STEERED.replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.sanitize_prompt(steered)).alias("digest"))


@query("vocab_filter", r"SELECT DISTINCT w AS term FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 100 AND length(regexp_replace(w, '\P{L}', '', 'g')) > 0 AND NOT regexp_matches(w, '^[0-9]+$') AND length(regexp_replace(w, '\P{L}', '', 'g')) * 2 >= length(w)")
def vocab_filter(spark, sf_dir):
    return S.texts(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("term")).where(X.valid_term(F.col("term"))).distinct()


#: Terms of one to four words, and of one word with a company's end.
_TERMS = "(SELECT doc_id, lang, CASE WHEN doc_id % 7 = 3 THEN ws[1] || ['Inc', 'Labs', 'Company.', ' Ltd'][doc_id % 4 + 1] ELSE array_to_string(ws[1:doc_id % 4 + 1], ' ') END AS t FROM (SELECT doc_id, lang, string_split_regex(text, '\\s+') AS ws FROM documents))"
@query("type_infer", rf"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'location' WHEN n BETWEEN 2 AND 4 AND regexp_matches(trim(t), '^\p{{Lu}}\S*(\s+\p{{Lu}}\S*)*$') THEN 'person' WHEN regexp_matches(t, '(Inc|LLC|Corp|Ltd|Co|Company|Technologies|Labs)$') THEN 'org' ELSE 'misc' END AS type
  FROM (SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS n FROM {_TERMS})""".replace("'\\\\s+'", "'\\s+'"))
def type_infer(spark, sf_dir):
    words = F.split("text", r"\s+")
    company = F.concat(F.get(words, 0), F.element_at(F.array(*map(F.lit, ("Inc", "Labs", "Company.", " Ltd"))), (F.col("doc_id") % 4 + 1).cast("int")))
    term = F.when(F.col("doc_id") % 7 == 3, company).otherwise(F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), " "))
    domain = F.when(F.col("lang") == "de", "places").otherwise("other")
    return S.texts(spark, sf_dir).select("doc_id", X.infer_type(term, domain).alias("type"))


_BARE = r"regexp_replace(trim(lower(w.word)), '^[.,!?;:\"'']+|[.,!?;:\"'']+$', '', 'g')".replace('\\"', '"')
@query("diff_gate", S.with_relations("segments words", rf"""WITH {_NESTED_WORDS}, g AS (SELECT s.transcript, s.segment, list_transform(list_filter(ws, lambda w: w.confidence >= 0.85), lambda w: {_BARE}) AS p,
  ' ' || regexp_replace(lower(substr(text, 40)), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' AS t, trim(substr(text, 40)) = '' AS none FROM spoken s JOIN segments USING (transcript, segment))
  SELECT transcript, segment, CASE WHEN none OR len(p) = 0 THEN true ELSE len(list_filter(p, lambda w: length(w) >= 2 AND NOT contains(t, ' ' || trim(regexp_replace(w, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' '))) < len(p) * 0.2 END AS valid FROM g"""))
def diff_gate(spark, sf_dir):
    rows = spoken(spark, sf_dir).join(S.segments(spark, sf_dir).select("transcript", "segment", "text"), ["transcript", "segment"])
    return rows.select("transcript", "segment", X.gate_correction(F.col("ws"), F.substr("text", F.lit(40))).alias("valid"))


@query("fenced_json", r"SELECT doc_id, md5(trim(text)) AS digest FROM documents WHERE NOT contains(text, '```') UNION ALL "
       r"SELECT doc_id, md5(trim(coalesce(nullif(regexp_extract(CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Here:' || chr(10) || '```json' || chr(10) || text || chr(10) || '```' END, '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), text))) FROM documents WHERE contains(text, '```')")
def fenced_json(spark, sf_dir):
    fenced = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Here:\n```json\n"), "text", F.lit("\n```\nDone.")))
    return S.texts(spark, sf_dir).select("doc_id", F.md5(X.fenced_json(fenced)).alias("digest"))


@query("parse_terms", r"SELECT doc_id, trim(string_split(x, ':')[-1]) AS term FROM (SELECT doc_id, unnest(string_split(text, ',')) AS x FROM documents) WHERE trim(string_split(x, ':')[-1]) <> ''")
def parse_terms(spark, sf_dir):
    return S.texts(spark, sf_dir).select("doc_id", F.explode(X.parse_terms(F.col("text"))).alias("term"))


# ---- learning --------------------------------------------------------------------------------

#: Capitalized words inside a line are taken for names.
_NAMES = r"names AS (SELECT doc_id AS pos, source, m AS term FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, ' (\p{Lu}\p{Ll}+)', 1)) AS m FROM documents))"


def names(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r" (\p{Lu}\p{Ll}+)"), 1)
    return S.texts(spark, sf_dir).select(F.col("doc_id").alias("pos"), "source", F.explode(found).alias("term"))


@query("pending_upsert", f"WITH {_NAMES} SELECT lower(term) AS key, count(*) AS occurrences, count(DISTINCT source) AS n_sources FROM names GROUP BY 1")
def pending_upsert(spark, sf_dir):
    rows = names(spark, sf_dir)
    early, late = rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1")
    state = L.merged(L.queue(early, F.lower("term")), L.queue(late, F.lower("term")))
    return state.select("key", "occurrences", F.size("sources").cast("long").alias("n_sources"))


@query("pending_promote", f"WITH {_NAMES} SELECT 'discovered-' || lower(term) AS id, count(*) AS occurrences FROM names GROUP BY lower(term) HAVING count(*) >= 3")
def pending_promote(spark, sf_dir):
    return L.promoted(L.queue(names(spark, sf_dir), F.lower("term"))).select("id", "occurrences")


@query("pending_rest", f"WITH {_NAMES} SELECT lower(term) AS key FROM names GROUP BY 1 HAVING count(*) < 3")
def pending_rest(spark, sf_dir):
    return L.still_pending(L.queue(names(spark, sf_dir), F.lower("term"))).select("key")


@query("alias_promotion", S.with_relations("aliases", "SELECT entry_id % 40 AS entry_id, lower(alias) AS alias, count(*) AS n, count(*) >= 3 AS promoted FROM aliases GROUP BY 1, 2"))
def alias_promotion(spark, sf_dir):
    return L.alias_counts(S.aliases(spark, sf_dir).withColumn("entry_id", F.col("entry_id") % 40))


@query("heard_terms", r"SELECT DISTINCT p_name AS term FROM part WHERE list_has_any(string_split(lower(p_name), ' '), (SELECT list(DISTINCT lower(p_brand)) || list(DISTINCT lower(split_part(p_type, ' ', 1))) || ['red', 'small'] FROM part))")
def heard_terms(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    said = parts.select(F.lower("p_brand").alias("word")).unionByName(parts.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("word")))
    said = said.unionByName(parts.sparkSession.sql("select explode(array('red', 'small')) as word"))
    return L.heard(parts.select(F.col("p_name").alias("term")).distinct(), said)


@query("vocabulary_union", "SELECT p_brand AS term FROM part UNION SELECT c_mktsegment FROM customer ORDER BY 1")
def vocabulary_union(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("term")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct().orderBy("term")


@query("vocabulary_difference", "SELECT p_name AS term FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 60 = 0)")
def vocabulary_difference(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"))
    return parts.join(parts.where("p_partkey % 60 = 0").select("term"), "term", "left_anti").select("term")


@query("deduplicated_entities", f"WITH {_NAMES} SELECT name, confidence FROM (SELECT lower(term) AS name, ((pos * 13) % 100) / 100 AS confidence, row_number() OVER (PARTITION BY lower(term) ORDER BY ((pos * 13) % 100) / 100 DESC, pos) AS n FROM names) WHERE n = 1")
def deduplicated_entities(spark, sf_dir):
    rows = names(spark, sf_dir).select(F.col("term").alias("text"), ((F.col("pos") * 13) % 100 / 100).alias("confidence"), "pos")
    return T.deduplicated_entities(rows).select(F.lower("text").alias("name"), "confidence")


@query("entity_variants", "SELECT canonical, array_to_string(list(variant ORDER BY pos)[:10], '|') AS variants FROM (SELECT p_type AS canonical, arg_min(p_name, p_partkey) AS variant, min(p_partkey) AS pos FROM part GROUP BY p_type, lower(p_name)) GROUP BY 1")
def entity_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("canonical"), F.col("p_name").alias("variant"), F.col("p_partkey").alias("pos"))
    return T.entity_variants(rows).select("canonical", F.array_join("variants", "|").alias("variants"))


@query("learnable_terms", "SELECT lower(p_name) AS term, min(p_partkey) AS pos FROM part GROUP BY 1")
def learnable_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("corrected"), F.lit(None).cast("string").alias("reason"), F.col("p_partkey").alias("pos"))
    return T.learnable(rows).select(F.lower("corrected").alias("term"), "pos")


_COMMON = ("this", "that", "with", "from", "there", "then")
@query("discovery", rf"""WITH {_NAMES}, e AS (SELECT lower(term) AS form, count(*) AS c, min(pos) AS pos FROM names GROUP BY 1), d AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[^\p{{L}}]+')) AS ws FROM documents)
  SELECT form, CASE WHEN length(form) < 4 OR form IN {_COMMON} OR c < 2 THEN 'rejected_weirdness' WHEN form LIKE 'e%' THEN 'already_in_dictionary' WHEN NOT list_contains(ws, form) THEN 'rejected_hallucinations' ELSE 'discovered' END AS outcome
  FROM e JOIN d ON d.doc_id = e.pos + 1""")
def discovery(spark, sf_dir):
    """Without the gate of sounds, which SQL cannot state."""
    return L.discover(*_discovery(spark, sf_dir), _COMMON, 0.5, 2, by_sound=None).select("form", "outcome")


def _discovery(spark, sf_dir):
    seen = names(spark, sf_dir).groupBy(F.lower("term").alias("text")).agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("pos")).withColumn("confidence", F.lit(0.9))
    heard = S.texts(spark, sf_dir).select((F.col("doc_id") - 1).alias("pos"), F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("words"))
    known = seen.where(F.col("text").startswith("e")).select(F.col("text").alias("form"))
    return seen.join(heard, "pos"), known


@query("discovery_by_sound")
def discovery_by_sound(spark, sf_dir):
    return L.discover(*_discovery(spark, sf_dir), _COMMON, 0.5, 2).select("form", "outcome", "heard_as")
