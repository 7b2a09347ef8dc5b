"""Queries over the plan of correction passes.

The proposals are derived from the turns: every third segment has one, some for the wrong batch, some that lose
words heard with confidence, some without changes and some twice; every fifth has a fix of the second pass, some
two; the last pass ends the first segment of every fourth transcript.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import correction as C
from scriptorium.plans.analysis_queries import _BARE, _NESTED_WORDS, spoken
from scriptorium.plans.registry import ORACLES, query
from scriptorium.sources import relations as S


def _proposals(segments, words):
    word = lambda i: F.element_at("ws", i)["word"]
    title = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    change = lambda a, b: F.struct(a.alias("original"), b.alias("corrected"), F.lit("name").alias("reason"))
    none = F.array().cast(C._CHANGE)
    two = F.array(change(word(1), F.concat(title(word(1)), F.lit("s"))), change(word(-1), F.concat(F.lit("Le "), F.lower(word(1)))))
    third = "(transcript + segment) % 3 = 0"
    rows = segments.where(third).join(words.where(third), ["transcript", "segment"]).join(C.batched(segments), ["transcript", "segment"])
    kept = F.concat(F.lit("So "), F.col("text"))
    batch = F.col("batch") + F.when(F.col("segment") % 7 == 6, 1).otherwise(0)
    first = rows.select("transcript", batch.alias("batch"), F.col("segment").alias("place"), "segment", F.when(F.col("segment") % 2 == 0, kept).otherwise(F.substr("text", F.lit(40))).alias("corrected"), F.when(F.col("segment") == 3, none).otherwise(two).alias("changes"))
    again = rows.where("segment % 4 = 0").select("transcript", "batch", (F.col("segment") + 1000).alias("place"), "segment", F.concat(F.lit("And "), F.col("text")).alias("corrected"), F.array(change(word(-1), F.lit("La Paz"))).alias("changes"))
    return first.unionByName(again)


def _fixes(segments):
    word = F.element_at(F.split(F.trim("text"), r"\s+"), 1)
    fix = lambda rows, pos, text: rows.select("transcript", pos.alias("pos"), F.col("segment").cast("long").alias("segment"), word.alias("original"), text.alias("corrected"), F.lit("same").alias("reason"))
    fifth = segments.where("segment % 5 = 1")
    second = fix(fifth, F.col("segment"), F.lower("text")).unionByName(fix(fifth.where("transcript % 2 = 0"), F.col("segment") + 1000, F.concat("text", F.lit("!"))))
    stray = fix(fifth, F.col("segment") + 2000, F.lit("lost")).withColumn("segment", F.col("segment") + 500)
    last = fix(segments.where("transcript % 4 = 0 and segment = 0"), F.col("segment"), F.concat("text", F.lit(" End.")))
    return second.unionByName(stray), last


def _corrected(spark, sf_dir) -> C.Corrected:
    rows, words = S.segments(spark, sf_dir), spoken(spark, sf_dir)
    return C.correct(rows, _proposals(rows, words), words, *_fixes(rows))


_KEEPS = rf"""(trim(corrected) = '' OR len(p) = 0 OR len(list_filter(p, lambda w: length(w) >= 2 AND NOT contains(' ' || regexp_replace(lower(corrected), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ', ' ' || trim(regexp_replace(w, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' '))) < len(p) * 0.2)"""
_PLAN = S.with_relations(
    "segments words",
    rf"""WITH {_NESTED_WORDS}, batches AS ({ORACLES["duration_batches"]}),
rows AS (SELECT s.transcript, s.segment, s.text, b.batch, ws, list_transform(list_filter(ws, lambda w: w.confidence >= 0.85), lambda w: {_BARE}) AS p, ws[1].word AS a, ws[-1].word AS z FROM segments s JOIN spoken USING (transcript, segment) JOIN batches b USING (transcript, segment)),
proposals AS (
  SELECT transcript, batch + CASE WHEN segment % 7 = 6 THEN 1 ELSE 0 END AS asked, batch, segment AS place, segment, p, CASE WHEN segment % 2 = 0 THEN 'So ' || text ELSE substr(text, 40) END AS corrected,
         CASE WHEN segment = 3 THEN [] ELSE [{{'o': a, 'c': upper(a[1]) || lower(a[2:]) || 's'}}, {{'o': z, 'c': 'Le ' || lower(a)}}] END AS changes
  FROM rows WHERE (transcript + segment) % 3 = 0
  UNION ALL
  SELECT transcript, batch, batch, segment + 1000, segment, p, 'And ' || text, [{{'o': z, 'c': 'La Paz'}}] FROM rows WHERE (transcript + segment) % 3 = 0 AND segment % 4 = 0
),
taken AS (SELECT transcript, batch, segment, min(place) AS place, arg_max(corrected, place) AS corrected, arg_max(changes, place) AS changes FROM proposals WHERE asked = batch AND {_KEEPS} GROUP BY ALL),
touched AS (SELECT DISTINCT transcript FROM taken),
second AS (
  SELECT transcript, segment AS pos, segment, a AS o, lower(text) AS c FROM rows WHERE segment % 5 = 1
  UNION ALL SELECT transcript, segment + 1000, segment, a, text || '!' FROM rows WHERE segment % 5 = 1 AND transcript % 2 = 0
  UNION ALL SELECT transcript, segment + 2000, segment + 500, a, 'lost' FROM rows WHERE segment % 5 = 1
),
later AS (SELECT * FROM second SEMI JOIN touched USING (transcript)),
final AS (SELECT transcript, segment, a AS o, text || ' End.' AS c FROM rows WHERE transcript % 4 = 0 AND segment = 0),
fixes AS (SELECT transcript, segment, arg_max({{'o': o, 'c': c}}, pos) AS f FROM later GROUP BY ALL)""",
).rstrip()


@query(
    "corrected_segments",
    _PLAN + """
SELECT r.transcript, r.segment, coalesce(l.c, f.f.c, t.corrected, r.text) AS text, t.corrected IS NOT NULL OR f.f IS NOT NULL OR l.c IS NOT NULL AS applied,
  CASE WHEN t.corrected IS NOT NULL OR f.f IS NOT NULL OR l.c IS NOT NULL THEN 'model' ELSE 'none' END AS source,
  array_to_string(list_concat(list_concat(coalesce(list_transform(t.changes, lambda x: x.o || ' -> ' || x.c), []), CASE WHEN f.f IS NULL THEN [] ELSE [f.f.o || ' -> ' || f.f.c || ' (pass2)'] END), CASE WHEN l.c IS NULL THEN [] ELSE [l.o || ' -> ' || l.c || ' (kicker)'] END), chr(10)) AS changes
FROM rows r LEFT JOIN taken t USING (transcript, segment) LEFT JOIN fixes f USING (transcript, segment) LEFT JOIN final l USING (transcript, segment)""",
)
def corrected_segments(spark, sf_dir):
    return _corrected(spark, sf_dir).segments.withColumn("changes", F.array_join("changes", "\n"))


@query(
    "correction_results",
    _PLAN + """, every AS (SELECT transcript, segment, len(changes) AS n FROM taken UNION ALL SELECT transcript, segment, 1 FROM later UNION ALL SELECT transcript, segment, 1 FROM final)
SELECT r.transcript, CASE WHEN r.transcript IN (SELECT transcript FROM touched) THEN 2 ELSE 1 END AS passes_completed, coalesce(sum(n), 0)::BIGINT AS total_changes, count(DISTINCT e.segment) AS segments_changed
FROM (SELECT DISTINCT transcript FROM rows) r LEFT JOIN every e USING (transcript) GROUP BY r.transcript""",
)
def correction_results(spark, sf_dir):
    return _corrected(spark, sf_dir).results


@query(
    "names_by_batch",
    _PLAN + r""", named AS (SELECT transcript, batch, place, n, trim(changes[n].c) AS canonical, trim(changes[n].o) AS variant FROM (SELECT *, unnest(range(1, len(changes) + 1)) AS n FROM taken)),
heard AS (SELECT transcript, canonical, lower(variant) AS low, min((batch, place, n)) AS spot, arg_min(variant, (batch, place, n)) AS variant FROM named WHERE regexp_matches(canonical, '^\p{Lu}') AND canonical <> variant GROUP BY ALL),
told AS (SELECT *, row_number() OVER (PARTITION BY transcript, canonical ORDER BY spot) AS nth, dense_rank() OVER (PARTITION BY transcript ORDER BY first) AS rank FROM (SELECT *, min(spot) OVER (PARTITION BY transcript, canonical) AS first FROM heard)),
each AS (SELECT DISTINCT transcript, batch FROM rows),
lines AS (SELECT e.transcript, e.batch, t.rank, '  - "' || canonical || '" (may appear as: ' || string_agg(variant, ', ' ORDER BY nth) || ')' AS line FROM each e JOIN told t ON t.transcript = e.transcript AND t.spot[1] < e.batch WHERE nth <= 5 AND rank <= 20 GROUP BY e.transcript, e.batch, t.rank, canonical)
SELECT e.transcript, e.batch, coalesce(chr(10) || 'Known entities from earlier segments:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) || chr(10), '') AS block FROM each e LEFT JOIN lines l USING (transcript, batch) GROUP BY e.transcript, e.batch""",
)
def names_by_batch(spark, sf_dir):
    return C.known_names(C.batched(S.segments(spark, sf_dir)), _corrected(spark, sf_dir).names)
