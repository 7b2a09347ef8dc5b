"""Queries that write prompts from dictionary entries, and look at spans and corrections of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import fuzzy as Z
from scriptorium.operators import prompts as P
from scriptorium.operators import recognition as N
from scriptorium.plans.analysis_queries import _OPEN, _without, sanitized
from scriptorium.plans.registry import query, table
from scriptorium.sources import relations as S

_CASES = "CASE type WHEN 'person' THEN 'People' WHEN 'location' THEN 'Places' WHEN 'org' THEN 'Organizations' WHEN 'product' THEN 'Products' WHEN 'event' THEN 'Events' WHEN 'jargon' THEN 'Terms' ELSE 'Other' END"
_PLACES = "list_position(['People', 'Places', 'Organizations', 'Products', 'Events', 'Terms', 'Technical', 'Medical', 'Legal', 'Other'], label)"
_ALIASED = "al AS (SELECT entry_id, list({'alias': alias, 'wrong': is_common_misspelling} ORDER BY alias, is_common_misspelling) AS als FROM aliases GROUP BY 1)"


def _tokens(x):
    return f"greatest(1, length({x}) // 4)"


def _prompt_sql(opening, budget):
    return f"""WITH RECURSIVE {S.SQL['usage']}, {S.SQL['entries']}, {S.SQL['aliases']}, {_ALIASED},
    t AS (SELECT -boost_weight AS b, id, {_CASES} AS label, list_prepend(canonical, list_transform(list_filter(als[1:2], lambda a: NOT a.wrong AND lower(a.alias) <> lower(canonical)), lambda a: a.alias)) AS ts
          FROM (SELECT * FROM entries ORDER BY id LIMIT 1000) JOIN al ON id = entry_id),
    e AS (SELECT b, id, label, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM t),
    u AS (SELECT *, sum({_tokens("term || ', '")}) OVER (PARTITION BY label ORDER BY b, id, pos ROWS UNBOUNDED PRECEDING) AS upto FROM e),
    g AS (SELECT label, row_number() OVER (ORDER BY {_PLACES}) AS n, list(term ORDER BY b, id, pos) AS terms, list(upto ORDER BY b, id, pos) AS uptos FROM u GROUP BY label),
    w AS (SELECT *, '[' || label || ': ' || array_to_string(terms, ', ') || ']' AS whole, {_tokens("'[' || label || ': ]'")} + 1 AS frame FROM g),
    fold AS (
      SELECT 0::BIGINT AS n, {_tokens(f"'{opening} '")}::BIGINT AS used, []::VARCHAR[] AS parts
      UNION ALL
      SELECT n, used + CASE WHEN part IS NULL THEN 0 ELSE {_tokens('part')} + 1 END, CASE WHEN part IS NULL THEN parts ELSE list_append(parts, part) END FROM (
        SELECT w.n, f.used, f.parts, CASE WHEN {_tokens('whole')} + 1 <= {budget} - f.used THEN whole
          ELSE nullif('[' || label || ': ' || array_to_string(terms[1:len(list_filter(uptos, lambda x: x + frame <= {budget} - f.used))], ', ') || ']', '[' || label || ': ]') END AS part
        FROM fold f JOIN w ON w.n = f.n + 1))
    SELECT CASE WHEN len(parts) = 0 THEN '' ELSE '{opening} ' || array_to_string(parts, ' ') END AS prompt FROM fold ORDER BY n DESC LIMIT 1"""


@query("term_prompt", _prompt_sql("You may hear proper nouns:", 200))
def term_prompt(spark, sf_dir):
    return P.term_prompt(S.dictionary(spark, sf_dir))


@query("term_prompt_wide", _prompt_sql("This is a technical discussion about software development. You may hear:", 3000))
def term_prompt_wide(spark, sf_dir):
    return P.term_prompt(S.dictionary(spark, sf_dir), 3000, "tech")


_HEAD = """'## Vocabulary Hints (SUGGESTIONS ONLY - not guaranteed to appear)' || chr(10) || chr(10) || 'These terms MAY appear in this transcript. They are hints, not facts.' || chr(10) ||
  'Only apply a term if ASR output contains a NEAR-MISS (phonetic or spelling).' || chr(10) || chr(10) || '| Term | Type | Aliases | Notes |' || chr(10) || '|------|------|---------|-------|' || chr(10)"""
_FOOT = """chr(10) || chr(10) || 'NEAR-MISS RULE:' || chr(10) || '- ONLY apply a vocabulary term if the raw ASR contains a phonetically similar word' || chr(10) || '- Example: ''Soon toe'' → ''Suunto'' (sounds similar) ✓' || chr(10) ||
  '- Example: ''shoe'' → ''Suunto'' (no phonetic match) ✗' || chr(10) || '- When in doubt, keep the original ASR text'"""
_CELL = r"trim(replace(replace(replace({0}, '\', '\\'), '|', '\|'), chr(10), ' '))"
_BLOCK = f"""WITH {_ALIASED},
    t AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'seed|' || id END AS source FROM (SELECT * FROM entries ORDER BY id LIMIT 1000) ORDER BY boost_weight DESC, id LIMIT 15)
    SELECT {_HEAD} || string_agg('| ' || {_CELL.format('canonical')} || ' | ' || type || ' | ' || array_to_string(list_transform(list_filter(als[1:3], lambda a: NOT a.wrong), lambda a: {_CELL.format('a.alias')}), ', ') || ' | ' ||
      {_CELL.format("concat_ws('; ', CASE WHEN display <> canonical THEN display END, 'Source: ' || source)")} || ' |', chr(10) ORDER BY boost_weight DESC, id) || {_FOOT} AS block FROM t JOIN al ON id = entry_id"""


def _sourced(spark, sf_dir):
    return S.dictionary(spark, sf_dir).withColumn("source", F.when(F.col("id") % 3 == 0, F.concat(F.lit("seed|"), F.col("id").cast("string"))))


@query("correction_block", S.with_relations("usage entries aliases", _BLOCK))
def correction_block(spark, sf_dir):
    return P.correction_table(_sourced(spark, sf_dir), 15)


@query("both_prompts", _prompt_sql("You may hear proper nouns:", 120).replace("SELECT CASE WHEN len(parts) = 0", f"SELECT * FROM (SELECT CASE WHEN len(parts) = 0") + f"), ({S.with_relations('usage entries aliases', _BLOCK)})")
def both_prompts(spark, sf_dir):
    return P.both(_sourced(spark, sf_dir), 120, 15)


@query("entries_for_prompt", S.with_relations("usage entries contexts placed", "SELECT id, round(CASE WHEN list_contains(contexts, 'EUROPE') THEN boost_weight ELSE boost_weight * 0.8 END, 6) AS effective FROM entries LEFT JOIN placed ON id = entry_id WHERE list_contains(contexts, 'EUROPE') OR contexts IS NULL OR len(contexts) = 0"))
def entries_for_prompt(spark, sf_dir):
    return P.for_context(S.dictionary(spark, sf_dir), "europe").select("id", F.round("effective", 6).alias("effective"))


@query("type_labels", f"SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 7 THEN 'Other' ELSE {_CASES} END AS label FROM (SELECT *, ['person', 'org', 'product', 'event', 'location', 'jargon', 'misc', NULL][p_partkey % 8 + 1] AS type FROM part)")
def type_labels(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("Person", "ORG", "product", "event", "location", "jargon", "misc")], F.lit(None)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.type_label(kind).alias("label"))


def _forms(spark, sf_dir):
    return Z.forms(S.entries(spark, sf_dir), S.aliases(spark, sf_dir))


@query("match_spans")
def match_spans(spark, sf_dir):
    """Spans of all turns that name a part."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found = Z.match_spans(turns, _forms(spark, sf_dir), "id")
    return found.select("id", "span", "start", "end", F.size("candidates").alias("n"), F.col("candidates")[0]["entry_id"].alias("entry_id"), F.col("candidates")[0]["confidence"].alias("confidence"))


@query("phonetic_anchor")
def phonetic_anchor(spark, sf_dir):
    """Corrections of every part's name to another's type or its own name changed."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 3
    corrected = F.when(kind == 0, F.upper("p_type")).when(kind == 1, F.concat(F.left(name, F.lit(2)), F.substr(name, F.lit(4)))).otherwise(name)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("the "), name, F.lit(", it was")).alias("original"), corrected.alias("corrected"))
    terms = table(spark, sf_dir, "part").select(F.explode(F.array(F.lower("p_type"), "p_name")).alias("term"))
    return Z.anchored(rows, terms)


@query("heard_by_sound")
def heard_by_sound(spark, sf_dir):
    """For every part's name a word of the same letters spelt otherwise."""
    spelt = F.regexp_replace(F.regexp_replace(F.split_part("p_name", F.lit(" "), F.lit(1)), "k|c", "q"), "e$", "")
    rows = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("form"), spelt.alias("w")).groupBy("form").agg(F.collect_set("w").alias("words"))
    return Z.heard_by_sound(rows)


@query("pass1_entities", "SELECT DISTINCT trim(replace(replace(p_brand || ' & ' || upper(p_type), '&', '&amp;'), '''', '&#x27;')) AS entity FROM part")
def pass1_entities(spark, sf_dir):
    from scriptorium.operators.queues import corrected_entities

    parts = table(spark, sf_dir, "part")
    changes = parts.select(F.concat(F.lit("user: "), "p_brand", F.lit(" & "), F.upper("p_type")).alias("corrected")).unionByName(parts.select(F.lower("p_name").alias("corrected")))
    return corrected_entities(changes, X.sanitize_prompt)


_CLEAN = _without("coalesce(text, '')", f"^[{_OPEN}]+", f"[{_OPEN}]+$", r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\p{Cf}\p{Co}]")


@query("recognized_entities", rf"""WITH clean AS (SELECT doc_id, {_CLEAN} AS t FROM documents),
tokens AS (SELECT doc_id, t, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, string_split_regex(t, '[ \t\n\f\r]') AS ws FROM clean)),
placed AS (SELECT doc_id, t, w, i, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS o, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '') AS before, regexp_matches(w, '^[A-Z][a-z]+[.,;:!?]?$') AS cap, regexp_extract(w, '^[A-Z][a-z]+') AS core FROM tokens),
runs AS (SELECT *, sum(CASE WHEN cap AND regexp_matches(before, '^[A-Z][a-z]+$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM placed),
found AS (SELECT doc_id, any_value(t) AS t, min(o)::BIGINT AS "start", max(o + length(core))::BIGINT AS "end", count(*) AS n, arg_min(before, i) AS before, arg_max(core, i) AS last FROM runs WHERE cap GROUP BY doc_id, run)
SELECT doc_id, substr(t, "start" + 1, "end" - "start") AS text, CASE WHEN last IN ('Inc', 'LLC', 'Corp', 'Ltd', 'Co', 'Company', 'Technologies', 'Labs') THEN 'organization' WHEN n > 1 THEN 'person' WHEN before IN ('in', 'at', 'from') THEN 'location' ELSE 'term' END AS entity_type,
  least(1.0, 0.4 + 0.2 * n)::DOUBLE AS confidence, "start", "end" FROM found""")
def recognized_entities(spark, sf_dir):
    """What the recognizer of rules finds in every whole text, and where."""
    texts = S.texts(spark, sf_dir).select("doc_id", "text")
    return N.with_entities(texts, least=0.0).select("doc_id", F.inline("entities")).withColumn("confidence", F.round("confidence", 6))


@query("discovered_nouns")
def discovered_nouns(spark, sf_dir):
    """Names in the transcripts' texts that their first halves had already and the dictionary has not."""
    rows = S.segments(spark, sf_dir).withColumn("raw_text", F.left("text", F.length("text") - F.col("segment") % 3 * 20))
    known = S.entries(spark, sf_dir, used=False).select(F.lower("canonical").alias("form"))
    return N.discovered_nouns(rows, known, ("the", "and"), min_confidence=0.5)


@query("sanitized_vocabulary", f"SELECT conv_id, array_to_string(list_filter(list({sanitized('text')} ORDER BY turn), lambda t: t <> ''), '|') AS terms FROM conversations GROUP BY 1")
def sanitized_vocabulary(spark, sf_dir):
    """All turns of a conversation as a vocabulary."""
    turns = table(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return listed.select("conv_id", F.array_join(X.sanitize_vocabulary(F.transform("ts", lambda t: t["text"])), "|").alias("terms"))


@query("pass2_transcript", S.with_relations("segments", "SELECT transcript, string_agg('[' || segment || '] ' || coalesce(text, ''), chr(10) ORDER BY segment) AS body FROM segments GROUP BY 1"))
def pass2_transcript(spark, sf_dir):
    from scriptorium.operators.transcripts import numbered_transcript

    return numbered_transcript(S.segments(spark, sf_dir))
