"""Queries over the dictionary: rankings, searches, lookups, statistics, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import dictionary as D
from scriptorium.operators import ranking as R
from scriptorium.operators import render as N
from scriptorium.operators import search_index as I
from scriptorium.plans.registry import query, table
from scriptorium.sources import relations as S
from scriptorium.sources import versions as V

PROFILE = R.Profile("ASIA", include_tiers=("B", "C"), include_contexts=("ASIA", "EUROPE"), max_entries=40, boost_multiplier=1.2)
#: Keywords of contexts, for texts of several languages.
KEYWORDS = {"english": ("the", "of the", "ing"), "german": ("der", "und die", "ung"), "french": ("que", "de la", "eau"), "spanish": ("los", "de los", "ción")}

_WEIGHT = "CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 WHEN 'C' THEN 0.7 WHEN 'D' THEN 0.7 ELSE 0.4 END::DOUBLE"
_RECENT = f"CASE WHEN last_seen_us IS NOT NULL AND floor(({S.NOW_US} - last_seen_us) / {S.DAY_US}) BETWEEN 0 AND 60 THEN 1.0 ELSE 0.5 END::DOUBLE"
_BASE = f"{_WEIGHT} * greatest(boost_weight, 0.01::DOUBLE)"
_NESTED = "usage entries contexts placed"
_OWN = "(SELECT entries.*, coalesce(contexts, []) AS contexts FROM entries LEFT JOIN placed ON id = entry_id)"
_SCORE = f"round({_BASE} * CASE WHEN list_contains(contexts, 'ASIA') THEN 1.5 ELSE 1.0 END::DOUBLE * {_RECENT}, 6)"


def _out(df, *columns):
    return df.select(*columns, F.round("score", 6).alias("score"))


@query("bias_list", S.with_relations(_NESTED, f"SELECT id, canonical, tier, {_SCORE} AS score FROM {_OWN} WHERE tier = 'A' OR tier <= 'F' "
       f"ORDER BY {_BASE} * CASE WHEN list_contains(contexts, 'ASIA') THEN 1.5 ELSE 1.0 END::DOUBLE * {_RECENT} DESC, lower(canonical), id LIMIT 60"))
def bias_list(spark, sf_dir):
    return _out(R.select_bias_list(S.dictionary(spark, sf_dir), S.NOW_US, context="asia", min_tier="F"), "id", "canonical", "tier")


@query("bias_list_filtered", S.with_relations(_NESTED, f"SELECT id, canonical, tier, round({_BASE} * {_RECENT}, 6) AS score FROM {_OWN} "
       "WHERE (tier = 'A' OR tier <= 'E') AND (tier = 'A' OR list_has_any(contexts, ['EUROPE', 'AFRICA'])) AND NOT list_contains(contexts, 'AMERICA') "
       f"ORDER BY {_BASE} * {_RECENT} DESC, lower(canonical), id LIMIT 80"))
def bias_list_filtered(spark, sf_dir):
    found = R.select_bias_list(S.dictionary(spark, sf_dir), S.NOW_US, min_tier="E", include_contexts=("europe", "africa"), exclude_contexts=("america",), k=80)
    return _out(found, "id", "canonical", "tier")


@query("bias_list_profile", S.with_relations(_NESTED, f"SELECT id, canonical, round({_BASE} * CASE WHEN list_contains(contexts, 'ASIA') THEN 1.5 ELSE 1.0 END::DOUBLE * {_RECENT} * 1.2::DOUBLE, 6) AS score FROM {_OWN} "
       "WHERE (tier = 'A' OR tier IN ('B', 'C')) AND list_has_any(contexts, ['ASIA', 'EUROPE']) "
       f"ORDER BY {_BASE} * CASE WHEN list_contains(contexts, 'ASIA') THEN 1.5 ELSE 1.0 END::DOUBLE * {_RECENT} * 1.2::DOUBLE DESC, tier, boost_weight DESC, occurrence_count DESC, id LIMIT 40"))
def bias_list_profile(spark, sf_dir):
    return _out(R.select_with_profile(S.dictionary(spark, sf_dir), PROFILE, S.NOW_US), "id", "canonical")


@query("entry_score", S.with_relations(_NESTED, f"SELECT id, {_SCORE} AS score FROM {_OWN}"))
def entry_score(spark, sf_dir):
    return _out(S.dictionary(spark, sf_dir).withColumn("score", R.bias_score(S.NOW_US, "Asia")), "id")


def _branch(form, scores, extra, place):
    rank = f"CASE WHEN lower({form}) = 'red' THEN 0 WHEN starts_with(lower({form}), 'red') THEN 1 ELSE 2 END"
    return (f"(SELECT id, canonical, tier, {rank} AS rank, {place} AS branch, {form} AS matched, ([{', '.join(f'{x}::DOUBLE' for x in scores)}])[{rank} + 1] * {_WEIGHT} * boost_weight AS score "
            f"FROM {'entries' if not place else 'entries JOIN aliases ON id = entry_id'} WHERE contains(lower({form}), 'red') ORDER BY rank, tier, {extra} id, {form} LIMIT 25)")


@query("search_ranked", S.with_relations("usage entries aliases", "WITH hits AS (FROM " + _branch("canonical", (1.0, 0.9, 0.7), "occurrence_count DESC,", 0) + " UNION ALL FROM " + _branch("alias", (0.95, 0.85, 0.65), "", 1) + ") "
       "SELECT id, canonical, round(score, 6) AS score, CASE branch WHEN 0 THEN 'canonical' ELSE 'alias' END AS matched_on FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch, rank, matched) AS n FROM hits) WHERE n = 1 "
       "ORDER BY hits.score DESC, branch, rank, tier, id LIMIT 25".replace("hits.score", "score")))
def search_ranked(spark, sf_dir):
    return R.search_ranked(S.entries(spark, sf_dir), S.aliases(spark, sf_dir), "Red ", 25).withColumn("score", F.round("score", 6))


#: A part of every part's name, of one to eight letters, and words that stand nowhere.
_ASKED = "asked AS (SELECT DISTINCT query, lower(trim(query)) AS q FROM (SELECT substr(p_name, (p_partkey % 5 + 1)::BIGINT, (p_partkey % 8 + 1)::BIGINT) AS query FROM part UNION ALL SELECT upper(p_brand) FROM part UNION ALL SELECT 'zz%' FROM part) WHERE trim(query) <> '')"


def _hits(form, rows, scores, used, place):
    rank = f"CASE WHEN lower({form}) = q THEN 0 WHEN starts_with(lower({form}), q) THEN 1 ELSE 2 END"
    return (f"SELECT query, id, canonical, tier, {place} AS branch, rank, matched, CASE rank WHEN 0 THEN {scores[0]} WHEN 1 THEN {scores[1]} ELSE {scores[2]} END::DOUBLE * {_WEIGHT} * boost_weight AS score FROM "
            f"(SELECT *, {form} AS matched, {rank} AS rank FROM {rows} JOIN asked ON contains(lower({form}), q)) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, tier, {used} id, matched) <= 15")


@query("search_many", S.with_relations("usage entries aliases", f"WITH {_ASKED}, hits AS (" + _hits("canonical", "entries", (1.0, 0.9, 0.7), "occurrence_count DESC,", 0) + " UNION ALL " + _hits("alias", "(SELECT * FROM entries JOIN aliases ON id = entry_id)", (0.95, 0.85, 0.65), "", 1) + "), "
       "one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY branch, rank, matched) = 1) "
       "SELECT query, (row_number() OVER (PARTITION BY query ORDER BY score DESC, branch, rank, tier, id))::INT AS place, id, canonical, round(score, 6) AS score, CASE branch WHEN 0 THEN 'canonical' ELSE 'alias' END AS matched_on FROM one QUALIFY place <= 15"))
def search_many(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    part_of = F.substr("p_name", F.col("p_partkey") % 5 + 1, F.col("p_partkey") % 8 + 1)
    asked = parts.select(F.explode(F.array(part_of, F.upper("p_brand"), F.lit("zz%"))).alias("query")).distinct()
    entries, aliases = S.entries(spark, sf_dir), S.aliases(spark, sf_dir)
    return I.search_many(entries, I.build(entries, aliases), asked, 15).withColumn("score", F.round("score", 6))


_ANY = "len(list_filter(names, lambda a: {})) > 0"
@query("search_scored", S.with_relations("usage entries aliases", "WITH own AS (SELECT entries.*, names FROM entries LEFT JOIN (SELECT entry_id, list(lower(alias)) AS names FROM aliases GROUP BY 1) ON id = entry_id) SELECT id, canonical, score FROM (SELECT *, CASE WHEN lower(canonical) = 'brand' THEN 100 "
       "WHEN starts_with(lower(canonical), 'brand') THEN 80 WHEN contains(lower(canonical), 'brand') THEN 60 "
       f"WHEN {_ANY.format(chr(97) + ' = ' + chr(39) + 'brand' + chr(39))} THEN 90 WHEN {_ANY.format('starts_with(a, ' + chr(39) + 'brand' + chr(39) + ')')} THEN 70 "
       f"WHEN {_ANY.format('contains(a, ' + chr(39) + 'brand' + chr(39) + ')')} THEN 50 WHEN contains(lower(display), 'brand') THEN 40 END AS score FROM own) WHERE score IS NOT NULL ORDER BY score DESC, lower(canonical), id LIMIT 50"))
def search_scored(spark, sf_dir):
    return R.search_scored(S.dictionary(spark, sf_dir), "Brand", 50).select("id", "canonical", "score")


@query("detect_context", "WITH w AS (SELECT doc_id, " + ", ".join(f"{' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{k}{chr(39)}) THEN {len(k.split())} ELSE 0 END' for k in ks)} AS {c}" for c, ks in KEYWORDS.items()) + " FROM documents) "
       "SELECT doc_id, CASE " + " ".join(f"WHEN {c} > 0 AND {c} = greatest({', '.join(KEYWORDS)}) THEN '{c}'" for c in KEYWORDS) + " END AS detected FROM w")
def detect_context(spark, sf_dir):
    return R.detect_context(S.texts(spark, sf_dir), KEYWORDS).select("doc_id", "detected")


@query("recognizer_forms", S.with_relations("usage entries aliases", "WITH f AS (SELECT id, 0 AS ord, canonical AS form FROM entries UNION ALL SELECT id, 1, display FROM entries UNION ALL "
       "SELECT entry_id, 1 + row_number() OVER (PARTITION BY entry_id ORDER BY alias), alias FROM aliases WHERE NOT is_common_misspelling) "
       "SELECT id, form FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(form) ORDER BY ord) AS n FROM f) WHERE n = 1"))
def recognizer_forms(spark, sf_dir):
    return R.forms(S.dictionary(spark, sf_dir)).select("id", "form")


@query("entries_by_tier", S.with_relations("usage entries", "SELECT id, boost_weight, occurrence_count FROM entries WHERE tier = 'C' AND language = 'en' ORDER BY boost_weight DESC, occurrence_count DESC, id LIMIT 100"))
def entries_by_tier(spark, sf_dir):
    return D.by_tier(S.entries(spark, sf_dir), "C", limit=100).select("id", "boost_weight", "occurrence_count")


@query("entries_by_context", S.with_relations("usage entries contexts", "SELECT id, tier FROM entries WHERE tier <= 'D' AND id IN (SELECT entry_id FROM contexts WHERE context = 'ASIA') ORDER BY tier, boost_weight DESC, occurrence_count DESC, id LIMIT 100"))
def entries_by_context(spark, sf_dir):
    return D.by_context(S.entries(spark, sf_dir), S.contexts(spark, sf_dir), "ASIA", "D", 100).select("id", "tier")


@query("context_entries_resorted", S.with_relations("usage entries contexts", "SELECT id, tier, canonical FROM (SELECT * FROM entries WHERE id IN (SELECT entry_id FROM contexts WHERE context = 'EUROPE') ORDER BY tier, boost_weight DESC, occurrence_count DESC, id LIMIT 50) ORDER BY tier, lower(canonical)"))
def context_entries_resorted(spark, sf_dir):
    return D.by_context(S.entries(spark, sf_dir), S.contexts(spark, sf_dir), "EUROPE", limit=50).orderBy("tier", F.lower("canonical")).select("id", "tier", "canonical")


@query("entries_in_context_any_case", S.with_relations(_NESTED, f"SELECT id FROM {_OWN} WHERE list_contains(contexts, 'AFRICA')"))
def entries_in_context_any_case(spark, sf_dir):
    return S.dictionary(spark, sf_dir).where(R.has_context(F.col("contexts"), "Africa")).select("id")


@query("recent_entries", S.with_relations("usage entries", f"SELECT id, last_seen_us FROM entries WHERE last_seen_us >= {S.NOW_US - 30 * S.DAY_US} ORDER BY last_seen_us DESC, id LIMIT 200"))
def recent_entries(spark, sf_dir):
    return D.recent(S.entries(spark, sf_dir), S.NOW_US, 30, 200).select("id", "last_seen_us")


@query("entry_by_canonical", S.with_relations("usage entries", "SELECT id, canonical FROM entries WHERE canonical IN (SELECT canonical FROM entries WHERE id = 7)"))
def entry_by_canonical(spark, sf_dir):
    entries = S.entries(spark, sf_dir)
    return D.by_canonical(entries, entries.where("id = 7").first().canonical).select("id", "canonical")


@query("entry_lookup", S.with_relations("usage entries aliases", "WITH keys AS (SELECT upper(canonical) AS key FROM entries WHERE id % 50 = 1 UNION ALL SELECT id::VARCHAR FROM entries WHERE id % 50 = 2 UNION ALL SELECT DISTINCT upper(alias) FROM aliases WHERE is_common_misspelling), "
       "f AS (SELECT id::VARCHAR AS low, id, 0 AS way FROM entries UNION ALL SELECT lower(canonical), id, 1 FROM entries UNION ALL SELECT lower(alias), entry_id, 2 FROM aliases) "
       "SELECT key, id, ['id', 'canonical', 'alias'][way + 1] AS found_by FROM (SELECT key, f.id, way, row_number() OVER (PARTITION BY key ORDER BY way, f.id) AS n FROM keys JOIN f ON lower(key) = low) WHERE n = 1"))
def entry_lookup(spark, sf_dir):
    e, a = S.entries(spark, sf_dir), S.aliases(spark, sf_dir)
    keys = e.where("id % 50 = 1").select(F.upper("canonical").alias("key")).unionByName(e.where("id % 50 = 2").select(F.col("id").cast("string").alias("key")))
    keys = keys.unionByName(a.where("is_common_misspelling").select(F.upper("alias").alias("key")).distinct())
    return D.lookup(e, a, keys)


@query("top_usage", S.with_relations("usage entries", "SELECT id, occurrence_count FROM (SELECT * FROM entries ORDER BY tier, boost_weight DESC, occurrence_count DESC, id LIMIT 40) ORDER BY occurrence_count DESC, tier, boost_weight DESC, id LIMIT 20"))
def top_usage(spark, sf_dir):
    return D.top_by_usage(S.entries(spark, sf_dir), 20).select("id", "occurrence_count")


@query("top_usage_exact", S.with_relations("usage entries", "SELECT id, occurrence_count FROM entries ORDER BY occurrence_count DESC, tier, boost_weight DESC, id LIMIT 20"))
def top_usage_exact(spark, sf_dir):
    return D.top_by_usage(S.entries(spark, sf_dir), 20, exact=True).select("id", "occurrence_count")


@query("dict_stats", S.with_relations("usage entries aliases pronunciations contexts", "SELECT 'total' AS dimension, 'entries' AS key, count(*) AS n FROM entries UNION ALL SELECT 'tier', tier, count(*) FROM entries GROUP BY tier UNION ALL SELECT 'type', type, count(*) FROM entries GROUP BY type "
       "UNION ALL SELECT 'total', 'aliases', count(*) FROM aliases UNION ALL SELECT 'total', 'pronunciations', count(*) FROM pronunciations UNION ALL SELECT 'total', 'last_updated', max(last_seen_us) FROM entries UNION ALL SELECT 'context', context, count(*) FROM contexts GROUP BY context"))
def dict_stats(spark, sf_dir):
    return D.stats(S.entries(spark, sf_dir), S.aliases(spark, sf_dir), S.contexts(spark, sf_dir), S.pronunciations(spark, sf_dir), "last_seen_us").where("dimension != 'tier' or key is not null")


@query("stats_cube", S.with_relations("usage entries", "SELECT tier, type, count(*) AS n, sum(occurrence_count)::BIGINT AS used FROM entries GROUP BY CUBE (tier, type)"))
def stats_cube(spark, sf_dir):
    return S.entries(spark, sf_dir).cube("tier", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrence_count").alias("used"))


@query("all_contexts", S.with_relations("contexts", "SELECT DISTINCT context FROM contexts ORDER BY 1"))
def all_contexts(spark, sf_dir):
    return S.contexts(spark, sf_dir).select("context").distinct().orderBy("context")


@query("relations_nested", S.with_relations("usage entries aliases contexts", "SELECT id, (SELECT string_agg(alias || ':' || is_common_misspelling, '|' ORDER BY alias) FROM aliases a WHERE a.entry_id = e.id) AS aliases, coalesce((SELECT string_agg(context, '|' ORDER BY context) FROM contexts c WHERE c.entry_id = e.id), '') AS contexts FROM entries e"))
def relations_nested(spark, sf_dir):
    named = F.transform("aliases", lambda a: F.concat(a["alias"], F.lit(":"), a["is_common_misspelling"].cast("string")))
    return S.dictionary(spark, sf_dir).select("id", F.array_join(named, "|").alias("aliases"), F.array_join("contexts", "|").alias("contexts"))


@query("all_forms", S.with_relations("usage entries aliases", "SELECT id, canonical AS form FROM entries UNION ALL SELECT entry_id, alias FROM aliases"))
def all_forms(spark, sf_dir):
    return S.dictionary(spark, sf_dir).select("id", F.explode(F.concat(F.array("canonical"), F.transform("aliases", lambda a: a["alias"]))).alias("form"))


_EXPORTED = f"""(SELECT row_number() OVER (ORDER BY tier, lower(canonical), o.id) AS place, o.id, canonical, tier, to_json({{'canonical': canonical, 'type': type, 'tier': tier, 'boost_weight': boost_weight,
  'aliases': coalesce(names, []), 'pronunciations': coalesce(ipas, []), 'contexts': list_sort(contexts), 'display': display}})::VARCHAR AS json
  FROM {_OWN} o LEFT JOIN (SELECT entry_id AS id, list(alias ORDER BY alias, is_common_misspelling) AS names FROM aliases GROUP BY 1) a USING (id) LEFT JOIN (SELECT entry_id AS id, list(ipa) AS ipas FROM pronunciations WHERE ipa <> '' GROUP BY 1) p USING (id)"""


def _nested(spark, sf_dir):
    said = S.pronunciations(spark, sf_dir).groupBy(F.col("entry_id").alias("id")).agg(F.collect_list(F.struct("ipa", "language")).alias("pronunciations"))
    return S.dictionary(spark, sf_dir).join(said, "id", "left")


@query("export_dictionary", S.with_relations("usage entries aliases pronunciations contexts placed", f"SELECT place, id, canonical, tier, json FROM {_EXPORTED} WHERE tier <= 'C' AND list_contains(contexts, 'ASIA'))"))
def export_dictionary(spark, sf_dir):
    return N.export_entries(_nested(spark, sf_dir), V.shared_place(spark, "export"), max_tier="C", context="asia")


@query("export_everything", S.with_relations("usage entries aliases pronunciations contexts placed", f"SELECT place, id, json FROM {_EXPORTED})"))
def export_everything(spark, sf_dir):
    return N.export_entries(_nested(spark, sf_dir), V.shared_place(spark, "export")).select("place", "id", "json")


@query("export_envelope", S.with_relations("usage entries contexts placed", f"""SELECT '{{"version":"1.0","exported_at":"{S.NOW}","filters":{{"tier":"C","context":"asia"}},"count":' || count(*) || '}}' AS json FROM {_OWN} WHERE tier <= 'C' AND list_contains(contexts, 'ASIA')"""))
def export_envelope(spark, sf_dir):
    kept = N.kept_for_export(S.dictionary(spark, sf_dir), "C", "asia")
    return N.export_envelope(kept, S.NOW, "C", "asia")


@query("validate_entries", S.with_relations("usage entries", "SELECT id, 'boost_weight' AS problem FROM entries WHERE boost_weight * 1.5 > 3"))
def validate_entries(spark, sf_dir):
    return D.validate(S.entries(spark, sf_dir).withColumn("boost_weight", F.col("boost_weight") * 1.5)).where("problem is not null").select("id", "problem")


def _incoming(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.regexp_replace("c_name", "0", "")).alias("canonical"), F.col("c_mktsegment").alias("type"), F.lit(None).cast("string").alias("display"), F.substring("c_mktsegment", 1, 1).alias("tier"), (F.col("c_acctbal") / 1000).alias("boost_weight"))


_INCOMING = ("incoming AS (SELECT trim(' ' || replace(c_name, '0', '')) AS canonical, 'misc' AS type, CASE WHEN substr(c_mktsegment, 1, 1) BETWEEN 'A' AND 'H' THEN substr(c_mktsegment, 1, 1) ELSE 'D' END AS tier, "
             "least(3.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(c_acctbal / 1000, 1.0))) AS boost_weight FROM customer)")


@query("import_clean", f"WITH {_INCOMING} SELECT canonical, type, tier, round(boost_weight, 6) AS boost_weight FROM incoming")
def import_clean(spark, sf_dir):
    return D.clean_import(_incoming(spark, sf_dir)).select("canonical", "type", "tier", F.round("boost_weight", 6).alias("boost_weight"))


@query("import_antijoin", S.with_relations("usage entries", f"WITH {_INCOMING} SELECT DISTINCT canonical FROM incoming WHERE lower(canonical) NOT IN (SELECT lower(canonical) FROM entries)"))
def import_antijoin(spark, sf_dir):
    return D.new_entries(D.clean_import(_incoming(spark, sf_dir)).select("canonical"), S.entries(spark, sf_dir)).select("canonical")


@query("bulk_create", S.with_relations("usage entries", "WITH names AS (SELECT p_brand AS canonical FROM part UNION ALL SELECT canonical FROM entries WHERE id % 3 = 0), fresh AS (SELECT DISTINCT canonical FROM names WHERE canonical NOT IN (SELECT canonical FROM entries)) "
       "SELECT (SELECT count(*) FROM fresh) AS created, (SELECT count(*) FROM names) - (SELECT count(*) FROM fresh) AS skipped"))
def bulk_create(spark, sf_dir):
    e = S.entries(spark, sf_dir)
    names = e.select(F.col("display").alias("canonical")).unionByName(e.where("id % 3 = 0").select("canonical"))
    fresh = D.new_entries(names, e, ignore_case=False)
    counted = fresh.select(F.lit(1).alias("new"), F.lit(0).alias("all")).unionByName(names.select(F.lit(0).alias("new"), F.lit(1).alias("all")))
    return counted.agg(F.sum("new").alias("created"), (F.sum("all") - F.sum("new")).alias("skipped"))


@query("delete_cascade", S.with_relations("usage entries aliases contexts", "WITH kept AS (SELECT id, canonical FROM entries WHERE tier <> 'B') SELECT 'entries' AS relation, id, canonical AS value FROM kept UNION ALL SELECT 'aliases', entry_id, alias FROM aliases WHERE entry_id IN (SELECT id FROM kept) "
       "UNION ALL SELECT 'contexts', entry_id, context FROM contexts WHERE entry_id IN (SELECT id FROM kept)"))
def delete_cascade(spark, sf_dir):
    e = S.entries(spark, sf_dir)
    left = D.delete({"entries": e, "aliases": S.aliases(spark, sf_dir), "contexts": S.contexts(spark, sf_dir)}, e.where("tier = 'B'"))
    told = lambda name, key, value: left[name].select(F.lit(name).alias("relation"), F.col(key).alias("id"), F.col(value).alias("value"))
    return told("entries", "id", "canonical").unionByName(told("aliases", "entry_id", "alias")).unionByName(told("contexts", "entry_id", "context"))


@query("update_entry", S.with_relations("usage entries", "SELECT id, CASE WHEN id % 10 = 0 THEN 'A' ELSE tier END AS tier, display FROM entries"))
def update_entry(spark, sf_dir):
    e = S.entries(spark, sf_dir)
    patch = e.where("id % 10 = 0").select("id", F.lit("A").alias("tier"), F.lit(None).cast("string").alias("display"))
    return D.patched(e, patch, ("tier", "display")).select("id", "tier", "display")


@query("add_alias", S.with_relations("usage entries aliases", "SELECT min(id) AS entry_id, min(tier || '-' || display) AS alias FROM entries WHERE lower(tier || '-' || display) NOT IN (SELECT lower(alias) FROM aliases) GROUP BY lower(tier || '-' || display)"))
def add_alias(spark, sf_dir):
    wanted = S.entries(spark, sf_dir).select(F.col("id").alias("entry_id"), F.concat_ws("-", "tier", "display").alias("alias"))
    return D.added_aliases(S.aliases(spark, sf_dir), wanted)


@query("usage_record", S.with_relations("usage", "SELECT * FROM usage"))
def usage_record(spark, sf_dir):
    return S.usage(spark, sf_dir)


@query("integrity_check", S.with_relations("usage entries contexts", "SELECT entry_id, context FROM contexts WHERE entry_id NOT IN (SELECT id FROM entries WHERE id % 7 <> 0)"))
def integrity_check(spark, sf_dir):
    return D.orphans(S.contexts(spark, sf_dir), S.entries(spark, sf_dir).where("id % 7 != 0")).select("entry_id", "context")
