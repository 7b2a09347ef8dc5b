"""Queries that match texts against dictionary forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.phonetic import metaphone
from scriptorium.operators import fuzzy as Z
from scriptorium.operators import table_functions as U
from scriptorium.plans.registry import query, table
from scriptorium.sources import relations as S


def _rows(spark, sf_dir):
    return Z.forms(S.entries(spark, sf_dir, used=False), S.aliases(spark, sf_dir))


def _queries(spark, sf_dir):
    """Every part's name with one letter changed, one left out, or as it is."""
    name = F.col("p_name")
    kind = F.col("p_partkey") % 3
    changed = F.when(kind == 0, F.overlay(name, F.lit("x"), F.lit(3))).when(kind == 1, F.concat(F.left(name, F.lit(2)), F.substr(name, F.lit(4)))).otherwise(name)
    return table(spark, sf_dir, "part").select(changed.alias("query")).distinct()


_FORMS = "forms AS (SELECT DISTINCT id AS entry_id, lower(canonical) AS form, 'canonical' AS kind FROM entries UNION SELECT entry_id, lower(alias), 'alias' FROM aliases)"
_QUERIES = "queries AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name[1:2] || 'x' || p_name[4:] WHEN 1 THEN p_name[1:2] || p_name[4:] ELSE p_name END AS query FROM part)"


@query("exact_join", S.with_relations("usage entries aliases", f"WITH {_FORMS} SELECT query, form, CASE kind WHEN 'canonical' THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence, max(entry_id) AS entry_id FROM (SELECT DISTINCT upper(p_type) AS query FROM part) JOIN forms ON lower(query) = form GROUP BY ALL"))
def exact_join(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(F.upper("p_type").alias("query")).distinct()
    return Z.exact(queries, _rows(spark, sf_dir)).select("query", "form", "confidence", "entry_id")


@query("edit_distance_join", S.with_relations("usage entries aliases", f"WITH {_FORMS}, {_QUERIES} SELECT query, entry_id, form, levenshtein(lower(trim(query)), form) AS distance FROM queries JOIN forms ON abs(length(trim(query)) - length(form)) <= 3 AND levenshtein(lower(trim(query)), form) BETWEEN 1 AND 3"))
def edit_distance_join(spark, sf_dir):
    return Z.edit_pairs(_queries(spark, sf_dir), _rows(spark, sf_dir)).select("query", "entry_id", "form", F.col("distance").cast("long").alias("distance"))


@query("metaphone_codes")
def metaphone_codes(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", metaphone("word").alias("m")).select("word", "m.p", "m.a")


@query("metaphone_join")
def metaphone_join(spark, sf_dir):
    return Z.by_sound(_queries(spark, sf_dir), _rows(spark, sf_dir))


@query("match_candidates")
def match_candidates(spark, sf_dir):
    return Z.candidates(_queries(spark, sf_dir), _rows(spark, sf_dir))


@query("best_match")
def best_match(spark, sf_dir):
    return Z.best_match(_queries(spark, sf_dir), _rows(spark, sf_dir), 0.5)


@query("capitalized_spans")
def capitalized_spans(spark, sf_dir):
    return Z.capitalized_spans(S.texts(spark, sf_dir))


@query("match_spans_sql")
def match_spans_sql(spark, sf_dir):
    """The names of entries in every turn, by table functions in SQL text."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")
    found = U.match_spans(spark, turns, _rows(spark, sf_dir))
    return found.select("doc_id", "span", "start", "end", F.col("candidates")[0]["entry_id"].alias("entry_id"), F.size("candidates").alias("n"))


@query("first_turns", "SELECT conv_id, n::INT AS place, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2")
def first_turns(spark, sf_dir):
    """The first two turns of each conversation, by a table function that stops reading there."""
    U.register(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = spark.sql("SELECT place, row FROM first_rows(2, TABLE(SELECT * FROM {turns}) PARTITION BY conv_id ORDER BY turn)", turns=turns)
    return found.select(F.split_part("row", F.lit("|"), F.lit(1)).cast("long").alias("conv_id"), "place", F.regexp_replace("row", r"(?s)^[^|]*\|[^|]*\|", "").alias("text"))
