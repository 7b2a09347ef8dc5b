"""The engine's relations, read from the tables of a data folder, and the same relations in SQL.

Parts become dictionary entries, regions their contexts, line items their usage; conversations become
transcripts; events become speech intervals and log lines; documents give texts. Everything is
deterministic, so a result can be compared with SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.plans.registry import table

#: The moment that "now" means in all queries, as text and in microseconds.
NOW = "2001-11-01 00:00:00"
NOW_US = 1_004_572_800_000_000
#: Entry types in the order of their ordinals.
TYPES = ("person", "org", "product", "event", "location", "jargon", "misc")
DAY_US = 86_400_000_000


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, occurrence_count, last_seen_us of each entry that was ever used."""
    seen = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("occurrence_count"), F.max(seen).alias("last_seen_us"))


def entries(spark: SparkSession, sf_dir: str, used: bool = True) -> DataFrame:
    """The fact table of the dictionary; with ``used``, how often and when last each entry was met."""
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("canonical"),
        F.col("p_brand").alias("display"),
        kind.alias("type"),
        F.substring(F.lit("ABCDEFGH"), F.col("p_size") % 8 + 1, F.lit(1)).alias("tier"),
        ((F.col("p_size") % 7) * 0.5).cast("double").alias("boost_weight"),
        F.lit("en").alias("language"),
    )
    if not used:
        return parts
    return parts.join(usage(spark, sf_dir), "id", "left").withColumn("occurrence_count", F.coalesce("occurrence_count", F.lit(0)).cast("long"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, alias, is_common_misspelling; one row for each distinct pair."""
    alias = lambda a, wrong: F.struct(a.alias("alias"), F.lit(wrong).alias("is_common_misspelling"))
    forms = F.array(alias(F.col("p_brand"), False), alias(F.col("p_type"), False), alias(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), True))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.inline(forms)).dropDuplicates(["entry_id", "alias"])


def pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, ipa, language: of every fourth size one, of every twelfth another that is empty."""
    size = F.col("p_size")
    ipa = F.array(F.struct(F.concat(F.lit("/"), F.lower("p_type"), F.lit("/")).alias("ipa")), F.struct(F.lit("").alias("ipa")))
    few = F.slice(ipa, 1, F.when(size % 12 == 0, 2).when(size % 4 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.inline(few)).withColumn("language", F.lit("en"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, context: the regions whose suppliers sold the part."""
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("context"))
    )
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entry_id"), F.col("l_suppkey").alias("s_suppkey"))
    return sold.join(places, "s_suppkey").select("entry_id", "context").distinct()


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their aliases and contexts nested: one row for each entry."""
    named = aliases(spark, sf_dir).groupBy(F.col("entry_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("alias", "is_common_misspelling"))).alias("aliases"))
    placed = contexts(spark, sf_dir).groupBy(F.col("entry_id").alias("id")).agg(F.sort_array(F.collect_set("context")).alias("contexts"))
    none = F.array().cast("array<string>")
    return entries(spark, sf_dir).join(named, "id", "left").join(placed, "id", "left").withColumn("contexts", F.coalesce("contexts", none))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript, segment, speaker, text, n_words, start, end: turns laid end to end with gaps."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("transcript"), F.col("turn").alias("segment"), F.col("role").alias("speaker"), F.col("text"), F.size(F.split(F.trim("text"), "\\s+")).cast("long").alias("n_words")
    )
    before = Window.partitionBy("transcript").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("n_words") * 400 + (F.col("segment") % 3) * 300
    start = F.coalesce(F.sum(length).over(before), F.lit(0))
    return turns.withColumn("start", start / 1000).withColumn("end", F.col("start") + F.col("n_words") * 400 / 1000)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript, segment, pos, word, confidence."""
    turns = segments(spark, sf_dir).select("transcript", "segment", F.posexplode(F.split(F.trim("text"), "\\s+")).alias("pos", "word"))
    return turns.withColumn("confidence", ((F.col("transcript") * 31 + F.col("segment") * 17 + F.col("pos") * 7) % 100) / 100)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, start, end in seconds: each event starts an interval of its value's length."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1_000_000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("id"), start.alias("start"), (start + F.abs("value")).alias("end"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, event, n, value: log lines; the payload is the event's JSON."""
    kinds = {"click": "chunk_transcribed", "view": "segment_created", "purchase": "correction_applied", "signup": "session_start", "error": "correction_rejected"}
    name = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("session"), F.coalesce(name, F.col("event_type")).alias("event"), F.get_json_object("props", "$.k").cast("long").alias("n"), "value", "event_id"
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


#: The same relations as common table expressions for DuckDB.
SQL = {
    "usage": "usage AS (SELECT l_partkey AS id, count(*) AS occurrence_count, max(epoch_us(l_shipdate)) AS last_seen_us FROM lineitem GROUP BY 1)",
    "entries": "entries AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS canonical, p_brand AS display, "
    "['person','org','product','event','location','jargon','misc'][p_partkey % 7 + 1] AS type, substr('ABCDEFGH', (p_size % 8 + 1)::BIGINT, 1) AS tier, "
    "((p_size % 7) * 0.5)::DOUBLE AS boost_weight, 'en' AS language, coalesce(occurrence_count, 0) AS occurrence_count, last_seen_us FROM part LEFT JOIN usage ON p_partkey = usage.id)",
    "aliases": "aliases AS (SELECT DISTINCT ON (entry_id, alias) entry_id, alias, wrong AS is_common_misspelling FROM (SELECT p_partkey AS entry_id, p_brand AS alias, false AS wrong FROM part "
    "UNION ALL SELECT p_partkey, p_type, false FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', ''), true FROM part))",
    "pronunciations": "pronunciations AS (SELECT p_partkey AS entry_id, '/' || lower(p_type) || '/' AS ipa, 'en' AS language FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, '', 'en' FROM part WHERE p_size % 12 = 0)",
    "contexts": "contexts AS (SELECT DISTINCT l_partkey AS entry_id, r_name AS context FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "placed": "placed AS (SELECT entry_id, list(context) AS contexts FROM contexts GROUP BY 1)",
    "segments": r"segments AS (SELECT *, start + n_words * 400 / 1000 AS \"end\" FROM (SELECT *, coalesce(sum(n_words * 400 + (segment % 3) * 300) OVER (PARTITION BY transcript ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000 AS start "
    r"FROM (SELECT conv_id AS transcript, turn AS segment, role AS speaker, text, len(string_split_regex(trim(text), '\s+')) AS n_words FROM conversations)))".replace('\\"', '"'),
    "words": r"words AS (SELECT transcript, segment, pos, ws[pos + 1] AS word, ((transcript * 31 + segment * 17 + pos * 7) % 100) / 100 AS confidence FROM "
    r"(SELECT transcript, segment, ws, unnest(range(len(ws))) AS pos FROM (SELECT transcript, segment, string_split_regex(trim(text), '\s+') AS ws FROM segments)))",
    "intervals": 'intervals AS (SELECT user_id AS grp, event_id AS id, (epoch_us(ts) - 1704067200000000) / 1000000 AS start, (epoch_us(ts) - 1704067200000000) / 1000000 + abs(value) AS "end" FROM events)',
    "log_events": "log_events AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session, CASE event_type WHEN 'click' THEN 'chunk_transcribed' WHEN 'view' THEN 'segment_created' WHEN 'purchase' THEN 'correction_applied' "
    "WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'correction_rejected' ELSE event_type END AS event, json_extract_string(props, '$.k')::BIGINT AS n, value, event_id FROM events)",
}


def with_relations(names: str, body: str) -> str:
    """SQL whose WITH clause names the relations wanted; further expressions may follow in the body."""
    made = ", ".join(SQL[n] for n in names.split())
    return f"WITH {made}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
