"""Line-first cleaning: judge each line, drop the lines that fail, then judge what is left.

Only DataFrame functions: one projection over the scan, without an exchange. Lambdas get the
word array through a let-binding, so that it is split once for each document.

Rules that a line may break:

* navigation - at most ``NAV_WORDS`` words, and two or more menu separators or a menu word alone;
* boilerplate - at most ``NAV_WORDS`` words, and one of the stock phrases: prose that mentions one stays;
* punctuation - symbols and exclamation marks make up more than ``SYMBOL_PERCENT`` of its characters, or
  it has at most ``NAV_WORDS`` words and breaks off in an ellipsis, as teasers do.

Phrases and menu words are those of four languages; a text is asked for all of them.

A document fails if its base statistics fail (fewer than 10 words, or more than a fifth of its
words in repeated 5-word windows) or if the dropped lines hold more than ``LOST_PERCENT`` of its
words.

Defined results: a null or empty text has no words, so it fails; its clean text is empty. Lines
without a word are kept as they are. Rows are judged one by one, so repeated rows and ties get
equal results and an empty table an empty one. Very long texts and lines are judged whole. Columns of the input that are not named in the call
never take part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import GAPS, WORD_GAP, ascii_lower, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
NAV_WORDS = 12
SYMBOL_PERCENT = 15
LOST_PERCENT = 50
TEASER = r"(?:…|\.\.\.)[\x20\x09-\x0D\])»]*$"
#: Phrases and menu words by language, in lower case.
PHRASES_OF = {
    "en": (
        "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
        "accept cookies", "enable javascript", "lorem ipsum", "subscribe to our", "click here",
        "powered by", "back to top", "read more", "sign up for", "follow us on", "share this",
    ),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren", "mehr erfahren", "nach oben"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "haga clic aquí", "leer más", "volver arriba"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d.utilisation", "accepter les cookies", "cliquez ici", "lire la suite", "haut de page"),
}
MENU_WORDS_OF = {
    "en": ("home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "sitemap", "next", "previous", "share"),
    "de": ("startseite", "anmelden", "abmelden", "suche", "kontakt", "impressum", "weiter", "teilen"),
    "es": ("inicio", "iniciar sesión", "registrarse", "buscar", "contacto", "siguiente", "anterior", "compartir"),
    "fr": ("accueil", "connexion", "rechercher", "plan du site", "suivant", "précédent", "partager"),
}
PHRASES = tuple(p for ps in PHRASES_OF.values() for p in ps)
MENU_WORDS = tuple(w for ws in MENU_WORDS_OF.values() for w in ws)
MENU_LINE = r"(?i)^[\x20\x09-\x0D]*(?:" + "|".join(MENU_WORDS) + r")[\x20\x09-\x0D]*$"
MENU_BYTES = max(len(w.encode()) for w in MENU_WORDS)
A_WORD = r"[^\x20\x09-\x0D]"
SEPARATORS = "|»›•"


def _count_of(text: Column, characters: str) -> Column:
    """How many of the characters stand in the text; one pattern match skips a whole run of others."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes: documents have at most some 100,000 windows, so two
    different ones meet with a probability under 1e-9. Only where a window does repeat are the
    positions sorted; the words covered are then the capped gaps between flagged positions.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(pairs: Column) -> Column:
            twin = F.filter(pairs, lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]))
            # get() is null beyond either end, and a null comparison must count as no twin
            return F.sort_array(F.transform(twin, lambda p: p["i"]))

        def total(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("int"), lambda a, s: a + s)

        return let(let(tagged, flagged), total)

    def judged(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0))

    def windows(hashes: Column) -> Column:
        runs = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))))
        return F.slice(runs, F.lit(1), F.size(hashes) - (WINDOW - 1))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), judged))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0))


def _may_break(text: Column) -> Column:
    """Which rules a text can break at all, so that its lines need not be asked for the others."""
    return F.struct(
        text.rlike(f"[{SEPARATORS}][^{SEPARATORS}]*[{SEPARATORS}]").alias("menu"),
        # lower() also maps some other characters to a-z, so it lets through too much at worst
        F.lower(text).rlike("|".join(PHRASES)).alias("phrase"),
        (F.contains(text, F.lit("...")) | F.contains(text, F.lit("…"))).alias("teaser"),
        text.rlike(f"[{SYMBOLS}!]").alias("symbols"),
    )


def _is_menu_word(line: Column) -> Column:
    """Whether a line is a menu word alone: only lines short enough are looked up."""
    bare = F.btrim(line, F.lit(GAPS))
    return (F.octet_length(bare) <= MENU_BYTES) & ascii_lower(bare).isin(list(MENU_WORDS))


def breaks_rule(line: Column, may: Column) -> Column:
    """Whether a line breaks one of the rules; the costly questions come last."""
    short = F.size(words_of(line)) <= NAV_WORDS
    menu = (may["menu"] & (_count_of(line, SEPARATORS) >= 2)) | _is_menu_word(line)
    phrase = may["phrase"] & ascii_lower(line).rlike("|".join(PHRASES))
    symbols = _count_of(line, SYMBOLS + "!") * 100 > F.length(F.regexp_replace(line, WORD_GAP, "")) * SYMBOL_PERCENT
    return ((menu | phrase | (may["teaser"] & line.rlike(TEASER))) & short) | (may["symbols"] & symbols)


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, clean text and verdict for each row.

    Returns key, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_lines_removed, n_words_removed, base_failed, kept.
    """
    return docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).select(
        F.col("__key").alias(key), *_verdicts(F.col("__text"))
    )


def _verdicts(text: Column) -> list[Column]:
    facts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))

    def by_line(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(A_WORD))
        repeats = let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w)))
        return let(_may_break(text), lambda may: let(F.filter(lines, lambda x: breaks_rule(x, may)), lambda bad: _cleaned(text, lines, may, bad, repeats)))

    lines = let(F.split(text, "\n"), by_line)
    both = let(
        F.struct(facts.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            x["l"]["clean_text"].alias("clean_text"),
            x["w"]["n_words"].alias("n_words"),
            x["w"]["word_chars"].alias("word_chars"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            x["l"]["n_lines"].alias("n_lines"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["l"]["n_lines_removed"].alias("n_lines_removed"),
            x["l"]["n_words_removed"].alias("n_words_removed"),
            ((x["w"]["n_words"] < MIN_WORDS) | (x["w"]["n_repeat_words"] * 100 > x["w"]["n_words"] * REPEAT_PERCENT)).alias("base_failed"),
        ),
    )
    return [
        F.inline(F.array(both)),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
    ]


def _cleaned(text: Column, lines: Column, may: Column, bad: Column, n_dup_lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        n_dup_lines.cast("long").alias("n_dup_lines"),
        F.size(bad).cast("long").alias("n_lines_removed"),
        F.aggregate(bad, F.lit(0).cast("int"), lambda a, x: a + F.size(words_of(x))).cast("long").alias("n_words_removed"),
        F.when(F.size(bad) == 0, text).otherwise(F.array_join(F.filter(lines, lambda x: ~breaks_rule(x, may)), "\n")).alias("clean_text"),
    )


def with_verdict(assessed: DataFrame) -> DataFrame:
    lost = F.col("n_words_removed") * 100 > F.col("n_words") * LOST_PERCENT
    return assessed.withColumn("kept", ~F.col("base_failed") & ~lost)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The full result of the operator: statistics, clean text and verdict."""
    return with_verdict(assess(docs, key, text))


def clean_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows that pass, with their clean text; all other columns as they came.

    The text length column, where there is one, follows the clean text.
    """
    columns = docs.columns
    judged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
    ).select("__row", *_verdicts(F.col("__text")))
    kept = with_verdict(judged).where("kept")
    put = {text: F.col("clean_text"), chars: F.length("clean_text").cast("long")}
    return kept.select(*[put.get(c, F.col("__row")[c]).alias(c) for c in columns])


ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
ruled AS (
  SELECT *, list_transform(lines, lambda x: struct_pack(
      line := x,
      low := translate(x, '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'),
      solid := length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')),
      nw := len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')))) AS ls
  FROM base),
judged AS (
  SELECT *, list_filter(ls, lambda l: l.solid > 0 AND (
      (l.nw <= {NAV_WORDS} AND (length(l.line) - length(regexp_replace(l.line, '[|»›•]', '', 'g')) >= 2
          OR regexp_matches(l.low, '{MENU_LINE}') OR regexp_matches(l.low, '{"|".join(PHRASES)}') OR regexp_matches(l.line, '{TEASER}')))
      OR (length(l.line) - length(regexp_replace(l.line, '[#*$%&|<>!]', '', 'g'))) * 100 > l.solid * {SYMBOL_PERCENT})) AS bad
  FROM ruled),
wins AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM base WHERE len(words) >= 5)),
hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM wins) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hot, generate_series(0, 4) AS g(k) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (lost * 100 > n_words * {LOST_PERCENT}) AS kept
FROM (
  SELECT j.doc_id, len(j.words) AS n_words,
         length(regexp_replace(j.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(j.text) - length(regexp_replace(j.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(j.ls, lambda l: l.solid > 0)) - len(list_distinct(list_transform(list_filter(j.ls, lambda l: l.solid > 0), lambda l: l.line))) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words,
         len(j.words) < {MIN_WORDS} OR 100 * coalesce(r.n, 0) > {REPEAT_PERCENT} * len(j.words) AS base_failed,
         coalesce(list_sum(list_transform(j.bad, lambda l: l.nw)), 0) AS lost
  FROM judged j LEFT JOIN rep r USING (doc_id))
"""
