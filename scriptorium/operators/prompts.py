"""Prompts from dictionary entries: terms for a recognizer, a table for a corrector.

Entries are rows (id, canonical, display, type, boost_weight, aliases, contexts, and a source if there is
one). Their order is by id where a prompt takes the first so many of them. A prompt is one row, since
its size is bounded by its budget; everything up to it is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most entries that a prompt looks at.
MOST_ENTRIES = 1000
#: Labels of groups by entry type.
LABELS = {
    "person": "People", "place": "Places", "location": "Places", "org": "Organizations", "organization": "Organizations",
    "product": "Products", "technical": "Technical", "event": "Events", "jargon": "Terms", "medical": "Medical",
    "legal": "Legal", "misc": "Other", "other": "Other",
}
#: Labels in the order of their groups.
LABEL_ORDER = ("People", "Places", "Organizations", "Products", "Events", "Terms", "Technical", "Medical", "Legal", "Other")
#: How a prompt begins, by context.
BEGINNINGS = {
    "running": "This is a conversation about running and fitness.",
    "work": "This is a discussion about pharmaceutical quality systems.",
    "asr_dev": "This is a technical discussion about speech recognition.",
    "cycling": "This is a conversation about cycling and biking.",
    "tech": "This is a technical discussion about software development.",
    "medical": "This is a medical conversation. Be precise with terminology.",
    "finance": "This is a discussion about finance and investing.",
    "lovecraft": "This is a reading of H.P. Lovecraft cosmic horror fiction.",
    "biography": "This is biographical content with historical names and places.",
}
#: What stands before and after the table of terms.
TABLE_HEAD = (
    "## Vocabulary Hints (SUGGESTIONS ONLY - not guaranteed to appear)\n\n"
    "These terms MAY appear in this transcript. They are hints, not facts.\n"
    "Only apply a term if ASR output contains a NEAR-MISS (phonetic or spelling).\n\n"
    "| Term | Type | Aliases | Notes |\n|------|------|---------|-------|\n"
)
TABLE_FOOT = (
    "\n\nNEAR-MISS RULE:\n"
    "- ONLY apply a vocabulary term if the raw ASR contains a phonetically similar word\n"
    "- Example: 'Soon toe' → 'Suunto' (sounds similar) ✓\n"
    "- Example: 'shoe' → 'Suunto' (no phonetic match) ✗\n"
    "- When in doubt, keep the original ASR text"
)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least; nothing for no text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def type_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.lower(kind)), F.lit("Other"))


def for_context(entries: DataFrame, context: str | None = None) -> DataFrame:
    """Entries of a context, and at four fifths of their weight those of none, with their effective weight
    and place."""
    tagged = F.lit(True) if context is None else F.exists("contexts", lambda c: F.lower(c) == context.lower())
    untagged = F.size(F.coalesce("contexts", F.array().cast("array<string>"))) == 0
    kept = entries.withColumn("effective", F.when(tagged, F.col("boost_weight")).when(untagged, F.col("boost_weight") * 0.8))
    return kept.where("effective is not null").orderBy(F.col("effective").desc(), "id")


def _proper(aliases: Column, n: int) -> Column:
    """Of the first n aliases those that are no misspellings."""
    return F.transform(F.filter(F.slice(F.coalesce(aliases, F.array().cast("array<struct<alias:string,is_common_misspelling:boolean>>")), 1, n), lambda a: ~a["is_common_misspelling"]), lambda a: a["alias"])


def term_prompt(entries: DataFrame, max_tokens: int = 200, context: str | None = None) -> DataFrame:
    """One row, prompt: groups of terms by label, as many as the budget holds.

    A running sum over each group's terms tells how many of them any budget pays for, so the groups,
    of which there are ten at most, only hand on what is left.
    """
    if max_tokens <= 0:
        raise ValueError("a prompt needs room for one token at least")
    opening = f"{BEGINNINGS[context]} You may hear:" if context in BEGINNINGS else "You may hear proper nouns:"
    first = entries.orderBy("id").limit(MOST_ENTRIES)
    others = F.filter(_proper(F.col("aliases"), 2), lambda a: F.lower(a) != F.lower("canonical"))
    place = F.array_position(F.array(*map(F.lit, LABEL_ORDER)), type_label(F.col("type")))
    terms = first.select((-F.col("boost_weight")).alias("b"), "id", place.alias("place"), F.posexplode(F.concat(F.array("canonical"), others)).alias("pos", "term"))
    cost = estimate_tokens(F.concat("term", F.lit(", ")))
    upto = terms.withColumn("upto", F.sum(cost).over(Window.partitionBy("place").orderBy("b", "id", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    groups = upto.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("b", "id", "pos", "term", "upto"))).alias("terms"))
    listed = groups.agg(F.sort_array(F.collect_list(F.struct("place", "terms"))).alias("groups"))

    def written(label: Column, some: Column) -> Column:
        return F.concat(F.lit("["), label, F.lit(": "), F.array_join(F.transform(some, lambda t: t["term"]), ", "), F.lit("]"))

    def spend(state: Column, group: Column) -> Column:
        label = F.element_at(F.array(*map(F.lit, LABEL_ORDER)), group["place"].cast("int"))
        left = F.lit(max_tokens) - state["used"]
        whole = written(label, group["terms"])
        frame = estimate_tokens(F.concat(F.lit("["), label, F.lit(": ]"))) + 1
        paid = F.filter(group["terms"], lambda t: t["upto"] + frame <= left)
        part = F.when(estimate_tokens(whole) + 1 <= left, whole).when(F.size(paid) > 0, written(label, paid))
        used = state["used"] + F.when(part.isNull(), 0).otherwise(estimate_tokens(part) + 1)
        return F.struct(used.cast("int").alias("used"), F.when(part.isNull(), state["parts"]).otherwise(F.concat(state["parts"], F.array(part))).alias("parts"))

    start = F.struct(estimate_tokens(F.lit(opening + " ")).alias("used"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate("groups", start, spend)["parts"]
    return listed.select(F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit(opening + " "), F.array_join(parts, " "))).alias("prompt"))


def escape_cell(text: Column) -> Column:
    return F.trim(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def correction_table(entries: DataFrame, max_entries: int = 100) -> DataFrame:
    """One row, block: a table of the entries with the highest boost, with up to three aliases and notes."""
    if max_entries <= 0:
        raise ValueError("a block needs room for one entry at least")
    source = F.col("source") if "source" in entries.columns else F.lit(None).cast("string")
    given = lambda c: F.nullif(c, F.lit(""))
    notes = F.concat_ws("; ", F.when(F.col("display") != F.col("canonical"), given(F.col("display"))), F.concat(F.lit("Source: "), given(source)))
    cells = (escape_cell(F.col("canonical")), F.coalesce("type", F.lit("misc")), F.array_join(F.transform(_proper(F.col("aliases"), 3), escape_cell), ", "), escape_cell(notes))
    row = F.concat(F.lit("| "), *[x for c in cells[:-1] for x in (c, F.lit(" | "))], cells[-1], F.lit(" |"))
    top = entries.orderBy("id").limit(MOST_ENTRIES).orderBy(F.col("boost_weight").desc(), "id").limit(max_entries)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("boost_weight")).alias("b"), "id", row.alias("row"))))
    body = F.array_join(F.transform(listed, lambda x: x["row"]), "\n")
    return top.agg(F.when(F.count(F.lit(1)) == 0, "").otherwise(F.concat(F.lit(TABLE_HEAD), body, F.lit(TABLE_FOOT))).alias("block"))


def both(entries: DataFrame, max_tokens: int = 200, max_entries: int = 100, context: str | None = None) -> DataFrame:
    """One row: prompt and block."""
    rows = term_prompt(entries, max_tokens, context).select("prompt", F.lit(None).cast("string").alias("block"))
    rows = rows.unionByName(correction_table(entries, max_entries).select(F.lit(None).cast("string").alias("prompt"), "block"))
    return rows.agg(F.max("prompt").alias("prompt"), F.max("block").alias("block"))
