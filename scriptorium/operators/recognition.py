"""A slot for entity recognizers: any model that is loaded once in a worker and asked text by text.

A loader is a function without arguments that returns a function of a text and labels, which gives dictionaries with
text, label, score, start and end. It is called at most once in each Python worker, whatever number of batches and
tasks the worker sees. The default model has rules only.

Defined results: null and blank texts have no entities. Characters that are neither printable nor white space, and white
space at the ends, are taken out before, and places are those of the text that is left. A text for which the model
fails has an empty list, and so has every text if the model cannot be loaded there. Entities without text or label,
and with scores that are missing, no number, or out of 0 to 1, are left out; the rest stand by falling score, equal
ones in the model's order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import COMPANY_ENDS, let, snippet
from scriptorium.operators.learning import discover, supported

Predict = Callable[[str, Sequence[str]], list[dict[str, Any]]]
Loader = Callable[[], Predict]
#: What a zero-shot model is asked for, and the entry types that its answers become.
LABELS = ("person", "organization", "product", "event", "location", "technology", "term")
ENTRY_TYPES = {"person": "person", "organization": "org", "product": "product", "event": "event", "location": "location", "technology": "jargon", "term": "jargon"}
_KIND = pa.list_(pa.struct([("text", pa.string()), ("entity_type", pa.string()), ("confidence", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
ENTITIES = "array<struct<text:string,entity_type:string,confidence:double,start:long,end:long>>"

#: Bytes of text, and texts, whose entities a worker holds at a time.
PART_BYTES, PART_TEXTS = 1 << 20, 512

_loaded: dict[str, Predict | None] = {}


def rules() -> Predict:
    """Runs of capitalized words: persons of two and more, organizations by their last word, locations by the
    word before, other terms. The more words, the surer."""
    word, gap, near = re.compile(r"([A-Z][a-z]+)([.,;:!?]?)"), re.compile(r"[ \t\n\f\r]"), ("in", "at", "from")

    def predict(text: str, labels: Sequence[str]) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        run: list[str] = []
        at = start = end = 0
        before = last = ""

        def close() -> None:
            if run:
                label = "organization" if run[-1] in COMPANY_ENDS else "person" if len(run) > 1 else "location" if before in near else "term"
                if label in labels:
                    out.append({"text": text[start:end], "label": label, "score": min(1.0, 0.4 + 0.2 * len(run)), "start": start, "end": end})
                run.clear()

        for token in gap.split(text):
            if found := word.fullmatch(token):
                if not run:
                    start, before = at, last
                run.append(found[1])
                end = at + len(found[1])
                if found[2]:
                    close()
            else:
                close()
            at += len(token) + 1
            last = token
        close()
        return out

    return predict


def cleaned(text: str) -> str:
    return "".join(c for c in text.strip() if c.isprintable() or c.isspace())


def entities_of(text: str | None, predict: Predict | None, labels: Sequence[str], least: float) -> list[dict[str, Any]]:
    """The entities of one text."""
    text = cleaned(text or "")
    if not text or predict is None:
        return []
    try:
        found = predict(text, labels)
        out = []
        for e in found:
            score, name, label = e.get("score", 0.0), (e.get("text") or "").strip(), (e.get("label") or "").strip()
            if isinstance(score, int | float) and max(least, 0.0) <= score <= 1.0 and name and label:
                out.append({"text": name, "entity_type": label, "confidence": float(score), "start": e.get("start"), "end": e.get("end")})
    except Exception:  # noqa: BLE001 - whatever a model raises, its text has no entities
        return []
    return sorted(out, key=lambda e: -e["confidence"])


def model_of(load: Loader) -> Predict | None:
    """The worker's model, loaded when it is first asked for; None if it cannot be."""
    name = f"{load.__module__}.{load.__qualname__}"
    if name not in _loaded:
        try:
            _loaded[name] = load()
        except Exception:  # noqa: BLE001
            _loaded[name] = None
    return _loaded[name]


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about PART_BYTES of a text column, each of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + PART_BYTES, "right")), at + 1), at + PART_TEXTS)
        yield batch.slice(at, to - at)
        at = to


def with_entities(rows: DataFrame, text: str = "text", load: Loader = rules, labels: Sequence[str] = LABELS, least: float = 0.5) -> DataFrame:
    """The rows with ``entities``; texts are read whole, in Arrow batches, without an exchange. A worker holds the
    entities of one part of a batch, however many rows or long texts it has."""
    names, asked = rows.columns, tuple(labels)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model_of(load)
        at = names.index(text)
        for batch in (part for b in batches for part in parts(b, at)):
            found = [entities_of(t, predict, asked, least) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _KIND)], names=[*names, "entities"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(made, f"{schema}, entities {ENTITIES}")


def _names(entities: Column) -> Column:
    """text, entity_type, confidence, count of each name among entities, in any case: the surest sighting, of equally
    sure ones the first, and how many there are. Equal names stand side by side in a sorted array."""
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(F.lower(e["text"]).alias("name"), (-e["confidence"]).alias("unsure"), e["start"].isNull().alias("nowhere"), e["start"].alias("start"), e["text"].alias("text"), e["entity_type"].alias("entity_type"))))

    def counted(es: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(es, i)["name"] != F.get(es, i - 1)["name"])
        places = F.filter(F.transform(es, lambda _, i: i), new)
        one = lambda e, n: F.struct(e["text"].alias("text"), e["entity_type"].alias("entity_type"), (-e["unsure"]).alias("confidence"), n.cast("long").alias("count"))
        return let(places, lambda ps: F.transform(ps, lambda p, k: one(F.get(es, p), F.coalesce(F.get(ps, k + 1), F.size(es)) - p)))

    return let(ordered, counted)


def discovered_nouns(segments: DataFrame, known: DataFrame, common: tuple[str, ...], load: Loader = rules, min_confidence: float = 0.7, least: int = 1, key: str = "transcript") -> DataFrame:
    """key, text, type, confidence, count, outcome, snippet: names that a recognizer finds in a transcript's text, by
    the gates of discovery against what was heard there (raw_text, else the text), with the sentence around the
    first hit. segments: key, segment, text, raw_text. known: form, in lower case.

    A transcript's names are counted, looked up among its words and given their sentences where its text is, so only
    names leave it.
    """
    line = F.struct("segment", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("raw_text", "text", F.lit("")).alias("raw"))
    whole = segments.groupBy(key).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    joined = lambda c: F.array_join(F.transform("lines", lambda x: x[c]), " ")
    whole = with_entities(whole.select(key, joined("text").alias("said"), joined("raw").alias("raw")), "said", load)
    each = whole.select(key, "said", F.array_distinct(F.split(F.lower("raw"), r"\s+")).alias("words"), F.inline(_names(F.col("entities"))))
    heard = supported(F.col("text"), F.col("words")).isNotNull()
    names = each.where(F.col("confidence") >= min_confidence).select(key, "text", "entity_type", "confidence", "count", heard.alias("heard"), F.when(heard, snippet(F.col("said"), F.col("text"))).alias("snippet"))
    found = discover(names, known, common, min_confidence, least, by_sound=None)
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in ENTRY_TYPES.items() for x in pair])[F.col("entity_type")], F.lit("misc"))
    return found.select(key, "text", kind.alias("type"), "confidence", "count", "outcome", F.when(F.col("outcome") == "discovered", F.col("snippet")).alias("snippet"))
