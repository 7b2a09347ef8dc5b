"""Chat formatting: a visitor flattens typed parts, and a reversible template marks the turns.

A turn's content is a text or a list of parts: text, image, audio, document. The visitor turns the
parts into one string in order; an attachment becomes a numbered placeholder, and its reference and
the tokens it expands to are recorded. The template writes

    <|turn|>role<|says|>content<|over|>

and a newline for each turn. Control strings inside roles and texts - whatever begins like one of
the template's marks, and the marks of other common templates - get a backslash after their first
character, besides any that stand there already, so that removing one gives the text back.

Rows are brought together by conversation, sorted by turn, and formatted as a stream: a task holds
one Arrow batch, however long a conversation is. The digest of a conversation is read back from
what was written, turn by turn.

Defined results: null texts and roles count as empty; rows with a null conversation id form one
conversation. Turns that tie are ordered by role, then text, nulls first; repeated rows are turns of
their own. Only content of the assistant role is in the loss mask, without its marks. An empty table
gives no conversations; other columns never take part. Very long texts are formatted whole: one larger than
Spark's bound on an Arrow batch is a batch of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
#: The beginnings of control strings, of this template and others.
_CONTROL = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
_ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_READ = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|over\|>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")
IMAGE_PATCH = 28
SOUND_TOKENS_A_SECOND = 25
PAGE_TOKENS = 512


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor: Visitor) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: Visitor) -> None:
        visitor.image(self)


@dataclass(frozen=True)
class Sound:
    ref: str
    seconds: float = 0.0

    def accept(self, visitor: Visitor) -> None:
        visitor.sound(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0

    def accept(self, visitor: Visitor) -> None:
        visitor.document(self)


@dataclass
class Visitor:
    """Flattens parts in order: the string so far, and an entry for each attachment."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def text(self, part: Text) -> None:
        self.pieces.append(escape(part.text))

    def image(self, part: Image) -> None:
        self._attach("image", part.ref, max(1, math.ceil(part.width / IMAGE_PATCH)) * max(1, math.ceil(part.height / IMAGE_PATCH)))

    def sound(self, part: Sound) -> None:
        self._attach("audio", part.ref, max(1, math.ceil(part.seconds * SOUND_TOKENS_A_SECOND)))

    def document(self, part: Document) -> None:
        self._attach("document", part.ref, max(1, part.pages) * PAGE_TOKENS)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": ref, "tokens": tokens})


Part = Text | Image | Sound | Document


def part_of(row: dict) -> Part:
    """A part from a struct with a field ``type`` and the fields that its type needs."""
    match row["type"]:
        case "image":
            return Image(row.get("ref") or "", row.get("width") or 0, row.get("height") or 0)
        case "audio":
            return Sound(row.get("ref") or "", row.get("seconds") or 0.0)
        case "document":
            return Document(row.get("ref") or "", row.get("pages") or 0)
        case _:
            return Text(row.get("text") or "")


def format_turn(role: str | None, content: str | list[Part] | None) -> tuple[str, list[dict]]:
    """One written turn and its attachments."""
    visitor = Visitor()
    for part in [Text(content or "")] if isinstance(content, str | None) else content:
        part.accept(visitor)
    return f"{TURN}{escape(role or '')}{SAYS}{''.join(visitor.pieces)}{OVER}\n", visitor.attachments


def read_turns(written: str) -> Iterator[tuple[str, str]]:
    """Role and content of each turn of a written conversation, unescaped."""
    for m in _READ.finditer(written):
        yield unescape(m[1]), unescape(m[2])


def expanded(written: str, attachments: list[dict]) -> str:
    """The written turn with each placeholder repeated as often as its attachment has tokens."""
    return _PLACEHOLDER.sub(lambda m: f"<|{m[1]}|>" * attachments[int(m[2])]["tokens"], written)


def _ordered(turns: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """Each conversation in one partition, in the order of its turns."""
    narrow = turns.select(F.col(key).alias("__key"), F.col(turn).alias("__turn"), F.col(role).alias("__role"), F.col(content).alias("__content"))
    ranked = ["__key", "__turn", "__role"] + (["__content"] if dict(narrow.dtypes)["__content"] == "string" else [])
    return narrow.repartition("__key").sortWithinPartitions(*ranked)


def _content(value) -> str | list[Part] | None:
    return [part_of(p) for p in value] if isinstance(value, list) else value


def format_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """A row for each turn, sorted within its conversation: written, attachments, and loss_start and
    loss_end (code points within the written turn; null outside the mask). ``content`` is a string or
    an array of part structs."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        for batch in batches:
            made = []
            for r, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                line, attached = format_turn(r, _content(c))
                start = line.index(SAYS) + len(SAYS)
                made.append((line, attached, *((start, len(line) - len(OVER) - 1) if r == "assistant" else (None, None))))
            columns = [batch.column(0), batch.column(1), *(pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), kind, pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, turn, "written", "attachments", "loss_start", "loss_end"])

    kinds = dict(turns.dtypes)
    schema = f"`{key}` {kinds[key]}, `{turn}` {kinds[turn]}, written string, attachments array<struct<kind:string,ref:string,tokens:long>>, loss_start long, loss_end long"
    return _ordered(turns, key, turn, role, content).mapInArrow(written, schema)


class Digest:
    """What is read back from the written turns of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, written: str, start: int | None, end: int | None) -> None:
        self.chars += len(written)
        for role, text in read_turns(written):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(written[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())


def digests(written: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation of format_turns' rows, in the partitions where they stand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, digest, done = None, None, []

        def flush() -> pa.RecordBatch:
            rows = [(k, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars) for k, d in done]
            done.clear()
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for k, line, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if digest is None or k != now:
                    now, digest = k, Digest()
                    done.append((k, digest))
                digest.add(line, start, end)
            open_ = done.pop()
            if done:
                yield flush()
            done.append(open_)
        if done:
            yield flush()

    kind = dict(written.dtypes)[key]
    schema = f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return written.select(key, "written", "loss_start", "loss_end").mapInArrow(read, schema)


#: Written lengths follow from the texts: the marks, and a backslash for each control string.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(role || chr(10) || text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) - 1 + 25 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
