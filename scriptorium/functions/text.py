"""Text functions: normalization, error rates, cleaning of web and book texts, gates on corrections.

Column functions throughout. Whole-document folds over word arrays (edit distances) take pairs of any
length: their time is the product of the lengths of unlike texts, their memory is bounded beside the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import edits as batched

#: Words of a side beyond which the reference refuses a pair; only who asks for that limit has it.
MAX_TOKENS = 50_000
#: HTML entities in the order of their replacement.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&ndash;", "–"))
#: Strings that mark a short line as navigation.
NAVIGATION = ("home", "fiction", "poetry", "essays", "letters", "miscellany", "about", "copyright", "h.p. lovecraft", "return to", "written", "first published")
#: Beginnings of the marker lines of book texts, in the order they are tried.
BOOK_STARTS = ("*** START OF THE PROJECT GUTENBERG", "*** START OF THIS PROJECT GUTENBERG")
BOOK_ENDS = ("*** END OF THE PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG")
#: What could steer a model, in any case.
STEERING = (r"system:", r"assistant:", r"user:", r"<\|.*?\|>", r"\[INST\]", r"\[/INST\]")
#: Entry types by the names of domains.
DOMAIN_TYPES = {
    "person": ("biography", "names", "people", "speakers"),
    "jargon": ("tech", "technical", "programming", "software"),
    "org": ("companies", "organizations", "orgs"),
    "product": ("products", "brands"),
    "location": ("places", "locations", "geography"),
    "event": ("events", "conferences"),
}
#: Ends of company names.
COMPANY_ENDS = ("Inc", "LLC", "Corp", "Ltd", "Co", "Company", "Technologies", "Labs")
SNIPPET_REACH, SNIPPET_MOST = 75, 150


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for several uses, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; there is no built-in function for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(text: Column, keep_case: bool = False, compose: bool = True) -> Column:
    """Words in lower case with single spaces; apostrophes stay only inside or before words."""
    done = F.coalesce(text, F.lit(""))
    done = nfkc(done) if compose else done
    done = done if keep_case else F.lower(done)
    for pattern, by in ((r"[^\p{L}\p{N}_\s']", " "), (r"^'+\s*", ""), (r"\s*'+$", ""), (r"\s'+\s", " "), (r"\s+'\s+", " "), (r"\s+", " ")):
        done = F.regexp_replace(done, pattern, by)
    return F.trim(done)


def tokens(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


#: Least band of an edit table; bits of columns that are kept for the way back, beyond which they are made again; bits
#: of words' rows that are kept, beyond which those of rarer words are made from their places.
_BAND, _KEPT_BITS, _ROW_BITS = 64, 1 << 26, 1 << 30


class _Table:
    """The columns of an edit table within a band, as bits of whole numbers (Myers, Hyyro).

    Row i of column j is bit i - j + up; rows above 0 stand for what would lead away from the start. A column
    is kept as its rises and falls from row to row; ``kept`` tells of a column where it equals its diagonal
    neighbour and where it is one more than its left one, which is all that the way back asks for. Columns
    after ``first`` are kept; ``waiting`` are pieces before them, with the states they begin with.
    """

    def __init__(self, ref: list, hyp: list, most: int):
        self.n, self.m, self.hyp = len(ref), len(hyp), hyp
        self.up, down = (most - self.n + self.m) // 2, (most + self.n - self.m) // 2
        self.width = self.up + down + 1
        self.full = (1 << self.width) - 1
        places: dict = {}
        for i, word in enumerate(ref):
            places.setdefault(word, []).append(i)
        whole = sorted(places, key=lambda w: -len(places[w]))[: _ROW_BITS // max(1, self.n)]
        self.rows = places | {w: self.row(places[w]) for w in whole}
        self.first, self.kept, self.waiting = self.m, [], []
        self.start = (self.full & ~((1 << (self.up + 1)) - 1), (1 << (self.up + 1)) - 1)

    @staticmethod
    def row(places: list[int]) -> int:
        """The bits at rising places."""
        low = places[0] >> 3
        bits = bytearray((places[-1] >> 3) - low + 1)
        for i in places:
            bits[(i >> 3) - low] |= 1 << (i & 7)
        return int.from_bytes(bits, "little") << 8 * low

    def columns(self, j: int, to: int, state: tuple[int, int], out: list | None) -> tuple[tuple[int, int], int]:
        """Go from column j to another; the state there, and by how much the band's upper edge has risen."""
        (rise, fall), full, top, risen = state, self.full, 1 << (self.width - 1), 0
        for j in range(j + 1, to + 1):
            shift = j - self.up - 1
            rows = self.rows.get(self.hyp[j - 1], 0)
            rows = rows if isinstance(rows, int) else self.row(rows)
            eq = (rows >> shift if shift >= 0 else rows << -shift) & full
            rise, fall = rise >> 1 | top, fall >> 1
            same = ((((eq & rise) + rise) ^ rise) | eq | fall) & full
            right = fall | (full & ~(same | rise))
            if out is not None:
                out.append((same, right))
            risen += not same & 1
            left, right = (rise & same) << 1 & full, (right << 1 | 1) & full
            rise, fall = left | (full & ~(same | right)), same & right
        return (rise, fall), risen

    def walk(self, a: int, b: int, state: tuple[int, int]) -> tuple[tuple[int, int], int]:
        """Go from column a to b; as many columns are kept as may be, and before them states to make the others
        from: as many as columns may be kept, so what is held grows with the depth of pieces within pieces."""
        few, risen = max(1, _KEPT_BITS // self.width), 0
        step = few if b - a <= few else max(few, -(-(b - a) // max(2, few)))
        for j in range(a, b, step):
            to = min(j + step, b)
            keep = to == b and to - j <= few
            if keep:
                self.first, self.kept = j, []
            else:
                self.waiting.append((j, to, state))
            state, more = self.columns(j, to, state, self.kept if keep else None)
            risen += more
        return state, risen

    def solve(self) -> int:
        """The distance, if it is within the band."""
        state, risen = self.walk(0, self.m, self.start)
        held = ((1 << (self.n - self.m + self.up + 1)) - 1) & ~1
        return self.up + risen + (state[0] & held).bit_count() - (state[1] & held).bit_count()

    def column(self, j: int) -> tuple[int, int]:
        """What is kept of a column; they are asked for from the last to the first."""
        while j <= self.first:
            self.walk(*self.waiting.pop())
        return self.kept[j - self.first - 1]


def _edits(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Distance, substitutions, insertions, deletions of two token lists; of equal ways substitution comes
    before insertion and that before deletion.

    The band is widened until the distance fits it (Ukkonen), from what the words' counts make certain, so
    alike lists cost their length times their distance. The cells on the way back are on ways of least
    cost, all of which lie in the band, so it is the whole table's. Columns that are too many to keep are
    made again from the nearest state before them.
    """
    n, m = len(ref), len(hyp)
    if not n or not m:
        return n + m, 0, m, n
    shared = sum((Counter(ref) & Counter(hyp)).values())
    most = max(_BAND, abs(n - m), max(n, m) - shared)
    while True:
        table = _Table(ref, hyp, min(most, n + m))
        distance = table.solve()
        if distance <= most:
            break
        most *= 2
    i, j, substituted = n, m, 0
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            continue
        (same, right), at = table.column(j), i - j + table.up
        if not same >> at & 1:
            i, j, substituted = i - 1, j - 1, substituted + 1
        elif right >> at & 1:
            j -= 1
        else:
            i -= 1
    inserted = (distance - substituted + m - n) // 2
    return distance, substituted, inserted, distance - substituted - inserted


def _distance(a: str, b: str) -> int:
    """Edit distance of two strings; the bits of one number are a column of the table (Myers)."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if not b:
        return len(a)
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        places.setdefault(c, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    masks = {c: int.from_bytes(x, "little") for c, x in places.items()}
    up, down = full, 0
    for c in b:
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(across | up)), up & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, less, eq = (more << 1 | 1) & full, (less << 1) & full, eq | down
        up, down = less | (full & ~(eq | more)), more & eq
    return score


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in "dsix"]))
def word_edits(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    """Edit distance of two token arrays of any length, and its substitutions, insertions and deletions."""
    found: list = [None] * len(refs)
    full = []
    for k, (r, h) in enumerate(zip(refs, hyps, strict=True)):
        if r is None or h is None:
            found[k] = (None,) * 4
        elif len(r) and len(h):
            full.append(k)
        else:
            found[k] = (len(r) + len(h), 0, len(h), len(r))
    made = batched.counted([refs.iloc[k].tolist() for k in full], [hyps.iloc[k].tolist() for k in full], batched.words_coded, _edits, True)
    for k, edits in zip(full, made, strict=True):
        found[k] = edits
    return pd.DataFrame(found, columns=["d", "s", "i", "x"], dtype="Int64")


@F.pandas_udf(T.LongType())
def character_edits(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    """Edit distance of two strings."""
    found = [None if r is None or h is None else max(len(r), len(h)) for r, h in zip(refs, hyps, strict=True)]
    # the longer one is what is cut into blocks: the other tells the number of steps
    full = {k: sorted((r, h), key=len, reverse=True) for k, (r, h) in enumerate(zip(refs, hyps, strict=True)) if r and h}
    made = batched.counted([p[0] for p in full.values()], [p[1] for p in full.values()], batched.characters_coded, lambda r, h: (_distance(r, h),), False)
    for k, (distance,) in zip(full, made, strict=True):
        found[k] = distance
    return pd.Series(found, dtype="Int64")


def word_errors(ref: Column, hyp: Column, most: int | None = MAX_TOKENS) -> Column:
    """wer, substitutions, insertions, deletions, n_ref, n_hyp of two texts that are normalized.

    Both empty: 0. Empty reference: infinite, all words inserted. Empty hypothesis: 1, all deleted. A pair
    with more words than ``most`` on a side has no counts, as in the reference; None: all pairs have.
    """
    both = F.struct(tokens(ref).alias("r"), tokens(hyp).alias("h"))
    n_ref, n_hyp = F.size(both["r"]).cast("long"), F.size(both["h"]).cast("long")
    asked = lambda side: both[side] if most is None else F.when(F.greatest(n_ref, n_hyp) <= most, both[side])
    edits = word_edits(asked("r"), asked("h"))
    wer = F.when((n_ref == 0) & (n_hyp == 0), 0.0).when(n_ref == 0, float("inf")).otherwise(edits["d"] / n_ref)
    return F.struct(wer.alias("wer"), edits["s"].alias("substitutions"), edits["i"].alias("insertions"), edits["x"].alias("deletions"), n_ref.alias("n_ref"), n_hyp.alias("n_hyp"))


def character_error_rate(ref: Column, hyp: Column) -> Column:
    """On characters without spaces, by the same rules."""
    a, b = F.replace(ref, F.lit(" "), F.lit("")), F.replace(hyp, F.lit(" "), F.lit(""))
    return F.when((a == "") & (b == ""), 0.0).when(a == "", float("inf")).otherwise(character_edits(a, b) / F.length(a))


def clean_html(html: Column) -> Column:
    """Text of a story page: scripts, styles, comments and tags out, navigation out, from the first
    long line on, in one line."""
    done = F.coalesce(html, F.lit(""))
    for pattern, by in ((r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n"), (r"<[^>]+>", "")):
        done = F.regexp_replace(done, pattern, by)
    for entity, by in ENTITIES:
        done = F.replace(done, F.lit(entity), F.lit(by))

    def from_first_long(lines: Column) -> Column:
        long_ = F.transform(lines, lambda x: F.length(x) > 50)
        return F.filter(lines, lambda x, i: i + 1 >= F.when(F.array_position(long_, True) > 0, F.array_position(long_, True)).otherwise(F.size(lines) + 1))

    lines = F.filter(F.transform(F.split(done, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_menu = lambda x: (F.length(x) < 100) & F.lower(x).rlike("|".join(map(re.escape, NAVIGATION)))
    kept = let(F.filter(lines, lambda x: ~is_menu(x)), from_first_long)
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def clean_book(text: Column) -> Column:
    """What stands between the line of the first start marker tried and that of the first end marker
    tried, in one line; a marker that is missing, or a start without a line after it, cuts nothing."""
    start, end = F.lit(0), F.length(text)
    for marker in reversed(BOOK_STARTS):
        line_end = F.call_function("locate", F.lit("\n"), text, F.locate(marker, text))
        start = F.when(F.contains(text, F.lit(marker)), F.when(line_end > 0, line_end).otherwise(F.lit(0))).otherwise(start)
    for marker in reversed(BOOK_ENDS):
        end = F.when(F.contains(text, F.lit(marker)), F.locate(marker, text) - 1).otherwise(end)
    body = F.substr(text, start + 1, F.greatest(F.lit(0), end - start))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))


def snippet(text: Column, term: Column) -> Column:
    """The sentence around the first hit, in any case; null without one."""
    at = F.instr(F.lower(text), F.lower(term))

    def cut(place: Column) -> Column:
        left = F.substr(text, F.greatest(F.lit(1), place - SNIPPET_REACH), F.least(place - 1, F.lit(SNIPPET_REACH)))
        behind = F.regexp_replace(left, r"(?s)^.*[.!?\n]", "")
        right = F.substr(text, place, F.length(term) + SNIPPET_REACH)
        ahead = F.concat(F.left(right, F.length(term)), F.regexp_extract(F.substr(right, F.length(term) + 1), r"(?s)^([^.!?\n]*[.!?\n]?)", 1))
        whole = F.trim(F.concat(behind, ahead))
        centred = F.concat(F.lit("..."), F.substr(text, F.greatest(F.lit(1), place - SNIPPET_REACH), F.lit(SNIPPET_MOST)), F.lit("..."))
        return F.when(place == 0, F.lit(None)).when(F.length(whole) > SNIPPET_MOST, centred).otherwise(whole)

    return let(at, cut)


def correct_locally(text: Column) -> Column:
    """A capital first letter and a full stop, where they are missing."""
    capital = F.when(F.left(text, F.lit(1)).rlike(r"^\p{Ll}"), F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))).otherwise(text)
    return F.when(F.trim(text) == "", text).otherwise(F.when(capital.rlike(r"[.!?]\z"), capital).otherwise(F.concat(capital, F.lit("."))))


#: White space of all kinds, as a character class's content.
BLANKS = r"\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}"


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def sanitize_prompt(text: Column, most: int = 1000) -> Column:
    """Characters out that are neither printable nor white space, HTML escaped, steering words removed
    one after the other, cut and stripped."""
    done = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\p{{C}}&&[^{BLANKS}]]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        done = F.replace(done, F.lit(a), F.lit(b))
    for pattern in STEERING:
        done = F.regexp_replace(done, f"(?iu){pattern}", "")
    return stripped(F.left(done, F.lit(most)))


def valid_term(term: Column) -> Column:
    """2 to 100 characters, some letter, not only digits, letters at least half."""
    letters = F.length(F.regexp_replace(term, r"\P{L}", ""))
    return F.length(term).between(2, 100) & (letters > 0) & ~term.rlike(r"^[0-9]+$") & (letters * 2 >= F.length(term))


def infer_type(term: Column, domain: Column) -> Column:
    """Entry type by the domain, else by the look of the term."""
    low, parts = F.lower(domain), F.split(stripped(term), r"\s+")
    person = F.size(parts).between(2, 4) & F.forall(parts, lambda w: w.rlike(r"^\p{Lu}"))
    by_domain = F.coalesce(*[F.when(low.isin(list(names)), kind) for kind, names in DOMAIN_TYPES.items()])
    by_look = F.when(person, "person").when(term.rlike(rf"({'|'.join(COMPANY_ENDS)})\z"), "org").otherwise("misc")
    return F.coalesce(by_domain, by_look)


def gate_correction(words: Column, corrected: Column, confident: float = 0.85, most: float = 0.2) -> Column:
    """Whether a correction keeps the words heard with confidence.

    words: array of (word, confidence). Words of one character never count as lost, but do count
    among the protected. Valid if the lost are under ``most`` of the protected, or nothing is
    protected, or there is no text.
    """
    bare = lambda w: F.regexp_replace(F.trim(F.lower(w)), r"""^[.,!?;:"']+|[.,!?;:"']+$""", "")
    protected = F.transform(F.filter(words, lambda w: w["confidence"] >= confident), lambda w: bare(w["word"]))
    # between characters that are no word characters, as words may hold any of them
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(corrected), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))

    def judged(kept: Column) -> Column:
        flat = lambda w: F.concat(F.lit(" "), F.trim(F.regexp_replace(w, r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
        lost = F.filter(kept, lambda w: (F.length(w) >= 2) & ~F.contains(spaced, flat(w)))
        return F.size(lost) < F.size(kept) * most

    return F.when((F.size(words) == 0) | (F.trim(corrected) == ""), True).otherwise(let(protected, lambda p: F.when(F.size(p) == 0, True).otherwise(judged(p))))


def fenced_json(text: Column) -> Column:
    """The content of the first fenced block, or the whole text, trimmed."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(block != "", block).otherwise(text))


def parse_terms(line: Column) -> Column:
    """Terms of a comma-separated line, what stands before a colon left out, blanks dropped."""
    one = F.transform(F.split(line, ","), lambda t: F.trim(F.substring_index(t, ":", -1)))
    return F.filter(one, lambda t: t != "")


def sanitize_vocabulary(terms: Column, most: int = 500) -> Column:
    return F.slice(F.filter(F.transform(terms, lambda t: sanitize_prompt(t)), lambda t: t != ""), 1, most)
