"""URL filters: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The vocabulary is a table of terms with a category and a weight, read from a file or the one below: a
strict term weighs 1, soft ones less, by how often they stand in harmless urls. An automaton over all
terms reads each lower-cased url once; a hit counts only if the characters beside it are not ASCII
letters or digits. A url whose distinct hits weigh 1 or more in all is blocked: one strict term, or
several different soft ones.

Rules are (host, path, verdict); a rule fits its host and every subdomain, where the url's path
starts with the rule's. The longest fitting rule decides, of rules of one length the one whose name
comes last; then the vocabulary is not asked.

Rows are judged in Arrow batches without an exchange; only the two columns named are read, and Spark's
bound on a batch is relied on. Very long urls are read to their end, in time proportional to length.

Defined results: a null url, or one without ``://``, has an empty host and path, so no rule fits;
the vocabulary still reads it (a null url as empty text). Repeated rows get equal results, an
empty table an empty one; other columns of the input never take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
class Term(NamedTuple):
    word: str
    category: str
    weight: float


#: The vocabulary by category, strict terms and soft ones with their weights.
_WORDS = {
    "adult": (
        "porn porno pornhub xxx hentai camgirl camgirls milf bdsm escorts nsfw sexcam",
        {"adult": 0.5, "sex": 0.6, "erotic": 0.6, "nude": 0.6, "nudes": 0.6, "escort": 0.6, "dating": 0.4, "fetish": 0.6, "webcam": 0.4, "hot": 0.2, "teen": 0.3, "singles": 0.4},
    ),
    "gambling": (
        "casino kasino blackjack baccarat sportsbook spielbank",
        {"bet": 0.5, "bets": 0.5, "betting": 0.6, "poker": 0.6, "lottery": 0.5, "lotto": 0.5, "jackpot": 0.6, "slots": 0.6, "roulette": 0.6, "bingo": 0.5, "odds": 0.4, "bonus": 0.5, "win": 0.5, "apuestas": 0.6, "wetten": 0.5, "pari": 0.4},
    ),
    "pills": (
        "viagra cialis levitra xanax tramadol phentermine",
        {"pills": 0.5, "pharmacy": 0.4, "meds": 0.4, "prescription": 0.3, "pillen": 0.5, "farmacia": 0.4, "steroids": 0.6, "weightloss": 0.5},
    ),
    "harm": (
        "malware phishing keylogger ransomware botnet stresser",
        {"crack": 0.5, "cracked": 0.5, "keygen": 0.6, "exploit": 0.4, "hack": 0.4, "hacks": 0.5, "virus": 0.4, "trojan": 0.5},
    ),
    "copies": (
        "warez torrentz putlocker",
        {"torrent": 0.5, "torrents": 0.5, "pirate": 0.4, "nulled": 0.6, "serial": 0.3, "stream": 0.2, "mp3": 0.3},
    ),
    "spam": (
        "spam linkfarm replicawatches paydayloan",
        {"cheap": 0.5, "click": 0.5, "deal": 0.5, "deals": 0.4, "free": 0.5, "loan": 0.5, "loans": 0.5, "payday": 0.6, "prize": 0.5, "promo": 0.5, "replica": 0.6, "discount": 0.4, "coupon": 0.4, "offer": 0.3, "gratis": 0.4, "billig": 0.4, "kredit": 0.4, "forex": 0.5, "crypto": 0.3, "earn": 0.4, "cash": 0.4, "winner": 0.5},
    ),
}
VOCABULARY = tuple(Term(w, c, x) for c, (strict, soft) in _WORDS.items() for w, x in [*((w, 1.0) for w in strict.split()), *soft.items()])


def read_vocabulary(path: str) -> tuple[Term, ...]:
    """Terms of a file with lines of a word, a category and a weight, parted by tabs."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    return tuple(Term(word.strip().lower(), category, float(weight)) for word, category, weight in rows)


_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: what stands after the first ``://``, cut at the marks that end them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _HOST.match(rest).group()
    return host.translate(_LOWER), _PATH.match(rest, len(host)).group()


def fitting_rule(host: str, path: str, rules: tuple[Rule, ...]) -> Rule | None:
    fits = (r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
    return max(fits, key=lambda r: (len(r.name), r.name), default=None)


@lru_cache(maxsize=8)
def automaton(vocabulary: tuple[Term, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term in vocabulary:
        made.add_word(term.word, term)
    made.make_automaton()
    return made


def vocabulary_hits(url: str | None, vocabulary: tuple[Term, ...] = VOCABULARY) -> list[Term]:
    """The distinct terms found between boundaries, the heaviest first."""
    if not vocabulary:
        return []
    low = (url or "").translate(_LOWER)
    found = set()
    for end, term in automaton(vocabulary).iter(low):
        start = end + 1 - len(term.word)
        if (start == 0 or low[start - 1] not in _BESIDE) and (end + 1 == len(low) or low[end + 1] not in _BESIDE):
            found.add(term)
    return sorted(found, key=lambda t: (-t.weight, t.word))


def judge(url: str | None, rules: tuple[Rule, ...] = RULES, vocabulary: tuple[Term, ...] = VOCABULARY) -> dict:
    host, path = split_url(url)
    rule = fitting_rule(host, path, rules)
    hits = vocabulary_hits(url, vocabulary)
    weight = round(sum(t.weight for t in hits), 6)
    return {
        "host": host,
        "path": path,
        "rule": rule and rule.name,
        "weight": weight,
        "verdict": rule.verdict if rule else "block" if weight >= 1 else "allow",
        "terms": [t.word for t in hits],
        "category": hits[0].category if hits else None,
    }


def url_filters(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: tuple[Term, ...] = VOCABULARY) -> DataFrame:
    """key, host, path, rule, verdict, and of the vocabulary's hits the weight, terms and first category."""
    kinds = {"host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(), "weight": pa.float64(), "terms": pa.list_(pa.string()), "category": pa.string()}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judge(u, rules, vocabulary) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[n] for m in made], t) for n, t in kinds.items())], names=[key, *kinds])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(judged, f"`{key}` {kind}, host string, path string, rule string, verdict string, weight double, terms array<string>, category string")


def oracle() -> str:
    """The same verdicts, with a pattern for each row of the vocabulary in place of the automaton."""
    rows = ", ".join(f"('{t.word}', {round(t.weight * 10)})" for t in VOCABULARY)
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(RULES, key=lambda r: (len(r.name), r.name), reverse=True)
    )
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)
    return f"""
    WITH vocabulary(word, tenths) AS (VALUES {rows}),
    parts AS (
      SELECT row_number() OVER () AS n, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
      FROM pages),
    split AS (
      SELECT n, page_id, low,
             translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM parts),
    hits AS (
      SELECT n, sum(tenths) AS tenths FROM split JOIN vocabulary ON contains(low, word) AND regexp_matches(low, '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)') GROUP BY n),
    ruled AS (SELECT *, CASE {cases} END AS rule FROM split LEFT JOIN hits USING (n))
    SELECT page_id, host, path, rule,
           CASE rule {verdicts} ELSE CASE WHEN coalesce(tenths, 0) >= 10 THEN 'block' ELSE 'allow' END END AS verdict
    FROM ruled
    """
