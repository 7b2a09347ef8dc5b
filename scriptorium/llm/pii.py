"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds follow fixed patterns and tests, and every base span stays, whatever its score: email,
ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). The method adds kinds
whose spans stay if their score reaches ``THRESHOLD``. A score is the kind's prior, plus
``EVIDENCE_GAIN`` for what the span shows by itself, plus ``CONTEXT_GAIN`` if one of the kind's context
words (in four languages) stands within ``CONTEXT_CHARS`` characters of it.

| kind | pattern and checksum | evidence |
|---|---|---|
| iban | compact or in groups of four, mod-97 | its country's registered length |
| ssn | nnn-nn-nnnn with valid ranges | - |
| routing | nine digits, weights 3, 7, 1 modulo 10 | - |
| dni | eight digits and a letter, modulo 23 | written without a space |
| nir | fifteen digits of a French number, key modulo 97 | - |
| taxid | eleven digits of a German number, ISO 7064 mod 11, 10 | - |
| cloud_key | a cloud access key's prefix and 16 capitals or digits | a letter and a digit among them |
| token | a service token's prefix and its body | entropy of the body |
| jwt | three base64 parts, the first two beginning like JSON | - |
| private_key | a PEM block of a private key, or its first line | - |
| password | a value assigned to a name like password or api_key | entropy or mixed characters |
| secret | twenty or more characters of base64 or hex with digits | entropy |

Each text is scanned as a whole by patterns that take time in proportion to its length: the local
part of an email is found from its ``@`` backwards, digit patterns start at the head of a run only,
and the others have fixed beginnings or bounded lengths. Texts are judged one by one in Arrow batches
(Spark's default bounds a batch at 64 MB; a longer text is a batch of its own), without an exchange.

Defined results: null counts as empty; a text without personal data has no spans, and its digest is
that of the empty string. Very long texts are scanned to their end. Spans of one kind do not overlap;
spans of different kinds may, and both are listed. Spans that start together are in the order of
KINDS. Repeated rows get equal results, an empty table an empty one; other columns of the input never
take part. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
PERSONAL_KINDS = ("iban", "ssn", "routing", "dni", "nir", "taxid")
SECRET_KINDS = ("cloud_key", "token", "jwt", "private_key", "password", "secret")
KINDS = (*BASE_KINDS, *PERSONAL_KINDS, *SECRET_KINDS)
PRIOR = {
    "email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6,
    "iban": 0.4, "ssn": 0.3, "routing": 0.2, "dni": 0.3, "nir": 0.4, "taxid": 0.2,
    "cloud_key": 0.4, "token": 0.4, "jwt": 0.8, "private_key": 0.9, "password": 0.1, "secret": 0.1,
}
CONTEXT_GAIN = 0.3
EVIDENCE_GAIN = 0.2
CONTEXT_CHARS = 48
THRESHOLD = 0.5
#: Bits a character of a value that was drawn rather than written.
ENTROPY = 2.7
#: Words that make a kind likelier, in lower case.
_BANK = ("iban", "account", "bank", "transfer", "konto", "überweisung", "cuenta", "banco", "compte", "banque", "virement")
_KEYS = ("key", "token", "secret", "password", "passwd", "pwd", "credential", "credentials", "auth", "bearer", "api", "aws", "schlüssel", "passwort", "clave", "contraseña", "clé", "jeton")
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "kontakt", "correo", "contacto", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse", "servidor", "serveur"),
    "card": ("card", "credit", "visa", "payment", "debit", "karte", "kreditkarte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "teléfono", "móvil", "téléphone"),
    "iban": _BANK,
    "ssn": ("ssn", "social", "security", "insurance"),
    "routing": ("routing", "aba", "transit", "bank", "wire"),
    "dni": ("dni", "nif", "identidad", "documento", "identity"),
    "nir": ("nir", "sécurité", "sociale", "insee", "assuré", "social"),
    "taxid": ("steuer", "steuernummer", "steuer-id", "idnr", "tin", "identifikationsnummer", "tax"),
    **dict.fromkeys(SECRET_KINDS, _KEYS),
}
#: Registered lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Control letters of Spanish numbers by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NINE = re.compile(r"(?<![0-9.-])[0-9]{9}(?![0-9]|[.-][0-9])")
_DNI = re.compile(r"(?<![0-9A-Za-z-])[0-9]{8}[\x20-]?[A-Z](?![0-9A-Za-z])")
_NIR = re.compile(r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])")
_ELEVEN = re.compile(r"(?<![0-9.-])[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}(?![0-9]|[.-][0-9])")
_CLOUD_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|rk_live_|sk-|npm_|pypi-|hf_|AIza|SG\.)([A-Za-z0-9_.-]{20,}+)")
_JWT = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,16}\x20){0,3}PRIVATE KEY-----(?:(?:(?!-----BEGIN)[A-Za-z0-9+/=:,\s-])*?-----END (?:[A-Z0-9]{1,16}\x20){0,3}PRIVATE KEY-----)?")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|passwort|contraseña|secret|token|bearer|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=.~!@#$%^&*-]{8,}+)")
_DRAWN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_BEGINS = re.compile(r"AKIA|ASIA|AGPA|AIDA|AROA|AIza|SG\.|[a-z_]{2}[_-]|xox|eyJ|-----BEGIN")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_CONTEXT = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, w)) + r")(?![^\W\d_])") for k, w in CONTEXT.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float

    @property
    def name(self) -> str:  # as the digests and lists give it
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, the digits summed: a multiple of 10."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11, 10 with the check digit last."""
    product = 10
    for d in map(int, digits[:-1]):
        product = ((d + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def entropy(value: str) -> float:
    """Bits a character, by the value's own frequencies."""
    return sum(-n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a domain after it, back over the local part, as far as the last email."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()


def _spans(pattern: re.Pattern, text: str, holds) -> Iterator[tuple[int, int]]:
    return (m.span() for m in pattern.finditer(text) if holds(m.group()))


def _digits(found: str) -> str:
    return _NOT_DIGITS.sub("", found)


def _is_ip(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def _is_card(found: str) -> bool:
    return 16 <= len(d := _digits(found)) <= 19 and luhn(d)


def _is_phone(found: str) -> bool:
    return 8 <= len(_digits(found)) <= 15


def _is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_routing(found: str) -> bool:
    d = list(map(int, found))
    return (found[:2] <= "12" or "21" <= found[:2] <= "32") and any(d) and sum(w * x for w, x in zip((3, 7, 1) * 3, d, strict=True)) % 10 == 0


def _is_dni(found: str) -> bool:
    return DNI_LETTERS[int(found[:8]) % 23] == found[-1]


def _is_nir(found: str) -> bool:
    d = _digits(found)
    return (97 - int(d[:13]) % 97) == int(d[13:])


def _is_taxid(found: str) -> bool:
    d = _digits(found)
    # of the first ten digits one stands twice or three times and one or two are missing
    return d[0] != "0" and len(set(d[:10])) in (8, 9) and mod11_10(d)


def _is_drawn(value: str) -> bool:
    """Whether a value looks drawn: letters and digits, and as many bits a character as that takes."""
    return bool(_DIGIT.search(value)) and not value.isdigit() and entropy(value) >= ENTROPY


def _mixed(value: str) -> bool:
    """Whether a value has three kinds of characters, as chosen passwords do."""
    return sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())) >= 3


def _personal(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans of kinds with digits and checksums, and whether they show more evidence."""
    for start, end in _spans(_IBAN, text, mod97):
        held = text[start:end].replace(" ", "")
        yield "iban", start, end, IBAN_LENGTHS.get(held[:2]) == len(held)
    yield from (("ssn", *s, False) for s in _spans(_SSN, text, _is_ssn))
    yield from (("routing", *s, False) for s in _spans(_NINE, text, _is_routing))
    yield from (("dni", *s, s[1] - s[0] == 9) for s in _spans(_DNI, text, _is_dni))
    yield from (("nir", *s, False) for s in _spans(_NIR, text, _is_nir))
    yield from (("taxid", *s, False) for s in _spans(_ELEVEN, text, _is_taxid))


def _secrets(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans of secrets, and whether they show more evidence."""
    if _BEGINS.search(text):
        yield from (("cloud_key", *m.span(), _is_drawn(m.group()[4:])) for m in _CLOUD_KEY.finditer(text))
        yield from (("token", *m.span(), _is_drawn(m.group(1))) for m in _TOKEN.finditer(text))
        yield from (("jwt", *m.span(), False) for m in _JWT.finditer(text))
        yield from (("private_key", *m.span(), False) for m in _PEM.finditer(text))
    if "=" in text or ":" in text:
        yield from (("password", *m.span(1), _is_drawn(m.group(1)) or _mixed(m.group(1))) for m in _ASSIGNED.finditer(text))
    yield from (("secret", *m.span(), True) for m in _DRAWN.finditer(text) if _is_drawn(m.group()))


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    if "@" in text:
        yield from (("email", *s, False) for s in emails(text))
    if _DIGIT.search(text):
        yield from (("ip", *s, False) for s in _spans(_IP, text, _is_ip))
        yield from (("card", *s, False) for s in _spans(_CARD, text, _is_card))
        if "+" in text:
            yield from (("phone", *s, False) for s in _spans(_PHONE, text, _is_phone))
        yield from _personal(text)
    yield from _secrets(text)


def find(text: str | None) -> list[Span]:
    """All spans by kind, as KINDS lists them, then by start."""
    text = text or ""
    found = []
    for kind, start, end, evidence in _proposed(text):
        around = (text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]).lower()
        score = min(1.0, PRIOR[kind] + EVIDENCE_GAIN * evidence + CONTEXT_GAIN * bool(_CONTEXT[kind].search(around)))
        if kind in BASE_KINDS or score >= THRESHOLD - 1e-9:
            found.append(Span(kind, start, end, score))
    return found


def redact(text: str | None) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the longest."""
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
    return "".join([*out, (text or "")[at:]])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and its spans (kind, start, end, score), the counts and digests of them, the numbers of added
    spans (personal ones and secrets), and whether there is any span."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            base = [[s for s in f if s.kind in BASE_KINDS] for f in found]
            counts = [pa.array([sum(s.kind == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(",".join(s.name for s in b).encode()).hexdigest() for b in base], pa.string())
            joined = pa.array([",".join(s.name for s in f) for f in found], pa.string())
            added = [pa.array([sum(s.kind in kinds for s in f) for f in found], pa.int64()) for kinds in (PERSONAL_KINDS, SECRET_KINDS)]
            flagged = pa.array([bool(f) for f in found], pa.bool_())
            full = pa.array([[s._asdict() for s in f] for f in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, joined, *added, flagged, full], names=[key, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_personal", "n_secrets", "flagged", "found"])

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    schema = f"`{key}` {kind}, {counts}, base_sha256 string, spans string, n_personal long, n_secrets long, flagged boolean, found array<struct<kind:string,start:long,end:long,score:double>>"
    return docs.select(key, text).mapInArrow(scanned, schema)
