"""Personal data in texts: proposals by pattern, validators, and context words.

Patterns propose spans, in time linear in the text: an address is proposed at its ``@``
and grows to the left, digit runs are entered at their start only. Validators confirm:
Luhn for cards, mod-97 and the country's length for IBANs, ranges for IP parts and
social-security numbers, digit counts for phones. Each kind has a prior score, which
words near the span raise or lower. The four base kinds keep every confirmed span; the
other kinds need a score of ``THRESHOLD``, so those without a checksum need their
context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "card13", "localphone")
THRESHOLD = 0.5
WINDOW = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "card13": 0.3, "localphone": 0.2}
RAISED, LOWERED = 0.35, 0.3

# fixed values: words that speak for a kind, in the languages of the corpus
FOR = {
    "email": "email mail contact write courriel correo kontakt",
    "ip": "ip address server host client adresse dirección",
    "card": "card visa mastercard amex credit debit payment carte tarjeta karte kreditkarte",
    "phone": "phone tel call mobile cell fax telephone téléphone appel teléfono llame móvil telefon anruf handy",
    "iban": "iban account bank konto compte cuenta banque banco",
    "ssn": "ssn social security",
}
FOR = {kind: frozenset(words.split()) for kind, words in FOR.items()}
FOR |= {"card13": FOR["card"], "localphone": FOR["phone"]}
# fixed values: words that speak against any kind
AGAINST = frozenset("version release isbn issn doi sku invoice order ticket section figure page test example dummy".split())
# fixed values: lengths of IBANs by country
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCALPHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")
WORD = re.compile(r"[^\W\d_]+")
DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has its country's length and check digits."""
    if len(iban) != IBAN_LENGTH.get(iban[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            past = m.end()
            yield start, past


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _chains(text: str) -> Iterator[tuple[int, int, str]]:
    """Longest digit chains of 13 to 19 digits that pass Luhn."""
    for m in CHAIN.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), digits


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, DIGITS)) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        # the pattern may run on into words behind: the country says how long it is
        want, at = IBAN_LENGTH.get(m[0][:2], 0), m.start()
        for size in (i for i, c in enumerate(m[0], 1) if c != " "):
            whole = m[0][:size].replace(" ", "")
            if len(whole) == want:
                following = text[at + size:at + size + 1]
                if mod97(whole) and not (following.isascii() and following.isalnum()):
                    yield at, at + size
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def scored(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised or lowered by words near the span."""
    near = {w.lower() for w in WORD.findall(text, max(start - WINDOW, 0), start)} | {w.lower() for w in WORD.findall(text, end, end + WINDOW)}
    return min(max(PRIOR[kind] + RAISED * bool(near & FOR[kind]) - LOWERED * bool(near & AGAINST), 0.0), 1.0)


def spans(text: str) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) in code points, by start and then kind."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if "+" in text:
        found += [("phone", *s) for s in _phones(text)]
    if not text.isalpha():
        found += [("ip", *s) for s in _ips(text)]
        found += [("card" if len(d) > 13 else "card13", a, b) for a, b, d in _chains(text)]
        found += [("iban", *s) for s in _ibans(text)]
        found += [("ssn", *s) for s in _ssns(text)]
        found += [("localphone", *m.span()) for m in LOCALPHONE.finditer(text)]
    if not found:
        return []
    out = [(k, a, b, k in BASE, scored(text, k, a, b)) for k, a, b in found]
    taken = [(a, b) for _, a, b, base, _ in out if base]
    taken.sort()

    def clear(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, y in taken)

    out = [s for s in out if s[3] or s[4] >= THRESHOLD and clear(s[1], s[2])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
FIELDS = ("kind", "start", "end", "base", "score")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [[dict(zip(FIELDS, s, strict=True)) for s in spans(t.as_py() or "")] for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, SPAN_TYPE)], names=["doc_id", "spans"])
        release()


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base, score) of every row of ``docs`` (doc_id, text).

    Spans count code points, ends excluded; they come by start, then kind. Base kinds of one
    sort never overlap one another, other kinds never overlap base spans. Null and empty
    texts have no spans, repeated rows are scanned as often as they stand, other columns
    are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id bigint, spans {SPANS}")


def _mask(at_least: float):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array([None if t is None else masked(t, at_least) for t in part.column("text").to_pylist()], pa.string()))
            release()

    return mask


def masked(text: str, at_least: float = THRESHOLD) -> str:
    """The text with each span of at least that score replaced by its kind, overlaps by the first one's."""
    out, past = [], 0
    for kind, a, b, _, score in spans(text):
        if score < at_least:
            continue
        if a >= past:
            out += [text[past:a], f"<{kind}>"]
        past = max(past, b)
    return "".join([*out, text[past:]])


def redacted(docs: DataFrame, at_least: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all columns stay, null texts stay null."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_mask(at_least), docs.withColumn("text", F.col("text").cast("string")).schema)
