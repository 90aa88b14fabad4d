from __future__ import annotations

import hashlib
import random
import re
import time

import helpers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sum_of_luhn(digits):
    doubled = [int(d) if i % 2 == len(digits) % 2 - 1 or (len(digits) - i) % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits)]
    return sum(doubled)


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and sum_of_luhn(digits) % 10 == 0, "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if passes(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def ours(text):
    return [s[:3] for s in pii.spans(text) if s[3]]


CASES = [
    "", "mail a.b+c%d@mail8.example.com, or x@y", "a@b.c@d.e f@g@h.i @x.y -@-.-", "..@a..b a@b.c.d-", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.2.3",
    "4463622617512349 4463 6226 1751 2349 4463-6226-1751-2349 0 00000000000000 1 2", "+1 (383) 555-6083 +12345678901234567 +1 5 ++1(((22)))3456789 +4930123456 ((",
    "+49 30 1234567-", "日本 4463622617512349 \U0001F642 a@b.cd", "12 34.1.2.3 4",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_of_cases(text):
    assert ours(text) == base(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1 0.@+-()5%é", max_size=60))
def test_base_spans_of_any_text(text):
    assert ours(text) == base(text)


def test_base_spans_of_made_up_pages():
    pick = random.Random(3)
    parts = [*CASES, "w", " ", ".", "+", "-", "7", "4463622617512349", "10.0.0.1", "x@y.zz"]
    for _ in range(300):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(12)))
        assert ours(text) == base(text)


def kinds(text):
    return [(k, text[a:b]) for k, a, b, is_base, _ in pii.spans(text) if not is_base]


def test_checksums_confirm_and_context_decides():
    assert kinds("pay DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert kinds("DE88 3704 0044 0532 0130 00 XX89370400440532013000 DE89370400440532013000X") == []
    assert kinds("my SSN: 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert kinds("ssn 000-45-6789, ssn 666-45-6789, ssn 123-00-6789") == []
    assert kinds("call (030) 123-4567 today") == [("localphone", "(030) 123-4567")] and kinds("see (030) 123-4567") == []
    assert kinds("order by phone 555 123-4567") == []
    assert kinds("visa 4222222222222") == [("card13", "4222222222222")] and kinds("no 4222222222222") == []


def test_context_moves_scores_of_base_spans_but_keeps_them():
    plain, raised, lowered = (pii.spans(t)[0][4] for t in ("x 10.1.2.3 y", "server 10.1.2.3 y", "version 10.1.2.3 y"))
    assert lowered < plain < raised


@pytest.mark.parametrize("text", ["1" * 2_000_000, "1 " * 1_000_000, "a" * 2_000_000 + "@", "a@" * 1_000_000, "+1(" * 700_000, "1." * 1_000_000, "+1" + "(" * 2_000_000, "AB12" * 500_000, "x@a" + ".b" * 1_000_000])
def test_very_long_texts_take_linear_time(text):
    start = time.time()
    pii.spans(text)
    assert time.time() - start < 20


def test_rows_of_the_operator(spark):
    df, data = helpers.odd(spark, helpers.rows(*CASES, start=200))
    out = pii.detect(df).collect()
    assert len(out) == len(data)
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in out)
    assert got == sorted((str(d[0]), base(d[1] or "")) for d in data)
    assert pii.detect(helpers.none(spark)).collect() == []


def test_query_over_the_table(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.RUN["op12_pii_scan"](spark, small).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        want = base(docs[r.doc_id])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) or not listed


def test_redaction_keeps_columns_and_nulls(spark):
    df, data = helpers.odd(spark, helpers.rows("write to a@b.cd or +1 (383) 555-6083!", start=300))
    out = pii.redacted(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[300] == "write to <email> or <phone>!" and texts[1] is None and texts[2] == ""
