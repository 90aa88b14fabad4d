from __future__ import annotations

import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import digests, masking, scores, text
from sluice.operators import evaluation, ledger

KEY = b"k" * 20


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hmac_matches_the_standard_library(spark):
    for msg in ("", "abc", "x" * 200, "naïve"):
        assert one(spark, digests.hmac_sha256(F.lit(msg), KEY)) == hmac.new(KEY, msg.encode(), hashlib.sha256).hexdigest()


def test_sequence_number(spark):
    want = int.from_bytes(hashlib.sha256(b"9|case|S1").digest()[:8], "big") % 10**5
    assert one(spark, digests.sequence_number("9", 5, F.lit("case"), F.lit("S1"))) == str(want).zfill(5)


def chain(n):
    prev, rows = "", []
    for seq in range(1, n + 1):
        body = {"seq": seq, "at": f"2024-01-01T00:00:{seq:02d}+00:00", "actor": 'o"x', "action": "a", "target": "t", "detail": {"n": seq}, "prev": prev}
        digest = hmac.new(KEY, json.dumps(body, sort_keys=True, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()
        rows.append([1, seq, body["at"], body["actor"], "a", "t", json.dumps(body["detail"], separators=(",", ":")), prev, digest])
        prev = digest
    return rows


AUDIT = "ledger int, seq bigint, logged_at string, actor string, action string, target string, detail string, prev_hash string, entry_hash string"


def test_audit_chain_intact_and_tampered(spark):
    rows = chain(30)
    ok = ledger.verify_chain(spark.createDataFrame(rows, AUDIT), ["ledger"], KEY).first()
    assert ok.intact and ok.entries == 30 and ok.broken_at is None
    rows[11][6] = '{"n":99}'
    bad = ledger.verify_chain(spark.createDataFrame(rows, AUDIT), ["ledger"], KEY).first()
    assert not bad.intact and bad.broken_at == 12
    del rows[4]
    assert ledger.verify_chain(spark.createDataFrame(rows, AUDIT), ["ledger"], KEY).first().broken_at == 6


def test_split_lag_crosses_ranges(spark):
    df = spark.createDataFrame([(1, s, f"v{s}") for s in (3, 5, 12, 30, 31)], "k int, s bigint, v string")
    got = [r.p for r in ledger.previous_value(df, ["k"], "s", "v", "p", width=10).orderBy("s").collect()]
    assert got == [None, "v3", "v5", "v12", "v30"]


def merkle(leaves):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"genesis").hexdigest()


def test_merkle_roots_of_all_sizes(spark):
    rows, want = [], {}
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [f"{n}-{i}" for i in range(n)]
        rows += [(n, i, x) for i, x in enumerate(leaves)]
        want[n] = merkle(leaves)
    rows.append((99, 0, None))
    want[99] = merkle([])
    df = spark.createDataFrame(rows, "block int, pos int, serialized string")
    assert {r.block: r.root for r in ledger.merkle_roots(df).collect()} == want


def test_masks(spark):
    assert one(spark, masking.mask_holder(F.lit("Rohan Al"))) == "R**** A***"
    assert one(spark, masking.mask_imei(F.lit("356938035643809"))) == "**** ****3809"
    assert one(spark, masking.mask_account(F.lit("AC0173920021"))) == "AC01******21"
    assert one(spark, masking.mask_account(F.lit("AC01"))) == "AC01"
    assert one(spark, masking.mask_ref(F.lit("HDF-000123"))) == "HDF-****-0123"


@pytest.mark.parametrize("raw,want", [
    ("2024-05-01T10:00:00Z", 1714557600), ("2024-05-01 10:00:00", 1714557600), ("2024-05-01T10:00:00.", 1714557600),
    ("2024-05-01T10:00:00.123456789", 1714557600), ("2024-05-01T15:30:00+05:30", 1714557600), ("2024-05-01", None), ("soon", None),
])
def test_flexible_timestamps(spark, raw, want):
    assert one(spark, F.unix_timestamp(text.flexible_timestamp(F.lit(raw)))) == want


def test_amount_rules(spark):
    adj = lambda r, a: one(spark, scores.amount_adjusted(F.lit(r), F.lit(a)))
    assert adj(0.5, 50.0) == pytest.approx(0.2) and adj(0.01, 2e7) == 0.72 and adj(1.0, 5e5) == 1.0 and adj(0.5, 0.0) == pytest.approx(0.175)


def test_phrases(spark):
    say = lambda f, v: one(spark, text.phrase(F.lit(f), F.lit(float(v))))
    for feature, (label, unit) in text.MEASURES.items():
        form, factor = text.UNITS[unit]
        assert say(feature, 2.26) == f"{label}: " + form % (2.26 * factor)
    assert say("log_total_out", np.log(1235.2)) == "total outflow: 1234"
    assert [say(f, v) for f in text.MARKS for v in (0, 1)] == [f"{label}: {w}" for label in text.MARKS.values() for w in ("no", "yes")]
    assert say("other_thing", 2) == "other thing: 2.00"


def test_mcnemar_and_bootstrap(spark):
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 1 + [(True, True)] * 5, "a_correct boolean, b_correct boolean")
    assert evaluation.mcnemar(pairs).first().p_value == pytest.approx(2 * (1 + 9) / 2**9)
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(20)], "case_id bigint, a double, b double")
    better = spark.createDataFrame([(i, 1.0 + i % 3, 0.5) for i in range(40)], "case_id bigint, a double, b double")
    assert not evaluation.paired_bootstrap(same, 300).first().significant
    r = evaluation.paired_bootstrap(better, 300).first()
    assert r.significant and r.low < r.mean_difference < r.high
