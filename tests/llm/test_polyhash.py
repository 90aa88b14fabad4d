from __future__ import annotations

import hashlib
import random

import helpers
import numpy as np

from sluice.llm import polyhash


def test_pieces_combine_to_the_whole():
    pick = random.Random(1)
    data = bytes(pick.randrange(256) for _ in range(5000))
    for chunk in (7, 64, 8192):
        poly = polyhash.Polynomial(1103515245, 2147483647, chunk)
        whole = sum((b + 1) * pow(poly.base, i, poly.prime) for i, b in enumerate(data)) % poly.prime
        assert poly.of(polyhash._widened(data)) == whole
        for cut in (0, 1, 63, 64, 4999):
            left, right = (poly.of(polyhash._widened(x)) if x else 0 for x in (data[:cut], data[cut:]))
            assert poly.combine(left, cut, right) == whole


def direct(data):
    groups = {}
    for d, t, *_ in data:
        groups.setdefault(t or "", []).append(d)
    return groups


def check(spark, df, data, **how):
    out = polyhash.classes(df, **how).collect()
    groups = direct(data)
    assert len(out) == len(data)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in out:
        ids = by[r.text_sha256]
        top = max((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids and r.keep_id == top and r.group_size == len(ids)
        assert not r.kept or r.doc_id == top
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_odd_rows(spark):
    df, data = helpers.odd(spark)
    check(spark, df, data)
    kept = polyhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(direct(data))
    assert polyhash.classes(helpers.none(spark)).count() == 0 and polyhash.deduplicated(helpers.none(spark)).count() == 0


def test_huge_texts_are_hashed_in_pieces(spark):
    df, data = helpers.odd(spark)
    check(spark, df, data, split=1000)
    whole = {(r.doc_id, r.text_sha256, r.h1, r.h2, r.n_bytes) for r in polyhash.fingerprints(df).collect()}
    assert {(r.doc_id, r.text_sha256, r.h1, r.h2, r.n_bytes) for r in polyhash.fingerprints(df, split=1000).collect()} == whole


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    # a hash modulo 3 and 5 puts different texts of one length together; comparing parts them
    monkeypatch.setattr(polyhash, "PRIMES", (3, 5))
    monkeypatch.setattr(polyhash, "COMPARE", 4)
    pick = random.Random(2)
    texts = ["".join(pick.choice("ab") for _ in range(9)) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    prints = df.sparkSession.createDataFrame(
        [(i, 9, *[polyhash.Polynomial(b, p).of(polyhash._widened(t.encode())) for b, p in zip(polyhash.BASES, (3, 5))], hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)],
        polyhash.FINGERPRINT)
    monkeypatch.setattr(polyhash, "fingerprints", lambda docs, split: prints)
    assert prints.select("h1", "h2").distinct().count() < len(set(texts))
    check(spark, df, list(enumerate(texts)))


def test_bytes_are_widened_beyond_zero():
    assert polyhash._widened(b"\x00\xff").tolist() == [1, 256] and polyhash._widened(b"\x00").dtype == np.uint64


def test_texts_are_shuffled_once_to_be_kept(spark):
    """The join with the kept rows and the window over repeated ones share an exchange."""
    rows = [(1, "a b", "x"), (1, "a b", "w"), (2, "a b", "z"), (None, "c", "q"), (None, "c", "p"), (3, None, "r"), (4, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = polyhash.deduplicated(docs)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(2, "a b", "z"), (None, "c", "p"), (4, "", "s")]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = polyhash.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    carried = [line for line in plan.splitlines() if "Exchange hashpartitioning(__key" in line]
    assert len(carried) == 2 and "Exchange hashpartitioning(__sha" not in plan
