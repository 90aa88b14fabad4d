from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sluice.llm.common import fresh
from sluice.llm.token_rollup import Rollup, tokens

SCHEMA = "doc_id bigint, version string, source string, lang string, tokens bigint, delete boolean, turn int, docs int"


def test_batches_follow_a_plain_ledger(spark):
    pick, store, ledger = random.Random(8), Rollup(spark, fresh(spark, "rollup")), {}
    batches = []
    for _ in range(5):
        rows = []
        for turn in range(40):
            rows.append((pick.choice([None, *range(12)]), pick.choice(["v1", "v2"]), pick.choice([None, "a", "b"]), pick.choice(["en", None]),
                         pick.choice([None, 0, 5, 9]), pick.choice([None, False, False, True]), turn, 1))
        batches.append(rows)
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        assert store.commit(b, df)
        for d, v, s, la, t, gone, *_ in rows:
            if gone:
                ledger.pop((d, v), None)
            else:
                ledger[d, v] = (s, la, t or 0)
        assert not store.commit(b, df) and not store.commit(0, df)
        want = {}
        for (_, v), (s, la, t) in ledger.items():
            n, total = want.get((s, la, v), (0, 0))
            want[s, la, v] = n + 1, total + t
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()} == want
    assert store.batches() == list(range(5))


def test_a_batch_that_died_is_replaced(spark):
    path = fresh(spark, "rollup")
    store = Rollup(spark, path)
    rows = spark.createDataFrame([(1, "v", "a", "en", 5, False, 0, 1)], SCHEMA)
    # data of an attempt without its marker isn't read and goes
    spark.createDataFrame([("a", "en", "v", 9, 99)], "source string, lang string, version string, docs bigint, tokens bigint").write.parquet(f"{path}/deltas/1")
    assert store.totals().count() == 0
    assert store.commit(1, rows)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 1, 5)]
    assert store.commit(2, rows.limit(0)) and store.totals().count() == 1


def test_ties_and_token_patterns(spark):
    store = Rollup(spark, fresh(spark, "rollup"))
    store.commit(1, spark.createDataFrame([(1, "v", "a", "en", 5, False, 0, 1), (1, "v", "b", "en", 7, False, 0, 1), (2, "v", "a", "en", 1, False, 3, 1), (2, "v", "a", "en", 1, True, 3, 1)], SCHEMA))
    assert [tuple(r) for r in store.totals().collect()] == [("b", "en", "v", 1, 7)]
    df = spark.createDataFrame([("It's 2 é-words!\n",), (None,), ("",), ("... 日本",)], "text string")
    out = df.select(tokens(F.col("text"), r"[^\x20\x09-\x0D]+"), tokens(F.col("text"), r"[\p{L}\p{N}]+")).collect()
    assert [tuple(r) for r in out] == [(3, 8), (0, 0), (0, 0), (2, 4)]


def test_query_over_odd_documents(spark, tmp_path):
    import helpers

    from sluice.llm import queries

    df, data = helpers.odd(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for d, text, lang, source, *_ in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        kept.setdefault(text or "", (source, lang))
    want = {}
    for text, (source, lang) in kept.items():
        for version, n in (("space-1", len(helpers.words(text)) + 1), ("word-2", len(re.findall(r"[^\W_]+|[^\w\x20\x09-\x0D]|_", text)))):
            docs, total = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = docs + 1, total + n
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in queries.RUN["op9_token_rollup"](spark, str(tmp_path)).collect()}
    assert got == want

    helpers.none(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.RUN["op9_token_rollup"](spark, str(tmp_path / "none")).collect() == []
