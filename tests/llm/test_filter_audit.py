from __future__ import annotations

from itertools import permutations

import helpers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import filter_audit, shards


def failed(rows):
    """Letters that each (doc_id, source, text) fails, by brute force."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        w = helpers.words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
               "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        out.append("".join(f for f in "ABCDE" if bad[f]))
    return out


def expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    bad = failed(rows)
    out, shares = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for (i, source, _), fails in zip(rows, bad, strict=True):
            part, gone = source or "", False
            for step, f in enumerate(order, 1):
                cell = out.setdefault((part, order, step), [0] * 6)
                fail = f in fails
                cell[2] += fail and gone
                cell[3] += fails == f
                if fail and not gone:
                    gone = True
                    cell[1] += 1
                    cell[4] += i in good
                    cell[5] += i in toxic
                    shares[part, f] = shares.get((part, f), 0) + 1
                cell[0] += not gone
    return {k: (*v, shares.get((k[0], k[1][k[2] - 1]), 0)) for k, v in out.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


LABELS = "doc_id bigint, quality int, toxic int, text string, part string"


def test_odd_rows_against_brute_force(spark):
    extra = helpers.rows("A # b", "Many words " * 150, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(300)), "ALL CAPS", start=100)
    df, data = helpers.odd(spark, extra)
    rows = [(r[0], r[3], r[1]) for r in data]
    labels = [(0, 1, 0), (4, 0, 1), (4, 1, None), (100, None, 1), (102, 1, 1), (103, 1, 0), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame([(*x, "t", "p") for x in labels], LABELS)
    assert got(filter_audit.audit(df, marks)) == expected(rows, [x for x in labels if x[0] is not None])


def test_hot_group_over_partitions(spark):
    rows = [(i, None if i % 5 == 0 else f"s{i % 2}", "the same text of all" if i % 3 else f"own {i} text") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(7)
    none = spark.createDataFrame([], LABELS)
    assert got(filter_audit.audit(df, none)) == expected(rows, [])


def test_many_shards(monkeypatch, spark):
    monkeypatch.setattr(filter_audit.shards, "SHARD_BYTES", 50)
    monkeypatch.setattr(filter_audit.shards, "RUN_BYTES", 20)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "part": ["p"], "text": [f"own{i} same same text"]}) for i in range(20)]
    monkeypatch.setattr(filter_audit.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    out = pa.Table.from_batches(list(filter_audit._local(4)(iter(batches)))).to_pylist()
    shard_rows = [r for r in out if r["cell"] is None]
    assert len(shard_rows) > 3 and [i for r in shard_rows for i in r["doc_id"]] == list(range(20))
    for r in shard_rows:
        words = {}
        for x in out:
            if x["cell"] is not None and x["shard"] == r["shard"]:
                (codes,) = shards.unpack(x["data"], x["n"], "int32")
                words |= dict(zip(shards.undelta(codes).tolist(), shards.unpack_words(x["names"], x["n"]).to_pylist(), strict=True))
        local, times = shards.unpack(r["cells"], r["entries"], "uint32", "uint32")
        local = shards.undelta(local)
        for k, doc in enumerate(r["doc_id"]):
            a, b = r["starts"][k], r["starts"][k + 1]
            assert {words[c]: t for c, t in zip(local[a:b].tolist(), times[a:b].tolist(), strict=True)} == {f"own{doc}": 1, "same": 2, "text": 1}


def test_matrix_is_coded_for_the_whole_table(spark):
    texts = ["b a b", "a c", "", "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    seen = {}
    for shard in filter_audit.matrix(df, F.lit("x")).collect():
        ids, times = shards.unpack(bytes(shard.cells), shard.entries, "int64", "uint32")
        ids = shards.undelta(ids)
        for k, doc in enumerate(shard.doc_id):
            a, b = shard.starts[k], shard.starts[k + 1]
            seen[doc] = dict(zip(ids[a:b].tolist(), times[a:b].tolist(), strict=True))
            assert list(ids[a:b]) == sorted(ids[a:b])
    assert sorted(seen[0].values()) == [1, 2] and seen[2] == {} and list(seen[3].values()) == [1]
    assert len({k for row in seen.values() for k in row}) == 3
    assert set(seen[3]) < set(seen[0]) and len(set(seen[0]) & set(seen[1])) == 1


def test_empty_table(spark):
    assert filter_audit.audit(helpers.none(spark), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("limit", [64, 1000])
def test_cut_keeps_words_whole(limit):
    text = "aé " * 500 + "z" * 3000 + "\n\tend " + "日本 " * 300
    parts = shards.cut(text, limit)
    assert b"".join(parts).decode() == text
    assert [w for p in parts for w in helpers.words(p.decode())] == helpers.words(text)
    assert all(len(p) <= limit or len(helpers.words(p.decode())) == 1 for p in parts)


def test_long_text_is_coded_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(shards, "PIECE_BYTES", 100)
    text = "alpha beta gamma alpha " * 40 + "x" * 500
    codes, offsets, words = shards.coded(pa.array([text]))
    assert [words[int(c)].as_py() for c in codes] == helpers.words(text) and list(offsets) == [0, len(codes)]


def test_runs_keep_every_row_once():
    texts = ["x" * n for n in (0, 5, 300, 10, 10, 10, 0, 90, 120, 3)] * 5 + [None]
    batches = [pa.RecordBatch.from_pydict({"i": pa.array(range(a, min(a + 4, len(texts)))), "text": pa.array(texts[a:a + 4], pa.string())}) for a in range(0, len(texts), 4)]
    out = list(shards.runs(iter(batches), limit=100))
    assert [i for b in out for i in b.column("i").to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 100 for b in out)
