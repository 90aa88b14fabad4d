from __future__ import annotations

import random

import helpers
import numpy as np
import xxhash
from pyspark.sql import functions as F

from sluice.llm import graphs, simhash


def direct(text):
    w = helpers.words(helpers.lower(text))
    if not w:
        return 0
    parts = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(prints, radius=3):
    """Smallest index reachable over links, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_links_find_every_component(spark):
    pick = random.Random(4)
    prints = []
    for _ in range(60):
        base = pick.getrandbits(64)
        for _ in range(pick.choice([1, 2, 6])):
            for bit in pick.sample(range(64), pick.choice([0, 1, 3, 4])):
                base ^= 1 << bit
            prints.append(base)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "id bigint, fp bigint")
    roots = {r.node: r.root for r in graphs.components(simhash.links(df)).collect()}
    mine = [roots.get(s, s) for s in signed]
    want = classes(prints)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_one_key_with_many_rows(spark):
    # one block pair is equal in all: a chain within the radius is one component, its edges a forest
    chain = [(i ^ (i >> 1)) for i in range(2000)]
    df = spark.createDataFrame([(int(c),) for c in chain], "fp bigint")
    edges = simhash.links(df)
    assert edges.count() < 10 * len(chain)
    assert {r.root for r in graphs.components(edges).collect()} == {0}


def test_components_of_long_paths_and_loops(spark):
    pick = random.Random(3)
    names = pick.sample(range(10**6), 300)
    pairs = list(zip(names[:200], names[1:200])) + [(names[250], names[251]), (names[251], names[250]), (names[299], names[299])]
    out = {r.node: r.root for r in graphs.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    low = min(names[:200])
    assert all(out[n] == low for n in names[:200]) and out[names[251]] == min(names[250:252])
    assert graphs.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_rows(spark):
    df, data = helpers.odd(spark, helpers.rows("A b C d e", "a B c D e", "a", "a b", start=50))
    out = simhash.groups(df).collect()
    assert len(out) == len(data)
    prints = [direct(t) for _, t, *_ in data]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp) for r in out) == sorted((d[0] is None, d[0] or 0, int(np.uint64(p).view(np.int64))) for d, p in zip(data, prints))
    roots = classes(prints)
    names = {}
    for d, k in zip(data, roots):
        if d[0] is not None:
            names[k] = min(names.get(k, d[0]), d[0])
    want = {(d[0], p): names.get(k) for d, p, k in zip(data, prints, roots)}
    assert {(r.doc_id, int(np.int64(r.fp).view(np.uint64))): r.component_id for r in out} == want
    kept = simhash.unique(df)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert simhash.groups(helpers.none(spark)).count() == 0 and simhash.unique(helpers.none(spark)).count() == 0


def test_long_texts_in_runs(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    assert int.from_bytes(whole, "big") == direct(text)
    monkeypatch.setattr(simhash, "RUN", 100)
    assert simhash.fingerprint(text.encode()) == whole


def test_query_names_fingerprints_in_hex(spark, small):
    from sluice.llm import queries

    row = queries.RUN["op5_simhash_neardup"](spark, small).orderBy("doc_id").first()
    text = spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.fingerprint == f"{direct(text):016x}"
