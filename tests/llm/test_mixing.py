from __future__ import annotations

from collections import Counter, defaultdict

import helpers
import pytest

from sluice.llm import mixing


def shared(sizes, weights=mixing.WEIGHTS, share=1.5, most=2.0):
    """Targets by repeated sharing of what exceeds the limits."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        room = left - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else room * w[s] / sum(w[x] for x in free) for s in order}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 3}, {"a": 0, "b": 8}, {"a": 0}, {f"s{i}": (i * 37) % 11 * 10 for i in range(25)}])
def test_targets_follow_repeated_sharing(spark, sizes):
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    want = shared(sizes)
    for r in mixing.targets(totals).collect():
        assert r.target == pytest.approx(want[r.source]), r


def test_mix_of_a_hot_source(spark):
    rows = [(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 3000 and out and mixing.mix(df.repartition(7)).select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.size == r.doc_id % 50 and 0 <= r.taken <= 2 * r.size
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 3 * max(r.size for r in rs)
    copies = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert copies == {r.doc_id: r.copies for r in out if r.copies}


def test_odd_rows(spark):
    df, data = helpers.odd(spark)
    out = mixing.mix(df).collect()
    assert len(out) == len(data)
    for r in out:
        assert r.size in [len(helpers.words(t)) for i, t, *_ in data if i == r.doc_id]
    taken = mixing.mixed(df)
    assert taken.columns == df.columns
    assert sum(len(helpers.words(r.text)) for r in taken.collect()) == sum(r.taken for r in out)
    assert mixing.mix(helpers.none(spark)).count() == 0 and mixing.mixed(helpers.none(spark)).count() == 0
