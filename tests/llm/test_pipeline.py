from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import helpers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from sluice.llm import language, mixing, pieces, polyhash, simhash  # noqa: E402


def shingles(text):
    w = helpers.words(helpers.lower(text))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact-dedup", "near-dedup", "mix", "pieces"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_takes_effect(spark, small):
    """Brute force over the small documents: which rows stay, and how often."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    staged = docs
    step = dict(corpus_pipeline.STAGES)

    kept = [r for r in rows if r.text and any(map(str.isalpha, r.text))]
    staged = step["language"](spark, staged, small)
    assert staged.columns == docs.columns and sorted(r.doc_id for r in staged.collect()) == sorted(r.doc_id for r in kept)

    last = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        last[r.text] = r
    kept = list(last.values())
    staged = step["exact-dedup"](spark, staged, small)
    assert staged.columns == docs.columns and sorted(r.doc_id for r in staged.collect()) == sorted(r.doc_id for r in kept)

    kept.sort(key=lambda r: r.doc_id)
    found = [shingles(r.text) for r in kept]
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(kept)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both >= 0.8 * (len(found[i]) + len(found[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = [r for i, r in enumerate(kept) if find(i) == i]
    staged = step["near-dedup"](spark, staged, small)
    assert staged.columns == docs.columns and sorted(r.doc_id for r in staged.collect()) == [r.doc_id for r in kept]

    copies = {r.doc_id: r.copies for r in mixing.mix(staged).collect()}
    staged = step["mix"](spark, staged, small)
    counts = Counter(r.doc_id for r in staged.collect())
    assert staged.columns == docs.columns and counts == Counter({k: v for k, v in copies.items() if v})

    out = step["pieces"](spark, staged, small).collect()
    assert Counter(r.doc_id for r in out) == counts and all(r.lossless and r.n_pieces == len(r.ids) for r in out)
    again = corpus_pipeline.run(spark, small)
    assert Counter(tuple(r[:3]) + (tuple(r.ids),) for r in again.collect()) == Counter(tuple(r[:3]) + (tuple(r.ids),) for r in out)


def test_language_stage_keeps_unlabelled_texts_and_wanted_languages(spark):
    texts = ["the of and with that", "der die und nicht auf", "123 ...", None, ""]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in language.identified(rows).collect()} == {0, 1}
    assert language.identified(rows, wanted=["en"]).collect() == []
    known = [(100 + i, t, lang) for i in range(20) for t, lang in (("the of and with that this", "en"), ("der die und nicht auf ein", "de"))]
    both = rows.unionByName(spark.createDataFrame(known, rows.schema))
    kept = {r.doc_id for r in language.identified(both, wanted=["en"]).collect()}
    assert 0 in kept and 1 not in kept and {r.doc_id for r in language.identified(both).collect() if r.doc_id < 100} == {0, 1}
    assert language.identified(both, least=1.1).collect() == []


def test_stages_take_odd_and_empty_tables(spark):
    odd, _ = helpers.odd(spark)
    for docs in (odd, helpers.none(spark)):
        staged = docs
        for _, stage in corpus_pipeline.STAGES:
            staged = stage(spark, staged, "")
        assert staged.count() >= 0
    assert staged.count() == 0
    assert {m.__name__ for m in (language, polyhash, simhash, mixing, pieces)}


def test_language_stage_marks_what_follows(spark):
    """A missing or wrong mark is replaced by the language of the text, and the last stage shows it."""
    known = [(100 + i, t, lang) for i in range(20) for t, lang in (("the of and with that this", "en"), ("der die und nicht auf ein", "de"))]
    odd = [(0, "the of and with that", None), (1, "der die und nicht auf", "en"), (2, "123 ...", "en")]
    docs = spark.createDataFrame([(i, t, lang, "web", len(t)) for i, t, lang in odd + known], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.token_stage(spark, corpus_pipeline.language_stage(spark, docs, ""), "")
    assert {r.doc_id: r.lang for r in out.where("doc_id < 100").collect()} == {0: "en", 1: "de"}
