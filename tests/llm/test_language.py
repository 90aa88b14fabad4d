from __future__ import annotations

import helpers
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import language

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it rests in the shade",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und ruht dann im Schatten",
    "fr": "le renard brun saute par dessus le chien paresseux et se repose ensuite à l'ombre",
}


def test_grams_are_those_of_each_text_alone():
    texts = ["Ab, c", "", "xyz", None, "a1b"]
    both = list(language.grams(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        for n, (bucket, owner) in enumerate(language.grams(pa.array([t], pa.string()))):
            assert (both[n][0][both[n][1] == i] == bucket).all()
            assert len(bucket) >= (1 if n == 0 or t else 0)
    same = [list(language.grams(pa.array([t])))[2][0].tolist() for t in ("A--b", "a b", "a 1 B!")]
    assert same[0] == same[1] == same[2]


def test_model_is_that_of_plain_counts(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())] * 2
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    for k, lang in enumerate(model.languages):
        counts = np.full(language.BUCKETS, language.SMOOTHING)
        for bucket, _ in language.grams(pa.array([TEXTS[lang]] * 2)):
            np.add.at(counts, bucket, 1)
        assert np.allclose(model.table[k], np.log(counts / counts.sum()))


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language.identify(docs.select("doc_id", "text", "lang"), train=~language.held_out()).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(language.held_out()).collect()
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    extra = [(200 + i, t, lang, "s", 1, 1, 1.0, 1, True, 1, 1) for i, (lang, t) in enumerate(TEXTS.items())]
    df, data = helpers.odd(spark, extra)
    out = language.identify(df).collect()
    assert len(out) == len(data)
    undefined = {2, 3, 9}
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id in undefined or r.doc_id == 1:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in {"en", "de", "fr"}
    kept = language.identified(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d[0] for d in data if d[0] is not None and d[0] not in undefined | {1})
    assert language.identify(helpers.none(spark)).count() == 0
    unlabelled = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
