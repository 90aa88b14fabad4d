from __future__ import annotations

import random

import helpers
import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import pieces


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def some(n):
    pick = random.Random(3)
    out = ["", " ", "a  b   c", "\n\n x", " lead", "trail ", "a\0b", "日本語 テキスト", "x" * 500, "🙂 ok\t\ttab", "    four", "The quick brown fox, naturally."]
    out += ["".join(pick.choice("abte ▁\n\0é日 ") for _ in range(pick.randint(0, 14))) for _ in range(n)]
    return out


def test_without_dropout_it_is_the_models_own_encoding(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [t for t in some(800) if pieces.SPACE not in t]  # the library reads the mark as a space
    found = pieces.Segmenter(model, drop=0.0).encode(pa.array(texts), np.zeros(len(texts), np.uint64), 1).to_pylist()
    assert found == [sp.encode(t) for t in texts]


def naive(seg, text, variant):
    """One segment by looking for the best pair again and again."""
    named = pieces._spread(np.array([pieces.xxhash.xxh64_intdigest(text, seg.seed)], np.uint64) ^ np.uint64(variant) * np.uint64(0x9E3779B97F4A7C15))
    parts = [(i, i + 1, int(seg.char[ord(c)])) for i, c in enumerate(text)]
    while True:
        best = None
        for k in range(len(parts) - 1):
            (s, _, a), (_, e, b) = parts[k], parts[k + 1]
            p = int(seg._joined(np.array([a]), np.array([b]))[0])
            if p >= 0 and seg._coins(named, np.array([s]), np.array([e]))[0] >= seg.bar and (best is None or seg.rank[p] < best[0]):
                best = seg.rank[p], k, p
        if best is None:
            break
        _, k, p = best
        parts[k:k + 2] = [(parts[k][0], parts[k + 1][1], p)]
    out = []
    for s, _, p in parts:
        out += [p] if p >= 0 else [int(seg.byte_ids[b]) for b in text[s].encode()]
    return out


def test_dropout_follows_the_agenda_and_decodes(model, monkeypatch):
    seg = pieces.Segmenter(model, seed=7, drop=0.3)
    words = [" transformation", " internationalisation", "abte", "é日", " the", "\n", " ▁x", " " * 9 + "indent", " " + "abcde" * 9]
    for variant in range(3):
        want = [naive(seg, w, variant) for w in words]
        assert seg.segments(words, np.full(len(words), variant)).to_pylist() == want
    monkeypatch.setattr(pieces, "LONG", 3)  # every segment by the heap
    assert seg.segments(words, np.full(len(words), 1)).to_pylist() == [naive(seg, w, 1) for w in words]


def test_variants_differ_and_all_are_lossless(model):
    texts = some(300)
    keys = np.arange(len(texts)).astype(np.uint64)
    seg = pieces.Segmenter(model, drop=0.3)
    one, again, other = seg.encode(pa.array(texts), keys), seg.encode(pa.array(texts), keys), seg.encode(pa.array(texts), keys + np.uint64(999))
    assert one == again and one != other
    for ids in (one, other):
        assert [t.decode() for t in seg.decode(ids)] == texts


def test_odd_rows(spark):
    df, data = helpers.odd(spark, helpers.rows(" ▁ literal mark", "x" * 5000, start=70))
    out = pieces.encoded(df, keep=("source", "size"))
    assert out.columns == ["doc_id", "ids", "n_chars", "lossless", "source", "size"]
    rows = out.collect()
    assert len(rows) == len(data) and all(r.lossless for r in rows)
    assert all(r.n_chars in [len(t or "") for i, t, *_ in data if i == r.doc_id] for r in rows)
    assert all(r.ids == [] for r in rows if r.doc_id in (1, 2))
    back = {(r.doc_id, r.text) for r in pieces.decoded(out).collect()}
    assert back == {(i, t or "") for i, t, *_ in data}
    assert pieces.encoded(helpers.none(spark)).count() == 0


def test_model_size_is_checked(monkeypatch):
    monkeypatch.setattr(pieces, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError):
        pieces._model_bytes(pieces.MODEL)


def test_each_occurrence_has_its_own_dropout(model, monkeypatch):
    seg = pieces.Segmenter(model, seed=7, drop=0.1)
    words = [" transformation", " the", " abte", " é日", " ▁x", " " + "internationalisation" * 2]
    texts = pa.array(["".join(words)[1:] + "\n" + "".join(words[:3])] * 60)
    keys = pieces._spread(np.arange(60).astype(np.uint64))
    found = seg.encode(texts, keys)
    parts = [*words, "\n", *words[:3]]
    want = []
    for key in keys:
        turn = pieces._spread(key + np.arange(len(parts)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        want.append([i for part, t in zip(parts, turn, strict=True) for i in naive(seg, part, t)])
    assert found.to_pylist() == want
    monkeypatch.setattr(pieces, "SPANS", -1)  # nothing is shared
    assert seg.encode(texts, keys) == found
    monkeypatch.setattr(pieces, "DRAWN", 7)
    monkeypatch.setattr(pieces, "SPANS", 63)
    assert seg.encode(texts, keys) == found


def test_a_frequent_word_has_many_segmentations(model):
    ids = pieces.Segmenter(model).encode(pa.array(["transformation"] * 2000), np.arange(2000).astype(np.uint64)).to_pylist()
    assert len(set(map(tuple, ids))) > 20


def test_a_slice_of_varied_text_is_encoded_in_bounded_memory(model):
    import tracemalloc

    from sluice.llm.common import slices

    pick = random.Random(9)
    texts = [" ".join("".join(pick.choice("etaoinshrdlu") for _ in range(pick.randint(3, 9))) for _ in range(300)) for _ in range(3000)]
    seg, batch = pieces.Segmenter(model), pa.record_batch({"text": texts})
    part = next(slices(batch, "text", pieces.SLICE)).column(0)
    tracemalloc.start()
    try:
        seg.encode(part, np.arange(len(part), dtype=np.uint64))
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
    finally:
        tracemalloc.stop()
