from __future__ import annotations

import random
import re
from collections import Counter

import helpers
import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import collocations


def direct(rows, least, longest=5, top=None):
    """Phrases by brute force from (text, lang) rows."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", helpers.lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, longest + 1):
                    if i + m <= len(words):
                        f.setdefault(lang, Counter())[tuple(words[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), lang, counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, _, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 7) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n bigint")


def made(seed, docs=60):
    pick = random.Random(seed)
    words = ["New", "york", "the", "of", "a", "é", "日本", "x1", "b\u0001c", "Q"]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r", "\x0b", "\x0c", "?!"]
    out = []
    for _ in range(docs):
        text = "".join(pick.choice(words[: pick.randrange(2, 11)]) + pick.choice(ends) for _ in range(pick.randrange(80)))
        out.append((pick.choice([text, text, text + " new york the of a", None, ""]), pick.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("seed, mass, shard", [(1, 1 << 21, 1 << 24), (2, 50, 400), (3, 7, 1)])
def test_against_brute_force(spark, monkeypatch, seed, mass, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rows = made(seed)
    assert got(collocations.phrases(frame(spark, rows), least=3, top=None, mass=mass)) == direct(rows, 3)


def test_one_hot_phrase_and_repeats(spark):
    rows = [("aa aa aa aa aa aa. hot phrase of all documents here", "en")] * 150 + [("hot phrase", "en"), ("of all", "de")]
    out = got(collocations.phrases(frame(spark, rows).repartition(5)))
    assert out == direct(rows, 100, top=2000) and any(r[2] == "aa aa" for r in out)


def test_top_and_ties(spark):
    rows = [(f"w{i} v{i}", "en") for i in range(30) for _ in range(3)]
    out = got(collocations.phrases(frame(spark, rows), least=3, top=10))
    assert out == direct(rows, 3, top=10) and len(out) == 10


def test_odd_rows(spark):
    df, data = helpers.odd(spark)
    assert got(collocations.phrases(df, least=2, top=50)) == direct([(r[1], r[2]) for r in data], 2, top=50)


@pytest.mark.parametrize("texts", [[], [None], ["", "  "], ["one. two"]])
def test_nothing_to_find(spark, texts):
    assert got(collocations.phrases(frame(spark, [(t, "en") for t in texts]) if texts else helpers.none(spark))) == []


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9_000_000_000, 7_000_000_000_000_017, 9_000_000_001, 9_000_000_013
    cuts = spark.createDataFrame([(b"p", 1, a, left, right), (b"p", 2, a, right, left)], "phrase binary, k int, a bigint, l bigint, r bigint")
    totals = spark.createDataFrame([(b"p", "text", "en", n)], "phrase binary, text string, lang string, n bigint")
    best = collocations.scores(cuts, totals).collect()[0]
    assert best.score == 1000 * a * n // (left * right) and best.k == 1


def test_pieces_of_folded_texts():
    text, first = collocations.folded(pa.array(["A b.C", "", "d  e\n\nf", " \t", "g"]))
    assert text.to_pylist() == ["a b\nc", "", "d  e\n\nf", "  ", "g"]
    assert first.tolist() == [True, False, True, True, False, True, True]


def test_ranges_keep_a_words_phrases_in_its_stretch():
    first, f = np.full(1000, 10_000), np.full(1000, 5_000)
    at = collocations.ranges(first, f, np.arange(1000) * 100, 1000)
    assert set(at.tolist()) == {10, 11, 12, 13, 14}
