"""Katz scores against a direct model, and the model's own sums."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import helpers
import pytest

from sluice.llm import katz, shards

END, START, NEW = ("end",), ("start",), ("new",)


class Direct:
    """The same model from plain dictionaries."""

    def __init__(self, texts: list[list]):
        self.uni = Counter(t for text in texts for t in text)
        self.n, self.types = sum(self.uni.values()), len(self.uni)
        self.d1 = katz.discounts([sum(c == r for c in self.uni.values()) for r in range(1, katz.GT + 2)])
        self.left = 1 - sum(self.disc(self.d1, c) for c in self.uni.values()) / self.n if self.n else 1.0
        scale = 1.0
        if self.left <= 1e-12:
            scale = self.n / (self.n + katz.RESERVE)
            self.left = 1 - scale
        self.p1 = {t: scale * self.disc(self.d1, c) / self.n for t, c in self.uni.items()}
        self.pairs, self.hist = Counter(), Counter()
        for text in texts:
            for a, b in zip([START, *text], text):
                self.pairs[a, b] += 1
                self.hist[a] += 1
        self.d2 = katz.discounts([sum(c == r for c in self.pairs.values()) for r in range(1, katz.GT + 2)])

    @staticmethod
    def disc(d, c):
        return d[c - 1] * c if c <= katz.GT else c

    def unigram(self, w):
        return self.p1.get(w, self.left)

    def prob(self, h, w):
        room = self.hist[h] + katz.RESERVE
        if self.pairs[h, w]:
            return self.disc(self.d2, self.pairs[h, w]) / room
        seen = [x for (a, x) in self.pairs if a == h]
        if not seen:
            return self.unigram(w)
        rest = 1 - sum(self.disc(self.d2, self.pairs[h, x]) for x in seen) / room
        return rest / (1 - sum(self.unigram(x) for x in seen)) * self.unigram(w)

    def score(self, text):
        return sum(math.log10(self.prob(h, t)) for h, t in zip([START, *text], text))


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def compare(spark, rows, held, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string, shard int, word string, n string").repartition(parts)
    fitted, scores = katz.fitted(df, held)
    out = scores.collect()
    keep = (lambda i: zlib.crc32(str(i).encode()) % 10 != 0) if held is not None else (lambda i: True)
    model = Direct([tokens(t) for i, t, *_ in rows if keep(i)])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, *_ in rows)
    texts = {i: tokens(t) for i, t, *_ in rows}
    for r in out:
        toks = texts[r.doc_id]
        assert r.n_tokens == len(toks) and r.train_tokens == model.n
        assert r.n_known == sum(model.uni[t] > 0 for t in toks)
        base = sum(math.log10((model.uni[t] + 0.1) / (model.n + 0.1 * (model.types + 1))) for t in toks)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(model.score(toks), rel=1e-9, abs=1e-9)
    return model, fitted


def sample(n):
    words = "the of a Cat dog ran sat On mat é, x\x1cy".split(" ")
    out = []
    for i in range(n):
        k = zlib.crc32(f"n{i}".encode()) % 12
        picks = [words[min(zlib.crc32(f"{i}/{j}".encode()) % 17, zlib.crc32(f"{j}-{i}".encode()) % 13) % len(words)] for j in range(k)]
        out.append((i, " ".join(picks) + (f" w{i}" if i % 3 == 0 else ""), "extra", 1, "w", "n"))
    return out


@pytest.mark.parametrize("mass, shard", [(1 << 20, 1 << 20), (7, 300)])
def test_scores_follow_the_direct_model(spark, monkeypatch, mass, shard):
    monkeypatch.setattr(katz, "MASS", mass)
    monkeypatch.setattr(katz, "SHARD_BYTES", shard)
    rows = [*sample(120), (1000, None, None, 1, "w", "n"), (1001, "", "x", 1, "w", "n"), (1002, "never seen words\tat all " * 50, "x", 1, "w", "n")]
    model, tables = compare(spark, rows, katz.held_out())
    for h in [START, *list(model.uni)[:6]]:
        if model.hist[h]:
            assert sum(model.prob(h, w) for w in [*model.uni, NEW]) == pytest.approx(1)
    # the tables hold what was counted
    ids = {r.word: r.id for r in tables.unigrams.collect()}
    assert {r.word: r.n for r in tables.unigrams.collect()} == {katz.END if w == END else w: c for w, c in model.uni.items()}
    pairs = {}
    for r in tables.bigrams.collect():
        h, w, c = shards.unpack(bytes(r.data), r.n, "int64", "int64", "int64")
        pairs |= dict(zip(zip(shards.undelta(h).tolist(), w.tolist(), strict=True), c.tolist(), strict=True))
    ids |= {END: ids[katz.END], START: katz.START}
    assert pairs == {(ids[a], ids[b]): c for (a, b), c in model.pairs.items()}
    assert tables.weights.count() == len(model.hist)


def test_hot_bigram_is_one_entry_a_shard(spark, monkeypatch):
    monkeypatch.setattr(katz, "MASS", 50)
    compare(spark, [(i, "hot pair hot pair hot pair" + (f" tail{i}" if i % 7 == 0 else ""), "x", 1, "w", "n") for i in range(300)], katz.held_out(), parts=5)


def test_odd_rows(spark):
    df, data = helpers.odd(spark)
    assert katz.score(df, katz.held_out()).count() == len(data)


def test_no_held_out_rows_and_repeats(spark):
    compare(spark, [*sample(20), *sample(20), (None, "a null id", "x", 1, "w", "n")], None)


def test_only_held_out_rows(spark):
    compare(spark, [(10, "all of it is new", "x", 1, "w", "n")] if zlib.crc32(b"10") % 10 == 0 else [(i, "new", "x", 1, "w", "n") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:1], katz.held_out())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert katz.score(df, katz.held_out()).count() == 0


def test_discounts_stay_between_zero_and_one():
    for n_r in ([0] * 6, [1, 0, 0, 0, 0, 0], [100, 40, 20, 10, 6, 4], [3, 3, 3, 3, 3, 3], [0, 5, 1, 0, 0, 0]):
        assert all(0 < d < 1 for d in katz.discounts(n_r))
