from __future__ import annotations

import random
import re

import helpers

from sluice.llm import licenses


def direct(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", helpers.lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_places_follow_a_direct_search():
    scanner, pick = licenses.Scanner(), random.Random(5)
    tokens = "gnu general public license apache license cc by mit license under the é zz 4 version".split()
    for _ in range(3000):
        text = pick.choice(" -\n_").join(pick.choice(tokens) for _ in range(pick.randint(0, 30)))
        assert scanner.scan(text.encode())[:5] == direct(text)


def test_runs_are_the_longest_that_occur():
    texts = [t.split() for t in ("a b a b c", "b c a", "c a b b")]
    auto, pick = licenses.Automaton(texts), random.Random(2)
    for _ in range(500):
        run = [pick.choice("abc") for _ in range(pick.randint(1, 6))]
        state = 0
        for word in run:
            state = auto.next[state].get(word) if state is not None else None
        found = {(n, i + len(run)) for n, t in enumerate(texts) for i in range(len(t)) if t[i:i + len(run)] == run}
        assert (state is not None) == bool(found)
        if found:
            assert set(auto.ends[state]) == found


def test_templates_with_gaps_and_pieces(monkeypatch):
    scanner = licenses.Scanner()
    notice = "This work, is (c) licensed under the GNU General Public License - version 3."
    out = scanner.scan(notice.encode())
    assert "gpl-3.0" in out[5] and out[7][0]["cover"] > 0.8
    short = scanner.scan(b"permission is hereby granted free of charge")
    assert short[5] == [] and 0 < short[6] < 1
    big = ("filler words of the text " * 50 + notice + " mit license ") * 20
    whole = scanner.scan(big.encode())
    monkeypatch.setattr(licenses, "PIECE", 64)
    assert scanner.scan(big.encode()) == whole and whole[1] == 40


def test_odd_rows(spark):
    df, data = helpers.odd(spark, helpers.rows("Apache License, APACHE license; cc-by", start=90))
    out = licenses.scan(df).collect()
    assert len(out) == len(data)
    for r in out:
        texts = [t for i, t, *_ in data if i == r.doc_id]
        assert tuple(r)[1:6] in [direct(t) for t in texts]
        assert 0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels)
    assert licenses.scan(helpers.none(spark)).count() == 0
