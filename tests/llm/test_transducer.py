from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import transducer as T

PHRASES = st.lists(st.lists(st.integers(5, 8), min_size=1, max_size=4).map(tuple), max_size=60)


def matrix(counter, width=4):
    keys = sorted(counter)
    rows = np.array([[*k, *[T.END] * (width - len(k))] for k in keys], np.int64).reshape(-1, width)
    return rows, np.array([counter[k] for k in keys], np.int64)


def prefixes(counter):
    out = Counter()
    for k, n in counter.items():
        for d in range(1, len(k) + 1):
            out[k[:d]] += n
    return out


def paths(a):
    return {tuple(a.alphabet[row].tolist()): int(w) for rows, weights, _, _ in a.levels() for row, w in zip(rows, weights, strict=True)}


@settings(max_examples=200, deadline=None)
@given(PHRASES)
def test_paths_carry_prefix_counts(phrases):
    counter = Counter(phrases)
    a = T.Automaton.of_bytes(T.build(*matrix(counter)).to_bytes())
    assert paths(a) == prefixes(counter)
    rows, own = a.phrases(4)
    assert {tuple(x for x in r.tolist() if x != T.END): int(n) for r, n in zip(rows, own, strict=True)} == dict(counter)
    asked = [(5,), (6, 7), (5, 5, 5), (5, 6, 7, 8), (9,), (5, 9), *counter]
    assert a.lookup(matrix(dict.fromkeys(asked, 1))[0]).tolist() == [prefixes(counter)[k] for k in sorted(set(asked))]


@settings(max_examples=200, deadline=None)
@given(PHRASES)
def test_states_are_minimal(phrases):
    a = T.build(*matrix(Counter(phrases)))
    starts = a.starts.astype(int)
    arcs = [tuple(zip(a.label[x:y].tolist(), a.weight[x:y].tolist(), a.target[x:y].tolist(), strict=True)) for x, y in zip(starts[:-1], starts[1:], strict=True)]
    levels, state = [], {a.states - 1}
    while state:
        levels.append(state)
        state = {t for s in state for _, _, t in arcs[s]} - {0}
    assert arcs[0] == () and set().union(*levels, {0}) == set(range(a.states))
    assert all(len({arcs[s] for s in level}) == len(level) for level in levels)


@settings(max_examples=100, deadline=None)
@given(st.lists(PHRASES, max_size=4), st.integers(1, 4))
def test_union_sums_and_prunes(parts, least):
    whole = Counter(p for part in parts for p in part)
    a = T.union([T.build(*matrix(Counter(p))) for p in parts], 4, least)
    assert paths(a) == {k: n for k, n in prefixes(whole).items() if n >= least}


def test_shared_ends_save_states():
    pick = random.Random(2)
    counter = Counter({(i, 500, 600, 700): 1 for i in range(pick.randrange(300, 400))})
    assert T.build(*matrix(counter)).states == 5
