"""Weighted acyclic automata over word numbers: counts of phrases, shared both ways.

A phrase is a path from the root; the weight of its last arc is its count. Prefixes share
their path; states of a level with the same arcs, weights included, are one state, so
rare phrases that end alike share their ends. An automaton is grown from sorted phrases, a level at a
time from the ends: when a level is reached, all states below are final and frozen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shards import pack, unpack

END = -1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def keys_of(rows: np.ndarray) -> list[np.ndarray]:
    """Few whole numbers per row that order rows as their columns do."""
    codes = rows + 1
    bits = int(codes.max(initial=1)).bit_length()
    if bits > 31:
        alphabet, flat = np.unique(rows, return_inverse=True)
        codes = flat.reshape(rows.shape).astype(np.int64)
        bits = len(alphabet).bit_length()
    width, keys = max(63 // bits, 1), []
    for at in range(0, rows.shape[1], width):
        key = np.zeros(len(rows), np.int64)
        for column in codes[:, at:at + width].T:
            key = (key << bits) | column
        keys.append(key)
    return keys


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and where in it each run of equal ones begins."""
    keys = keys_of(rows)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    differs = np.zeros(len(rows), bool)
    differs[:1] = True
    for key in keys:
        key = key[order]
        differs[1:] |= key[1:] != key[:-1]
    return order, np.flatnonzero(differs)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order, heads = grouped(rows)
    return rows[order[heads]], np.add.reduceat(counts[order], heads)


@dataclass
class Automaton:
    """Arcs of all states, in one run per state: label, weight, target. State 0 has none.

    Labels are places in ``alphabet`` (ascending); the root is the last state.
    """

    alphabet: np.ndarray
    starts: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    def to_bytes(self) -> bytes:
        blobs = [pack(self.alphabet), pack(self.starts), pack(self.label, self.weight, self.target)]
        head = [len(self.alphabet), len(self.starts), len(self.label), *map(len, blobs)]
        return b"".join([np.array(head, np.int64).tobytes(), *blobs])

    @staticmethod
    def of_bytes(data: bytes) -> Automaton:
        a, s, n, x, y, _ = np.frombuffer(data, np.int64, 6).tolist()
        (alphabet,), (starts,) = unpack(data[48:48 + x], a, np.int64), unpack(data[48 + x:48 + x + y], s, np.uint32)
        return Automaton(alphabet, starts, *unpack(data[48 + x + y:], n, np.uint32, np.int64, np.uint32))

    @property
    def states(self) -> int:
        return len(self.starts) - 1

    def levels(self):
        """Per length: rows (labels), weight of the last arc, the state it leads to, and each row's parent one level up."""
        state, rows, up = np.array([self.states - 1]), np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
        starts = self.starts.astype(np.int64)
        while True:
            n = starts[state + 1] - starts[state]
            if not n.sum():
                return
            up = np.repeat(np.arange(len(state)), n)
            arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[state], n)
            rows = np.column_stack([rows[up], self.label[arc].astype(np.int64)])
            state = self.target[arc].astype(np.int64)
            yield rows, self.weight[arc], state, up

    def phrases(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases as they were added, padded with END, in symbols, and how often each ended there."""
        out, counts = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
        last = None
        for rows, weight, _, up in self.levels():
            if last is not None:
                counts[-1] = last - np.bincount(up, weights=weight, minlength=len(last)).astype(np.int64)
            padded = np.full((len(rows), width), END, np.int64)
            padded[:, :rows.shape[1]] = self.alphabet[rows]
            out.append(padded)
            counts.append(weight)
            last = weight
        rows, own = np.concatenate(out), np.concatenate(counts)
        return rows[own > 0], own[own > 0]

    def lookup(self, rows: np.ndarray) -> np.ndarray:
        """Counts of phrases (symbols, END behind): the automaton of the questions, composed with this one.

        Both are walked in step, a level at a time; a phrase that leaves the automaton has count 0.
        """
        n = len(rows)
        found, state, alive = np.zeros(n, np.int64), np.full(n, self.states - 1), np.ones(n, bool)
        if not len(self.label) or not n:
            return found
        owner = np.repeat(np.arange(self.states, dtype=np.int64), np.diff(self.starts.astype(np.int64)))
        keys = (owner << 32) | self.label
        for column in rows.T:
            on = alive & (column != END)
            place = np.minimum(np.searchsorted(self.alphabet, column), len(self.alphabet) - 1)
            on &= self.alphabet[place] == column
            want = (state << 32) | place
            arc = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            on &= keys[arc] == want
            alive &= on | (column == END)
            found = np.where(on, self.weight[arc], np.where(alive, found, 0))
            state = np.where(on, self.target[arc].astype(np.int64), 0)
        return found


def build(rows: np.ndarray, counts: np.ndarray, least: int = 1) -> Automaton:
    """The automaton, minimal in each level, of sorted distinct ``rows`` (symbols, END behind); phrases below ``least`` are left out."""
    alphabet, flat = np.unique(rows, return_inverse=True)
    coded = flat.reshape(rows.shape).astype(np.int64)
    if len(alphabet) and alphabet[0] == END:
        alphabet, coded = alphabet[1:], coded - 1
    width = rows.shape[1]
    # nodes of the prefix tree, level by level: first row, weight, parent
    sums = np.r_[0, np.cumsum(counts)]
    differs, nodes = np.zeros(len(rows), bool), []
    if len(rows):
        differs[0] = True
    for d in range(width):
        if len(rows):
            differs[1:] |= coded[1:, d] != coded[:-1, d]
        at = np.flatnonzero(differs)
        inside = coded[at, d] >= 0
        weight = (sums[np.r_[at[1:], len(rows)]] - sums[at]) if len(at) else np.zeros(0, np.int64)
        keep = inside & (weight >= least)
        nodes.append((at[keep], weight[keep], coded[at[keep], d]))
    below = np.zeros(len(nodes[-1][0]) if nodes else 0, np.int64)
    starts, labels, weights, targets, made, arcs = [np.zeros(1, np.int64)], [], [], [], 1, 0
    for d in range(width - 1, -1, -1):
        first, weight, label = nodes[d]
        parents = nodes[d - 1][0] if d else np.zeros(1, np.int64)
        parent = np.maximum(np.searchsorted(parents, first, side="right") - 1, 0)
        n = np.bincount(parent, minlength=len(parents)).astype(np.int64)
        begin = np.cumsum(n) - n
        # equal states have equal arcs; a digest proposes, the arcs themselves decide
        digest = _mixed(_mixed(_mixed(label) + weight.astype(np.uint64)) + below.astype(np.uint64))
        total = np.r_[np.uint64(0), np.cumsum(digest, dtype=np.uint64)]
        digest = total[begin + n] - total[begin]
        _, lead, same = np.unique(np.column_stack([digest, n.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
        lead = lead[same.reshape(-1)]
        each = np.repeat(np.arange(len(parents)), n)
        twin = np.arange(len(first)) - begin[each] + begin[lead[each]]
        equal = (label == label[twin]) & (weight == weight[twin]) & (below == below[twin])
        odd = np.bincount(each[~equal], minlength=len(parents)) > 0
        lead = np.where(odd, np.arange(len(parents)), lead)
        new = np.unique(lead[n[lead] > 0])
        if d == 0:
            new = np.zeros(1, np.int64)
        state = np.zeros(len(parents), np.int64)
        state[new] = made + np.arange(len(new))
        arc = np.arange(n[new].sum()) - np.repeat(np.cumsum(n[new]) - n[new], n[new]) + np.repeat(begin[new], n[new])
        labels.append(label[arc])
        weights.append(weight[arc])
        targets.append(below[arc])
        starts.append(arcs + np.cumsum(n[new]) - n[new])
        made, arcs = made + len(new), arcs + len(arc)
        below = state[lead]
    offsets = np.r_[np.concatenate(starts), arcs]
    return Automaton(alphabet.astype(np.int64), offsets.astype(np.uint32), np.concatenate(labels).astype(np.uint32), np.concatenate(weights).astype(np.int64), np.concatenate(targets).astype(np.uint32))


def union(parts: list[Automaton], width: int, least: int = 1) -> Automaton:
    """One automaton with the sums of the weights of all ``parts``."""
    found = [p.phrases(width) for p in parts]
    if not found:
        return build(np.zeros((0, width), np.int64), np.zeros(0, np.int64))
    rows, counts = summed(np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found]))
    return build(rows, counts, least)
