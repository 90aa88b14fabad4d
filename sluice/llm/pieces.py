"""SentencePiece BPE encoding and decoding with seeded merge-dropout.

Text is cut into segments that no merge can cross (a run of spaces with the word behind
it, a line end). Each distinct segment is merged as the model's agenda does: of all
adjacent symbols whose joint piece exists, the pair with the best score, leftmost first,
merges next. A keyed hash of (seed, doc_id, place, segment, span) decides whether a candidate
takes part, so each occurrence has its own segmentation, agrees on every run, and always
decodes to the same text. Occurrences of a segment that drop the same spans, of all that
could ever merge, have the same agenda and share its result. All segments of a run of
texts pop their agendas together in numpy, one merge each per round. Rate 0 gives the
model's own encoding.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20
DROP = 0.1
MODEL_BYTES = 32 << 20
SPACE = "▁"
NONE = np.int64(1) << 62
#: segments of more characters are merged alone, with a heap
LONG = 64
TOGETHER = 1 << 12
#: occurrences whose coins are drawn at once
DRAWN = 1 << 15
#: segments of more spans that could merge share nothing
SPANS = 63
#: bits of the table of pieces' hashes
MARKS = 22
#: bytes of text that are encoded at once; arrays over all spans of its segments take some 100 times that
SLICE = 1 << 20
#: a run of spaces with what follows, a line end, or a start without a space
SEGMENT = re.compile(r" +[^ \n]*|\n|[^ \n]+")


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segmenter:
    """A BPE model with byte fallback, prepared for many segments at once."""

    def __init__(self, model: bytes, seed: int = SEED, drop: float = DROP):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(size)]
        if any(p and (SPACE in s.lstrip(SPACE) or "\n" in s) for s, p in zip(pieces, plain, strict=True)):
            raise ValueError("a piece of this model crosses words or lines")
        self.seed, self.drop = seed, drop
        self.bar = np.uint64(min(int(drop * 2.0**64), 2**64 - 1))
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        known = {s: i for i, (s, p) in enumerate(zip(pieces, plain, strict=True)) if p}
        scores = np.array([sp.get_score(i) for i in range(size)])
        # rank of a piece among all scores: the better, the smaller
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in known.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.char[32], self.char[ord(SPACE)] = self.char[ord(SPACE)], -1
        joins = {}
        for s, i in known.items():
            for cut in range(1, len(s)):
                a, b = known.get(s[:cut]), known.get(s[cut:])
                if a is not None and b is not None:
                    joins[a * size + b] = i
        self.size = size
        # hashes of all that a merge can give; a false hit only keeps results from being shared
        self.longest = max((len(pieces[i]) for i in joins.values()), default=0)
        self.marks = np.zeros(1 << MARKS, bool)
        for i in set(joins.values()):
            h = np.zeros(1, np.uint64)
            for c in pieces[i].replace(SPACE, " "):
                h = self._rolled(h, np.array([ord(c)], np.uint64))
            self.marks[self._mark(h)] = True
        # open addressing: a key's slot is the first free one from its hash on
        self.slots = 1 << max(4, (4 * len(joins)).bit_length())
        self.join_keys = np.full(self.slots, -1, np.int64)
        self.join_ids = np.full(self.slots, -1, np.int32)
        self.probes = 1
        homes = self._home(np.array(list(joins), np.int64)).tolist()
        for (key, piece), home in zip(joins.items(), homes, strict=True):
            step = 0
            while self.join_keys[(home + step) % self.slots] >= 0:
                step += 1
            self.join_keys[(home + step) % self.slots], self.join_ids[(home + step) % self.slots] = key, piece
            self.probes = max(self.probes, step + 1)
        raw = [b""] * size
        for i, s in enumerate(pieces):
            raw[i] = bytes([int(s[3:5], 16)]) if sp.is_byte(i) else s.replace(SPACE, " ").encode() if plain[i] else b""
        self.raw = pa.array(raw, pa.binary())

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each adjacent pair, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = self._home(key)
        found = self.join_keys[at]
        out = np.where(found == key, self.join_ids[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % self.slots
            found = self.join_keys[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.join_ids[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        out[(left < 0) | (right < 0)] = -1
        return out

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    @staticmethod
    def _rolled(h: np.ndarray, point: np.ndarray) -> np.ndarray:
        return (h + point + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _mark(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - MARKS)

    def _spans(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and end of every span that a merge could give, whatever was dropped before, by owner."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        start = np.arange(len(points)) - (np.cumsum(lengths) - lengths)[owner]
        room = lengths[owner] - start
        points = points.astype(np.uint64)
        at, h, found = np.arange(len(points)), np.zeros(len(points), np.uint64), []
        for n in range(1, self.longest + 1):
            on = room[at] >= n
            at, h = at[on], h[on]
            if not len(at):
                break
            h = self._rolled(h, points[at + n - 1])
            if n > 1:
                hit = at[self.marks[self._mark(h)]]
                found.append((owner[hit], start[hit], start[hit] + n))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        own, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(own, kind="stable")
        return own[order], a[order], b[order]

    def _shared(self, texts: list[str], code: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences to merge, and for each occurrence which of them has its result.

        ``code`` gives the text of each occurrence and ``named`` its keyed name.
        """
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        own, start, end = self._spans(points, np.array([len(t) for t in texts], np.int64))
        count = np.bincount(own, minlength=len(texts))
        head = np.cumsum(count) - count
        dropped = np.zeros(len(code), np.uint64)
        few = np.flatnonzero(count[code] <= SPANS)
        for x in range(0, len(few), DRAWN):
            some = few[x:x + DRAWN]
            n = count[code[some]]
            first = np.cumsum(n) - n
            bit = np.arange(n.sum()) - np.repeat(first, n)
            span = bit + np.repeat(head[code[some]], n)
            out = np.flatnonzero(self._coins(np.repeat(named[some], n), start[span], end[span]) < self.bar)
            who = np.repeat(np.arange(len(some)), n)[out]
            # bits are distinct, so their sum is the set of them
            np.add.at(dropped, some[who], np.uint64(1) << bit[out].astype(np.uint64))
        many = np.flatnonzero(count[code] > SPANS)
        dropped[many] = np.arange(len(many)).astype(np.uint64)
        order = np.lexsort((dropped, code))
        new = np.r_[True, (code[order][1:] != code[order][:-1]) | (dropped[order][1:] != dropped[order][:-1])] if len(code) else np.zeros(0, bool)
        place = np.empty(len(code), np.int64)
        place[order] = np.cumsum(new) - 1
        return order[new], place

    def _coins(self, named: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The keyed hash of each candidate span."""
        return _spread(named + start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + end.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def _costs(self, left, right, named, start, end) -> np.ndarray:
        """Agenda keys of adjacent pairs: rank of the joint piece before place in the segment; ``NONE`` where nothing may merge."""
        piece = self._joined(left, right)
        cost = (self.rank[piece] << 32) | start
        cost[piece < 0] = NONE
        if self.drop > 0:
            some = np.flatnonzero(piece >= 0)
            cost[some[self._coins(named[some], start[some], end[some]) < self.bar]] = NONE
        return cost

    def _together(self, symbol: np.ndarray, lengths: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Merge many short segments at once, in place; returns which symbols are left."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        head = np.cumsum(lengths) - lengths
        start = np.arange(len(symbol)) - head[owner]
        last = (head + lengths)[owner] - 1
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        cost = np.full(len(symbol), NONE)
        end = np.append(start[1:] + 1, 0)
        pair = np.flatnonzero(np.arange(len(symbol)) < last)
        cost[pair] = self._costs(symbol[pair], symbol[pair + 1], named[owner[pair]], start[pair], end[pair])
        left = np.ones(len(symbol), bool)
        at, size = head, lengths
        while len(at):
            spots = np.cumsum(size) - size
            best = np.minimum.reduceat(cost[np.arange(size.sum()) + np.repeat(at - spots, size)], spots)
            on = best < NONE
            at, size, best = at[on], size[on], best[on]
            if not len(at):
                break
            i = at + (best & 0xFFFFFFFF)
            j = after[i]
            symbol[i] = self._joined(symbol[i], symbol[j])
            left[j], cost[j] = False, NONE
            after[i] = after[j]
            inner = after[i] <= last[i]
            before[after[i][inner]] = i[inner]
            cost[i] = NONE
            ahead = before[i] >= at
            a, b = np.r_[i[inner], before[i][ahead]], np.r_[after[i][inner], i[ahead]]
            stop = np.where(after[b] <= last[b], start[np.minimum(after[b], len(start) - 1)], lengths[owner[b]])
            cost[a] = self._costs(symbol[a], symbol[b], named[owner[a]], start[a], stop)
        return left

    def _alone(self, symbol: np.ndarray, named: np.uint64) -> np.ndarray:
        """Merge one long segment with a heap, in place; returns which symbols are left."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = np.ones(n, bool)
        name = np.full(1, named, np.uint64)
        at = np.arange(n - 1)
        heap = [(c, i + 1, i + 2) for i, c in enumerate(self._costs(symbol[:-1], symbol[1:], np.full(n - 1, named, np.uint64), at, at + 2).tolist()) if c < NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            stop = after[j]
            c = int(self._costs(symbol[i:i + 1], symbol[j:j + 1], name, np.array([i]), np.array([stop]))[0])
            if c < NONE:
                heapq.heappush(heap, (c, j, stop))

        while heap:
            c, j, stop = heapq.heappop(heap)
            i = c & 0xFFFFFFFF
            # a neighbour that has grown or gone makes the entry stale
            if not left[i] or after[i] != j or after[j] != stop:
                continue
            symbol[i] = self._joined(symbol[i:i + 1], symbol[j:j + 1])[0]
            left[j], after[i] = False, stop
            if stop < n:
                before[stop] = i
                push(i, stop)
            if before[i] >= 0:
                push(before[i], i)
        return left

    def _named(self, digests: np.ndarray, variants: np.ndarray) -> np.ndarray:
        return _spread(digests ^ (variants.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def _digests(self, texts: list[str]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.array([digest(t, self.seed) for t in texts], np.uint64)

    def segments(self, texts: list[str], variants: np.ndarray) -> pa.Array:
        """Piece ids of each segment as a list array; ``variants`` (any 64-bit keys) pick the dropped candidates."""
        return self._merged(texts, self._named(self._digests(texts), variants) if self.drop > 0 else np.zeros(len(texts), np.uint64))

    def _merged(self, texts: list[str], named: np.ndarray) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        head = np.r_[0, np.cumsum(lengths)]
        symbol = self.char[points]
        left = np.ones(len(symbol), bool)
        long = lengths > LONG
        for i in np.flatnonzero(long).tolist():
            part = slice(head[i], head[i + 1])
            left[part] = self._alone(symbol[part], named[i])
        edges = np.flatnonzero(np.r_[True, long[1:] | long[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for x in range(a, b, TOGETHER) if not long[a] else ():
                y = min(x + TOGETHER, b)
                part = slice(head[x], head[y])
                left[part] = self._together(symbol[part], lengths[x:y], named[x:y])
        # characters without a piece become their bytes
        y, owner = symbol[left], np.repeat(np.arange(len(texts)), lengths)[left]
        odd = np.flatnonzero(y < 0)
        raws = [chr(c).encode("utf-8", "surrogatepass") for c in points[left][odd].tolist()]
        width = np.ones(len(y), np.int64)
        width[odd] = [len(r) for r in raws]
        ids = np.repeat(y, width)
        ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        count = np.bincount(owner, weights=width, minlength=len(texts)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids.astype(np.int32)))

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Segments of the texts, one after the other, and their offsets per text; a text is led by one space."""
        plain = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0 "), plain, pa.scalar("")), "\0")
        # runs of spaces, and texts that hold the mark itself, are cut one by one
        rough = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "\0")), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        if rough.any():
            lists = parts.to_pylist()
            for i in np.flatnonzero(rough).tolist():
                lists[i] = SEGMENT.findall(" " + texts[i].as_py())
            parts = pa.array(lists, pa.list_(pa.string()))
        ends = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        before = np.r_[0, np.cumsum(full)]
        return flat.filter(pa.array(full)), before[ends - ends[0]]

    def encode(self, texts: pa.Array, keys: np.ndarray, variants: int | None = None) -> pa.Array:
        """Ids of each text; ``keys`` (uint64) and the place key the dropout of each occurrence. An empty text has none.

        With ``variants``, a segment has so many segmentations at most.
        """
        texts = pc.fill_null(texts, "")
        flat, offsets = self.cut(texts)
        blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        names = coded.dictionary.to_pylist()
        if self.drop > 0:
            spot = np.arange(len(code)) - offsets[owner]
            turn = _spread(keys[owner] + spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            named = self._named(self._digests(names)[code], turn if variants is None else turn % np.uint64(variants))
            used, place = self._shared(names, code, named)
            lists = self._merged([names[i] for i in code[used].tolist()], named[used])
        else:
            lists, place = self._merged(names, np.zeros(len(names), np.uint64)), code
        taken = lists.take(pa.array(place))
        inner = taken.offsets.to_numpy().astype(np.int64) - (taken.offsets[0].as_py() if len(taken) else 0)
        ids, bounds = taken.flatten(), inner[offsets]
        if blank.any():
            keep = np.repeat(~blank, np.diff(bounds))
            sizes = np.where(blank, 0, np.diff(bounds))
            ids, bounds = ids.filter(pa.array(keep)), np.r_[0, np.cumsum(sizes)]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), ids)

    def decode(self, ids: pa.Array) -> list[bytes]:
        """UTF-8 text of each list of ids."""
        bounds = ids.offsets.to_numpy().astype(np.int64)
        raw = self.raw.take(ids.flatten())
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
        joined = b"".join(raw.to_pylist()) if len(raw) < 64 else raw.buffers()[2].to_pybytes()[raw.offset:][: int(sizes.sum())]
        at = np.r_[0, np.cumsum(sizes)][bounds - bounds[0]]
        return [joined[a:b][1:] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(2)
def _segmenter(model: bytes, seed: int, drop: float) -> Segmenter:
    """One per worker process, as preparing the tables takes a second."""
    return Segmenter(model, seed, drop)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model is larger than {MODEL_BYTES} bytes")
    return model


def encoded(docs: DataFrame, model: str = MODEL, seed: int = SEED, drop: float = DROP, variants: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_chars and lossless of every row, and the columns in ``keep``.

    The model file is read by the driver and broadcast; its size is checked. ``lossless``
    says that decoding the ids gave the text's bytes. Null and empty texts have no ids.
    Which merges drop depends on seed, doc_id and the place in the text, so repeated rows
    agree; a null doc_id counts as 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))
    fields = {f.name: f for f in docs.schema.fields}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    schema = "doc_id bigint, ids array<int>, n_chars bigint, lossless boolean" + "".join(f", `{c}` {fields[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(shared.value, seed, drop)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = pc.fill_null(part.column(1).cast(pa.string()), "")
                keys = pc.fill_null(part.column(0), 0).to_numpy().astype(np.int64).view(np.uint64)
                ids = segmenter.encode(texts, _spread(keys + np.uint64(seed % 2**64)), variants)
                good = [a == b.encode() for a, b in zip(segmenter.decode(ids), texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pc.utf8_length(texts).cast(pa.int64()), pa.array(good, pa.bool_()), *[part.column(i) for i in range(2, part.num_columns)]],
                    names=["doc_id", "ids", "n_chars", "lossless", *keep])
            release()

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null and empty ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(_model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(shared.value, SEED, 0.0)
        for batch in batches:
            lists = pa.array([v or [] for v in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in segmenter.decode(lists)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
