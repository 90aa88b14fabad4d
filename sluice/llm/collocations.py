"""Phrases whose words stand together more often than their parts would by chance.

1. Runs of texts become shards: word numbers of a dictionary of their own, with a break
   wherever a piece ends. Dictionaries are summed: words seen ``least`` times get an
   address, the start of their own stretch on a line as long as all their occurrences.
2. A phrase can only be frequent if all its words are, so other words become breaks.
   Each shard builds a count automaton of its word pairs, cut at ranges of the line (a
   phrase lies at its first word's stretch, at a place its second word gives); the
   automata of a range are united, their weights summed, and each shard learns which of
   its own pairs are frequent.
3. The same again with phrases of up to five words in which all neighbours are frequent
   pairs. What is left after the union is the table of frequent phrases, by range.
4. Every cut of a phrase asks for its parts: the first part lies on the phrase's own path;
   the rest is sent to the range it lies at, where the questions are composed with that
   range's automaton.

Ranges hold about ``MASS`` occurrences, and a shard sends each phrase once with its count,
so a frequent phrase is as many entries as there are shards, not occurrences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import shards
from .common import release
from .transducer import END, Automaton, build, grouped, summed, union

LEAST, LONGEST, TOP = 100, 5, 2000
MASS = 1 << 21
SHARD_BYTES = 6 << 20

#: bytes of texts -> lower case, tab to space, every end of a piece to line feed
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
FOLD[9] = 32
FOLD[list(b".,;:!?\n\x0b\x0c\r")] = 10

LOCAL = "shard bigint, cell bigint, n bigint, names binary, langs binary, data binary, tokens binary"
TEXT = pa.string()
FIELDS = [c.split()[0] for c in LOCAL.split(", ")]


def folded(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts with pieces ended by line feeds, and for each word whether a piece starts with it."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    flat = FOLD[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None and len(data) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    gap = (flat == 32) | (flat == 10)
    after = np.r_[True, gap[:-1]] if len(flat) else gap
    after[offsets[:-1][offsets[:-1] < len(flat)]] = True
    starts = np.flatnonzero(~gap & after)
    piece = np.cumsum(flat == 10)[starts] if len(starts) else starts
    owner = np.searchsorted(offsets, starts, side="right")
    fresh_piece = np.r_[True, (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])] if len(starts) else np.zeros(0, bool)
    return pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())), fresh_piece


class Shard:
    """Word numbers of a run of texts; 0 is a break. A word belongs to its text's language."""

    def __init__(self):
        self.words, self.langs, self.runs, self.bytes = shards.Dictionary(), [], [], 0

    def add(self, run: pa.RecordBatch) -> None:
        text, first = folded(pc.fill_null(run.column("text").cast(TEXT), ""))
        codes, offsets, words = shards.coded(text)
        lang = pc.fill_null(run.column("lang").cast(TEXT), "und").dictionary_encode()
        # one entry per (language, word): a separator no language name can forge, as it is cut at the first
        key = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)) * max(len(words), 1) + codes
        pairs, place = np.unique(key, return_inverse=True)
        at = self.words.add(words.cast(TEXT).take(pa.array(pairs % max(len(words), 1))))
        self.langs.append(lang.dictionary.take(pa.array(pairs // max(len(words), 1))))
        stream = np.insert(place.astype(np.int64) + at + 1, np.flatnonzero(first), 0)
        self.runs.append(stream)
        self.bytes += pc.sum(pc.binary_length(text)).as_py() or 0

    def batches(self, shard: int, parts: int) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays(self.words.parts)
        langs = pa.concat_arrays(self.langs)
        word, lang = words.dictionary_encode(), langs.dictionary_encode()
        key = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(word.dictionary), 1) + word.indices.to_numpy(zero_copy_only=False)
        pairs, place = np.unique(key, return_inverse=True)
        stream = np.concatenate(self.runs)
        stream = np.where(stream > 0, np.r_[-1, place][stream] + 1, 0) if len(place) else stream
        counts = np.bincount(stream, minlength=len(pairs) + 1)[1:]
        words = word.dictionary.take(pa.array(pairs % max(len(word.dictionary), 1)))
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(stream)], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
            pa.array([shards.pack(stream.astype(np.uint32))], pa.binary())], names=FIELDS)
        where = lang.indices.to_numpy(zero_copy_only=False)[np.unique(key, return_index=True)[1]] if len(key) else np.zeros(0, int)
        rows = list(shards.sliced(words, parts, counts.astype(np.int64), where.astype(np.int32)))
        if rows:
            cell, n, names, data = zip(*rows, strict=True)
            spoken = json.dumps(lang.dictionary.to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), shard)), pa.array(cell, pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array([spoken] * len(rows), pa.binary()), pa.array(data, pa.binary()),
                pa.nulls(len(rows), pa.binary())], names=FIELDS)


def _local(parts: int):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for run in shards.runs(batches):
            shard.add(run)
            if shard.bytes >= SHARD_BYTES:
                yield from shard.batches(number, parts)
                number, shard = number + 1, Shard()
                release()
        if shard.runs:
            yield from shard.batches(number, parts)
        release()

    return local


FREQUENT = "cell bigint, word string, lang string, f bigint, past bigint"
HEARD = "shard bigint, n bigint, cell bigint, data binary"


def _words_of(group: pa.Table):
    """Slices of one cell: shards, sizes, codes, each entry's word, the distinct words, their languages and counts."""
    names, sizes, words, (codes, counts, where) = shards.gathered(group, np.int64, np.int32)
    group = group.take(pa.array(np.argsort(group.column("shard").to_numpy(), kind="stable")))
    spoken = [json.loads(x) for x in group.column("langs").to_pylist()]
    lang = pa.array([x for some in spoken for x in some], TEXT).dictionary_encode()
    first = np.cumsum([0, *map(len, spoken)])[:-1]
    lang_of = lang.indices.to_numpy(zero_copy_only=False)[np.repeat(first, sizes) + where]
    word = words.dictionary_encode()
    key = lang_of.astype(np.int64) * max(len(word.dictionary), 1) + word.indices.to_numpy(zero_copy_only=False)
    pairs, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(pairs)).astype(np.int64)
    at = pa.array(pairs % max(len(word.dictionary), 1)), pa.array(pairs // max(len(word.dictionary), 1))
    return names, sizes, codes, place, word.dictionary.take(at[0]), lang.dictionary.take(at[1]), total


def _counting(least: int):
    """Words of a cell -> the frequent ones with their places in the cell's stretch, and all counts by language."""

    def count(key, group):
        *_, words, langs, total = _words_of(group)
        on = np.flatnonzero(total >= least)
        f = total[on]
        some, lang = np.unique(langs.to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if len(langs) else (np.zeros(0, str), np.zeros(0, int))
        n = np.bincount(lang, weights=total, minlength=len(some)).astype(np.int64)
        k = len(on) + len(some)
        return pa.Table.from_arrays([
            pa.array(np.full(k, key[0].as_py())), pa.concat_arrays([words.take(pa.array(on)).cast(TEXT), pa.nulls(len(some), TEXT)]),
            pa.concat_arrays([langs.take(pa.array(on)).cast(TEXT), pa.array(some.tolist(), TEXT)]), pa.array(np.r_[f, n]), pa.array(np.r_[np.cumsum(f) - f, np.zeros(len(some), np.int64)])],
            names=["cell", "word", "lang", "f", "past"])

    return count


def _telling(least: int):
    """Words of a cell -> what each shard hears about its own frequent ones."""

    def tell(key, group):
        names, sizes, codes, place, _, _, total = _words_of(group)
        on = total >= least
        past = np.where(on, np.cumsum(total * on) - total, 0)
        kept = on[place]
        sizes = np.diff(np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(sizes)]])
        out = shards.told_rows(names, sizes, codes[kept], past[place][kept], total[place][kept])
        return out.add_column(2, "cell", pa.array(np.full(out.num_rows, key[0].as_py())))

    return tell


STREAM = "shard bigint, n bigint, tokens binary, address array<bigint>, f array<bigint>"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with the addresses of their frequent words; all other words are breaks, words between two breaks go."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            (stream,) = shards.unpack(one.column("tokens")[0].as_buffer(), one.column("n")[0].as_py(), np.uint32)
            codes, past, f = shards.heard(one, np.int64, np.int64)
            told = one.column("told")[0].as_py() or []
            address = past + np.repeat([t["begin"] for t in told], [t["n"] for t in told]).astype(np.int64)
            order = np.argsort(address)
            told = np.zeros(max(int(stream.max(initial=0)), int(codes.max(initial=-1)) + 1) + 1, np.int64)
            told[codes[order] + 1] = np.arange(1, len(order) + 1)
            stream = told[stream]
            on = stream > 0
            near = np.r_[False, on[:-1]] | np.r_[on[1:], False]
            stream = stream[(on & near) | (~on & np.r_[False, on[:-1]])] if len(stream) else stream
            yield pa.RecordBatch.from_arrays([
                one.column("shard"), pa.array([len(stream)], pa.int64()), pa.array([shards.pack(stream.astype(np.uint32))], pa.binary()),
                shards.lists(pa.array(address[order])), shards.lists(pa.array(f[order]))], names=["shard", "n", "tokens", "address", "f"])
        release()


def _spread(symbol: np.ndarray) -> np.ndarray:
    """A place between 0 and 1 that depends on the word's address only."""
    x = symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def ranges(first: np.ndarray, f: np.ndarray, second: np.ndarray, mass: int) -> np.ndarray:
    """The range a phrase lies at: its first word's stretch, at the place its second word gives."""
    return (first + (_spread(second) * f).astype(np.int64)) // mass


SLICES = "range bigint, shard bigint, data binary"


def _slices(shard: pa.Array, rows: np.ndarray, counts: np.ndarray, address: np.ndarray, f: np.ndarray, mass: int) -> Iterator[pa.RecordBatch]:
    """Distinct phrases of a shard (places in its alphabet) as one automaton per range."""
    at = ranges(address[rows[:, 0]], f[rows[:, 0]], address[rows[:, 1]], mass)
    order = np.argsort(at, kind="stable")
    some, heads = np.unique(at[order], return_index=True)
    names, blobs = [], []
    for r, a, b in zip(some.tolist(), heads.tolist(), [*heads[1:].tolist(), len(order)][: len(heads)], strict=True):
        mine = rows[order[a:b]]
        symbols = np.where(mine >= 0, address[mine], END)
        names.append(r)
        blobs.append(build(symbols, counts[order[a:b]]).to_bytes())
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.concat_arrays([shard] * len(names)), pa.array(blobs, pa.binary())], names=["range", "shard", "data"])


def _stream(one: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (stream,) = shards.unpack(one.column("tokens")[0].as_buffer(), one.column("n")[0].as_py(), np.uint32)
    return stream.astype(np.int64) - 1, *(one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("address", "f"))


def _pairs(mass: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                stream, address, f = _stream(one)
                both = (stream[:-1] >= 0) & (stream[1:] >= 0)
                keys, counts = np.unique((stream[:-1][both] << 32) | stream[1:][both], return_counts=True)
                yield from _slices(one.column("shard"), np.column_stack([keys >> 32, keys & 0xFFFFFFFF]), counts, address, f, mass)
            release()

    return pairs


def _answering(least: int):
    """Pairs of a range, from all shards -> each shard's own pairs that are frequent in all."""

    def answer(key, group):
        names, blobs = group.column("shard").to_numpy(), group.column("data").to_pylist()
        parts = [Automaton.of_bytes(b).phrases(2) for b in blobs]
        rows, owner = np.concatenate([r for r, _ in parts]), np.repeat(names, [len(r) for r, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order, heads = grouped(rows)
        total = np.add.reduceat(counts[order], heads) if len(heads) else counts
        on = np.zeros(len(rows), bool)
        on[order] = np.repeat(total >= least, np.diff(np.r_[heads, len(rows)]))
        out = rows[on]
        some, heads = np.unique(owner[on], return_index=True) if on.any() else (np.zeros(0, np.int64), np.zeros(0, int))
        order = np.argsort(owner[on], kind="stable")
        ends = np.r_[np.searchsorted(owner[on][order], some), len(order)] if len(some) else np.zeros(1, int)
        listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[order, j])) for j in (0, 1)]
        release()
        return pa.Table.from_arrays([pa.array(some, pa.int64()), *listed], names=["shard", "one", "two"])

    return answer


def _windows(mass: int, longest: int):
    """Phrases of two words and more in which all neighbours are frequent pairs."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                stream, address, f = _stream(one)
                a, b = (np.searchsorted(address, one.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("one", "two"))
                known = np.sort((a.astype(np.int64) << 32) | b)
                if not len(known) or len(stream) < 2:
                    continue
                here = np.where((stream[:-1] >= 0) & (stream[1:] >= 0), (stream[:-1] << 32) | stream[1:], -1)
                tied = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
                length = np.zeros(len(stream), np.int64)
                for step in range(longest - 1):
                    reach = np.zeros(len(stream), bool)
                    rest = tied[step:]
                    reach[: len(rest)] = rest
                    length += reach & (length == step)
                at = np.flatnonzero(length > 0)
                padded = np.r_[stream, np.full(longest, END)]
                rows = padded[at[:, None] + np.arange(longest)]
                rows[np.arange(longest) > length[at][:, None]] = END
                rows, counts = summed(rows, np.ones(len(rows), np.int64))
                yield from _slices(one.column("shard"), rows, counts, address, f, mass)
            release()

    return windows


MODEL = "range bigint, data binary, address array<bigint>, f array<bigint>"


def _united(least: int, longest: int):
    def unite(key, group):
        whole = union([Automaton.of_bytes(b) for b in group.column("data").to_pylist()], longest, least)
        release()
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([whole.to_bytes()], pa.binary())], names=["range", "data"])

    return unite


CUTS = "phrase binary, size int, a bigint, k int, first binary, rest binary, home bigint, l bigint, r bigint, symbols array<bigint>"


def _cut(mass: int, longest: int):
    """Frequent phrases of a range with each of their cuts; single words are answered by the alphabet."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, address, f in zip(batch.column("data"), batch.column("address"), batch.column("f"), strict=True):
                a, address, f = Automaton.of_bytes(data.as_buffer().to_pybytes()), address.values.to_numpy(zero_copy_only=False), f.values.to_numpy(zero_copy_only=False)
                counts = f[np.searchsorted(address, a.alphabet)] if len(address) else np.zeros(0, np.int64)
                above: list[np.ndarray] = []
                for size, (rows, weight, _, up) in enumerate(a.levels(), 1):
                    above = [w[up] for w in above] + [counts[rows[:, 0]] if size == 1 else weight]
                    if size == 1:
                        continue
                    symbols = a.alphabet[rows]
                    whole = [s.tobytes() for s in symbols]
                    for k in range(1, size):
                        rest = symbols[:, k:]
                        single = size - k == 1
                        home = np.full(len(rows), -1) if single else ranges(rest[:, 0], counts[rows[:, k]], rest[:, 1], mass)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(whole, pa.binary()), pa.array(np.full(len(rows), size), pa.int32()), pa.array(weight), pa.array(np.full(len(rows), k), pa.int32()),
                            pa.array([s[:k].tobytes() for s in symbols], pa.binary()), pa.array([np.ascontiguousarray(s).tobytes() for s in rest], pa.binary()),
                            pa.array(home, pa.int64()), pa.array(above[k - 1]), pa.array(counts[rows[:, k]] if single else np.zeros(len(rows), np.int64), mask=np.full(len(rows), not single)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(np.ascontiguousarray(symbols).reshape(-1)))],
                            names=[c.split()[0] for c in CUTS.split(", ")])
        release()

    return cut


def _composed(longest: int):
    def compose(asked: pa.Table, model: pa.Table) -> pa.Table:
        rests = asked.column("rest").to_pylist()
        rows = np.full((len(rests), longest), END, np.int64)
        for i, rest in enumerate(rests):
            rows[i, :len(rest) // 8] = np.frombuffer(rest, np.int64)
        found = Automaton.of_bytes(model.column("data")[0].as_buffer().to_pybytes()).lookup(rows) if model.num_rows else np.zeros(len(rows), np.int64)
        return asked.select(["phrase", "k"]).append_column("r", pa.array(found, pa.int64()))

    return compose


def frequent_words(local: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(cell, word, lang, f, past) of frequent words, and (lang, n) of all words."""
    found = shards.settled(local.groupBy("cell").applyInArrow(_counting(least), FREQUENT), "phrase-words")
    return found.where("word IS NOT NULL"), found.where("word IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))


def scores(cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """floor(1000 a n / (l r)) of every cut, in exact decimals, and each phrase's lowest cut (the first one on ties)."""
    wide = "decimal(19,0)"
    score = F.expr(f"CAST(CAST(1000 * a AS {wide}) * CAST(n AS {wide}) AS decimal(38,0)) div CAST(CAST(l AS {wide}) * CAST(r AS {wide}) AS decimal(38,0))")
    cuts = cuts.join(totals, "phrase").withColumn("score", score.cast("long"))
    return cuts.groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang", "text")).alias("best")).select("phrase", "best.*")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, mass: int = MASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of two to ``longest`` words, the best first.

    ``docs`` has text and lang; null texts are empty, null languages count as ``und``.
    Phrases do not cross ``[.,;:!?]`` or ends of lines. A phrase whose words stand in a
    longer one that is just as frequent is left out. Ties go to the larger count, then to
    the phrase's bytes. Repeated rows count as often as they stand, other columns are
    ignored, no words give no rows. ``top`` None returns all.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = shards.cells(docs)
    local = shards.settled(rows.mapInArrow(_local(parts), LOCAL), "phrase-shards")
    slices = local.where("cell IS NOT NULL").drop("tokens")
    words, totals = frequent_words(slices, least)
    # where each cell's words begin on the line
    begin = words.groupBy("cell").agg(F.sum("f").alias("size")).withColumn("begin", F.sum("size").over(W.orderBy("cell")) - F.col("size")).select("cell", "begin")
    words = shards.settled(words.join(begin, "cell").select("word", "lang", "f", (F.col("past") + F.col("begin")).alias("address")), "phrase-addresses")
    heard = slices.groupBy("cell").applyInArrow(_telling(least), HEARD).join(begin, "cell")
    heard = heard.groupBy("shard").agg(F.collect_list(F.struct("n", "data", "begin")).alias("told"))
    texts = local.where("cell IS NULL").select("shard", "n", "tokens")
    streams = shards.settled(texts.join(heard, "shard").mapInArrow(_streams, STREAM), "phrase-streams")

    known = streams.mapInArrow(_pairs(mass), SLICES).groupBy("range").applyInArrow(_answering(least), "shard bigint, one array<bigint>, two array<bigint>")
    known = known.groupBy("shard").agg(F.flatten(F.collect_list("one")).alias("one"), F.flatten(F.collect_list("two")).alias("two"))
    known = shards.settled(known, "phrase-pairs")
    found = streams.join(known, "shard").mapInArrow(_windows(mass, longest), SLICES)
    model = shards.settled(found.groupBy("range").applyInArrow(_united(least, longest), "range bigint, data binary"), "phrase-model")
    return ranked(model, words, totals, longest, top, mass)


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, data in zip(batch.column("range").to_pylist(), batch.column("data"), strict=True):
            symbols = Automaton.of_bytes(data.as_buffer().to_pybytes()).alphabet
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(symbols), r)), pa.array(symbols)], names=["range", "address"])


def ranked(model: DataFrame, words: DataFrame, totals: DataFrame, longest: int, top: int | None, mass: int) -> DataFrame:
    """Scores and ranks of the phrases in ``model`` (range, automaton)."""
    counts = model.mapInArrow(_alphabet, "range bigint, address bigint").join(words.select("address", "f"), "address")
    counts = counts.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("address", "f"))).alias("s")).select("range", F.col("s.address").alias("address"), F.col("s.f").alias("f"))
    cuts = shards.settled(model.join(counts, "range").mapInArrow(_cut(mass, longest), CUTS), "phrase-cuts")
    asked = cuts.where("r IS NULL").select("phrase", "k", "rest", F.col("home").alias("range"))
    looked = asked.groupBy("range").cogroup(model.select(F.col("range").alias("at"), "data").groupBy("at")).applyInArrow(_composed(longest), "phrase binary, k int, r bigint")
    parts = cuts.where("r IS NOT NULL").select("phrase", "k", "a", "l", "r").unionByName(cuts.where("r IS NULL").select("phrase", "k", "a", "l").join(looked, ["phrase", "k"]))
    # the longer phrases around a phrase: one word more on either side
    around = cuts.where("k = 1").select(F.col("rest").alias("phrase"), F.col("a").alias("longer")).unionByName(
        cuts.where("k = size - 1").select(F.col("first").alias("phrase"), F.col("a").alias("longer")))
    around = around.groupBy("phrase").agg(F.max("longer").alias("longer"))
    spelled = cuts.where("k = 1").select("phrase", F.posexplode("symbols").alias("place", "address"))
    spelled = spelled.join(words.select("address", "word", "lang"), "address")
    spelled = spelled.groupBy("phrase").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), " ").alias("text"), F.min("lang").alias("lang"))
    best = scores(parts, spelled.join(totals, "lang"))
    best = best.join(around, "phrase", "left").where("longer IS NULL OR longer < a")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("text"))
    best = best.withColumn("rank", F.row_number().over(order))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
