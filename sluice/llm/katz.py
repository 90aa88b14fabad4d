"""Language-model scores with a Katz backoff bigram model over all words.

Counts of one to ``GT`` are discounted by Good-Turing, per order. What a history's
discounted bigrams leave is spread over the other words by their unigram probability,
with the weight that makes the history's probabilities sum to one; unigrams leave their
rest to unseen words in the same way. A token is scored by its bigram, if that was seen,
else by backoff weight times the unigram, and so on down. Every word of the training
texts is a word of the model, whatever the size of the table.

1. Runs of texts become shards: token numbers of a dictionary of their own. The
   dictionaries are summed by hash cell: the unigram table. Each shard is told the ids and
   counts of its own words.
2. A shard sends each of its distinct bigrams once, with its count in training texts, to
   the bucket of its history; a history with many tokens is spread over several buckets by
   its followers, so that no bucket depends on one history, and a frequent bigram is as
   many entries as there are shards. Buckets sum the counts, write them as the bigram
   table, and answer each shard's questions with the counts.
3. What the buckets know of a history (how many followers have which count, how much
   unigram mass they hold) is summed per history: discounts and backoff weights, a table
   of its own, which shards are joined to where a token of theirs backs off.
4. Shards score their texts from the counts and weights they were told.

The model's tables (``UNIGRAM``, ``BIGRAM``, ``HISTORY``) stay in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards
from .common import crc, release

GT = 5
#: counts set aside for unseen followers of every history, so that none gets probability 0
RESERVE = 0.1
SHARD_BYTES = 6 << 20
MASS = 1 << 20
#: stands for the end of a text; no word is empty
END = ""
#: the history of a text's first token; ids of words begin at 1
START = 0


def discounts(n_r: list[int]) -> np.ndarray:
    """Good-Turing factors d_1..d_k from numbers of types n_1..n_{k+1}.

    Where the formula gives no factor between 0 and 1, as with few types, the absolute
    discount n_1 / (n_1 + 2 n_2) takes its place (one half without types).
    """
    n = [float(x) for x in n_r]
    k = len(n) - 1
    cut = (k + 1) * n[k] / n[0] if n[0] else 1.0
    fixed = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - fixed) / r)
    return np.array(out)


@dataclass
class Unigrams:
    """Totals of the unigram table: tokens, types, texts, discount factors, the share of unseen words."""

    total: int
    types: int
    texts: int
    factors: np.ndarray
    left: float
    scale: float

    @staticmethod
    def of(total: int, types: int, texts: int, n_r: list[int]) -> Unigrams:
        factors = discounts(n_r)
        small = sum(r * n * (1 - d) for r, n, d in zip(range(1, GT + 1), n_r, factors, strict=False))
        left, scale = (small / total if total else 1.0), 1.0
        if total and left <= 0:
            # no small counts at all: set aside as for a history, from all words alike
            scale = total / (total + RESERVE)
            left = 1 - scale
        return Unigrams(total, types, texts, factors, left, scale)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Discounted share of words by their count; all unseen words count as one."""
        d = np.r_[0.0, self.factors, 1.0][np.minimum(counts, GT + 1)]
        return np.where(counts > 0, self.scale * d * counts / max(self.total, 1), self.left)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))


LOCAL = "shard bigint, cell bigint, n bigint, names binary, data binary, doc_id array<bigint>, held array<boolean>, ends array<bigint>, tokens binary"


class Shard:
    """Token numbers of a run of texts, ends included."""

    def __init__(self):
        self.words, self.runs, self.bytes = shards.Dictionary(), [], 0

    def add(self, run: pa.RecordBatch) -> None:
        text = pc.ascii_lower(pc.fill_null(run.column("text").cast(pa.string()), ""))
        codes, offsets, words = shards.coded(text)
        first = self.words.add(pa.concat_arrays([words.cast(pa.string()), pa.array([END])]))
        tokens = np.insert(codes.astype(np.int64), offsets[1:], len(words)) + first
        self.runs.append((run.column("doc_id"), run.column("held"), np.diff(offsets) + 1, tokens))
        self.bytes += pc.sum(pc.binary_length(text)).as_py() or 0

    def batches(self, shard: int, parts: int) -> Iterator[pa.RecordBatch]:
        words, place = self.words.unify()
        ids, held, sizes, tokens = zip(*self.runs, strict=True)
        tokens, sizes, held = place[np.concatenate(tokens)], np.concatenate(sizes), pa.concat_arrays(held)
        learned = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), sizes)
        counts = np.bincount(tokens[learned], minlength=len(words))
        one = {
            "shard": pa.array([shard], pa.int64()), "cell": pa.nulls(1, pa.int64()), "n": pa.array([len(tokens)], pa.int64()), "names": pa.nulls(1, pa.binary()), "data": pa.nulls(1, pa.binary()),
            "doc_id": shards.lists(pa.concat_arrays(ids)), "held": shards.lists(held), "ends": shards.lists(pa.array(np.cumsum(sizes), pa.int64())), "tokens": pa.array([shards.pack(tokens.astype(np.uint32))], pa.binary())}
        yield pa.RecordBatch.from_pydict(one)
        cell, n, names, data = zip(*shards.sliced(words, parts, counts.astype(np.int64)), strict=True)
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array(np.full(len(n), shard)), "cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64()), "names": pa.array(names, pa.binary()), "data": pa.array(data, pa.binary()),
            **{k: pa.nulls(len(n), one[k].type) for k in ("doc_id", "held", "ends", "tokens")}})


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


UNIGRAM = "id bigint, word string, n bigint"


def _summed(group: pa.Table, cell: int, parts: int):
    """Slices of a cell, each entry's word, and the words with ids and counts; frequent words have small ids."""
    names, sizes, words, (codes, counts) = shards.gathered(group, np.int64)
    coded = words.dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(place, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return names, sizes, codes, place, coded.dictionary, rank * parts + cell + 1, total


def _unigrams(parts: int):
    def unigrams(key, group):
        *_, words, ids, total = _summed(group, key[0].as_py(), parts)
        on = pa.array(np.flatnonzero(total > 0))
        return pa.Table.from_arrays([pa.array(ids).take(on), words.cast(pa.string()).take(on), pa.array(total).take(on)], names=["id", "word", "n"])

    return unigrams


def _tell(parts: int):
    def tell(key, group):
        names, sizes, codes, place, _, ids, total = _summed(group, key[0].as_py(), parts)
        return shards.told_rows(names, sizes, codes, ids[place], total[place])

    return tell


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Pairs:
    """A shard's distinct bigrams, bucket by bucket, and where its tokens are among them."""

    def __init__(self, row: pa.RecordBatch, uni: Unigrams, buckets: int):
        (tokens,) = shards.unpack(row.column("tokens")[0].as_buffer(), row.column("n")[0].as_py(), np.uint32)
        self.ends = row.column("ends").flatten().to_numpy(zero_copy_only=False)
        self.held = row.column("held").flatten().to_numpy(zero_copy_only=False).astype(bool)
        codes, ids, f = shards.heard(row, np.int64, np.int64)
        ids, f = shards.by_code(codes, ids), shards.by_code(codes, f)
        # the start of a text stands behind all words
        self.ids, self.f = np.r_[ids, START], np.r_[f, uni.texts]
        self.word = tokens.astype(np.int64)
        self.history = np.r_[len(ids), self.word[:-1]] if len(tokens) else self.word
        self.history[self.ends[:-1]] = len(ids)
        self.doc = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        keys, place = np.unique((self.history << 32) | self.word, return_inverse=True)
        times = np.bincount(place[~self.held[self.doc]], minlength=len(keys))
        h, w = keys >> 32, keys & 0xFFFFFFFF
        spread = np.maximum(1, -(-self.f[h] // MASS)).astype(np.uint64)
        sub = _mix(self.ids[w]) % spread
        bucket = (_mix(self.ids[h].astype(np.uint64) * np.uint64(1 << 20) + sub) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.ids[w], self.ids[h], bucket))
        self.h, self.w, self.times, bucket = h[order], w[order], times[order], bucket[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.token = back[place]
        some, heads = np.unique(bucket, return_index=True)
        self.slices = list(zip(some.tolist(), heads.tolist(), [*heads[1:].tolist(), len(order)][: len(heads)], strict=True))


    def slice(self, a: int, b: int) -> bytes:
        """Histories, followers and counts of one bucket; followers refer to an alphabet with their unigram counts."""
        some, place = np.unique(self.w[a:b], return_inverse=True)
        order = np.argsort(self.ids[some])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        some = some[order]
        words = shards.pack(shards.delta(self.ids[some]), self.f[some].astype(np.uint32))
        rows = shards.pack(shards.delta(self.ids[self.h[a:b]]), back[place].astype(np.uint32), self.times[a:b].astype(np.uint32))
        return len(some).to_bytes(8, "little") + len(words).to_bytes(8, "little") + words + rows


def _slice(data: bytes, n: int) -> tuple[np.ndarray, ...]:
    """Histories, followers, the followers' unigram counts, and counts."""
    k, size = (int.from_bytes(data[i:i + 8], "little") for i in (0, 8))
    ids, f = shards.unpack(data[16:16 + size], k, np.int64, np.uint32)
    h, place, times = shards.unpack(data[16 + size:], n, np.int64, np.uint32, np.uint32)
    return shards.undelta(h), shards.undelta(ids)[place], f[place], times


ASKED = "bucket bigint, shard bigint, n bigint, data binary"


def _ask(uni: Unigrams, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                p = Pairs(row, uni, buckets)
                if not p.slices:
                    continue
                blobs = [p.slice(a, b) for _, a, b in p.slices]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in p.slices], pa.int64()), pa.concat_arrays([row.column("shard")] * len(blobs)), pa.array([b - a for _, a, b in p.slices], pa.int64()), pa.array(blobs, pa.binary())],
                    names=["bucket", "shard", "n", "data"])
                del p, blobs
            release()

    return ask


BUCKET = "kind string, bucket bigint, shard bigint, n bigint, data binary, need array<bigint>"
HISTORY = ["h", "large", "taken", *[f"n{r}" for r in range(1, GT + 2)]]


def _count(uni: Unigrams):
    """A bucket: sums counts, and writes its bigrams, what it knows of histories, and answers."""

    def count(key, group):
        group = group.take(pa.array(np.argsort(group.column("shard").to_numpy(), kind="stable"))).combine_chunks()
        names, sizes = group.column("shard").to_numpy(), group.column("n").to_numpy()
        n = int(sizes.sum())
        h, w, f, times = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint32), np.empty(n, np.uint32)
        at = 0
        for size, data in zip(sizes.tolist(), group.column("data").chunk(0), strict=True):
            h[at:at + size], w[at:at + size], f[at:at + size], times[at:at + size] = _slice(data.as_py(), size)
            at += size
        del group
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])] if n else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        c = np.add.reduceat(times[order], heads, dtype=np.int64) if n else np.zeros(0, np.int64)
        counts = np.empty(n, np.int64)
        counts[order] = c[np.cumsum(new) - 1]
        hs, ws, fs = hs[heads], ws[heads], f[order[heads]]
        seen = c > 0
        some, place = np.unique(hs[seen], return_inverse=True)
        small = np.bincount(place * (GT + 2) + np.minimum(c[seen], GT + 1), minlength=len(some) * (GT + 2)).reshape(-1, GT + 2)
        large = np.bincount(place, weights=c[seen] * (c[seen] > GT), minlength=len(some)).astype(np.int64)
        taken = np.bincount(place, weights=uni.probability(fs[seen].astype(np.int64)), minlength=len(some))
        rows = [("bigram", -1, int(seen.sum()), shards.pack(shards.delta(hs[seen]), ws[seen], c[seen]), None),
                ("history", -1, len(some), shards.pack(some, large, taken, *[small[:, r].astype(np.int64) for r in range(1, GT + 2)]), None)]
        at = 0
        for name, size in zip(names.tolist(), sizes.tolist(), strict=True):
            mine = counts[at:at + size]
            rows.append(("answer", name, size, shards.pack(np.minimum(mine, 0xFFFFFFFF).astype(np.uint32)), np.unique(h[at:at + size][mine == 0])))
            at += size
        kind, shard, size, data, need = zip(*rows, strict=True)
        release()
        return pa.Table.from_arrays([
            pa.array(kind), pa.array(np.full(len(rows), key[0].as_py())), pa.array(shard, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary()), pa.array(need, pa.list_(pa.int64()))],
            names=["kind", "bucket", "shard", "n", "data", "need"])

    return count


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            columns = shards.unpack(data.as_buffer(), n, np.int64, np.int64, np.float64, *[np.int64] * (GT + 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=HISTORY)


def backoff(histories: DataFrame, factors: np.ndarray) -> DataFrame:
    """(h, log_weight) of every history that was seen.

    The weight is what the discounts leave over what the unigrams of unseen followers hold.
    A history that was followed by all there is keeps its rest for none.
    """
    total, used = F.col("large").cast("double"), F.col("large").cast("double")
    for r, d in enumerate(factors, 1):
        total, used = total + r * F.col(f"n{r}"), used + float(d) * r * F.col(f"n{r}")
    rest = F.greatest(1 - used / (total + RESERVE), F.lit(1e-300))
    return histories.select("h", (F.log10(rest) - F.log10(F.greatest(1 - F.col("taken"), F.lit(1e-300)))).alias("log_weight"))


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(uni: Unigrams, factors: np.ndarray, buckets: int):
    logs = np.r_[0.0, np.log10(factors * np.arange(1, GT + 1))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                p = Pairs(row, uni, buckets)
                answers = {a["bucket"]: a["data"] for a in row.column("answers")[0].as_py() or []}
                c = np.zeros(len(p.h), np.int64)
                for bucket, a, b in p.slices:
                    (c[a:b],) = shards.unpack(answers[bucket], b - a, np.uint32)
                room = np.log10(p.f + RESERVE)
                lower = np.log10(uni.probability(p.f))
                weights = np.zeros(len(p.ids))
                names, values = (row.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("needed", "log_weight"))
                if len(names):
                    order = np.argsort(names)
                    at = np.minimum(np.searchsorted(names[order], p.ids), len(names) - 1)
                    weights = np.where(names[order][at] == p.ids, values[order][at], 0.0)
                high = np.where(c > GT, np.log10(np.maximum(c, 1)), logs[np.minimum(c, GT)])
                each = np.where(c > 0, high - room[p.h], weights[p.h] + lower[p.w])
                k = len(p.ends)
                yield pa.RecordBatch.from_arrays([
                    row.column("doc_id").flatten(), pa.array(p.held), pa.array(np.bincount(p.doc, minlength=k).astype(np.int64)), pa.array(np.bincount(p.doc, weights=p.f[p.word] > 0, minlength=k).astype(np.int64)),
                    pa.array(np.full(k, uni.total)), pa.array(np.bincount(p.doc, weights=uni.base(p.f)[p.word], minlength=k)), pa.array(np.bincount(p.doc, weights=each[p.token], minlength=k))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del p, c, each
            release()

    return score


def held_out(mod: int = 10) -> Column:
    return F.pmod(crc("doc_id"), F.lit(mod)) == 0


@dataclass
class Model:
    """The tables of a model: unigrams (id, word, n), packed bigrams by bucket, histories with their weights."""

    unigrams: DataFrame
    bigrams: DataFrame
    weights: DataFrame
    totals: Unigrams
    factors: np.ndarray


def fitted(docs: DataFrame, held: Column | None = None) -> tuple[Model, DataFrame]:
    """The model of the rows of ``docs`` that are not held out, and the scores of all rows."""
    mark = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("held"))
    parts = shards.cells(docs)
    local = shards.settled(rows.mapInArrow(_local(parts), LOCAL), "katz-shards")
    words = local.where("cell IS NOT NULL").select(*shards.SLICE)
    table = shards.settled(words.groupBy("cell").applyInArrow(_unigrams(parts), UNIGRAM), "katz-unigrams")
    few = [F.count_if(F.col("n") == r) for r in range(1, GT + 2)]
    total, types, texts, *n_r = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0)), *few).first()
    uni = Unigrams.of(total, types, texts, n_r)

    told = shards.settled(shards.mapping(words.groupBy("cell").applyInArrow(_tell(parts), shards.TOLD)), "katz-told")
    texts_ = local.where("cell IS NULL").select("shard", "n", "doc_id", "held", "ends", "tokens").join(told, "shard")
    buckets = max(8, -(-total // MASS))
    asked = texts_.mapInArrow(_ask(uni, buckets), ASKED)
    counted = shards.settled(asked.groupBy("bucket").applyInArrow(_count(uni), BUCKET), "katz-bigrams")

    histories = counted.where("kind = 'history'").select("n", "data").mapInArrow(_histories, "h bigint, large bigint, taken double, " + ", ".join(f"{c} bigint" for c in HISTORY[3:]))
    histories = shards.settled(histories.groupBy("h").agg(*[F.sum(c).alias(c) for c in HISTORY[1:]]), "katz-histories")
    factors = discounts([x or 0 for x in histories.agg(*[F.sum(c) for c in HISTORY[3:]]).first()])
    weights = backoff(histories, factors)

    answers = counted.where("kind = 'answer'").select("shard", "bucket", "data", "need")
    given = answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    needs = answers.select("shard", F.explode("need").alias("h")).distinct().join(weights, "h")
    needs = needs.groupBy("shard").agg(F.collect_list("h").alias("needed"), F.collect_list("log_weight").alias("log_weight"))
    whole = texts_.join(given, "shard", "left").join(needs, "shard", "left")
    for column, kind in (("needed", "array<bigint>"), ("log_weight", "array<double>")):
        whole = whole.withColumn(column, F.coalesce(column, F.array().cast(kind)))
    model = Model(table, counted.where("kind = 'bigram'").select("bucket", "n", "data"), weights, uni, factors)
    return model, shards.settled(whole.mapInArrow(_score(uni, factors, buckets), SCORES), "katz-scores")


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text); rows where ``held`` holds aren't learned from.

    n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-0.1 unigrams) and score (log10 probability by the model). Null is the
    empty text, which is one end. Repeated rows are counted and scored as often as they
    stand. Without training rows every word is unseen. Other columns are ignored. An empty
    table gives no rows.
    """
    return fitted(docs, held)[1]
