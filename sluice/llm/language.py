"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is one space. The n-grams of one
to three characters fall into hashed buckets. Tasks count them per language with numpy,
the counts are summed by Spark, and the log-probability matrix (languages x buckets, of
a checked size) is broadcast. Scoring looks up all n-grams of a run of texts at once and
sums them per text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc, slices

BUCKETS = 1 << 15
ORDERS = 3
SMOOTHING = 0.5
MODEL_BYTES = 64 << 20
UNDEFINED = "und"
SLICE = 1 << 20


@lru_cache(1)
def _lower_letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, space for all others."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order, the bucket of each n-gram and the text it stands in, in text order.

    A text is framed by spaces and gives at least one n-gram per order; n-grams never
    cross texts. Texts without a letter are framed spaces only.
    """
    joined = " \x00 ".join(pc.fill_null(texts, "").to_pylist())
    points = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.asarray([0 if n is None else n for n in pc.utf8_length(pc.fill_null(texts, "")).to_pylist()], np.int64)
    # each text is framed by two spaces and followed by the separator, but for the last
    owner = np.repeat(np.arange(len(texts)), lengths + 3)[: len(points)]
    points = _lower_letters()[points]
    keep = np.r_[True, (points[1:] != 32) | (points[:-1] != 32) | (owner[1:] != owner[:-1])]
    points, owner = points[keep], owner[keep]
    mixed = np.zeros(len(points), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            return
        size = len(points) - n + 1
        mixed = mixed[:size] * np.uint32(0x01000193) + points[n - 1:] * np.uint32(0x9E3779B1)
        h = mixed ^ (mixed >> np.uint32(15))
        h = (h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(7)
        inside = owner[:size] == owner[n - 1:]
        yield (h % np.uint32(buckets)).astype(np.int64)[inside], owner[:size][inside]


def _counter(languages: list[str], buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.array(languages, pa.string())
        totals = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lang = pc.index_in(part.column(1).cast(pa.string()), place).to_numpy(zero_copy_only=False).astype(np.int64)
                for bucket, owner in grams(part.column(0).cast(pa.string()), buckets):
                    totals += np.bincount(lang[owner] * buckets + bucket, minlength=totals.size).reshape(totals.shape)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // buckets, pa.int32()), pa.array(at % buckets, pa.int32()), pa.array(totals.ravel()[at])], names=["lang", "bucket", "n"])

    return count


class Model:
    """Log-probabilities: ``table`` (languages x buckets) and ``prior``."""

    def __init__(self, languages: list[str], table: np.ndarray, prior: np.ndarray):
        self.languages, self.table, self.prior = languages, table, prior


def fit(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model:
    """Learn from all rows of ``docs`` with a text and a language.

    The matrix must stay under ``MODEL_BYTES``; more languages than that raise an error.
    Without such rows the model knows no language.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    limit = MODEL_BYTES // (8 * buckets)
    seen = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(limit + 1).collect()
    if len(seen) > limit:
        raise ValueError(f"more than {limit} languages: take fewer buckets or a larger MODEL_BYTES")
    languages = [r["lang"] for r in seen]
    if not languages:
        return Model([], np.zeros((0, buckets)), np.zeros(0))
    counts = known.mapInArrow(_counter(languages, buckets), "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), buckets), smoothing)
    table[counts["lang"].to_numpy(), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    prior = np.array([r["n"] for r in seen], np.float64)
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)), np.log(prior / prior.sum()))


def _posterior(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log of prior times likelihood (languages x texts), and which texts have a letter."""
    total = np.repeat(model.prior[:, None], len(texts), axis=1)
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    buckets = model.table.shape[1]
    for bucket, owner in grams(texts, buckets) if len(model.languages) else ():
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        for row, logs in zip(total, model.table, strict=True):
            if len(firsts):
                row[owner[firsts]] += np.add.reduceat(logs[bucket], firsts)
    return total, lettered


def _scorer(broadcast, buckets: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        names = np.array([*model.languages, UNDEFINED], object)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column(1).cast(pa.string())
                total, lettered = _posterior(model, texts)
                if len(names) > 1:
                    best = np.where(lettered, total.argmax(axis=0), len(names) - 1)
                    top = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
                else:
                    best, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best], pa.string()), pa.array(np.where(best < len(names) - 1, top, 0.0)), *[part.column(i) for i in range(2, part.num_columns)]],
                    names=["doc_id", "lang_pred", "score", *part.schema.names[2:]])

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text).

    ``score`` is the posterior of the language. Null texts and texts without a letter
    are ``und`` with score 0, as is every text where no language was learned. Ties go
    to the language first in order. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared, model.table.shape[1]), "doc_id bigint, lang_pred string, score double")


def held_out(mod: int = 4, rest: int = 2) -> Column:
    return F.pmod(crc("doc_id"), F.lit(mod)) == rest


def identify(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` where ``train`` holds (all by default) and predict all rows."""
    return predict(docs, fit(docs if train is None else docs.where(train)))


def identified(docs: DataFrame, train: Column | None = None, wanted: Sequence[str] | None = None, least: float = 0.0, label: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is one of ``wanted`` (all learned ones by default).

    Columns are unchanged, but the one named ``label`` gets the predicted language where one
    was learned; what reads it afterwards goes by the text instead of a missing or wrong mark.

    A row stays if the posterior of the wanted languages together is above one half and the
    predicted one's is at least ``least``. Rows whose text is null or has no letter go. Where
    no language was learned, there is no posterior: every text with a letter stays, unless
    languages are asked for. The decision depends on the text alone, so it is taken where
    the row is read.
    """
    model = fit(docs if train is None else docs.where(train))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = np.array([wanted is None or name in wanted for name in model.languages], bool)
    names = np.array(model.languages, object)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept, told = [], []
            for part in slices(batch, "text", SLICE):
                texts = part.column(at).cast(pa.string())
                logs, lettered = _posterior(shared.value, texts)
                if len(taken):
                    shares = np.exp(logs - logs.max(axis=0))
                    shares /= shares.sum(axis=0)
                    lettered &= (shares[taken].sum(axis=0) > 0.5) & (shares.max(axis=0) >= least)
                    told.append(np.flatnonzero(taken)[logs[taken].argmax(axis=0)] if taken.any() else np.zeros(len(texts), np.int64))
                elif wanted is not None:
                    lettered &= False
                kept.append(lettered)
            if label is not None and told:
                where = batch.schema.get_field_index(label)
                batch = batch.set_column(where, batch.schema.field(where), pa.array(names[np.concatenate(told)], pa.string()).cast(batch.schema.field(where).type))
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(keep, docs.schema)
