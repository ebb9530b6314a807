"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams inside the words of a text (with marks at word ends), hashed to buckets; a text
has a bucket or not. On the training texts every bucket gets the logarithm of the ratio between its
smoothed shares in toxic and in other texts. Buckets whose log odds are within their error are dropped;
logistic regression on the others, scaled by their ratios, gives the weights. Weights that stay small are
dropped too and the rest is fitted again, so scoring touches few buckets.

Training uses at most ``max_rows`` labelled texts, those with the smallest hash of their id; one task
fits them. Scoring needs no shuffle, and the model is ``buckets`` numbers at most.

Defined results: a null or empty text has no features and gets the score of the intercept; repeated rows
get repeated scores; several labels of one document count as their maximum; null labels do not count;
labels of one class only, or none, give the smoothed share of that class as every score. Other columns,
labels included, are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.llm.wordbytes import finish, find_words, hash_words, over_pieces
from corpusfold.session import ship_package, stage


@dataclass(frozen=True)
class ToxicityOptions:
    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 18
    max_rows: int = 12_000
    smoothing: float = 1.0
    epochs: int = 12
    batch: int = 128
    rate: float = 0.3
    sure: float = 3.0  #: standard errors that the log odds of a bucket must be away from zero
    least: float = 0.05  #: smaller effects of a bucket are dropped
    decay: float = 1e-5
    piece: int = 1 << 19  #: bytes of text whose n-grams are in memory at once


@dataclass(frozen=True)
class Model:
    """Effects of the kept buckets (sorted), and the intercept."""

    buckets: np.ndarray
    effects: np.ndarray
    intercept: float


def word_grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray, options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the given words, and where each word's buckets begin."""
    length = end - begin + 2
    first = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(len(begin)), length)
    inside = np.arange(first[-1]) - first[owner]
    text = np.where(inside == 0, 1, 2).astype(np.uint64)  # marks at both ends
    middle = (inside > 0) & (inside < length[owner] - 1)
    text[middle] = data[begin[owner[middle]] + inside[middle] - 1]
    owners, found = [], []
    for n in options.sizes:
        if len(text) < n:
            continue
        size = len(text) - n + 1
        value = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | text[k : k + size]
        ok = inside[:size] + n <= length[owner[:size]]
        owners.append(owner[:size][ok])
        found.append((finish(value[ok]) % np.uint64(options.buckets)).astype(np.int32))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(len(begin) + 1, np.int64)
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(begin)))])


def features(texts: pa.Array, options: ToxicityOptions, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of every text (those in ``only``, if given), and where each text's begin."""
    words = find_words(texts, lower=True)
    _, one, which = np.unique(hash_words(words), return_index=True, return_inverse=True)
    grams, first = word_grams(words.data, words.begin[one], words.end[one], options)
    if only is not None:
        keep = only[grams]
        grams, first = grams[keep], np.concatenate([[0], np.cumsum(keep)])[first]
    count = np.diff(first)[which]
    row = np.repeat(words.rows(), count)
    start = np.repeat(first[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(which) else np.zeros(0, np.int64)
    pair = np.unique(row * options.buckets + grams[start + np.arange(len(row))])
    return (pair % options.buckets).astype(np.int32), np.searchsorted(pair // options.buckets, np.arange(len(words.first)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[first])


def fit(rows: list[np.ndarray], labels: np.ndarray, options: ToxicityOptions) -> Model:
    none = Model(np.zeros(0, np.int32), np.zeros(0), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))))
    if labels.min(initial=1) == labels.max(initial=0):
        return none
    count = np.array([labels.sum(), len(labels) - labels.sum()])
    # row by row, since the buckets of a row are distinct: all rows in one array would take several times their memory
    held = np.zeros((2, options.buckets))
    for row, y in zip(rows, labels.tolist()):
        held[0 if y else 1, row] += 1
    share = (held + options.smoothing) / (count[:, None] + 2 * options.smoothing)
    ratio = np.log(share[0]) - np.log(share[1])
    # the error of the log odds tells which buckets are more than chance
    odds = np.log(share[0] / (1 - share[0])) - np.log(share[1] / (1 - share[1]))
    error = np.sqrt((1 / (held + 0.5) + 1 / (count[:, None] - held + 0.5)).sum(axis=0))
    keep = np.abs(odds) >= options.sure * error
    weight, intercept = np.zeros(options.buckets), none.intercept
    rng = np.random.default_rng(0)
    for _ in range(2):
        squares, square = np.full(options.buckets, 1e-6), 1e-6
        for _ in range(options.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), options.batch):
                chosen = order[at : at + options.batch]
                part = [rows[i][keep[rows[i]]] for i in chosen]
                index = np.concatenate(part)
                sizes = np.array([len(p) for p in part])
                z = intercept + _sums(weight[index] * ratio[index], np.concatenate([[0], np.cumsum(sizes)]))
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]
                touched, where = np.unique(index, return_inverse=True)
                g = np.bincount(where, np.repeat(error, sizes), len(touched)) * ratio[touched] / len(chosen) + options.decay * weight[touched]
                squares[touched] += g * g
                weight[touched] -= options.rate * g / np.sqrt(squares[touched])
                g0 = error.mean()
                square += g0 * g0
                intercept -= options.rate * g0 / np.sqrt(square)
        keep &= np.abs(weight * ratio) >= options.least
    kept = np.flatnonzero(keep)
    return Model(kept.astype(np.int32), (weight * ratio)[kept], float(intercept))


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", options: ToxicityOptions = ToxicityOptions()) -> Model:
    """Fits on the labelled ones of ``docs`` (``max_rows`` at most)."""
    ship_package(docs.sparkSession)
    chosen = (
        labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(options.max_rows)
    )

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        flat, first = features(piece.column("text"), options)
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), lists], ["id", "y", "f"])

    # max_rows rows: small whatever the tables hold
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(
        F.broadcast(chosen.select(F.col("_id").alias("id"), F.col("_y").alias("y"))), "id"
    )
    sample = stage(rows.mapInArrow(over_pieces(make, "text", options.piece), "id long, y int, f array<int>"), "toxicity-sample")

    def fit_all(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        made = fit([np.asarray(f, dtype=np.int32) for f in part["f"]], part["y"].to_numpy(dtype=float), options)
        return pd.DataFrame({"buckets": [made.buckets], "effects": [made.effects], "intercept": [made.intercept]})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit_all, "buckets array<int>, effects array<double>, intercept double").collect()
    if not found:
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    return Model(np.array(found[0]["buckets"], np.int32), np.array(found[0]["effects"]), found[0]["intercept"])


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "toxicity", options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """All columns of ``docs`` and ``name``, a probability; a column of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        effects = np.zeros(options.buckets)
        effects[shared.value.buckets] = shared.value.effects
        only = np.zeros(options.buckets, dtype=bool)
        only[shared.value.buckets] = True
        flat, first = features(piece.column(text), options, only)
        z = shared.value.intercept + _sums(effects[flat], first)
        return piece.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

    rest = docs.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])
    return rest.mapInArrow(over_pieces(make, text, options.piece), schema)


def held_out(id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id).cast("string")) % folds == fold
