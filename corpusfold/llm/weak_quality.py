"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Only the number of documents with each
pattern of votes is needed to estimate, by expectation-maximisation, how often a labeller gives each vote
on good and on bad documents; the table of patterns has 3 ** labellers rows at most. The posterior of its
pattern is a document's label. A linear scorer over hashed features (shapes of words, repetition nearby,
symbols) learns the posteriors of at most ``max_rows`` documents, those with the smallest hash of their
id, and then scores every text in one pass without a shuffle. No human label is used.

Defined results: null and empty texts get votes and a score like any other (they are short); repeated rows
count as often as they occur and get equal scores; without documents every score is one half; extra
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.columns import words
from corpusfold.llm.quality_rules import measure
from corpusfold.llm.wordbytes import finish, find_words, hash_words, over_pieces
from corpusfold.session import ship_package, stage


@dataclass(frozen=True)
class QualityOptions:
    buckets: int = 1 << 14
    max_rows: int = 20_000
    epochs: int = 30
    batch: int = 256
    rate: float = 0.5
    decay: float = 1e-5
    threshold: float = 0.5


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, "b").when(good, "g").otherwise("-")


def signs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measures of the quality rules, and words without odd characters, letters, different and doubled words."""
    body = F.coalesce(F.col(text), F.lit(""))
    more = docs.select(
        "*",
        F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}+[.,]?(?![^\x20\x09-\x0D])")).cast("long").alias("n_clean"),
        F.length(F.regexp_replace(body, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct(words(F.col(text)))).cast("long").alias("n_distinct"),
        F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?:[\x20\x09-\x0D]|$))")).cast("long").alias("n_doubled"),
    )
    return measure(more, text)


def votes() -> Column:
    """One letter a labeller, from the signs of a text; every kind of defect is seen by more than one of them."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return F.concat(
        _vote(100 * F.col("n_symbols") <= chars, 20 * F.col("n_symbols") > chars),
        _vote(10 * F.col("n_clean") >= 9 * n, 10 * F.col("n_clean") < 6 * n),
        _vote(100 * F.col("n_letters") >= 95 * chars, 100 * F.col("n_letters") < 85 * chars),
        _vote(10 * F.col("n_capitals") <= chars, 2 * F.col("n_capitals") > chars),
        _vote(20 * F.col("n_repeat_words") <= n, 3 * F.col("n_repeat_words") > n),
        _vote(10 * F.col("n_distinct") >= 6 * n, 10 * F.col("n_distinct") < 3 * n),
        _vote(50 * F.col("n_doubled") <= n, 4 * F.col("n_doubled") > n),
        _vote((chars >= 3 * n) & (chars <= 9 * n), (chars > 14 * n) | (chars < 2 * n)),
    )


LETTERS = "bg-"


def em(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for every pattern, each labeller's shares of votes by class (labeller, class, letter), and the prior."""
    letters = np.array([[LETTERS.index(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), -1)
    labellers = letters.shape[1]
    seen = np.eye(len(LETTERS))[letters]
    # most votes decide at the start
    lean = (letters == 1).sum(axis=1) - 2 * (letters == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-lean.astype(float)))
    shares, prior = np.zeros((labellers, 2, len(LETTERS))), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        shares = np.einsum("cp,pjl->jcl", weight, seen) + 0.5
        shares /= shares.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("pjl,jcl->pc", seen, np.log(shares)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved, good = np.abs(new - good).max(initial=0), new
        if moved < 1e-9:
            break
    return good, shares, prior


_CLASS = np.full(256, 97, dtype=np.uint64)  # letters, and all beyond ASCII
_CLASS[:128] = np.arange(128)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 48, 65, 97


def features(texts: pa.Array, options: QualityOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of every text, and where each text's begin: the root of a feature's share of the words."""
    found = find_words(texts)
    row, n = found.rows(), len(found.begin)
    length = found.end - found.begin
    shape = _CLASS[found.data[found.begin]] if n else np.zeros(0, np.uint64)
    for back in (1, 2, 3):
        place = np.maximum(found.end - back, found.begin)
        shape = (shape << np.uint64(8)) | (_CLASS[found.data[place]] if n else shape)
    size = np.minimum(np.log2(length, where=length > 0, out=np.zeros(n)).astype(np.uint64), np.uint64(7))
    h = hash_words(found)
    nearby = np.zeros(n, dtype=np.uint64)
    for gap in range(1, 9):
        same = np.zeros(n, dtype=bool)
        same[gap:] = (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap]) if n > gap else False
        nearby[same & (nearby == 0)] = gap
    kinds = [finish(shape * np.uint64(8) + np.uint64(1)), finish(size * np.uint64(8) + np.uint64(2)), finish(nearby * np.uint64(8) + np.uint64(3))]
    total = np.maximum(1, found.counts)
    rows = [row] * 3
    # one feature for the order of magnitude of the length
    rows.append(np.arange(len(total)))
    kinds.append(finish(np.log2(found.counts + 1).astype(np.uint64) * np.uint64(8) + np.uint64(4)))
    flat, owner = np.concatenate(kinds) % np.uint64(options.buckets), np.concatenate(rows)
    pair, count = np.unique(owner * options.buckets + flat.astype(np.int64), return_counts=True)
    owner = pair // options.buckets
    return (pair % options.buckets).astype(np.int32), np.sqrt(np.minimum(1, count / total[owner])), np.searchsorted(owner, np.arange(len(total) + 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, options: QualityOptions) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors."""
    weight, intercept = np.zeros(options.buckets), 0.0
    squares, square = np.full(options.buckets, 1e-6), 1e-6
    rng = np.random.default_rng(0)
    for _ in range(options.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), options.batch):
            chosen = order[at : at + options.batch]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            z = intercept + np.bincount(owner, weight[index] * value, len(chosen))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[chosen]) / len(chosen)
            g = np.bincount(index, error[owner] * value, options.buckets) + options.decay * weight
            squares += g * g
            weight -= options.rate * g / np.sqrt(squares)
            square += error.sum() ** 2
            intercept -= options.rate * error.sum() / np.sqrt(square)
    return weight, intercept


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", options: QualityOptions = QualityOptions()) -> tuple[np.ndarray, float]:
    """Weights and intercept of the scorer."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    voted = stage(signs(rows).select("doc_id", votes().alias("pattern")), "votes")
    table = sorted((r["pattern"], r["c"]) for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("c")).collect())
    if not table:
        return np.zeros(options.buckets), 0.0
    patterns = [p for p, _ in table]
    good, _, _ = em(patterns, np.array([c for _, c in table], dtype=float))
    posterior = spark.createDataFrame(pd.DataFrame({"pattern": patterns, "good": good}))
    chosen = (
        voted.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.first("pattern").alias("pattern"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.max_rows).join(F.broadcast(posterior), "pattern").select("doc_id", "good")
    )

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        index, value, first = features(piece.column("text"), options)
        at = pa.array(first.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("good"), pa.ListArray.from_arrays(at, pa.array(index)), pa.ListArray.from_arrays(at, pa.array(value))],
            ["doc_id", "good", "f", "v"],
        )

    sample = stage(
        rows.join(F.broadcast(chosen), "doc_id").mapInArrow(over_pieces(make, "text"), "doc_id long, good double, f array<int>, v array<double>"),
        "quality-sample",
    )

    def fit_all(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        weight, intercept = fit([(np.asarray(f), np.asarray(v)) for f, v in zip(part["f"], part["v"])], part["good"].to_numpy(), options)
        return pd.DataFrame({"weight": [weight], "intercept": [intercept]})

    made = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit_all, "weight array<double>, intercept double").collect()
    return (np.array(made[0]["weight"]), made[0]["intercept"]) if made else (np.zeros(options.buckets), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, id: str = "doc_id", text: str = "text", options: QualityOptions = QualityOptions()) -> DataFrame:
    """doc_id, quality (a probability) and kept for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        weight, intercept = shared.value
        index, value, first = features(piece.column("text"), options)
        z = intercept + np.diff(np.concatenate([[0.0], np.cumsum(weight[index] * value)])[first])
        quality = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(quality), pa.array(quality >= options.threshold)], ["doc_id", "quality", "kept"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(over_pieces(make, "text"), "doc_id long, quality double, kept boolean")
