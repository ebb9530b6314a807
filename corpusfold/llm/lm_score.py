"""Language-model scoring of whole texts with a causal self-attention model over subword ids.

Texts are read once: their subword ids are staged, and all else reads these. The ids of a word begin with the space
before it and spell it, so they tell words apart.

What is gathered from the corpus covers all training documents: the counts of every word and of every subword
id, which say how likely an id is within its class, and the neighbours of every id,
which give the classes. The attention model, which predicts classes, is trained on every id of every
training document. These are staged in as many parts as there are rounds. In a round each task takes
Adam's steps over its share of a part, and the changes that the tasks make are averaged in blocks of
parameters, so the driver receives one set of parameters a round. A corpus with fewer ids than ``steps``
batches is read several times.

Texts are scored in overlapping windows: every id is predicted once, all windows of a batch together. What the model
gives to the ids of a word is the word's probability in its context. It is mixed with the word's share of all training
tokens, which knows words that the corpus repeats: p = w * context + (1 - w) * share. The weight is that of ``mixes`` under
which all training texts, each word left out of its own count, are most likely. The base score needs the count of every word of every text. The counts of the most frequent words
(at most ``frequent_limit``) are broadcast; the other words of a text are joined
with their counts, and none of these can be hot.

Defined results: a null or empty text is its end alone; repeated rows get equal scores and, in training,
count as often as they occur; a null id is not held out and is trained on; without training documents
every count is zero and the model gives classes equal chances. Other columns are not looked at. Which texts a task
trains on follows from the layout of the table, and so do the last digits of a score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.llm import attention
from corpusfold.llm.packing import Encoder, find
from corpusfold.llm.wordbytes import M1, M3, Words, find_words, finish, hash_words, pieces
from corpusfold.session import ship_package, stage


#: Rows of parameters that are averaged together, and steps that a task takes in a round at least, given the texts.
BLOCK, TASK_STEPS = 1024, 30
#: Changes of so many tasks meet at first.
TEAM = 64
#: Ids that are looked at together, and those that a task reads when there are enough for all cores.
PIECE_IDS, TASK_IDS = 1 << 19, 1 << 23
#: Counts of words of some pieces that a task adds up before it sends them on.
WAITING = 1 << 20


@dataclass(frozen=True)
class ScoreOptions:
    vocabulary: str  #: path of a tokenizer file, on every machine
    size: int = 50_257
    end: int = 50_256  #: an id that no word gives
    mixes: tuple[float, ...] = (0.05, 0.15, 0.3, 0.5)  #: weights of the context to choose from
    frequent_limit: int = 1 << 19
    model: attention.ModelOptions = field(default_factory=attention.ModelOptions)


def held_out(id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(False))


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first place of every distinct word, as they come, and which one each word is."""
    which, keys = pd.factorize(hash_words(words))
    return keys, np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)), which


@functools.lru_cache(1)
def _encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a process, as it remembers words."""
    return Encoder(vocabulary)


def _encoded(encoder: Encoder, words: Words, end: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each closed with ``end``, and where each text's begin; ``found`` is their ``_distinct``."""
    ids, size = encoder.of(words, " ", found)
    at = np.concatenate([[0], np.cumsum(size)])
    first = at[words.first]
    first = first + np.arange(len(first))
    out = np.full(first[-1], end, dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    inside[first[1:] - 1] = False
    out[inside] = ids
    return out, first


def _id_type(options: ScoreOptions) -> str:
    return "<u2" if options.size <= 1 << 16 else "<u4"


def _staged_ids(options: ScoreOptions):
    def run(batches):
        encoder = _encoder(options.vocabulary)
        kind, rounds = np.dtype(_id_type(options)), options.model.rounds
        row = TaskContext.get().partitionId()
        for piece in pieces(batches, "text"):
            words = find_words(piece.column("text"), lower=True)
            flat, first = _encoded(encoder, words, options.end, _distinct(words))
            data = pa.py_buffer(flat.astype(kind))
            ids = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer((first * kind.itemsize).astype(np.int32)), data])
            # training texts are dealt to the rounds, the others are a part of their own
            trains = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            part = np.where(trains, (row + np.cumsum(trains) - trains) % rounds, rounds)
            row += int(trains.sum())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), ids, pa.array(np.diff(first)), pa.array(part.astype(np.int32))],
                ["doc_id", "held_out", "ids", "n", "part"],
            )

    return run


def _sequences(batches: Iterable[pa.RecordBatch], options: ScoreOptions) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with about ``PIECE_IDS`` ids, one row at least, these ids in a row, and where each text's begin."""
    kind = np.dtype(_id_type(options))
    for batch in batches:
        ids = batch.column("ids").cast(pa.large_binary())
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        start = 0
        while start < len(ids):
            stop = int(np.searchsorted(at, at[start] + PIECE_IDS * kind.itemsize, side="right")) - 1
            stop = min(max(stop, start + 1), len(ids))
            flat = np.frombuffer(data, dtype=np.uint8)[at[start] : at[stop]].view(kind).astype(np.int32)
            yield batch.slice(start, stop - start), flat, (at[start : stop + 1] - at[start]) // kind.itemsize
            start = stop


def _word_runs(flat: np.ndarray, leads: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word's ids begin and where they stop, and a hash of them; ids that are in ``leads`` begin words, ``end`` closes texts."""
    cuts = leads.copy()
    cuts[end] = True
    begin = np.flatnonzero(cuts[flat])
    stop = np.append(begin[1:], len(flat))[: len(begin)]
    place = np.arange(len(flat)) - np.repeat(begin, stop - begin)
    # a sum of products of 64 bits, one factor by the id and an odd one by its place in the word
    factor = finish(np.arange(1, int(place.max(initial=0)) + 2, dtype=np.uint64) * M3) | np.uint64(1)
    value = finish(np.arange(1, len(leads) + 1, dtype=np.uint64) * M1).take(flat)
    value *= factor.take(place)
    keys = np.add.reduceat(value, begin) if len(begin) else np.zeros(0, np.uint64)
    word = leads[flat[begin]]
    return begin[word], stop[word], finish(keys)[word]


def _leads(options: ScoreOptions) -> np.ndarray:
    """Which ids begin a word."""
    known = Encoder(options.vocabulary).leads[: options.size]
    return np.concatenate([known, np.zeros(options.size - len(known), dtype=bool)])


def _counts(options: ScoreOptions, leads: np.ndarray):
    """How often words, by their hashes, and ids occur."""

    def made(is_id: bool, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), is_id)), pa.array(key), pa.array(c)], ["is_id", "key", "c"])

    def run(batches):
        _encoder.cache_clear()  # no later stage needs it
        total = np.zeros(options.size, dtype=np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> pa.RecordBatch:
            which, keys = pd.factorize(np.concatenate([k for k, _ in waiting]))
            count = np.bincount(which, np.concatenate([c for _, c in waiting]), len(keys))
            waiting.clear()
            return made(False, keys.view(np.int64), count.astype(np.int64))

        for _, flat, _ in _sequences(batches, options):
            total += np.bincount(flat, minlength=options.size)
            which, keys = pd.factorize(_word_runs(flat, leads, options.end)[2])
            waiting.append((keys, np.bincount(which, minlength=len(keys))))
            if sum(len(k) for k, _ in waiting) > WAITING:
                yield added()
        if waiting:
            yield added()
        yield made(True, (seen := np.flatnonzero(total)), total[seen])

    return run


def _in_tasks(ids: DataFrame, total: int) -> DataFrame:
    """Rows with so many ids in no more tasks than these need: what a task knows costs memory and time."""
    return ids.coalesce(max(1, total // TASK_IDS, ids.sparkSession.sparkContext.defaultParallelism))


def _texts(batches, options: ScoreOptions):
    """The ids of the texts of every batch in a row."""
    kind = np.dtype(_id_type(options))
    for batch in batches:
        ids = batch.column("ids").cast(pa.large_binary())
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        if len(ids) and at[-1] > at[0]:
            yield np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind).astype(np.int32)


def _neighbours(shared, options: ScoreOptions):
    def run(batches):
        place, rank = attention.clustered(shared.value, options.model)
        for pairs, times in attention.neighbours(_texts(batches, options), place, rank, options.end, options.model):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "c"])

    return run


def _learn(shared, options: ScoreOptions, turn: int, repeats: int):
    def run(batches):
        p = attention.load(shared.value)
        change, weight = attention.learn(p, _texts(batches, options), options.end, options.model, turn, TaskContext.get().partitionId(), repeats)
        for block, at in enumerate(range(0, len(weight), BLOCK)):
            w = weight[at : at + BLOCK]
            if w.any():
                team = TaskContext.get().partitionId() // TEAM
                made = [pa.array([n], pa.int32()) for n in (block, team)] + [pa.array([change[at : at + BLOCK].tobytes()]), pa.array([w.tobytes()])]
                yield pa.RecordBatch.from_arrays(made, ["block", "team", "change", "weight"])

    return run


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """The changes of a block by some tasks as one; their order, and with it rounding, is fixed by their bytes."""
    part = part.sort_values(["weight", "change"])
    change, weight = 0.0, 0.0
    for c, w in zip(part["change"], part["weight"]):
        w = np.frombuffer(w)[:, None]
        change, weight = change + np.frombuffer(c, dtype=np.float32).reshape(len(w), -1) * w, weight + w
    mean = (change / np.maximum(weight, 1)).astype(np.float32)
    return pd.DataFrame({"block": part["block"].iloc[:1], "change": [mean.tobytes()], "weight": [weight.tobytes()]})


def averaged(made: DataFrame) -> DataFrame:
    """The mean change of every block: of groups of tasks first, so that no group grows with the number of tasks."""
    sums = "block int, change binary, weight binary"
    return made.groupBy("block", "team").applyInPandas(_summed, sums).groupBy("block").applyInPandas(_summed, sums)


def train(ids: DataFrame, total: int, of_id: np.ndarray, options: ScoreOptions) -> dict[str, np.ndarray]:
    """The attention model of the staged ``ids`` of all training rows, ``total`` ids that occur as ``of_id`` says."""
    spark = ids.sparkSession
    o = options.model
    met = (
        _in_tasks(ids.select("ids"), total).mapInArrow(_neighbours(spark.sparkContext.broadcast(of_id), options), "pair long, c long")
        .groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    )
    p = attention.begun(of_id, met.column("pair").to_numpy(), met.column("c").to_numpy(), o)
    share, repeats = attention.schedule(total, o)
    # a task with few ids takes too few steps to get anywhere
    tasks = max(1, total * share // o.rounds // (TASK_STEPS * o.batch * o.window))
    for turn in range(o.rounds):
        part = ids.where(F.col("part").isin([(turn * share + k) % o.rounds for k in range(share)])).select("ids").coalesce(tasks)
        known = spark.sparkContext.broadcast(attention.save(p))
        made = averaged(part.mapInArrow(_learn(known, options, turn, repeats), "block int, team int, change binary, weight binary"))
        made = made.select("block", "change").toArrow()
        change = np.zeros_like(attention.as_rows(p))
        for block, mean in zip(made.column("block").to_pylist(), made.column("change").to_pylist()):
            mean = np.frombuffer(mean, dtype=np.float32).reshape(-1, change.shape[1])
            change[block * BLOCK : block * BLOCK + len(mean)] = mean
        p = attention.moved(p, change)
        known.unpersist()
    return p


@dataclass(frozen=True)
class Shared:
    """What every scoring task knows: the model, and hash and count of the frequent words, those of a ``level`` at least."""

    parameters: bytes
    share: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    level: int

    def log10(self, count: np.ndarray, less: int = 0) -> np.ndarray:
        """Of words with so many occurrences, ``less`` of which do not count."""
        return np.log10(np.maximum(count - less, 0) + 0.5) - np.log10(max(self.tokens - less, 0) + 0.5 * (self.distinct + 1))


def _mixed(row: np.ndarray, p: np.ndarray, share: np.ndarray, n: int, mixes: tuple[float, ...]) -> np.ndarray:
    """Sums by row of the log10 of probabilities ``p`` mixed with the ``share`` by each weight, a column for each."""
    return np.stack([np.bincount(row, np.log(w * p + (1 - w) * share), n) for w in mixes], axis=1) / np.log(10)


def _score(shared, options: ScoreOptions, leads: np.ndarray):
    def run(batches):
        known: Shared = shared.value
        parameters = attention.load(known.parameters)
        row_id = TaskContext.get().partitionId() << 40
        for piece, flat, first in _sequences(batches, options):
            n = piece.num_rows
            places = attention.log10_places(parameters, known.share, flat, first, options.end, options.model)
            begin, stop, keys = _word_runs(flat, leads, options.end)
            which, keys = pd.factorize(keys)
            at = np.searchsorted(begin, first)
            words = np.diff(at)
            row = np.repeat(np.arange(n), words)
            total = np.concatenate([[0.0], np.cumsum(places)])
            context = total[stop] - total[begin]
            at = np.minimum(find(known.hashes, keys), max(0, len(known.hashes) - 1))
            frequent = known.hashes[at] == keys if len(known.hashes) else np.zeros(len(keys), dtype=bool)
            count = known.counts[at] if len(known.hashes) else np.zeros(len(keys))
            hit = frequent[which]
            # what depends on the count alone is computed once a distinct word; the end is a word of its own
            one = which[hit]
            base = np.bincount(row[hit], known.log10(count)[one], n) + known.log10(np.float64(known.ends))
            n_known = np.bincount(row[hit], minlength=n) + (known.ends > 0)
            p, rows = np.exp(np.concatenate([context[hit], places[first[1:] - 1]]) * np.log(10)), np.concatenate([row[hit], np.arange(n)])
            count, one = np.append(count, known.ends), np.concatenate([one, np.full(n, len(count))])
            scores, left_out = (_mixed(rows, p, (10.0 ** known.log10(count, less))[one], n, options.mixes) for less in (0, 1))
            offsets = pa.array(np.searchsorted(row[~hit], np.arange(n + 1)).astype(np.int32))

            def lists(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(options.mixes)), pa.array(values.ravel()))

            yield pa.RecordBatch.from_arrays([
                pa.array(row_id + np.arange(n)), piece.column("doc_id"), piece.column("held_out"), pa.array(words + 1), pa.array(n_known.astype(np.int64)),
                pa.array(base), lists(scores), lists(left_out),
                pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                    [pa.array(keys[which[~hit]].view(np.int64)), pa.array(np.exp(context[~hit] * np.log(10)).astype(np.float32))], ["hash", "context"]
                )),
            ], ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "left_out", "words"])
            row_id += n

    return run


def _level() -> Column:
    """Of a count: levels are few, and eight of them double it."""
    return F.floor(F.log2("c") * 8)


def gather(rows: DataFrame, options: ScoreOptions, leads: np.ndarray | None = None) -> tuple[DataFrame, Shared, DataFrame]:
    """The count of every word of the training rows by its hash, what the scoring tasks share, and the staged ids of all rows."""
    leads = _leads(options) if leads is None else leads
    ids = stage(rows.mapInArrow(_staged_ids(options), "doc_id long, held_out boolean, ids binary, n long, part int"), "lm-ids", partition_by="part")
    training = ids.where("NOT held_out")
    ends, read = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    made = _in_tasks(training.select("ids"), read).mapInArrow(_counts(options, leads), "is_id boolean, key long, c long")
    found = stage(made.groupBy("is_id", "key").agg(F.sum("c").alias("c")), "words")
    counts = found.where("NOT is_id").select(F.col("key").alias("hash"), "c")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens = (total or 0) + ends
    seen = found.where("is_id").select("key", "c").toArrow()
    of_id = np.zeros(options.size)
    of_id[seen.column("key").to_numpy()] = seen.column("c").to_numpy()

    parameters = attention.save(train(training, read, of_id, options) if ends else attention.untrained(options.size, options.model))
    # as many of the highest levels as have no more than frequent_limit words
    level, room = 1 << 20, options.frequent_limit
    for r in sorted(counts.groupBy(_level().alias("level")).count().collect(), reverse=True):
        room -= r[1]
        if room < 0:
            break
        level = r[0]
    often = counts.where(_level() >= level).toArrow()
    hashes = often.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known = Shared(
        parameters, attention.within(of_id, attention.load(parameters)["classes"]), hashes[order], often.column("c").to_numpy()[order],
        tokens, distinct + (ends > 0), ends, level,
    )
    return counts, known, ids


def score_texts(docs: DataFrame, options: ScoreOptions, *, id: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), (held_out(id) if held is None else held).alias("held_out"))
    leads = _leads(options)
    counts, known, ids = gather(rows, options, leads)
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = stage(
        _in_tasks(ids.select("doc_id", "held_out", "ids"), total).mapInArrow(
            _score(spark.sparkContext.broadcast(known), options, leads),
            "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>, "
            "words array<struct<hash: long, context: float>>",
        ),
        "scored",
    )
    # every word comes once here, so a hash table of a part of these stays small, and the occurrences need no sorting
    rare = counts.where(_level() < known.level).hint("shuffle_hash")
    count, context = F.col("c"), F.col("context").cast("double")

    def share(less: int) -> Column:
        return (F.greatest(count - less, F.lit(0)) + 0.5) / (max(known.tokens - less, 0) + 0.5 * (known.distinct + 1))

    ten = float(np.log(10))
    sums = [(F.sum(F.ln(share(0))) / ten).alias("more"), F.count_if(count > 0).alias("more_known")]
    for name, less in (("scores", 0), ("left_out", 1)):
        sums.append(F.array(*[F.sum(F.ln(w * context + (1 - w) * share(less))) / ten for w in options.mixes]).alias(f"more_{name}"))
    # the words of a text meet again as narrow rows; sums of parts would be wider than what they sum
    met = (
        scored.select("row_id", F.inline("words")).join(rare, "hash", "left")
        .select("row_id", "context", F.coalesce("c", F.lit(0)).alias("c")).repartition("row_id")
    )
    more = met.groupBy("row_id").agg(*sums)

    def with_more(name: str) -> Column:
        return F.zip_with(name, F.coalesce(f"more_{name}", F.transform(name, lambda _: F.lit(0.0))), lambda a, b: a + b).alias(name)

    found = stage(
        scored.join(more, "row_id", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), with_more("scores"), with_more("left_out"),
        ),
        "mixed",
    )
    totals = found.where("NOT held_out").agg(*[F.sum(F.get("left_out", k)).alias(f"_{k}") for k in range(len(options.mixes))]).first()
    best = max(range(len(options.mixes)), key=lambda k: -np.inf if totals[k] is None else totals[k])
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", F.get("scores", best).alias("score"),
    )
