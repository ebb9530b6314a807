"""Spelling variant grouping by PartEnum signatures.

A word is a binary vector over (letter, how often): one insertion or deletion moves it by one place, one
replacement by two, so words one edit apart are within Hamming distance two. Each letter is a part of that
vector; a signature is the vector without one choice of at most two parts. Two words within the distance share
the signature that leaves out just the parts in which they differ, and words that share none need no look.
What is left of a word stays in the order of the word, which splits the groups further and loses no pair:

same length        the letters left out become marks, since a replaced letter stays in its place
lengths L and L+1  one letter, or none, is left out, and the longer length belongs to the signature

Words meet in an equi-join on signatures and are verified by their edit distance. A pair counts where the parts
left out on both sides are its differing letters alone, which holds for one signature of each pair: nothing
has to be made distinct afterwards. A signature has as many words as fill its marks, whatever their number of
occurrences, so no group is hot.

The form of a word is its near word of largest count, when that is ``ratio`` times its own; counts at least
double along forms, so following them ends, and pointers are doubled until none moves.

Defined results: null and empty texts have no words; a null id counts as an empty one where runs are damaged; repeated
rows all count; a table without frequent words gives no rows. Other columns are not looked at. A text of any length
is read whole; a word of d different letters has at most 1 + 3d + d(d-1)/2 signatures, d being at most 90.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.session import ship_package, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MARK = "*"  # no letter
FLUSH = 200_000


@dataclass(frozen=True)
class SpellingOptions:
    """``damage_every``: a run whose checksum it divides loses one letter; None leaves all runs as they are."""

    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    damage_every: int | None = None


def runs_of(text: str) -> Counter:
    """Runs of letters with their counts; bytes.lower changes A-Z alone."""
    return Counter(RUN.findall(text.encode().lower().decode()))


def damaged(run: str, prefix: int, every: int) -> str:
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, options: SpellingOptions) -> DataFrame:
    """word, n: words of enough letters and occurrences in all texts, staged."""
    ship_package(docs.sparkSession)
    every, shortest = options.damage_every, options.min_length

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs_of(text.as_py()).items():
                    word = run if every is None else damaged(run, prefix, every)
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    summed = found.groupBy("word").agg(F.sum("n").alias("n"))
    return stage(summed.where(F.col("n") >= options.min_count), "spelling-words")


def _translate(value: Column, letters: Column, to: str) -> Column:
    return F.call_function("translate", value, letters, F.lit(to))


def signatures(words: DataFrame) -> DataFrame:
    """sig, packed: the letters left out, the count and the word. The lowest bit of sig is 1 for words of one length.

    Rows are narrow, since a word has some forty of them, and have no column that only one side of the join reads: so
    both sides stay one plan.
    """
    word = F.col("word")
    letters = F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))
    lettered = words.select("word", "n", letters.alias("letters"))
    of = F.col("letters")
    two = F.flatten(
        F.transform(of, lambda x, i: F.transform(F.slice(of, i + 2, F.size(of)), lambda y: F.concat(x, y)))
    )

    def one(sig: Column, same: int, without: Column) -> Column:
        marked = F.shiftleft(F.shiftright(sig, 1), 1).bitwiseOR(F.lit(same))
        return F.struct(marked.alias("sig"), F.concat_ws(" ", without, F.col("n").cast("string"), word).alias("packed"))

    def masked(without: Column) -> Column:
        return one(F.xxhash64(F.lit(0), _translate(word, without, MARK * 2)), 1, without)

    def shortened(longer: Column):
        return lambda without: one(F.xxhash64(longer, _translate(word, without, "")), 0, without)

    # the longer word of a pair holds the letter that is left out; the shorter one may not
    all_of = F.concat(
        F.transform(F.concat(of, two), masked),
        F.transform(of, shortened(F.length(word))),
        F.transform(F.concat(F.array(F.lit("")), of), shortened(F.length(word) + 1)),
    )
    return lettered.select(F.explode(all_of).alias("s")).select("s.sig", "s.packed")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every word with each word one edit away, each pair once in either direction."""
    # the planner takes exploded rows for as few as the words they come from; a merge join does not rely on that. Both
    # sides are one plan, so the rows are shuffled once
    met = signatures(words).hint("merge")
    joined = met.alias("a").join(met.alias("b"), F.col("a.sig") == F.col("b.sig"))

    def part(side: str, at: int) -> Column:
        return F.substring_index(f"{side}.packed", " ", at)

    pairs = joined.select(
        F.col("a.sig").bitwiseAND(F.lit(1)).alias("same"), part("a", -1).alias("word"), part("b", -1).alias("near"),
        F.substring_index(part("b", 2), " ", -1).cast("long").alias("near_n"),
        (F.length(part("a", 1)) + F.length(_translate(part("b", 1), part("a", 1), ""))).alias("differing"),
    )
    lengths = F.length("word") - F.length("near")
    return pairs.where(
        (F.col("word") != F.col("near")) & (F.col("differing") <= 2)
        & F.when(F.col("same") == 1, lengths == 0).otherwise(F.abs(lengths) == 1)
        & (F.levenshtein("word", "near", 1) == 1)
    ).select("word", "near", "near_n")


def variants(words: DataFrame, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    top = -F.col("best.less")
    holds = top >= options.ratio * F.col("n")
    known = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(holds, F.col("best.near")).alias("form"), F.when(holds, top).alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(known.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(pointers: DataFrame) -> DataFrame:
    """Follows (word, root) to words that point nowhere, doubling the way in each round."""
    open_ = stage(pointers, "spelling-roots")
    while True:
        onward = open_.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stage(open_.join(onward, "root", "left").select("word", "root", "_next"), "spelling-roots")
        if joined.where(F.col("_next").isNotNull()).isEmpty():
            return joined.select("word", "root")
        open_ = joined.select("word", F.coalesce("_next", "root").alias("root"))


def group_variants(docs: DataFrame, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of all texts (doc_id, text)."""
    return variants(vocabulary(docs, options), options)
