"""Quality rules whose cutoffs carry a guarantee: few good documents are lost in every stratum.

Each rule rejects a document when a ratio exceeds a cutoff. For every stratum and rule the cutoffs are
tried from the most lenient to the strictest on labelled holdout documents. A cutoff is certified when
the exact binomial tail shows that its false rejection rate is below the rule's share of ``max_loss``;
the sequence ends at the first cutoff that fails, so trying many cutoffs costs no confidence. Over
strata and rules the confidence is divided evenly (Bonferroni). A rule without a certified cutoff stays
off: with few labels nothing is rejected.

Defined results: a null or empty text has no words; rows are judged one by one, so repeated rows get
repeated results; a null stratum is a stratum; several labels of one document count as their minimum;
with no labels, or an empty table, every rule stays off. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.columns import let, words
from corpusfold.session import stage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
STRATUM = "_stratum"


@dataclass(frozen=True)
class Rule:
    """Rejects when ``1000 * numerator > cutoff * denominator``; cutoffs run from lenient to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("long_words", "word_chars", "n_words", (40000, 30000, 20000, 16000, 14000, 12000, 11000, 10000)),
    Rule("short_words", "n_words", "word_chars", (800, 600, 500, 450, 400, 350, 300)),
    Rule("symbols", "n_symbols", "word_chars", (500, 400, 300, 200, 150, 100, 70, 50, 30, 20)),
    Rule("repeats", "n_repeat_words", "n_words", (900, 700, 500, 400, 300, 250, 200, 150, 100)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (900, 700, 500, 400, 300, 200, 150, 100)),
    Rule("capitals", "n_capitals", "word_chars", (900, 700, 500, 400, 300, 200, 150, 100)),
)


def repeated_words(w: Column) -> Column:
    """Words of ``w`` inside three-word windows that occur twice or more."""
    windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    # most texts repeat nothing, which a hash set tells without the sort
    counted = let(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_words_of_repeats(w, h))
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(counted).cast("long")


def _words_of_repeats(w: Column, hashes: Column) -> Column:
    # the lower bits of a hash give way to its place, so that one sort makes equal windows neighbours
    low = F.pow(F.lit(2), F.length(F.bin(F.size(w)))).cast("long") - 1

    def equal(a: Column, b: Column) -> Column:
        i, j = a["place"], b["place"]
        same = a["hash"] == b["hash"]
        for k in range(3):
            same = same & (F.get(w, i + k) == F.get(w, j + k))
        return F.coalesce(same, F.lit(False))

    def neighbours(m: Column) -> Column:
        tagged = F.sort_array(
            F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))
        )
        return F.transform(
            tagged, lambda t: F.struct(t.bitwiseAND(F.bitwise_not(m)).alias("hash"), t.bitwiseAND(m).cast("int").alias("place"))
        )

    def covered(s: Column) -> Column:
        repeated = F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["place"], x["place"] + 1, x["place"] + 2)))))

    return let(let(low, neighbours), covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns ``MEASURES`` to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    line_stats = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    other = [c for c in docs.columns if c not in MEASURES]
    return docs.select(
        *[F.col(f"`{c}`") for c in other],
        stats.alias("_w"),
        line_stats.alias("_l"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(body, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    ).select(
        *[F.col(f"`{c}`") for c in other],
        "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, ten places up, where its error is below double precision."""
    z = x + 10
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p), for k < n * p.

    Terms are added downwards from k. They fall geometrically there, and those more than 40 standard
    deviations away, which the sum leaves out, are below the smallest double.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = (
        _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1)
        + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    )
    least = F.greatest(F.lit(1).cast("long"), k - (20 * F.sqrt(nd) + 100).cast("long"))
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * i * (1 - p) / ((nd - i + 1) * p)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    terms = F.when(k < 1, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(k, least, F.lit(-1).cast("long")), zero, add, lambda acc: acc["sum"])
    )
    return F.exp(top) * terms


def rejects(rule: Rule, cutoff) -> Column:
    return 1000 * F.col(rule.numerator) > cutoff * F.col(rule.denominator)


def calibrate(
    measured: DataFrame, labels: DataFrame, *, stratum: str, id: str = "doc_id", quality: str = "quality",
    max_loss: float = 0.05, confidence: float = 0.95, rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per stratum with a certified cutoff, or null, for every rule."""
    good = (
        labels.select(F.col(id).alias("_id"), F.col(quality).alias("_quality"))
        .groupBy("_id").agg(F.min("_quality").alias("_quality")).where("_quality = 1")
    )
    holdout = measured.join(good, F.col(f"`{id}`") == F.col("_id"))
    hits = {
        (r.name, j): F.sum(F.when(rejects(r, c), 1).otherwise(0)).cast("long")
        for r in rules for j, c in enumerate(r.cutoffs)
    }
    counts = stage(
        holdout.groupBy(F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias(STRATUM)).agg(
            F.count(F.lit(1)).alias("n"), *[v.alias(f"{name}_{j}") for (name, j), v in hits.items()]
        ),
        "rule-counts",
    )
    share = max_loss / len(rules)
    error = (1 - confidence) / (len(rules) * max(1, counts.count()))
    trials = counts.select(
        STRATUM, "n",
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.lit(j).alias("step"), F.col(f"{name}_{j}").alias("k")) for name, j in hits
        ])),
    )
    passed = (F.col("k") < F.col("n") * share) & (binomial_tail(F.col("k"), F.col("n"), share) <= error)
    # the first failure ends the sequence
    ends = trials.withColumn("passed", F.coalesce(passed, F.lit(False))).groupBy(STRATUM, "rule").agg(
        F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.count(F.lit(1)).cast("int")).alias("certified")
    )
    cutoff = {
        r.name: F.max(F.when(F.col("rule") == r.name, F.get(F.array(*map(F.lit, r.cutoffs)), F.col("certified") - 1)))
        for r in rules
    }
    return ends.groupBy(STRATUM).agg(*[c.cast("long").alias(f"cut_{name}") for name, c in cutoff.items()])


def judge(
    measured: DataFrame, cutoffs: DataFrame, *, stratum: str, rules: tuple[Rule, ...] = RULES, broadcast_strata: int = 100_000,
) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` and ``kept``. Cutoffs travel to the rows when there are few strata."""
    small = stage(cutoffs, "rule-cutoffs")
    if small.count() <= broadcast_strata:
        small = F.broadcast(small)
    joined = measured.withColumn(STRATUM, F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))).join(small, STRATUM, "left")
    failed = F.array_compact(F.array(*[F.when(rejects(r, F.col(f"cut_{r.name}")), F.lit(r.name)) for r in rules]))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop(STRATUM, *[f"cut_{r.name}" for r in rules])
    )


def filter_quality(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", stratum: str = "lang", **limits) -> DataFrame:
    """Measures ``docs``, certifies cutoffs on ``labels`` and judges every row."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    measured = stage(measure(narrow).drop("text"), "rule-measures")
    cutoffs = calibrate(measured, labels.withColumnRenamed(id, "doc_id"), stratum="stratum", **limits)
    return judge(measured, cutoffs, stratum="stratum")
