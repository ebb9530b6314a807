"""Benchmark decontamination with native functions only.

Benchmark items become windows of ``n`` words; an item with fewer words is one window of its own
length. Every run of three words in a window (its anchors) is hashed; these hashes are a broadcast set
when their number is below ``broadcast_anchors`` and an ordinary join side otherwise. Documents are
scanned at every eleventh place, which meets each window of 13 words exactly once, and a scanned place
leaves its task only if its hash is in the set. The windows around it are then compared word by word
with those of the benchmark, next to the text, so neither chance nor a hash collision can count.

Defined results: null or empty texts, and texts of separators only, have no words and are clean; null
or empty items have no window; repeated items count once per ``item_id``; repeated rows of documents get
repeated results; an empty benchmark leaves everything clean. Other columns are carried
unchanged, but for those that have the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.columns import let, lower_ascii, row_key, words
from corpusfold.session import stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHOR = 3
ANY_CASE_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    return words(lower_ascii(text), SEPARATORS)


def anchor_size(length: int) -> int:
    return min(ANCHOR, length)


def _hash(w: Column, i: Column, length: int) -> Column:
    """Of the anchor at place ``i`` for windows of ``length`` words."""
    return F.xxhash64(F.lit(length), *[F.get(w, i + k) for k in range(anchor_size(length))])


def benchmark_windows(items: DataFrame, n: int, id: str, text: str) -> DataFrame:
    """length, hash of an anchor, its offset in the window, the window and the sorted ids of its items."""
    w = normalised(F.col(text))
    size = F.size(w)
    found = let(
        w,
        lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x) - F.least(F.size(x), F.lit(n))),
            lambda i: F.slice(x, i + 1, F.least(F.size(x), F.lit(n))),
        ),
    )
    rows = items.where(size > 0).select(
        F.col(id).cast("string").alias("item_id"), F.least(size, F.lit(n)).alias("length"), F.explode(found).alias("window")
    )
    keyed = rows.groupBy("length", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    anchors = None
    for k in range(1, n + 1):
        here = F.transform(
            F.sequence(F.lit(0), F.lit(k - anchor_size(k))),
            lambda o: F.struct(o.alias("offset"), _hash(F.col("window"), o, k).alias("hash")),
        )
        anchors = F.when(F.col("length") == k, here) if anchors is None else anchors.when(F.col("length") == k, here)
    return keyed.select("*", F.inline(anchors))


def document_anchors(docs: DataFrame, lengths: list[int], text: str) -> DataFrame:
    """The anchors of every document: id, key, anchor (its place), length, hash.

    A window of ``length`` words holds ``length - size + 1`` anchors in a row, so taking every place that
    this number divides meets each window once.
    """

    def of_length(w: Column, k: int) -> Column:
        size = anchor_size(k)
        places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size, F.lit(k - size + 1)))
        return F.coalesce(
            F.transform(places, lambda i: F.struct(i.alias("anchor"), F.lit(k).alias("length"), _hash(w, i, k).alias("hash"))),
            F.array().cast("array<struct<anchor:int,length:int,hash:bigint>>"),
        )

    def places(w: Column) -> Column:
        each = [of_length(w, k) for k in lengths]
        return each[0] if len(each) == 1 else F.concat(*each)

    return docs.select("_id", "_key", F.inline(let(normalised(F.col(text)), places)))


def scan(
    docs: DataFrame, items: DataFrame, *, n: int = 13, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_anchors: int = 1_000_000,
) -> DataFrame:
    """Every row of ``docs`` with ``hits``: verified (place, length, items), sorted; null if there are none."""
    windows = stage(benchmark_windows(items, n, item_id, item_text), "benchmark-windows")
    columns = [c for c in docs.columns if c != "hits"]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(id).alias("_id"), row_key(id, text).alias("_key"), F.col(text).alias("_text")
    )
    # at most n different lengths
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    if not lengths:
        return docs.select(
            *[F.col(f"`{c}`") for c in columns], F.lit(None).cast("array<struct<place:int,length:int,items:array<string>>>").alias("hits")
        )
    side = F.broadcast(windows) if windows.count() <= broadcast_anchors else windows
    found = (
        document_anchors(keyed, lengths, "_text").join(side, ["length", "hash"])
        .withColumn("place", F.col("anchor") - F.col("offset"))
        .where("place >= 0")
        .groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("place", "length", "window", "items"))).alias("_found"))
    )
    joined = keyed.alias("d").join(
        found.alias("f"), F.col("d._id").eqNullSafe(F.col("f._id")) & (F.col("d._key") == F.col("f._key")), "left"
    )
    verified = let(
        normalised(F.col("_text")),
        lambda w: F.transform(
            F.filter(F.col("_found"), lambda h: F.slice(w, h["place"] + 1, h["length"]) == h["window"]),
            lambda h: F.struct(h["place"].alias("place"), h["length"].alias("length"), h["items"].alias("items")),
        ),
    )
    return joined.select("_row", F.when(F.col("_found").isNotNull(), verified).alias("hits")).select("_row.*", "hits")


def hit_words(hits: Column) -> Column:
    """Number of words inside at least one hit; ``hits`` are sorted by place."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))

    def add(acc: Column, h: Column) -> Column:
        end = h["place"] + h["length"]
        return F.struct(
            (acc["words"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["place"]))).alias("words"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.coalesce(F.aggregate(hits, zero, add, lambda acc: acc["words"]), F.lit(0)).cast("long")


def flag(docs: DataFrame, items: DataFrame, *, text: str = "text", share: int = 20, **options) -> DataFrame:
    """``scan`` with n_words, n_hit, items and contaminated (a ``share``-th of the words is hit, or more)."""
    n_words = F.size(words(F.col(text), ANY_CASE_SEPARATORS)).cast("long")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.col("hits"), lambda h: h["items"]))))
    return (
        scan(docs, items, text=text, **options)
        .withColumn("n_words", n_words)
        .withColumn("n_hit", hit_words(F.col("hits")))
        .withColumn("items", F.coalesce(found, F.array().cast("array<string>")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def remove_documents(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id).alias("_id"), F.col(text).alias("_text"))
    return flag(rows, items, id="_id", text="_text", **options).where(~F.col("contaminated")).select("_row.*")


def remove_spans(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All of ``docs``; hit words, with what stands between them, are cut out of the text."""
    token = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    covered = F.array_distinct(
        F.flatten(F.transform(F.col("hits"), lambda h: F.sequence(h["place"], h["place"] + h["length"] - 1)))
    )
    kept = let(
        F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)),
        lambda w: let(
            F.array_except(F.sequence(F.lit(0), F.size(w) - 1), covered),
            lambda keep: F.array_join(F.transform(keep, lambda i: F.get(w, i)), ""),
        ),
    )
    cleaned = F.when(F.size("hits") > 0, F.concat(lead, kept)).otherwise(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"), F.col(id).alias("_id"), F.col(text).alias(text))
    new = scan(rows, items, id="_id", text=text, **options).withColumn("_cleaned", cleaned)
    return new.select(*[F.col("_cleaned").alias(c) if c == text else F.col(f"_kept.`{c}`") for c in docs.columns])
