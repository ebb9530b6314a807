"""Exact Jaccard self-join on word n-grams with token-combination prefixes.

A document is its set of shingles. Shingles are ordered: rare ones first (by hash), then frequent ones
by count. A set's prefix has to be so long that whoever is similar to it shares something of it. A rare
shingle in the prefix is a signature by itself. Frequent shingles belong to a class with a number k: only
combinations of k of them, within a group of the class, are signatures. A group with c prefix shingles
then stands for c - (k - 1) of them, and the prefix is extended until these sum up to the
``T = |x| - ceil(t * |x|) + 1`` that the plain prefix has. Hence no link is lost, whatever the classes.
The number of groups follows from the size, so a set has about as many combinations as T. Sizes of
linked sets differ by one step of a geometric scale at most; each set uses the groups of its own step
and of the next, so both use the same ones somewhere.

Verification, in the order of cost:
1. equal sets are one node from the start;
2. signatures held by up to ``few`` nodes give pairs. Bitmaps bound their intersection from above; what
   is left is compared in full, one partner a node first, then only what still joins two components;
3. nodes of signatures held by more form clusters, which are dealt into blocks. Each block (or pair of
   blocks, where a cluster needs several) counts its intersections at once and reports a forest.

Defined results: texts without words (or null) are empty sets, linked with nothing; fewer than ``n``
words are one shingle; repeated rows are copies; rows with one id and different texts are compared each
by its own text; rows with a null id link like others and get a null component unless their group has an
id; an empty table gives an empty result. Other columns are not looked at.
Nodes are 64-bit digests of sets, shingles are 64-bit hashes of words.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusfold.llm.columns import row_key
from corpusfold.llm.components import connected_components
from corpusfold.llm.wordbytes import M1, M2, find_words, finish, hash_words, over_pieces, pieces, times, window_hashes
from corpusfold.session import ship_package, stage


@dataclass(frozen=True)
class JoinOptions:
    percent: int = 85  #: link when 100 * intersection >= percent * union
    n: int = 4
    classes: tuple[tuple[int, int], ...] = ((4, 2), (4096, 3))  #: (count from which on, k of its combinations)
    frequent_limit: int = 1 << 20  #: frequent shingles that are told to the tasks (12 bytes each), the most frequent ones
    buffer: int = 1 << 22  #: shingles that a task counts at once
    few: int = 8
    block: int = 1000
    remembered: int = 1 << 18  #: sets that a task remembers, to sign copies once


@dataclass(frozen=True)
class Frequent:
    """Frequent shingles, sorted by hash, with their place in the order and their class."""

    hashes: np.ndarray
    rank: np.ndarray
    k: np.ndarray


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = find_words(texts, lower=True)
    h = hash_words(words)
    w = window_hashes(h, n)
    sets = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= n:
            sets.append(np.unique(w[begin : end - n + 1]))
        elif end > begin:
            # a whole short text: its length keeps it apart from the windows
            sets.append(window_hashes(h[begin:end], end - begin) ^ times(M1, end - begin))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def digest(s: np.ndarray) -> int:
    """A set's node: all its hashes and its size."""
    mixed = finish(s * M2 + np.arange(1, len(s) + 1, dtype=np.uint64) * M1)
    both = mixed.sum(dtype=np.uint64) ^ times(M1, int(np.bitwise_xor.reduce(mixed)) + len(s))
    return int(finish(np.array([both])).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Four bits or more for every shingle; a power of two, so that maps of two sizes can be folded."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits // 8, dtype=np.uint8)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    while len(a) > size:
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    return a


def may_link(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """False only if the bitmaps prove that the sets are not linked."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = min(len(x), len(y))
    x, y = _fold(x, size), _fold(y, size)
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= percent * (na + nb - most)


# -- tasks ------------------------------------------------------------------------------------------


def _describe(options: JoinOptions):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()),
        ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ])

    def run(batches):
        waiting: list[np.ndarray] = []
        size = 0

        def flush():
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts >= 2
            return values[often].view(np.int64), counts[often]

        for piece in pieces(batches, "text"):
            sets = shingle_sets(piece.column("text"), options.n)
            rows = [[], []]
            for i, s in enumerate(sets):
                waiting.append(s)
                size += len(s)
                full = size >= options.buffer
                found = flush() if full else (None, None)
                if full:
                    waiting, size = [], 0
                for kept, value in zip(rows, found):
                    kept.append(value)
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), piece.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()),
                pa.array([bitmap(s) for s in sets], pa.binary()), pa.array(rows[0], schema.field("hashes").type), pa.array(rows[1], schema.field("counts").type),
            ], schema=schema)
        if size:
            found = flush()
            # a row without a document carries what is left
            yield pa.RecordBatch.from_arrays([
                pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
                pa.array([found[0]], schema.field("hashes").type), pa.array([found[1]], schema.field("counts").type),
            ], schema=schema)

    return run


def needed(n: int, percent: int) -> int:
    """T: so many prefix shingles, one of which every linked set shares."""
    return n + (-percent * n) // 100 + 1


def size_step(n: int, percent: int) -> int:
    """Linked sets are at most one step apart; the scale is a little wider than their greatest ratio."""
    return int(np.log(n) / np.log(100 / (percent - 1)))


def signatures(s: np.ndarray, frequent: Frequent, options: JoinOptions) -> tuple[np.ndarray, np.ndarray]:
    """The set's single signatures and its combinations."""
    none = np.zeros(0, dtype=np.uint64)
    if len(s) == 0:
        return none, none
    t = needed(len(s), options.percent)
    at = np.searchsorted(frequent.hashes, s)
    at[at == len(frequent.hashes)] = 0
    often = frequent.hashes[at] == s if len(frequent.hashes) else np.zeros(len(s), dtype=bool)
    rare = s[~often]
    if len(rare) >= t:
        return rare[:t], none
    left = t - len(rare)
    order = at[often][np.argsort(frequent.rank[at[often]])]
    combos = []
    for step in (own := size_step(len(s), options.percent), own + 1):
        # the size that opens the step says how many groups there are
        groups = max(1, needed(max(1, int((100 / (options.percent - 1)) ** step)), options.percent) // 4)
        filled: dict[tuple[int, int], list[int]] = {}
        reached = 0
        for i in order.tolist():
            k = int(frequent.k[i])
            members = filled.setdefault((k, int(frequent.hashes[i] >> np.uint64(20)) % groups), [])
            members.append(i)
            reached += len(members) >= k
            if reached >= left:
                break
        for (k, _), members in filled.items():
            if len(members) >= k:
                chosen = np.sort(np.array(list(combinations(sorted(members), k)), dtype=np.int64), axis=1)
                mixed = np.full(len(chosen), times(M1, step * 64 + k + 1), dtype=np.uint64)
                for column in range(k):
                    mixed = finish(mixed + frequent.hashes[chosen[:, column]])
                combos.append(mixed)
    return rare, np.concatenate(combos) if combos else none


def _sign(frequent, options: JoinOptions):
    def run(batches):
        seen: set[int] = set()
        for piece in pieces(batches, "text"):
            out = {"sig": [], "node": [], "n": [], "combined": []}
            for s in shingle_sets(piece.column("text"), options.n):
                node = digest(s)
                if node in seen:
                    continue
                if len(seen) >= options.remembered:
                    seen.clear()
                seen.add(node)
                single, combined = signatures(s, frequent.value, options)
                count = len(single) + len(combined)
                out["sig"].append(np.concatenate([single, combined]).view(np.int64))
                out["node"].append(np.full(count, node))
                out["n"].append(np.full(count, len(s), dtype=np.int32))
                out["combined"].append(np.arange(count) >= len(single))
            if out["sig"]:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return run


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], percent: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] linked to b[j], from one product of 0/1 matrices over the shared shingles."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    common = np.zeros((len(a), len(b)), dtype=np.float32)

    def places(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    if len(shared):
        (ra, ca), (rb, cb) = places(a), places(b)
        for start in range(0, len(shared), columns):
            x, y = np.zeros((len(a), columns), dtype=np.float32), np.zeros((len(b), columns), dtype=np.float32)
            for m, r, c in ((x, ra, ca), (y, rb, cb)):
                lo, hi = np.searchsorted(c, [start, start + columns])
                m[r[lo:hi], c[lo:hi] - start] = 1
            common += x @ y.T
    inter = common.astype(np.int64)
    return np.nonzero(100 * inter >= percent * (na[:, None] + nb[None, :] - inter))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _block_links(options: JoinOptions):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(pa.array(rows["text"], pa.large_string()), options.n)
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        i, j = linked_pairs([sets[x] for x in left], [sets[x] for x in right], options.percent)
        a, b = node[left[i]], node[right[j]]
        return pd.DataFrame(_forest(a[a < b], b[a < b]) + _forest(a[a > b], b[a > b]), columns=["a", "b"], dtype="int64")

    return links


def _pair_links(options: JoinOptions):
    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (shingle_sets(piece.column(c), options.n) for c in ("text", "text_b"))
        good = []
        for x, y in zip(a, b):
            inter = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * inter >= options.percent * (len(x) + len(y) - inter))
        return pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return over_pieces(make, "text")


def _prune(options: JoinOptions):
    def run(batches):
        for batch in batches:
            na, nb, a, b = (batch.column(c).to_pylist() for c in ("na", "nb", "bits", "bits_b"))
            good = [may_link(*row, options.percent) for row in zip(na, nb, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


# -- jobs -------------------------------------------------------------------------------------------


def frequent_shingles(spark: SparkSession, described: DataFrame, options: JoinOptions):
    """The most frequent shingles, as a broadcast of at most ``frequent_limit`` entries."""
    counted = stage(
        described.where("hashes IS NOT NULL").select(F.explode(F.arrays_zip("hashes", "counts")).alias("x"))
        .groupBy(F.col("x.hashes").alias("hash")).agg(F.sum("x.counts").alias("count"))
        .where(F.col("count") >= options.classes[0][0]),
        "frequent",
    )
    # the smallest power of two from which on the entries fit
    sizes = {r["p"]: r["c"] for r in counted.groupBy(F.floor(F.log2("count")).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for p in sorted(sizes, reverse=True):
        if (total := total + sizes[p]) > options.frequent_limit:
            break
        least = p
    rows = counted.where(F.col("count") >= 2**least).toArrow()
    hashes = rows.column("hash").to_numpy().view(np.uint64)
    counts = rows.column("count").to_numpy()
    by_hash = np.argsort(hashes)
    hashes, counts = hashes[by_hash], counts[by_hash]
    rank = np.empty(len(hashes), dtype=np.int64)
    rank[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    k = np.full(len(hashes), options.classes[0][1], dtype=np.int8)
    for least_count, size in options.classes:
        k[counts >= least_count] = size
    return spark.sparkContext.broadcast(Frequent(hashes, rank, k))


def shared_signatures(signed: DataFrame, options: JoinOptions) -> DataFrame:
    """sig, step, node, n of all signatures that nodes share within a step of sizes, and holders, their number.

    A single signature is of a rare shingle, so its holders are few and most are alone: they are sorted out
    first. Combinations may be held by very many and are only ever counted in parts.
    """
    same = W.partitionBy("sig")
    single = (
        signed.where("NOT combined").withColumn("lo", F.min("node").over(same)).withColumn("hi", F.max("node").over(same))
        .where("lo < hi").select("sig", "node", "n")
    )
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / (options.percent - 1))))
    stepped = (
        single.union(signed.where("combined").select("sig", "node", "n"))
        .select("sig", "node", "n", F.explode(F.array(step, step + 1)).alias("step"))
        .groupBy("sig", "step", "node").agg(F.first("n").alias("n"))
    )
    stepped = stage(stepped, "stepped")
    holders = stepped.groupBy("sig", "step").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    return stepped.join(holders, ["sig", "step"])


def _verified(pairs: DataFrame, texts: DataFrame, options: JoinOptions) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), "text")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return stage(pairs.join(left, "a").join(right, "b").mapInArrow(_pair_links(options), "a long, b long"), "links")


def ngram_join(docs: DataFrame, *, id: str = "doc_id", text: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """doc_id, key (of id and text), n_shingles, component_id and keeper for every row.

    ``keeper`` is the key of the row that stands for the group: of the smallest id, then the smallest key.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), row_key(id, text).alias("key"), F.col(text).alias("text"))
    described = stage(
        rows.mapInArrow(_describe(options), "doc_id long, key long, n long, node long, bits binary, hashes array<long>, counts array<long>"),
        "described",
    )
    base = described.where("n >= 0").select("doc_id", "key", "n", "node")
    nodes = stage(
        described.where("n > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")
        ),
        "nodes",
    )
    frequent = frequent_shingles(spark, described, options)
    signed = rows.mapInArrow(_sign(frequent, options), "sig long, node long, n int, combined boolean")
    shared = stage(shared_signatures(signed, options), "shared")

    few = shared.where(F.col("holders") <= options.few)
    other = few.select("sig", "step", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = (
        few.select("sig", "step", F.col("node").alias("a"), F.col("n").alias("na")).join(other, ["sig", "step"])
        .where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= options.percent * F.greatest("na", "nb")))
        .select("a", "b", "na", "nb").distinct()
    )
    bits = nodes.select("node", "bits")
    possible = stage(
        pairs.join(bits.select(F.col("node").alias("a"), "bits"), "a")
        .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
        .select("a", "b", "na", "nb", "bits", "bits_b").mapInArrow(_prune(options), "a long, b long"),
        "possible",
    )

    # a signature held by very many meets its centre in as many shares
    shares = F.ceil(F.col("holders") / options.block).cast("int")
    many = shared.where(F.col("holders") > options.few).withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int"))
    centre = (
        many.groupBy("sig", "step", "share").agg(F.min("node").alias("b"), F.first("holders").alias("holders"))
        .groupBy("sig", "step").agg(F.min("b").alias("b"), F.first("holders").alias("holders"))
        .select("sig", "step", "b", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    )
    clusters = connected_components(many.join(centre, ["sig", "step", "share"]).select(F.col("node").alias("a"), "b").distinct())
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / options.block).alias("blocks"))
    dealt = stage(
        clusters.join(sizes, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "blocks"
    )

    wanted = possible.select(F.explode(F.array("a", "b")).alias("node")).union(dealt.select("node")).distinct()
    reps = nodes.join(wanted, "node").select("node", F.col("rep.key").alias("key"))
    texts = stage(reps.join(rows.select("key", "text"), "key").select("node", "text").dropDuplicates(["node"]), "texts")

    first = possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(first, texts, options)
    joined = connected_components(links)
    label = joined.select(F.col("node").alias("_n"), "component")
    open_pairs = (
        possible.join(label.withColumnRenamed("component", "_ca"), F.col("a") == F.col("_n"), "left").drop("_n")
        .join(label.withColumnRenamed("component", "_cb"), F.col("b") == F.col("_n"), "left")
        .where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")
    )
    links = links.union(_verified(open_pairs, texts, options))

    # a member meets every block of its cluster once: side 0 within its own, 1 or 2 in a pair of blocks
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tasks = dealt.select("node", "component", "block", F.explode(others).alias("o")).select(
        "node", "component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"),
        F.when(F.col("block") == F.col("o"), 0).when(F.col("block") < F.col("o"), 1).otherwise(2).alias("side"),
    )
    in_blocks = tasks.join(texts, "node").groupBy("component", "i", "j").applyInPandas(_block_links(options), "a long, b long")
    components = connected_components(links.union(stage(in_blocks, "links")))

    label = components.select(F.col("node").alias("_n"), "component")
    placed = nodes.join(label, F.col("node") == F.col("_n"), "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("least"))
    places = placed.join(smallest, "component").select(F.col("node").alias("_n"), F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("keeper"))
    return base.join(places, (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("keeper", "key").alias("keeper"),
    )


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """``docs`` with one row of every group of near duplicates, the one with the smallest id.

    A group without ids keeps one row too. Rows that are equal in id and text are one document. Texts without words are linked with nothing and stay.
    """
    joined = ngram_join(docs, id=id, text=text, options=options)
    stays = joined.where(F.col("key") == F.col("keeper")).select(F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(id, text).alias("_key"))
    return rows.join(stays, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
