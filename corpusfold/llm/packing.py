"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Documents become token ids with an end mark; longer ones than ``capacity`` are cut, the first piece
takes the remainder. What is packed is the histogram of piece lengths, ``capacity`` numbers whatever the
corpus. A configuration is a multiset of lengths that fits into a sequence. Multiplicative weights price
the lengths: each round an exact knapsack dynamic program finds the most valuable configuration, takes a
fraction of it, and lowers the prices of the lengths it covers. The fractional solution is rounded down
and the rest is packed best fit, longest first, on counts too. Pieces then find their places on their
own: a piece's rank among those of its length says which copy of which configuration it belongs to.

Defined results: null and empty texts are the end mark alone; repeated rows are documents of their own
and may carry the same id; an empty table gives no pieces; extra columns are not looked at. Special
tokens spelled out in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusfold.llm.wordbytes import SPACE, Words, hash_words, pieces, text_bytes
from corpusfold.session import ship_package, stage


@dataclass(frozen=True)
class PackOptions:
    vocabulary: str  #: path of a tokenizer file, on every machine
    capacity: int = 1024
    end_id: int = 2
    rounds: int = 1500  #: of the multiplicative weights
    step: float = 0.5  #: share of a length's pieces that a round covers at most
    rate: float = 0.005  #: how fast prices fall with coverage; small, so that full sequences stay the most valuable
    favour: float = 0.01  #: how much more than its volume a long piece is worth at the start
    cache: int = 1 << 20  #: encoded words that a task remembers


# -- tokens -----------------------------------------------------------------------------------------


def units(column: pa.Array) -> Words:
    """Cuts texts before white space that follows other characters.

    The tokenizer never joins characters over such a place, so units can be encoded one by one. Places after a white
    space character beyond ASCII are left alone, as it belongs to the white space that follows.
    """
    data, at = text_bytes(column)
    space = SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    wide = np.zeros(len(data), dtype=bool)  # the character ending before this place may be wide white space
    if len(data) > 3:
        wide[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)
        wide[2:] |= (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
    cut &= ~wide
    filled = at[:-1][np.diff(at) > 0]
    cut[filled] = True
    begin = np.flatnonzero(cut)
    end = np.concatenate([begin[1:], [len(data)]])[: len(begin)]
    return Words(data, begin, end, np.searchsorted(begin, at))


def _described(path: str):
    """Ids of many texts by a tokenizer file, and the bytes of every id, as far as they are known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    first = {i: token.replace("\u0120", " ").encode() for token, i in tokenizer.get_vocab().items()}
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], first


def _ranked(path: str):
    """The same by the file of the byte pairs with their ranks, for an encoder that is faster on short texts."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoding.encode_ordinary(t) for t in texts], {rank: token for token, rank in ranks.items()}


class Encoder:
    """Token ids of units, each distinct one encoded once while it is remembered."""

    def __init__(self, vocabulary: str, limit: int = 1 << 20):
        ranked = vocabulary.endswith(".tiktoken")
        self.batch, known = _ranked(vocabulary) if ranked else _described(vocabulary)
        self.limit = limit
        self.leads = np.zeros(max(known, default=-1) + 1, dtype=bool)  #: which ids begin with a space
        self.leads[[i for i, token in known.items() if token[:1] == b" "]] = True
        self.width = None  #: how many bytes an id stands for
        if ranked:
            self.width = np.zeros(len(self.leads), dtype=np.int64)
            self.width[list(known)] = [len(token) for token in known.values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _joined(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words after a space each, and how many each has, encoded as one text; none if an id reaches over a space.

        No word may have white space beyond ASCII, see :func:`units`.
        """
        size = words.end[chosen] - words.begin[chosen]
        stop = np.cumsum(size + 1)
        text, letters = np.full(stop[-1], 32, dtype=np.uint8), np.ones(stop[-1], dtype=bool)
        letters[stop - size - 1] = False
        text[letters] = gather_runs(words.data, words.begin[chosen], size)
        ids = np.array(self.batch([text.tobytes().decode()])[0], dtype=np.int32)
        at = np.cumsum(self.width[ids])
        last = np.searchsorted(at, stop)
        return (ids, np.diff(last, prepend=-1)) if at[-1] == stop[-1] and (at[last] == stop).all() else None

    def _coded(self, words: Words, chosen: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some words, and for each of these where its ids begin and how many they are."""
        alone = np.ones(len(chosen), dtype=bool)
        size, parts = np.zeros(len(chosen), dtype=np.int64), []
        if lead == " " and self.width is not None:
            # what may begin a wide white space; words never hold another
            wide = np.flatnonzero((words.data == 0xC2) | (words.data >= 0xE1) & (words.data <= 0xE3))
            alone = np.searchsorted(wide, words.end[chosen]) > np.searchsorted(wide, words.begin[chosen])
            if not alone.all():
                made = self._joined(words, chosen[~alone])
                if made is None:
                    alone[:] = True
                else:
                    parts.append(made[0])
                    size[~alone] = made[1]
        if alone.any():
            raw, mine = words.data.tobytes(), chosen[alone]
            coded = self.batch([lead + raw[a:b].decode() for a, b in zip(words.begin[mine].tolist(), words.end[mine].tolist())])
            size[alone] = [len(c) for c in coded]
            parts.append(np.array([i for c in coded for i in c], dtype=np.int32))
        order = np.argsort(alone, kind="stable")
        start = np.empty(len(chosen), dtype=np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(parts), start, size

    def of(self, words: Words, lead: str = "", found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, each read with ``lead`` before it, and how many every word has.

        ``found`` has the hashes of the distinct words, a place of each, and which one every word is, where the caller knows.
        """
        keys, one, which = found or np.unique(hash_words(words), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit:
            self._forget()
        at = find(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        start, size = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        start[~new], size[~new] = self.start[at[~new]], self.size[at[~new]]
        if new.any():
            ids, start[new], size[new] = self._coded(words, one[new], lead)
            start[new] += len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            sort = np.argsort(keys[new])
            to = at[new][sort]
            self.keys = np.insert(self.keys, to, keys[new][sort])
            self.start, self.size = np.insert(self.start, to, start[new][sort]), np.insert(self.size, to, size[new][sort])
        size = size[which]
        return gather_runs(self.ids, start[which], size), size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        u = units(column)
        ids, size = self.of(u)
        return ids, np.concatenate([[0], np.cumsum(size)])[u.first]


def gather_runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``start``, one after the other."""
    before = np.cumsum(size) - size
    at = np.repeat(start - before, size)
    at += np.arange(len(at))
    return values.take(at)


def find(values: np.ndarray, these: np.ndarray) -> np.ndarray:
    """Where ``these`` belong in sorted ``values``; they are looked up in order, which is faster in a large table."""
    order, out = np.argsort(these), np.empty(len(these), dtype=np.int64)
    out[order] = np.searchsorted(values, these[order])
    return out


def _cut(options: PackOptions, with_ids: bool):
    def run(batches):
        encoder = Encoder(options.vocabulary, options.cache)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(options.capacity + 1, dtype=np.int64)
        for piece in pieces(batches, "text"):
            ids, first = encoder.encode(piece.column("text"))
            out = {k: [] for k in ("doc", "piece", "start", "length", "crc", "ids")}
            for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                own = np.append(ids[a:b], np.int32(options.end_id)).astype("<u4")
                begin, stop = 0, (len(own) - 1) % options.capacity + 1
                number = 0
                while begin < len(own):
                    cut = own[begin:stop]
                    out["doc"].append(row)
                    out["piece"].append(number)
                    out["start"].append(begin)
                    out["length"].append(len(cut))
                    out["crc"].append(zlib.crc32(cut.tobytes()))
                    out["ids"].append(cut.astype(np.int32) if with_ids else None)
                    begin, stop, number = stop, stop + options.capacity, number + 1
            length = np.array(out["length"], dtype=np.int64)
            order = np.argsort(length, kind="stable")
            runs = np.searchsorted(length[order], length[order])
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(length)) - runs + ranks[length[order]]
            ranks += np.bincount(length, minlength=len(ranks))
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id").take(pa.array(out["doc"], pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                pa.array(length), pa.array(out["crc"], pa.int64()), pa.array(np.full(len(length), part)), pa.array(rank),
                pa.array(out["ids"], pa.list_(pa.int32())),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"])

    return run


# -- the plan ---------------------------------------------------------------------------------------


def knapsack(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of lengths that fits; ``price[l]`` is zero for lengths that are not on offer."""
    items = np.flatnonzero(price > 0)
    if not len(items):
        return {}
    value, value_of = np.zeros(capacity + 1), price[items]
    choice = np.zeros(capacity + 1, dtype=np.int64)
    count = np.searchsorted(items, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := count[c]:
            reach = value_of[:k] + value[c - items[:k]]
            best = int(reach.argmax())
            if reach[best] > value[c]:
                value[c], choice[c] = reach[best], items[best]
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if l := int(choice[c]):
            found[l] = found.get(l, 0) + 1
            c -= l
        else:
            c -= 1
    return found


def configurations(histogram: np.ndarray, options: PackOptions) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution: configurations (length, number), longest first, and how much of each is used."""
    need = histogram.astype(float)
    lengths = np.arange(len(need))
    covered = np.zeros(len(need))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(options.rounds):
        left = need - covered
        offered = left > 1e-6
        if not offered.any():
            break
        share = np.divide(covered, need, out=np.zeros_like(need), where=need > 0)
        # worth by volume, falling with coverage
        price = np.where(offered, lengths ** (1 + options.favour) * np.exp(-options.rate * share), 0.0)
        found = knapsack(price, options.capacity)
        if 256 * (options.capacity - sum(l * a for l, a in found.items())) > options.capacity:
            break  # what is left fits together no better than best fit makes it
        key = tuple(sorted(found.items(), reverse=True))
        step = min(min(max(options.step * need[l], 1.0), left[l]) / a for l, a in found.items())
        used[key] = used.get(key, 0.0) + step
        for l, a in found.items():
            covered[l] += a * step
    return used


def best_fit(histogram: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Best fit decreasing on counts: equal sequences are handled together."""
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room
    for l in range(capacity, 0, -1):
        left = int(histogram[l])
        room = l
        while left and room <= capacity:
            if bins[room]:
                content, number = bins[room].popitem()
                take = min(number, left)
                if number > take:
                    bins[room][content] = number - take
                grown = content + (l,)
                bins[room - l][grown] = bins[room - l].get(grown, 0) + take
                left -= take
                room = min(room, l) if room - l >= l else room
            else:
                room += 1
        if left:
            fit = capacity // l
            if whole := left // fit:
                content = (l,) * fit
                bins[capacity - fit * l][content] = bins[capacity - fit * l].get(content, 0) + whole
            if rest := left % fit:
                content = (l,) * rest
                bins[capacity - rest * l][content] = bins[capacity - rest * l].get(content, 0) + 1
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for by_content in bins:
        for content, number in by_content.items():
            values, counts = np.unique(content, return_counts=True)
            key = tuple(sorted(zip(values.tolist(), counts.tolist()), reverse=True))
            out[key] = out.get(key, 0) + number
    return out


@dataclass(frozen=True)
class Plan:
    """Slots in the order of (length, first rank): where the pieces of that length from that rank on go."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))
        slot = np.empty(len(length), dtype=np.int64)
        for l in np.unique(length):
            mine = length == l
            a, b = start[l], start[l + 1]
            slot[mine] = a + np.searchsorted(self.rank[a:b], rank[mine], side="right") - 1
        within = rank - self.rank[slot]
        return self.sequence[slot] + within // self.each[slot], self.offset[slot] + within % self.each[slot] * length


def make_plan(histogram: np.ndarray, options: PackOptions) -> Plan:
    """Rounds the fractional solution down and packs what is left."""
    chosen = {c: int(x + 1e-9) for c, x in configurations(histogram, options).items()}
    left = histogram.astype(np.int64).copy()
    for c, x in chosen.items():
        for l, a in c:
            left[l] -= a * x
    for c, x in best_fit(left, options.capacity).items():
        chosen[c] = chosen.get(c, 0) + x
    rows, number = [], 0
    ranks = np.zeros(len(histogram), dtype=np.int64)
    for c, x in chosen.items():
        offset = 0
        for l, a in c if x else ():
            rows.append((l, ranks[l], number, a, offset))
            ranks[l] += a * x
            offset += a * l
        number += x
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T, sequences=number)


# -- jobs -------------------------------------------------------------------------------------------


def pack(docs: DataFrame, options: PackOptions, *, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for), a row for every piece."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = stage(
        rows.mapInArrow(
            _cut(options, with_ids),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long, ids array<int>",
        ),
        "pieces",
    )
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("c"))
    histogram = np.zeros(options.capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect():
        histogram[r["length"]] = r["c"]
    plan = spark.sparkContext.broadcast(make_plan(histogram, options))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"), "ids"
    )

    def place(batches):
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield keep.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    placed = ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"
    )
    return placed if with_ids else placed.drop("ids")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of every packed sequence, at most ``capacity`` of them; needs ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
