"""Exact removal of repeated word passages, with an FM-index per shard.

A window of ``length`` words is repeated if its words start at another place too. To bring equal windows
together without shipping all of them, each window is filed under its anchor, the ``gram``-word run with
the smallest hash in it; equal windows have equal anchors. The windows of one anchor in a document are
neighbours, so together they are one short segment. Only anchors that occur twice or more matter. Their
segments are dealt to shards by anchor; a shard builds an FM-index over its distinct segments (with
their numbers of occurrences) and streams the segments through it: backward search gives the matching
statistics, and runs of ``length`` words or more are reported as intervals of repeated windows.
Segments that are equal as a whole are settled by counting their 64-bit hashes, without a search; only
segments that occur once are searched.

An anchor that occurs more than ``hot`` times is filed window by window under each window's own hash, so
that a passage in a third of all documents is spread over the shards, whatever surrounds it; for these windows the count alone decides. Copies of a
segment are counted where they arise, before the shuffle, and travel once a task.

Defined results: null or empty texts have no words and lose none; repeated rows are repetitions of each
other, so all their windows go; texts of fewer than ``length`` words lose nothing; an empty table gives
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.columns import row_key
from corpusfold.llm.fm_index import FmIndex
from corpusfold.llm.wordbytes import Words, find_words, hash_words, over_pieces, window_hashes
from corpusfold.session import ship_package, stage


@dataclass(frozen=True)
class DedupOptions:
    length: int = 35
    gram: int = 6
    hot: int = 2000  #: occurrences of an anchor from which on its windows are filed one by one
    shard_words: int = 400_000  #: aimed size of an index
    remembered: int = 1 << 16  #: segments that a task holds to count their copies


def anchors_of(h: np.ndarray, first: np.ndarray, options: DedupOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of the anchor, first and last window start of every segment (places are word numbers in all rows)."""
    span = options.length - options.gram + 1
    grams = window_hashes(h, options.gram)
    starts = np.concatenate([
        np.arange(a, b - options.length + 1) for a, b in zip(first[:-1].tolist(), first[1:].tolist())
    ] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    row = np.searchsorted(first, starts, side="right") - 1
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    anchor = starts + np.concatenate([np.argmin(views[starts[i : i + 65536]], axis=1) for i in range(0, len(starts), 65536)])
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(starts)]]) - 1
    return row[begin], anchor[begin], starts[begin], starts[last]


def _words(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = find_words(column)
    return words, hash_words(words)


def _count_anchors(options: DedupOptions):
    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, h = _words(piece.column("text"))
        _, anchor, _, _ = anchors_of(h, words.first, options)
        values, counts = np.unique(window_hashes(h, options.gram)[anchor] if len(anchor) else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["anchor", "c"])

    return over_pieces(make, "text")


def _place_anchors(options: DedupOptions):
    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, h = _words(piece.column("text"))
        row, anchor, _, _ = anchors_of(h, words.first, options)
        hashes = window_hashes(h, options.gram)[anchor] if len(anchor) else np.zeros(0, np.uint64)
        key = piece.column("key").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(key[row]), pa.array((anchor - words.first[row]).astype(np.int32))], ["anchor", "key", "at"]
        )

    return over_pieces(make, "text")


def _pack():
    """Texts as compressed bytes, for the shuffles."""

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=3)
        packed = [squeeze.compress((t or "").encode()) for t in piece.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(packed, pa.binary())], ["doc_id", "key", "packed"])

    return over_pieces(make, "text")


def _unpack(column: pa.Array) -> tuple[list[bytes], pa.Array]:
    squeeze = zstandard.ZstdDecompressor()
    raw = [squeeze.decompress(b) for b in column.to_pylist()]
    return raw, pa.array(raw, pa.large_binary()).cast(pa.large_string())


def _segments(options: DedupOptions):
    """Rows of two kinds: an occurrence (key, place) of a segment, and a segment's words with a count of copies."""
    schema = pa.schema([
        ("route", pa.int64()), ("seg", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("words", pa.binary()), ("copies", pa.int64()),
    ])

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def release():
            keys = np.array(list(held), dtype=np.int64).reshape(-1, 2)
            values = list(held.values())
            none = pa.nulls(len(values))
            return pa.RecordBatch.from_arrays([
                pa.array(keys[:, 0]), pa.array(keys[:, 1]), none.cast(pa.int64()), none.cast(pa.int32()),
                pa.array([v[0] for v in values], pa.binary()), pa.array([v[1] for v in values], pa.int64()),
            ], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = {"route": [], "seg": [], "key": [], "place": []}
                raw, plain = _unpack(part.column("packed"))
                words, h = _words(plain)
                row, anchor, low, high = anchors_of(h, words.first, options)
                hashes = window_hashes(h, options.gram)[anchor].view(np.int64) if len(anchor) else np.zeros(0, np.int64)
                wanted = [dict(zip(a, c)) for a, c in zip(part.column("anchors").to_pylist(), part.column("counts").to_pylist())]
                key = part.column("key").to_pylist()
                first = words.first.tolist()
                split_row, split = -1, []
                for r, g, a, b in zip(row.tolist(), hashes.tolist(), low.tolist(), high.tolist()):
                    count = wanted[r].get(g)
                    if count is None:
                        continue
                    if r != split_row:
                        # bytes split at the same six characters that separate words
                        split_row, split = r, raw[r].split()
                    hot = count > options.hot
                    for x, y in [(i, i) for i in range(a, b + 1)] if hot else [(a, b)]:
                        text = b" ".join(split[x - first[r] : y - first[r] + options.length])
                        seg = xxhash.xxh64_intdigest(text) - 2**63
                        route = seg if hot else g
                        out["route"].append(route)
                        out["seg"].append(seg)
                        out["key"].append(key[r])
                        out["place"].append(x - first[r])
                        entry = held.setdefault((route, seg), [text, 0])
                        entry[1] += 1
                    if len(held) >= options.remembered:
                        yield release()
                        held.clear()
                none = pa.nulls(len(out["seg"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["route"], pa.int64()), pa.array(out["seg"], pa.int64()), pa.array(out["key"], pa.int64()),
                    pa.array(out["place"], pa.int32()), none.cast(pa.binary()), none.cast(pa.int64()),
                ], schema=schema)
        if held:
            yield release()

    return run


def repeated_runs(statistics: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Word intervals (begin, end) covered by runs of window starts with matches of ``length`` or more."""
    good = np.concatenate([[False], statistics >= length, [False]])
    edges = np.flatnonzero(good[1:] != good[:-1]).reshape(-1, 2)
    return [(int(a), int(b) - 1 + length) for a, b in edges]


def _index_shard(options: DedupOptions):
    def report(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        route, seg, copies = (rows.column(c).to_numpy() for c in ("route", "seg", "copies"))
        _, one, which = np.unique(seg, return_index=True, return_inverse=True)
        distinct = rows.column("words").take(pa.array(one)).combine_chunks()
        words = find_words((distinct.chunk(0) if isinstance(distinct, pa.ChunkedArray) else distinct).cast(pa.large_string()))
        symbols = np.unique(hash_words(words), return_inverse=True)[1]
        sequences = [symbols[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
        times = np.bincount(which, copies).astype(np.int64)
        index = FmIndex(sequences, times)
        # a segment that occurs twice is repeated as it stands; the others are streamed through the index
        runs = [[(0, len(s))] for s in sequences]
        single = np.flatnonzero(times == 1).tolist()
        for i, s in zip(single, index.matching_statistics([sequences[i] for i in single], options.length)):
            runs[i] = repeated_runs(s, options.length)
        # a segment may come under its anchor and, as a window, under its own hash
        _, pairs = np.unique(np.stack([route, seg]), axis=1, return_index=True)
        pairs = [i for i in pairs.tolist() if runs[which[i]]]
        return pa.table({
            "route": route[pairs], "seg": seg[pairs],
            "begins": pa.array([[a for a, _ in runs[which[i]]] for i in pairs], pa.list_(pa.int32())),
            "ends": pa.array([[b for _, b in runs[which[i]]] for i in pairs], pa.list_(pa.int32())),
        })

    return report


def _cut(keep_text: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                totals, removed, shas, texts, spans = [], [], [], [], []
                for text, found in zip(_unpack(part.column("packed"))[0], part.column("spans").to_pylist()):
                    words = text.split()
                    gone = _merged({(f["place"] + x, f["place"] + y) for f in found or () for x, y in zip(f["begins"], f["ends"])})
                    edges = [0, *(x for span in gone for x in span), len(words)]
                    keep = list(zip(edges[::2], edges[1::2]))
                    kept = b" ".join(w for x, y in keep for w in words[x:y])
                    totals.append(len(words))
                    removed.append(sum(y - x for x, y in gone))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    spans.append([x for span in gone for x in span])
                    texts.append(_without(text, keep) if keep_text and gone else text.decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                    pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64())),
                ], ["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"])

    return run


def _merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals, in order."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _without(text: bytes, keep: list[tuple[int, int]]) -> str:
    """A word goes with the white space after it; what stands before the first word stays."""
    words = find_words(pa.array([text], pa.large_binary()).cast(pa.large_string()))
    begin = [*words.begin.tolist(), len(text)]
    return (text[: begin[0]] + b"".join(text[begin[x] : begin[y]] for x, y in keep)).decode()


def substring_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", options: DedupOptions = DedupOptions(), keep_text: bool = True) -> DataFrame:
    """doc_id, key, n_words, n_removed, kept_sha256, kept_text, removed_spans (begin, end, begin, ... in words) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), row_key(id, text).alias("key"), F.col(text).alias("text"))
    repeated = stage(
        rows.mapInArrow(_count_anchors(options), "anchor long, c long").groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1"), "anchors"
    )
    # rows with one key are copies of a document: each of them is at every place of that key, and its spans count once
    mine = (
        rows.mapInArrow(_place_anchors(options), "anchor long, key long, at int").join(repeated, "anchor")
        .groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("anchor", "c"))).alias("m"))
        .select("key", F.map_keys("m").alias("anchors"), F.map_values("m").alias("counts"))
    )
    packed = rows.mapInArrow(_pack(), "doc_id long, key long, packed binary")
    segments = stage(
        packed.join(mine, "key").mapInArrow(
            _segments(options), "route long, seg long, key long, place int, words binary, copies long"
        ),
        "segments",
    )
    distinct = segments.where("words IS NOT NULL")
    words = distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, words // (6 * options.shard_words))
    found = stage(
        distinct.select("route", "seg", "words", "copies", F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"))
        .groupBy("shard").applyInArrow(_index_shard(options), "route long, seg long, begins array<int>, ends array<int>"),
        "repeats",
    )
    spans = (
        segments.where("words IS NULL").join(found, ["route", "seg"])
        .groupBy("key").agg(F.collect_set(F.struct("place", "begins", "ends")).alias("spans"))
    )
    return packed.join(spans, "key", "left").select("doc_id", "key", "packed", "spans").mapInArrow(
        _cut(keep_text),
        "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans array<long>",
    )
