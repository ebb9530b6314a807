"""Licence scans: MinHash bands over overlapping windows find templates, exact containment confirms them.

Texts become runs of three words. A template with t of them belongs to the class of the power of two L
that is at least t; for this class a text is seen through windows of 2 * L runs that begin every L runs,
so an occurrence always lies within a window. If a window holds ``contained`` of a template, their Jaccard
similarity has a known lower bound; the number of bands is chosen so that the chance of meeting in at
least one is ``1 - miss`` or more at that bound. Met pairs are confirmed by counting the template's runs
in the window. Versions tell licences apart: runs with a digit must all be there, however many others are. Every place
of a notice is reported, one after the other also where they share a window; places of one licence are disjoint. One
pass, no shuffle; templates are configuration and travel with the tasks.

Defined results: null and empty texts hold no licence; templates of fewer than three words are refused;
repeated rows get repeated results; extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.wordbytes import find_words, finish, hash_words, over_pieces, window_hashes
from corpusfold.session import ship_package

#: Notices in use.
TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}

#: Bytes between words: ASCII that is neither digit nor letter.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
RUN = 3


@dataclass(frozen=True)
class ScanOptions:
    contained: float = 0.8
    miss: float = 1e-6
    rows: int = 1  #: MinHash values of a band


@dataclass(frozen=True)
class TemplateClass:
    """Templates of one class with the multipliers of its bands; ``keys[band]`` are sorted, ``owner`` says whose they are.

    Of each template its distinct runs, where each stands first, and which of them are decisive.
    """

    stride: int
    names: list[str]
    runs: list[np.ndarray]
    places: list[np.ndarray]
    decisive: list[np.ndarray]
    multipliers: np.ndarray
    keys: np.ndarray
    owner: np.ndarray


def text_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of all texts; row i has ``first[i]:first[i + 1]``, short texts none."""
    words = find_words(texts, lower=True, separators=BREAKS)
    w = window_hashes(hash_words(words), RUN)
    size = np.maximum(0, words.counts - RUN + 1)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(words.first[:-1] - first[:-1], size) + np.arange(first[-1])
    return w[at] if len(at) else np.zeros(0, np.uint64), first


def bands(similarity: float, options: ScanOptions) -> int:
    """So many bands that all of them miss with probability ``miss`` at most."""
    return int(np.ceil(np.log(options.miss) / np.log1p(-(similarity**options.rows))))


def _minima(blocks: np.ndarray, rows: int) -> np.ndarray:
    """Band keys from MinHash values (values x windows)."""
    keys = blocks[::rows].copy()
    for k in range(1, rows):
        keys = finish(keys + blocks[k::rows])
    return keys


def _decisive(text: str) -> np.ndarray:
    """Hashes of the runs that name a number."""
    words = find_words(pa.array([text]), lower=True, separators=BREAKS)
    hashes = window_hashes(hash_words(words), RUN)
    numbered = [any(c.isdigit() for i in range(at, at + RUN) for c in words.text(i).decode()) for at in range(len(hashes))]
    return np.unique(hashes[np.array(numbered, dtype=bool)])


def compile_templates(templates: dict[str, str], options: ScanOptions) -> list[TemplateClass]:
    by_stride: dict[int, list[tuple[str, tuple[np.ndarray, ...]]]] = {}
    for name, text in sorted(templates.items()):
        runs, _ = text_runs(pa.array([text]))
        if not len(runs):
            raise ValueError(f"template {name} has fewer than {RUN} words")
        by_stride.setdefault(1 << int(len(runs) - 1).bit_length(), []).append((name, (*np.unique(runs, return_index=True), _decisive(text))))
    out = []
    for stride, members in sorted(by_stride.items()):
        least = min(np.ceil(options.contained * len(r)) / (2 * stride + len(r) - np.ceil(options.contained * len(r))) for _, (r, *_) in members)
        count = bands(float(least), options) * options.rows
        multipliers = np.random.default_rng(stride).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = np.stack([_minima(np.array([(r * m).min() for m in multipliers])[:, None], options.rows)[:, 0] for _, (r, *_) in members], axis=1)
        order = np.argsort(keys, axis=1)
        out.append(TemplateClass(
            stride, [n for n, _ in members], *(list(parts) for parts in zip(*(m for _, m in members))), multipliers, np.take_along_axis(keys, order, 1), order
        ))
    return out


def candidates(runs: np.ndarray, first: np.ndarray, c: TemplateClass, options: ScanOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of windows, and the template each of them met."""
    size = np.diff(first)
    blocks = -(-size // c.stride)
    row = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[:-1][row] + number * c.stride
    end = np.minimum(begin + 2 * c.stride, first[1:][row])
    if not len(begin):
        return begin, end, begin
    last = np.append(row[1:] != row[:-1], True)
    met = []
    for i in range(0, len(c.multipliers), options.rows):
        values = []
        for m in c.multipliers[i : i + options.rows]:
            low = np.minimum.reduceat(runs * m, begin)
            joined = low.copy()
            joined[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
            values.append(joined)
        key = _minima(np.stack(values), options.rows)[0]
        known, owner = c.keys[i // options.rows], c.owner[i // options.rows]
        lo, hi = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
        for w in np.flatnonzero(hi > lo).tolist():
            met.extend(w * len(c.names) + int(owner[j]) for j in range(lo[w], hi[w]))
    pairs = np.unique(np.array(met, dtype=np.int64))
    window, template = pairs // len(c.names), pairs % len(c.names)
    return begin[window], end[window], template


def occurrences(part: np.ndarray, c: TemplateClass, t: int, options: ScanOptions) -> list[tuple[float, int, int]]:
    """Containment, first and last run of every place of a template among the runs of a window."""
    own = c.runs[t]
    at = np.minimum(np.searchsorted(own, part), len(own) - 1)
    inside = np.flatnonzero(own[at] == part)

    def share(of: np.ndarray) -> float:
        held = np.unique(part[of])
        return len(held) / len(own) if np.isin(c.decisive[t], held).all() else 0.0

    whole = share(inside)
    if whole < options.contained:
        return []
    # a place ends where the runs of the template begin anew; if none holds enough, the window as a whole does
    groups = np.split(inside, np.flatnonzero(np.diff(c.places[t][at[inside]]) <= 0) + 1)
    found = [(s, int(g[0]), int(g[-1])) for g in groups if (s := share(g)) >= options.contained]
    return found or [(whole, int(inside[0]), int(inside[-1]))]


def _disjoint(places: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The best of places that overlap, the first of equally good ones, in order."""
    kept: list[tuple[float, int, int]] = []
    for place in sorted(set(places), key=lambda p: (-p[0], p[1], p[2])):
        if all(place[2] <= other[1] or other[2] <= place[1] for other in kept):
            kept.append(place)
    return sorted(kept, key=lambda p: p[1])


def _scan(classes: list[TemplateClass], options: ScanOptions):
    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        runs, first = text_runs(piece.column("text"))
        found: list[dict[str, list[tuple[float, int, int]]]] = [{} for _ in range(piece.num_rows)]
        for c in classes:
            for begin, end, t in zip(*(x.tolist() for x in candidates(runs, first, c, options))):
                places = occurrences(runs[begin:end], c, t, options)
                if places:
                    row = int(np.searchsorted(first, begin, side="right")) - 1
                    here = begin - int(first[row])
                    found[row].setdefault(c.names[t], []).extend((s, here + a, here + b + RUN) for s, a, b in places)
        rows = [
            [{"license": n, "containment": s, "begin": b, "end": e} for n, places in sorted(f.items()) for s, b, e in _disjoint(places)]
            for f in found
        ]
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    return over_pieces(make, "text")


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, id: str = "doc_id", text: str = "text", options: ScanOptions = ScanOptions()) -> DataFrame:
    """doc_id and matches (license, containment, begin and end in words) of every place, sorted by license and begin."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "array<struct<license:string,containment:double,begin:bigint,end:bigint>>"
    return rows.mapInArrow(_scan(compile_templates(templates, options), options), f"doc_id long, matches {kind}")
