"""Words of a batch of texts as numpy arrays: places, lengths and 64-bit hashes, without a loop per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of well-known 64-bit mixers.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S32, _S29 = np.uint64(32), np.uint64(29)
_BLOCK_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
LONG_WORD = 64
PIECE_BYTES = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """``begin`` and ``end`` are byte places in ``data``; words of row i are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each one begins; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find_words(column: pa.Array, *, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(separators[data], out=inside[:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a text begins
    edge[at] = True
    after = np.empty_like(inside)
    after[0] = False
    after[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~after | edge))
    end = np.flatnonzero(after & (~inside | edge))
    return Words(data, begin, end, np.searchsorted(begin, at))


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of every word, from eight bytes at a time; very long words go through xxhash."""
    length = (words.end - words.begin).astype(np.int64)
    padded = np.zeros(len(words.data) + 8, dtype=np.uint8)
    padded[: len(words.data)] = words.data
    blocks = np.ndarray(shape=(len(words.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = length.astype(np.uint64) * M1
    short = length <= LONG_WORD
    active = np.flatnonzero(short)
    step = 0
    while len(active):
        left = length[active] - 8 * step
        block = blocks[words.begin[active] + 8 * step] & _BLOCK_MASKS[np.minimum(left, 8)]
        part = (h[active] ^ (block * M2)) * M3
        h[active] = part ^ (part >> _S32)
        active = active[left > 8]
        step += 1
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(words.text(i))
    return finish(h)


def times(a: np.uint64, b: int) -> np.uint64:
    """A product modulo 2**64."""
    return np.uint64(int(a) * b % 2**64)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S29)) * M2
    return h ^ (h >> _S32)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values, wherever rows end."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(h) - n + 1
    out = h[:size].copy()
    for k in range(1, n):
        out *= M3
        out ^= out >> _S32
        out += h[k : k + size]
    return finish(out)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches at rows so that a piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def over_pieces(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str, limit: int = PIECE_BYTES) -> Callable:
    """A function for ``mapInArrow`` that applies ``make`` to pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, limit):
            made = make(piece)
            if made is not None and made.num_rows:
                yield made

    return run
