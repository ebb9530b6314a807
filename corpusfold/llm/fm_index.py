"""An FM-index over word sequences in numpy: suffix order, wavelet matrix, matching statistics.

All searches advance together: a step is a handful of array operations over every active pattern.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Wavelet:
    """A wavelet matrix over small integers: packed bits and one count for every 64 of them."""

    def __init__(self, values: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        current = values
        for level in reversed(range(self.levels)):
            bit = (current >> level) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.bits.append(packed)
            self.counts.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        # where each symbol's run begins once all levels are passed
        self.start = self._descend(np.arange(alphabet), np.zeros(alphabet, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = at >> 6
            below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
            ones = self.counts[i][word] + np.bitwise_count(self.bits[i][word] & below)
            bit = (symbols >> (self.levels - 1 - i)) & 1
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbols, at) - self.start[symbols]


class FmIndex:
    """Over the concatenation of ``sequences`` (arrays of symbols from 0 on), each with its own end mark.

    ``weights`` says how often each sequence occurs; occurrences are counted with them.
    """

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        m = len(sequences)
        self.marks = m
        lengths = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        text = np.empty(int(lengths.sum()), dtype=np.int64)
        ends = np.cumsum(lengths) - 1
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[ends] = np.arange(m)
        text[inside] = np.concatenate(sequences) + m
        self._sort(text)
        alphabet = int(text.max()) + 1
        bwt = text[self.order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.wavelet = Wavelet(bwt, alphabet)
        owner = np.repeat(np.arange(m), lengths)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[self.order]])])

    def _sort(self, text: np.ndarray) -> None:
        """Suffix order by doubling, and the common prefix of neighbours from the ranks of each round."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        rounds, step = [rank.astype(np.int32)], 1
        while rank.max() < n - 1:
            later = np.zeros(n, dtype=np.int64)
            later[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + later
            order = np.argsort(key)
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = fresh
            rounds.append(rank.astype(np.int32))
            step *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)
        # lcp[i]: common symbols of the suffixes at i - 1 and i
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(n - 1, dtype=np.int64)
        for k in reversed(range(len(rounds))):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, dtype=bool)
            same[inside] = rounds[k][a[inside]] == rounds[k][b[inside]]
            common[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        # runs are as short as sequences, so small numbers do
        self.lcp = np.concatenate([[-1], common, [-1]]).astype(np.int32 if common.max(initial=0) > 32000 else np.int16)
        # minima over runs of 2**k places, to find the next smaller value on either side
        self.minima = [self.lcp]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= len(self.lcp):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _extend(self, symbols, lo, hi):
        return (
            self.before[symbols] + self.wavelet.rank(symbols, lo),
            self.before[symbols] + self.wavelet.rank(symbols, hi),
        )

    def _parent(self, lo, hi):
        """The interval [lo, hi) of a pattern becomes that of its longest prefix which occurs more often."""
        depth = np.maximum(self.lcp[lo], self.lcp[hi]).astype(np.int64)
        left, right = lo.copy(), hi.copy()
        for k in reversed(range(len(self.minima))):
            width, low = 1 << k, self.minima[k]
            # rows of [left - width + 1, left] all share the prefix: step over them
            start = left - width + 1
            ok = start >= 0
            ok[ok] = low[start[ok]] >= depth[ok]
            left[ok] -= width
            ok = right < len(low)
            ok[ok] = low[right[ok]] >= depth[ok]
            right[ok] += width
        return left, right, depth

    def matching_statistics(self, sequences: list[np.ndarray], least: int = 1) -> list[np.ndarray]:
        """For every place of every sequence, the longest run of words from there that occurs twice or more.

        Only runs of ``least`` words or more have to be right: a sequence is left as soon as no place
        further to the front can begin one, and what was not visited counts as zero.
        """
        m, n = len(sequences), len(self.order)
        length = np.array([len(s) for s in sequences], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(length)])
        flat = np.concatenate([*sequences, np.zeros(0, dtype=np.int64)]).astype(np.int64) + self.marks
        found = np.zeros(len(flat), dtype=np.int64)
        lo, hi, depth = np.zeros(m, dtype=np.int64), np.full(m, n, dtype=np.int64), np.zeros(m, dtype=np.int64)
        alive = length >= least
        for back in range(1, int(length.max(initial=0)) + 1):
            at = np.flatnonzero(alive & (length >= back))
            open_ = at
            while len(open_):
                symbols = flat[first[open_ + 1] - back]
                a, b = self._extend(symbols, lo[open_], hi[open_])
                good = self.weight[b] - self.weight[a] >= 2
                rows = open_[good]
                lo[rows], hi[rows] = a[good], b[good]
                depth[rows] += 1
                # the empty run does not extend: the word itself occurs once
                bad = open_[~good]
                bad = bad[depth[bad] > 0]
                lo[bad], hi[bad], depth[bad] = self._parent(lo[bad], hi[bad])
                # the run that is left ends here; all runs from further to the front end before
                alive[bad] = length[bad] - back + 1 + depth[bad] >= least
                open_ = bad[alive[bad]]
            done = at[alive[at]]
            found[first[done + 1] - back] = depth[done]
            alive[done] = length[done] - back + np.maximum(depth[done], 0) >= least
        return [found[a:b] for a, b in zip(first[:-1], first[1:])]
