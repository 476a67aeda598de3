"""An FM-index over word numbers: Burrows-Wheeler transform, wavelet matrix and backward search in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: 64 bits a word, and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, highest first, the bits of all symbols in the order of the bits before."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels, self.zeros = [], []
        for bit in range(depth - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before two places. `first`: where each symbol's run begins on the last level."""
        depth = len(self.levels)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (depth - 1 - level)) & 1 == 1
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return low - first[symbol], high - first[symbol]


class FMIndex:
    """An index of word sequences for search of patterns of up to `width` words.

    Suffixes are sorted by their first words only, as far as patterns reach. Each sequence carries an
    owner; the smallest owner of any pattern of exactly `width` words is known after its search.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, width: int):
        self.width = width
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        self.vocabulary, ids = np.unique(np.concatenate(sequences), return_inverse=True)
        text[inside] = ids + 1  # 0 ends a sequence
        rank, ranks, span = text, {}, 1
        ranks[1] = rank
        while span < width:
            rank = self._join(rank, rank, span)
            span *= 2
            ranks[span] = rank
        order = np.argsort(rank, kind="stable")
        self.size = len(text)
        shifted = np.concatenate([text[-1:], text[:-1]])
        last = shifted[order]
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.first = np.cumsum(counts) - counts
        depth = max(1, int(len(self.vocabulary)).bit_length())
        self.wavelet = Wavelet(last, depth)
        # where each symbol's run begins after the last level: symbols in order of their reversed bits
        symbols = np.arange(len(counts))
        reverse = np.zeros(len(counts), np.int64)
        for bit in range(depth):
            reverse |= ((symbols >> bit) & 1) << (depth - 1 - bit)
        by = np.argsort(reverse, kind="stable")
        run = np.zeros(len(counts), np.int64)
        run[by] = np.cumsum(counts[by]) - counts[by]
        self.run = run
        self.short = self._classes(ranks, width - 1, order)
        start, _ = self._classes(ranks, width, order)
        owner = np.repeat(owners, sizes + 1)[order]
        heads = np.unique(start)
        least = np.minimum.reduceat(owner, heads)
        self.least = least[np.searchsorted(heads, start)]

    @staticmethod
    def _join(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of suffixes by `left`, then by `right` of the suffix `shift` words on."""
        moved = np.concatenate([right[shift:], np.zeros(min(shift, len(right)), np.int64)])
        return np.unique(left * (int(right.max()) + 1) + moved, return_inverse=True)[1].astype(np.int64)

    def _classes(self, ranks: dict[int, np.ndarray], width: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the sorted suffixes: first and end of the rows with the same first `width` words."""
        if width == 0:
            return np.zeros(self.size, np.int64), np.full(self.size, self.size)
        half = max(s for s in ranks if s <= width)
        rank = self._join(ranks[half], ranks[half], width - half) if half < width else ranks[half]
        sorted_ = rank[order]
        new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        which = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        return new[which], np.append(new[1:], self.size)[which]

    def stream(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of `width` words of each sequence: the smallest owner that has it, or -1 for none.

        All sequences are read from right to left at once. A state is the range of suffixes that begin
        with the words read, up to `width` of them: the matching statistic as far as it is needed. Where
        a word can't be put in front, the match gives up its last word and is read again.
        """
        sizes = np.array([len(s) for s in sequences], np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(sequences)
        place = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[place] == flat, place + 1, -1)
        found = np.full(len(flat), -1, np.int64)
        live = np.flatnonzero(sizes >= self.width)
        stop, low, high = begin + sizes, np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64)
        at = stop - 1
        while len(live):
            a, b, where = low[live], high[live], at[live]
            full = stop[live] - where - 1 == self.width
            rows = a[full]
            a[full], b[full] = self.short[0][rows], self.short[1][rows]
            stop[live[full]] -= 1
            c = symbol[where]
            known = c > 0
            c = np.where(known, c, 0)
            x, y = self.wavelet.rank(c, a, b, self.run)
            x, y = x + self.first[c], y + self.first[c]
            ok = known & (x < y)
            low[live], high[live] = x, y
            at[live] -= 1
            whole = ok & (stop[live] - where == self.width)
            found[where[whole]] = self.least[x[whole]]
            bad = live[~ok]
            if len(bad):
                # an unknown word ends all windows that hold it; else only the last word is given up
                stop[bad] = np.where(known[~ok], stop[bad] - 1, where[~ok])
                at[bad], low[bad], high[bad] = stop[bad] - 1, 0, self.size
            live = live[(at[live] >= begin[live]) & (stop[live] - begin[live] >= self.width)]
        return [found[b : b + max(0, n - self.width + 1)] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
