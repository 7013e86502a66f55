"""FM-index over sequences of integer symbols, for many patterns at a time.

The text is a run of segments, each ended by the separator 0, which no pattern holds. Suffixes are
sorted by prefix doubling (separators differ by position, so a comparison ends at the segment's end;
only ranks that are still shared are sorted again). The Burrows-Wheeler transform is kept as a wavelet
matrix whose bit vectors answer rank from counts per 64-bit word; suffix positions are kept for every
``sample``-th position and each segment start, others are reached by stepping back through the text.
"""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes."""
    n = len(seq)
    seq = seq.astype(np.int64)
    sep = seq == 0
    count = int(sep.sum())
    rank = np.where(sep, np.cumsum(sep) - 1, seq + count)
    bits = max(1, int(rank.max()).bit_length()) if n else 1
    together = max(1, 62 // bits)
    together = 1 << (together.bit_length() - 1)
    key = rank.copy()
    # behind a separator the order is settled, so what the key takes from the next segment does no harm
    for i in range(1, together):
        key = (key << bits) | np.concatenate([rank[i:], np.zeros(min(i, n), np.int64)])[:n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.empty(n, bool)
    if n:
        new[0] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0)) if n else place
    rank = np.empty(n, np.int64)
    rank[order] = first
    width = together
    single = new & np.append(new[1:], True) if n else new
    open_at = place[~single]
    while len(open_at):
        suffix = order[open_at]
        ahead = suffix + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[suffix]
        o = np.lexsort((second, group))
        suffix, second, group = suffix[o], second[o], group[o]
        order[open_at] = suffix
        new = np.empty(len(o), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[suffix] = np.maximum.accumulate(np.where(new, open_at, 0))
        open_at = open_at[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        """``seq`` holds symbols below ``sigma`` and ends with a separator."""
        n = self.n = len(seq)
        order = suffix_order(seq)
        bwt = seq[order - 1].astype(np.int64)  # position 0 takes the last symbol, a separator
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        here = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((here >> level) & 1).astype(bool)
            words = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(n - int(bit.sum()))
            here = np.concatenate([here[~bit], here[bit]])
        starts = np.zeros(n, bool)
        if n:
            starts[0] = True
            starts[1:] = seq[:-1] == 0
        kept = (order % sample == 0) | starts[order]
        packed = np.packbits(np.append(kept, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
        self.kept, self.kept_count = packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
        self.sampled = order[kept]

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return counts[word] + np.bitwise_count(low).astype(np.int64)

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with each symbol followed by what its rows ``lo:hi`` begin with."""
        base = self.start[symbols]
        begin = np.zeros_like(lo)
        for level in range(self.levels):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            for_all = [self._ones(self.words[level], self.counts[level], x) for x in (lo, hi, begin)]
            lo, hi, begin = (np.where(one, self.zeros[level] + r, x - r) for x, r in zip((lo, hi, begin), for_all))
        return base + lo - begin, base + hi - begin

    def _symbol_and_rank(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, at, begin = np.zeros_like(rows), rows, np.zeros_like(rows)
        for level in range(self.levels):
            word = at >> 6
            one = ((self.words[level][word] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, b = (self._ones(self.words[level], self.counts[level], x) for x in (at, begin))
            at, begin = np.where(one, self.zeros[level] + a, at - a), np.where(one, self.zeros[level] + b, begin - b)
            symbol = (symbol << 1) | one
        return symbol, at - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern; ``patterns`` has one row a pattern, all of one length."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            lo[live], hi[live] = self.step(patterns[live, column].astype(np.int64), lo[live], hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        at, steps, out = rows.astype(np.int64).copy(), 0, np.zeros(len(rows), np.int64)
        wait = np.arange(len(rows))
        while len(wait):
            here = at[wait]
            known = ((self.kept[here >> 6] >> (here & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            done = here[known]
            out[wait[known]] = self.sampled[self._ones(self.kept, self.kept_count, done)] + steps
            wait = wait[~known]
            symbol, rank = self._symbol_and_rank(at[wait])
            at[wait] = self.start[symbol] + rank
            steps += 1
        return out

    def maximal(self, seq: np.ndarray) -> np.ndarray:
        """For each position of ``seq`` (separators allowed) the length of the longest run of symbols that
        ends there, exclusive of separators, and occurs in the text."""
        n = len(seq)
        length = np.zeros(n, np.int64)
        at = np.arange(n)
        live = at[seq > 0]
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        reach = 0
        while len(live):
            back = live - reach
            ok = back >= 0
            live, back = live[ok], back[ok]
            ok = seq[back] > 0
            live, back = live[ok], back[ok]
            if not len(live):
                break
            lo[live], hi[live] = self.step(seq[back].astype(np.int64), lo[live], hi[live])
            live = live[lo[live] < hi[live]]
            reach += 1
            length[live] = reach
        return length


def spread_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the ranges, and which range each comes from."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which
