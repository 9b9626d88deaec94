"""FM-index over a sequence of symbols: backward search and location of phrases."""

from __future__ import annotations

import numpy as np

from .wavelet import WaveletMatrix

SAMPLE = 8


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; the sequence must end suffixes by distinct symbols."""
    n = len(ranks)
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
    return order


class FMIndex:
    """Runs of symbols (1 and up) in one index; phrases never match across runs.

    The last column is held as a wavelet matrix. Every SAMPLE-th place and every run's start
    keep their suffix positions; others are found by steps back to one of these.
    """

    def __init__(self, runs: np.ndarray, offsets: np.ndarray, symbols: int):
        sizes = np.diff(offsets)
        text = np.zeros(len(runs) + len(sizes), np.int64)
        ends = offsets[1:] + np.arange(len(sizes))
        starts = ends - sizes
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = runs
        self.n, self.symbols = len(text), symbols
        distinct = np.where(body, text + len(sizes), 0)
        distinct[ends] = np.arange(len(sizes))
        order = suffix_array(distinct)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.last = WaveletMatrix.build(last.astype(np.uint32), max(int(symbols).bit_length(), 1))
        kept = (order % SAMPLE == 0) | np.isin(order, starts)
        self.kept = kept
        self.place = np.cumsum(kept) - 1
        self.positions = order[kept]
        self.to_run = np.cumsum(body) - body  # place in `runs` of each place in the text

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are aligned to the right."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(width):
            at = np.flatnonzero((sizes > step) & (low < high))
            if not len(at):
                break
            symbol = phrases[at, width - 1 - step]
            base = self.first[symbol]
            low[at], high[at] = base + self.last.rank(symbol, low[at]), base + self.last.rank(symbol, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in `runs` where the suffixes of these rows start."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.kept[rows])
        while len(left):
            symbol = self.last.access(rows[left])
            rows[left] = self.first[symbol] + self.last.rank(symbol, rows[left])
            steps[left] += 1
            left = left[~self.kept[rows[left]]]
        return self.to_run[self.positions[self.place[rows]] + steps]
