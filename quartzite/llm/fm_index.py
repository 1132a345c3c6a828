"""An FM-index over integer symbols: suffix order, wavelet-tree ranks, backward search and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order. Symbol 0 ends a run; such ends count as distinct, so no comparison goes beyond a run."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * np.int64(n + int(text.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


def packed(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits as 64-bit words, and how many are set before each word."""
    octets = np.packbits(bit, bitorder="little")
    words = np.zeros(len(bit) // 64 + 1, np.uint64)
    words.view(np.uint8)[: len(octets)] = octets
    return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])


class WaveletTree:
    """Level-wise wavelet tree with packed bits: rank and access for vectors of positions."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.n, self.levels = len(symbols), []
        s = symbols
        for shift in range(self.bits - 1, -1, -1):
            bit = ((s >> shift) & 1).astype(np.uint8)
            self.levels.append((*packed(bit), len(bit) - int(bit.sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    @staticmethod
    def ones(level: tuple, at: np.ndarray) -> np.ndarray:
        words, counts = level[:2]
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[w] + np.bitwise_count(words[w] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        first = np.zeros_like(at)
        for i, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            a, b = self.ones(level, first), self.ones(level, at)
            first = np.where(one, level[2] + a, first - a)
            at = np.where(one, level[2] + b, at - b)
        return at - first

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in self.levels:
            words = level[0]
            one = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            a = self.ones(level, at)
            at = np.where(one, level[2] + a, at - a)
            symbol = symbol * 2 + one
        return symbol


class FMIndex:
    """text: symbols from 1 up, each run ended by 0. sample: every so many positions of a run keep their place; a bit of each suffix tells which do."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        n = len(text)
        order = suffix_order(text)
        self.top = int(text.max(initial=0))
        self.tree = WaveletTree(text[order - 1] if n else text, self.top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))]).astype(np.int64)
        begins = np.concatenate([[True], text[:-1] == 0]) if n else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(begins, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        marked = ((order - start[order]) % sample == 0) if n else np.zeros(0, bool)
        self.n, self.marked, self.places = n, packed(marked), order[marked].astype(np.int32 if n < 1 << 31 else np.int64)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (a matrix, a row each; symbols may exceed those of the text) at once: ranges of suffixes."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases <= self.top).all(axis=1))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, column]
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            dead = low[alive] >= high[alive]
            alive = alive[~dead]
        found = np.zeros(len(phrases), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text to the nearest sampled position."""
        out, rows, todo = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(todo):
            at = rows[todo]
            done = (self.marked[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            out[todo[done]] = self.places[WaveletTree.ones(self.marked, at[done])] + steps
            todo = todo[~done]
            c = self.tree.access(rows[todo])
            rows[todo] = self.first[c] + self.tree.rank(c, rows[todo])
            steps += 1
        return out
