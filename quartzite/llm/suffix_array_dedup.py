"""Passage deduplication with sparse suffix arrays.

Only suffixes that start at content-selected minimiser positions are retained (see repeats; about one word in 22 for
passages of 50 words), every such position of a run, and of equal surroundings only the first. The suffixes of many shards, of
one minimiser each, are sorted together to the right, and their beginnings to the left, and neighbours in either order are compared.
A passage that starts o words before its minimiser extends o words to the left and the rest to the right: two passages are
equal if no pair of neighbours between their suffixes shares less to the right, and none between their beginnings less to the
left. So the places of each o fall into classes, and all but the first place of a class are repeated. Words are compared as such.

Defined results: as for substring deduplication, with passages in place of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import window_hashes, word_digests
from .repeats import GRAM, GROUP, cut_repeats

PASSAGE = 50


def neighbours(words: np.ndarray, group: np.ndarray, at: np.ndarray, step: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the word sequences that start at `at` and go on by `step`, `length` words long, within their groups; how many words each shares with the one before it (-1 across groups)."""
    reach = np.arange(int(length.max(initial=0)))
    rows = np.zeros((len(at), len(reach) + 1), ">i4")
    rows[:, 0] = group
    inside = reach < length[:, None]
    rows[:, 1:][inside] = words[(at[:, None] + step * reach)[inside]]
    order = np.argsort(rows.view(f"V{rows.shape[1] * 4}").ravel(), kind="stable")
    rows, length = rows[order], length[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) - 1
    return order, np.concatenate([[-1], np.minimum(shared, np.minimum(length[1:], length[:-1]))])


def classes(order: np.ndarray, shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence the number of its class, when neighbours that share `least` words or more belong together, and whether it has company there."""
    together = shared >= least
    number, company = np.empty(len(order), np.int64), np.empty(len(order), bool)
    number[order] = np.cumsum(~together)
    company[order] = together | np.append(together[1:], False)
    return number, company


def matched_before(texts: list[list[str]], group: np.ndarray, window: int, k: int = GRAM) -> list[np.ndarray]:
    """For each content (its words) a mask of its passages that occurred before, in an earlier content of its group or earlier in this one.

    The contents of a group share their least gram, and each of their windows holds it.
    """
    flat = pa.array([w for t in texts for w in t], pa.string())
    words = np.asarray(flat.dictionary_encode().indices).astype(np.int32) + 1
    ends = np.cumsum([0, *map(len, texts)])
    begin, size = ends[:-1], np.diff(ends)
    grams = window_hashes(word_digests(flat)[:, 0], k)
    owner = np.repeat(np.arange(len(texts)), size)
    grams = np.append(grams, np.full(len(words) - len(grams), np.iinfo(np.uint64).max))
    fits = np.arange(len(words)) + k <= ends[1:][owner]
    grams[~fits] = np.iinfo(np.uint64).max
    at = np.flatnonzero(fits & (grams == np.minimum.reduceat(grams, begin)[owner]))
    of = owner[at]
    left, right = np.minimum(at - begin[of], window - k), np.minimum(ends[1:][of] - at, window)
    to_right = neighbours(words, group[of], at, 1, right)
    to_left = neighbours(words, group[of], at - 1, -1, left)
    repeated = np.zeros(len(words), bool)
    for o in range(window - k + 1):
        after, a = classes(*to_right, window - o)
        before, b = classes(*to_left, o)
        rows = np.flatnonzero((left >= o) & (right >= window - o) & a & b)
        _, first, where = np.unique(after[rows] * (len(at) + 1) + before[rows], return_index=True, return_inverse=True)
        repeated[at[rows[first[where] < np.arange(len(rows))]] - o] = True
    return [repeated[x : x + n - window + 1] for x, n in zip(begin.tolist(), size.tolist(), strict=True)]


def deduplicate_passages(docs: DataFrame, window: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, group: int = GROUP) -> DataFrame:
    """Remove each word of a passage of `window` words that also starts earlier: doc_id, n_words, n_removed, text."""
    return cut_repeats(docs, window, lambda contents, group, n: matched_before(contents, group, n, min(k, n)), id_col, text_col, k, group)
