"""Substring deduplication with suffix automata.

Documents are streamed through suffix automata of reference shards; after each word the matching statistic is the length of the
longest suffix that the shard has, and spans whose statistic reaches the threshold are removed. There are two forms.

`remove_known` takes a reference of its own (licences, boilerplate, a test set). Shards of SHARD_WORDS words are built into automata
by tasks, written, and broadcast one after the other; each is one more pass over the documents, which carry the spans found so far,
and the table of the pass before is deleted.

`deduplicate_substrings` takes the corpus as its own reference, in which every text counts for those after it. That can't be
broadcast: the automata of a corpus are larger than it is, and every shard would meet every document, work that grows with the
square of the corpus. So shards are made by minimiser (see repeats) and runs are sent to the only shard that can hold their
windows: the reference text of a shard is its distinct candidate runs in the order of their first places, each run is streamed
through the automaton of what came before it, and a window whose last word has a statistic of the window's length or more starts earlier.

Defined results: a null or empty text has no words; a text shorter than the window loses nothing; places are ordered by
id and start, a null id comes last, and rows that share both id and start are not earlier than each other; an empty table
gives no rows; only id and text are read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialise, shuffle_partitions, text_slices, word_lists
from .repeats import GRAM, GROUP, cut_repeats

WINDOW = 20
#: Words of a broadcast automaton (some hundred bytes each).
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """A suffix automaton of several sequences, extended a symbol at a time."""

    def __init__(self, following: list[dict] | None = None, link: list[int] | None = None, length: list[int] | None = None):
        self.next: list[dict] = following or [{}]
        self.link, self.length = link or [-1], length or [0]

    def packed(self) -> bytes:
        """What another process makes the same automaton from."""
        return pickle.dumps((self.next, self.link, self.length))

    def _copy(self, p: int, c, q: int) -> int:
        """A copy of q for the suffixes that end in state p and then c."""
        new = len(self.link)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def extend(self, state: int, c) -> tuple[int, int]:
        """Append c to the sequence that state stands for: its new state, and the longest suffix that occurred before."""
        q = self.next[state].get(c)
        if q is not None:
            if self.length[q] != self.length[state] + 1:
                q = self._copy(state, c, q)
            return q, self.length[q]
        new, p = len(self.link), state
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[state] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new, self.length[self.link[new]]

    def statistics(self, words: list) -> np.ndarray:
        """After each word the length of the longest suffix that the automaton holds; nothing is added to it."""
        following, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, np.empty(len(words), np.int64)
        for i, c in enumerate(words):
            while state and c not in following[state]:
                state = link[state]
                n = length[state]
            to = following[state].get(c)
            if to is not None:
                state, n = to, n + 1
            out[i] = n
        return out


def seen_before(contents: list[list[str]], group: np.ndarray, window: int) -> list[np.ndarray]:
    """For each content a mask of its windows that occurred before: in an earlier content of its group, or earlier in this one."""
    automaton, out = SuffixAutomaton(), []
    for at, words in enumerate(contents):
        if at and group[at] != group[at - 1]:
            automaton = SuffixAutomaton()
        state, statistic = 0, np.empty(len(words), np.int64)
        for i, c in enumerate(words):
            state, statistic[i] = automaton.extend(state, c)
        out.append(statistic[window - 1 :] >= window)
    return out


def deduplicate_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, group: int = GROUP) -> DataFrame:
    """Remove each word that a window covers whose words also start earlier: doc_id, n_words, n_removed, text."""
    return cut_repeats(docs, window, seen_before, id_col, text_col, k, group)


def shards(reference: DataFrame, text_col: str, window: int, words: int) -> DataFrame:
    """words: the distinct texts of a reference, cut into lists of at most so many words that overlap by a window less one; texts shorter than a window hold nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            offsets, flat = word_lists(part.column("text"), lower=False)
            pieces, size = [], 0
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                while b - a >= window:
                    end = min(b, a + words)
                    if pieces and size + end - a > words:
                        yield pa.RecordBatch.from_pylist([{"texts": pieces}], schema=kind)
                        pieces, size = [], 0
                    pieces.append(flat.slice(a, end - a).to_pylist())
                    size += end - a
                    a = end if end == b else end - window + 1
            if pieces:
                yield pa.RecordBatch.from_pylist([{"texts": pieces}], schema=kind)

    kind = pa.schema([("texts", pa.list_(pa.list_(pa.string())))])
    rows = reference.select(F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    return rows.mapInArrow(run, "texts array<array<string>>")


def automaton_of(texts: list[list[str]]) -> SuffixAutomaton:
    automaton = SuffixAutomaton()
    for words in texts:
        state = 0
        for c in words:
            state, _ = automaton.extend(state, c)
    return automaton


def automata(reference: DataFrame, text_col: str, window: int, words: int) -> DataFrame:
    """automaton: the pickled suffix automaton of each shard of a reference, built by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in batch.column("texts"):
                yield pa.RecordBatch.from_pydict({"automaton": pa.array([automaton_of(texts.as_py()).packed()], pa.binary())})

    pieces = materialise(shards(reference, text_col, window, words), "shards")
    return materialise(pieces.repartition(shuffle_partitions(reference.sparkSession)).mapInArrow(run, "automaton binary"), "automata")


#: The automaton that a worker process has at hand, with its name.
_LOADED: dict[str, SuffixAutomaton] = {}


def loaded(name: str, raw: bytes) -> SuffixAutomaton:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = SuffixAutomaton(*pickle.loads(raw))
    return _LOADED[name]


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", reference_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Remove from each document every word of a maximal span of at least `window` words that a reference text holds: doc_id, n_words, n_removed, text (of the kept words, joined by one space).

    A null text has no words, in documents and in the reference; an empty reference removes nothing; ids may be null and repeat, and be of any type; only id and text are read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spans = "array<struct<a:int,b:int>>"
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast(spans).alias("spans"))
    schema = out.schema

    def found(held, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = loaded(name, held.value)
            for part in text_slices(batches):
                offsets, flat = word_lists(part.column("text"), lower=False)
                words, rows = flat.to_pylist(), []
                for a, b, old in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("spans").to_pylist(), strict=True):
                    ends = np.flatnonzero(automaton.statistics(words[a:b]) >= window) if b - a >= window else []
                    new = old
                    if len(ends):
                        breaks = np.flatnonzero(np.diff(ends) > 1)
                        first, last = ends[np.concatenate([[0], breaks + 1])], ends[np.concatenate([breaks, [len(ends) - 1]])]
                        new = [*old, *({"a": int(x) - window + 1, "b": int(y) + 1} for x, y in zip(first, last, strict=True))]
                    rows.append(new)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(rows, part.schema.field("spans").type)], names=["doc_id", "text", "spans"])

        return out.mapInArrow(run, schema)

    before = None
    for row in automata(reference, reference_text, window, shard_words).toLocalIterator():  # one automaton of bounded size at a time
        held = spark.sparkContext.broadcast(bytes(row.automaton))
        out = materialise(found(held, uuid.uuid4().hex), "known")
        held.unpersist()
        if before is not None:
            discard(before)
        before = out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, flat = word_lists(part.column("text"), lower=False)
            gone = np.zeros(len(flat) + 1, np.int32)
            for a, own in zip(offsets[:-1].tolist(), part.column("spans").to_pylist(), strict=True):
                for s in own:
                    gone[a + s["a"]] += 1
                    gone[a + s["b"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(ends)), pc.binary_join(kept, " ")], names=["doc_id", "n_words", "n_removed", "text"])

    return out.mapInArrow(cut, f"doc_id {schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, text string")
