"""Ranked lexical search: WAND over shards of documents.

The items are the stated query set: they are read in blocks of ITEMS_PER_BLOCK, whose vocabulary is known to every task. A first pass over
the documents writes an index, a row for each document: its number of terms, and which terms of the vocabulary it has how often. Counts of
documents and terms over the whole index give the terms' weights. A second pass reads the index alone. A task cuts it into shards of
DOCS documents in the order of their ids, builds the posting lists of a shard and the largest score that a term reaches in it, and runs
WAND for all items at once, a step of each at a time: the cursors of an item are sorted by the document they stand at, the largest scores
are summed up along them, and the first document at which the sum reaches the least score of the item's heap is the pivot. What lies before
it is skipped; the pivot is scored if the first cursor stands at it. A task's heap goes on from shard to shard, and what is left of it at
the end meets the other tasks' heaps, in two steps, so that no key gathers them all at once.

A score is the sum over an item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)), where w is floor(1000 ln((2N+2)/(2df+1)))
and m is 25 + (75 n N) div L, in whole numbers but for the logarithm.

Defined results: a null text or item has no terms; a document without terms is no document, an item without any finds nothing; rows of
equal or null ids count as documents, or items, of their own; equal scores stand by rising id, null ids last; empty tables give no rows.
Other columns are not read. Ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialise, text_slices, word_lists

TOP = 10
ITEMS_PER_BLOCK = 20_000
#: Documents of a shard.
DOCS = 4096
#: Cursors that a task moves at once: items by their numbers of terms.
CELLS = 1 << 17
#: Heaps of tasks are merged in so many parts first.
PARTS = 64


def indexed(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """A row for each document that has terms: doc_id, n (its terms), terms (places in the vocabulary, rising) and tfs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, flat = word_lists(part.column("text"), "alnum")
            coded = flat.dictionary_encode()
            known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1)).astype(np.int64)
            symbols = known[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64)
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            pairs, counts = np.unique((owner[symbols >= 0] << 32) | symbols[symbols >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs >> 32, np.arange(len(size) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, counts)]
            out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(size > 0))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def length_norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    if int(n.max(initial=0)) * 75 * docs < 1 << 63:
        return 25 + 75 * n * docs // total
    return np.array([25 + 75 * x * docs // total for x in n.tolist()], np.int64)


class Shard:
    """Posting lists of a shard: documents (numbered from 0) and scores of each term, for one occurrence in the item."""

    def __init__(self, size: int, terms: np.ndarray, docs: np.ndarray, scores: np.ndarray):
        order = np.lexsort((docs, terms))
        self.size, self.docs, self.scores = size, docs[order], scores[order]
        terms = terms[order]
        self.names, self.begin = np.unique(terms, return_index=True)
        self.end = np.append(self.begin[1:], len(terms))
        self.most = np.maximum.reduceat(self.scores, self.begin) if len(terms) else self.scores
        # A key of list and document, so that all cursors can be moved by one search.
        self.keys = np.repeat(np.arange(len(self.names)), self.end - self.begin) * (size + 1) + self.docs

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """The places of terms among the lists; -1 where the shard lacks one."""
        if not len(self.names):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        return np.where(self.names[at] == terms, at, -1)


def wand(shard: Shard, lists: np.ndarray, times: np.ndarray, heaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """WAND for several items at once. lists: an item's posting lists, -1 for none; times: how often the item has each term; heaps: the best scores that each item
    has so far, zeros where there are less; they are brought up to date. Returns items, documents and scores that reach the least score of their heap when they are met."""
    found: list[tuple] = []
    items = np.arange(len(lists))
    most = np.where(lists >= 0, shard.most[np.maximum(lists, 0)], 0) * times if len(shard.names) else np.zeros(lists.shape, np.int64)
    at = np.where(lists >= 0, shard.begin[np.maximum(lists, 0)], 0) if len(shard.names) else np.zeros(lists.shape, np.int64)
    while len(items):
        live = lists >= 0
        live &= at < shard.end[np.maximum(lists, 0)] if len(shard.names) else False
        here = np.where(live, shard.docs[np.minimum(at, len(shard.docs) - 1)] if len(shard.docs) else 0, shard.size)
        order = np.argsort(here, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(np.where(live, most, 0), order, axis=1), axis=1)
        least = np.maximum(heaps[items].min(axis=1), 1)
        reaches = sums >= least[:, None]
        goes_on = reaches[:, -1]
        if not goes_on.all():
            items, lists, times, most, at, here, order, reaches, least, live = (x[goes_on] for x in (items, lists, times, most, at, here, order, reaches, least, live))
            if not len(items):
                break
        rows = np.arange(len(items))
        pivot = here[rows, order[rows, reaches.argmax(axis=1)]]
        ready = here[rows, order[rows, 0]] == pivot
        # Score the pivots that all cursors before them have reached.
        on = (here == pivot[:, None]) & live
        score = (np.where(on, shard.scores[np.minimum(at, len(shard.scores) - 1)], 0) * times).sum(axis=1)
        good = np.flatnonzero(ready & (score >= least))
        if len(good):
            found.append((items[good], pivot[good], score[good]))
            heap = heaps[items[good]]
            place = heap.argmin(axis=1)
            k = np.arange(len(good))
            heap[k, place] = np.maximum(heap[k, place], score[good])
            heaps[items[good]] = heap
        # Cursors before the pivot go to it or beyond it; those of scored pivots go beyond.
        step = (ready[:, None] & on) | (~ready[:, None] & live & (here < pivot[:, None]))
        target = np.broadcast_to((pivot + ready)[:, None], step.shape)[step]
        at[step] = np.searchsorted(shard.keys, lists[step] * (shard.size + 1) + target)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def groups_of(items: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items (terms, times) as matrices of like width, at most so many cells each (or one item): item numbers, terms (-1 where there is none), times."""
    order = sorted((i for i in range(len(items)) if len(items[i][0])), key=lambda i: len(items[i][0]))
    out, start = [], 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * len(items[order[stop]][0]) <= cells:
            stop += 1
        chosen = order[start:stop]
        width = len(items[chosen[-1]][0])
        terms, times = np.full((len(chosen), width), -1, np.int64), np.zeros((len(chosen), width), np.int64)
        for row, i in enumerate(chosen):
            terms[row, : len(items[i][0])], times[row, : len(items[i][0])] = items[i]
        out.append((np.array(chosen), terms, times))
        start = stop
    return out


def by_rank(entry: tuple) -> tuple:
    """Order of (score, id) pairs: the larger score first, then the smaller id, null ids last."""
    return (-entry[0], entry[1] is None, 0 if entry[1] is None else entry[1])


def _search(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int, shard_docs: int, kind: str) -> DataFrame:
    """The heaps of all tasks: item (its place in the block), doc_id, score."""
    groups = groups_of(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        heaps = [np.zeros((len(g[0]), top), np.int64) for g in groups]
        for batch in batches:
            for start in range(0, batch.num_rows, shard_docs):
                part = batch.slice(start, shard_docs)
                part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_end"))
                size = np.diff(np.asarray(part.column("terms").offsets))
                docs = np.repeat(np.arange(part.num_rows), size)
                terms = part.column("terms").flatten().to_numpy().astype(np.int64)
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                m = length_norms(part.column("n").to_numpy(), n_docs, n_terms)[docs]
                shard = Shard(part.num_rows, terms, docs, weights[terms] * (10**9 * tf // (1000 * tf + 8 * m)))
                for (numbers, wanted, times), heap in zip(groups, heaps, strict=True):
                    lists = np.where(wanted >= 0, shard.lists(wanted), -1)
                    rows, where, scores = wand(shard, lists, times, heap)
                    if not len(rows):
                        continue
                    ids = part.column("doc_id").take(pa.array(where)).to_pylist()
                    new: dict[int, list] = {}
                    for row, doc, score in zip(rows.tolist(), ids, scores.tolist(), strict=True):
                        new.setdefault(row, []).append((score, doc))
                    for row, entries in new.items():
                        number = int(numbers[row])
                        best[number] = sorted([*best.get(number, []), *entries], key=by_rank)[:top]
        rows = [(number, doc, score) for number, entries in best.items() for score, doc in entries]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(index.schema["doc_id"].dataType)
    return index.mapInArrow(run, f"item long, doc_id {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", items_per_block: int = ITEMS_PER_BLOCK, shard_docs: int = DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best `top` documents of each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = queries.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    item_kind, doc_kind = asked.schema["i"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    block: list[tuple] = []

    def found(block: list[tuple]) -> DataFrame:
        offsets, flat = word_lists(pa.array([t for _, t in block], pa.string()), "alnum")
        coded = flat.dictionary_encode()
        symbols = np.asarray(coded.indices).astype(np.int64)
        items = [np.unique(symbols[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        index = materialise(indexed(docs, coded.dictionary, id_col, text_col), "index")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        weights = np.zeros(len(coded.dictionary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
            weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        heaps = _search(index, items, weights, n_docs, n_terms, top, shard_docs, doc_kind)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for by in (["item", "part"], ["item"]):
            heaps = heaps if by == ["item"] else heaps.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
            heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item long, item_id {item_kind}")
        return heaps.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: a block of items

    for row in asked.toLocalIterator():
        if len(block) == items_per_block:
            out, block = out.unionByName(materialise(found(block), "found")), []
        block.append((row.i, row.t))
    return out.unionByName(found(block)) if block else out
