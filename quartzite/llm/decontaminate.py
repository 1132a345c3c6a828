"""Benchmark decontamination through an FM-index of each training shard.

Documents never move: each task indexes its own documents shard by shard (SLICE_BYTES of text each) and searches all
distinct benchmark phrases in the index, whatever the number of items that share one. Only words that occur in the benchmark can lie inside a match, so a shard's text for the
index is its runs of such words, without those shorter than the shortest phrase. Phrases are found by backward search
through wavelet-tree ranks and located by sampled suffix positions; the places are merged into spans of words.

The benchmark is the stated query set: it is read in blocks of ITEMS_PER_BLOCK items, and each block is one more pass over the
documents, written before the next one, so what the driver and a task hold is bounded by a block.

Defined results: a null text or item has no words; an item without words matches nothing; items with the same id count
once, in any of their texts; items with a null id are searched like others, mark their words, and together add one null to
items; item ids may be of any type that has an order; repeated rows are judged each on its own; empty tables give no rows or no hits; only id and text are read unless `clean` is asked for, which keeps every column of the documents as it is, but for the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import ALNUM_WORD, bounded_batches, materialise, text_slices, word_lists
from .fm_index import FMIndex

WINDOW = 10
ITEMS_PER_BLOCK = 20_000
#: Items and spans in the rows that a task holds before it hands them on, and lists of items that it keeps for texts with the same phrases.
HELD, LISTS = 200_000, 64
FOUND = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:int,stop:int>>,items:array<ID>>"


def phrases_of(items: list[tuple], window: int) -> tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]], list[list[int]], list]:
    """The vocabulary; for each phrase length the distinct phrases (a matrix of symbols, from 1) and their numbers; the items of each phrase, as places among the item ids; these ids."""
    offsets, flat = word_lists(pa.array([t for _, t in items], pa.string()), "alnum")
    coded = flat.dictionary_encode()
    symbols = np.asarray(coded.indices).astype(np.int64) + 1
    ids = list(dict.fromkeys(item for item, _ in items))
    place = {item: k for k, item in enumerate(ids)}
    having: dict[tuple, set] = {}
    for (item, _), a, b in zip(items, offsets[:-1], offsets[1:], strict=True):
        size = min(window, b - a)
        for i in range(a, b - size + 1 if size else a):
            having.setdefault(tuple(symbols[i : i + size]), set()).add(place[item])
    rows: dict[int, list] = {}
    for number, phrase in enumerate(having):
        rows.setdefault(len(phrase), []).append((phrase, number))
    return coded.dictionary, {n: (np.array([p for p, _ in x]), np.array([k for _, k in x], np.int64)) for n, x in sorted(rows.items())}, [sorted(x) for x in having.values()], ids


def scan(texts: pa.Array, vocabulary: pa.Array, phrases: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """Offsets of the shard's words, whether each word is hit, and the distinct (text, phrase) pairs found, in order."""
    offsets, flat = word_lists(texts, "alnum")
    hit, pairs = np.zeros(len(flat) + 1, np.int32), []
    if not len(flat) or not phrases:
        return offsets, hit[:-1] > 0, np.zeros((0, 2), np.int64)
    coded = flat.dictionary_encode()
    known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1)).astype(np.int64) + 1
    symbols = known[np.asarray(coded.indices)]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    # Runs of known words within one text, none shorter than the shortest phrase.
    edge = np.concatenate([[True], (owner[1:] != owner[:-1]) | ((symbols[1:] == 0) != (symbols[:-1] == 0))])
    begin = np.flatnonzero(edge)
    length = np.diff(np.concatenate([begin, [len(symbols)]]))
    good = (symbols[begin] > 0) & (length >= min(phrases))
    begin, length = begin[good], length[good]
    if not len(begin):
        return offsets, hit[:-1] > 0, np.zeros((0, 2), np.int64)
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1) + np.arange(int((length + 1).sum()))
    text = symbols[np.minimum(at, len(symbols) - 1)]
    text[np.cumsum(length + 1) - 1] = 0
    index = FMIndex(text)
    for size, (rows, numbers) in phrases.items():
        low, high = index.search(rows)
        count = high - low
        which = np.repeat(np.arange(len(rows)), count)
        place = at[index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum())))]
        np.add.at(hit, place, 1)
        np.add.at(hit, place + size, -1)
        pairs.append(np.unique(owner[place] << 32 | numbers[which]))
    found = np.unique(np.concatenate(pairs))
    return offsets, np.cumsum(hit)[:-1] > 0, np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)


def merged_spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)]


def cut(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and what lies between them."""
    words = [m.span() for m in re.finditer(ALNUM_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : words[s["start"]][0]])
        at = words[s["stop"] - 1][1]
    return "".join([*kept, text[at:]])


def _pass(items: list[tuple], window: int, into: int | None = None):
    """One pass over the documents. into: the place among the kept columns that gets the text without the spans; the pass then is the last one."""
    vocabulary, phrases, having, ids = phrases_of(items, window)

    def listed(numbers: np.ndarray, before: list) -> list:
        """The items of some phrases, and those found in earlier passes, in order."""
        found = {ids[k] for n in numbers.tolist() for k in having[n]}
        return sorted(found.union(before), key=lambda x: (x is None, 0 if x is None else x))

    def emitted(part: pa.RecordBatch, out: list[dict]) -> pa.RecordBatch:
        if into is None:
            columns = [pa.array(out, part.schema.field("__found").type) if c == "__found" else part.column(c) for c in part.schema.names]
            return pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        texts = [cut(t, f["spans"]) if f["spans"] else t for t, f in zip(part.column("__text").to_pylist(), out, strict=True)]
        names = [c for c in part.schema.names if c.startswith("__c")]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == f"__c{into}" else part.column(c) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            offsets, hit, pairs = scan(part.column("__text"), vocabulary, phrases)
            bounds = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1))
            start, out, held, lists = 0, [], 0, {}
            for i, old in enumerate(part.column("__found").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                numbers = pairs[bounds[i] : bounds[i + 1], 1]
                if not len(numbers):
                    out.append({"n_words": int(b - a), "n_hit": 0, "spans": [], "items": []} if old is None else old)
                else:
                    own, before = hit[a:b], (old or {}).get("items") or []
                    for s in old["spans"] if old is not None else []:
                        own[s["start"] : s["stop"]] = True
                    key = (numbers.tobytes(), tuple(before))  # texts with the same phrases share a list
                    if key not in lists:
                        if len(lists) >= LISTS:
                            lists.clear()
                        lists[key] = listed(numbers, before)
                    out.append({"n_words": int(b - a), "n_hit": int(own.sum()), "spans": merged_spans(own), "items": lists[key]})
                held += len(out[-1]["items"]) + len(out[-1]["spans"])
                if held > HELD:
                    yield emitted(part.slice(start, len(out)), out)
                    start, out, held = i + 1, [], 0
            if out:
                yield emitted(part.slice(start, len(out)), out)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", clean: bool = False, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, spans (of words, merged), items.

    With clean, instead every column of the documents, the text without the spans.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.columns if clean else [id_col]
    rows = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    kind = FOUND.replace("ID", rows.schema["i"].dataType.simpleString())
    out = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").alias("__text"), F.lit(None).cast(kind).alias("__found"))
    schema, block = out.schema, []
    for row in rows.toLocalIterator():
        if len(block) == items_per_block:
            out, block = materialise(out.mapInArrow(_pass(block, window), schema), "pass"), []
        block.append((row.i, row.t))
    if not clean:
        return out.mapInArrow(_pass(block, window), schema).select(F.col("__c0").alias("doc_id"), "__found.*")
    cleaned = StructType([StructField(f"__c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)])
    return out.mapInArrow(_pass(block, window, kept.index(text_col)), cleaned).toDF(*kept)
