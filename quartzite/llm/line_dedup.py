"""Line deduplication with two Bloom filters.

Pass one marks in each task which hashed keys it has seen once and which twice; merging two tasks' filters marks as seen
twice what either has seen twice and what both have seen. A task holds the bits of FLUSH keys at most and ships positions, not
filters, and each merging task owns a range of both filters, of MERGED bits at most, so nothing grows with the number of tasks.
Pass two emits only the lines whose bits are all set in the second filter, aggregated before the shuffle, and confirms them
exactly on 128-bit digests with their number of documents and their first document. Pass three drops the confirmed lines.

The filters have 16 bits for each line that the files' sizes suggest, up to MAX_BITS (128 MB each); beyond that more lines are
suspected and shuffled, and the result stays the same. Confirmed keys are broadcast while they have at most BROADCAST_BYTES;
beyond, each document gets its own confirmed keys through a join on its id.

Defined results: a null or empty text is one empty line; an empty key is never dropped; a key counts once a row, however
often it repeats in it; rows with equal ids count each; a document with a null id is never a first place; ids may be of any
type that has an order; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, is_small, materialise, shuffle_partitions, signed, text_bytes, text_slices

MAX_BITS = 1 << 30
CHUNK = 1 << 16
#: Bits of each filter that a merging task owns.
MERGED = 1 << 25
#: Bit positions that a task gathers before it ships them (8 bytes each).
FLUSH = 4_000_000
HASHES = 2
BITS_PER_LINE = 16
#: Bytes of a line, roughly.
LINE_BYTES = 40


def lines_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lists = pc.split_pattern(pc.fill_null(texts, ""), pattern="\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return offsets - offsets[0], lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def digests(lines: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's key code, and each code's 128-bit digest as a row of two numbers; codes whose key is too short are not usable."""
    coded = pc.ascii_lower(pc.ascii_trim_whitespace(lines)).dictionary_encode()
    keys = coded.dictionary
    usable = np.asarray(pc.greater_equal(pc.utf8_length(keys), max(min_chars, 1)), dtype=bool)
    raw = b"".join(xxhash.xxh3_128_digest(k) for k in keys.to_pylist())
    return np.asarray(coded.indices).astype(np.int64), np.frombuffer(raw, np.uint64).reshape(-1, 2), usable


def bit_places(digest: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(digest[:, 0] + np.uint64(j) * digest[:, 1]) & np.uint64(bits - 1) for j in range(HASHES)], axis=1).astype(np.int64)


def by_document(offsets: np.ndarray, codes: np.ndarray, n_codes: int) -> np.ndarray:
    """In how many documents of the slice each code occurs."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(np.unique(owner * max(n_codes, 1) + codes) % max(n_codes, 1), minlength=n_codes)


def _chunks(name: str, set_at: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
    """A row for each chunk of a filter in which bits are set (positions in ascending order)."""
    chunk = set_at // CHUNK
    edges = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(set_at)) if len(set_at) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(chunk[a]), name, (set_at[a:b] % CHUNK).astype(np.uint16).tobytes()


def repeated_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that two documents or more seem to have, as a packed bitmap."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for part in text_slices(batches):
            offsets, lines = lines_of(part.column("text"))
            codes, digest, usable = digests(lines, min_chars)
            count = by_document(offsets, codes, len(digest))
            places = bit_places(digest, bits)
            # A position that comes twice may stand for one key of two documents.
            gathered += [places[usable].ravel(), places[usable & (count > 1)].ravel()]
            if sum(map(len, gathered)) >= FLUSH:
                yield shipped(gathered)
                gathered = []
        if any(map(len, gathered)):
            yield shipped(gathered)

    def shipped(gathered: list[np.ndarray]) -> pa.RecordBatch:
        at, count = np.unique(np.concatenate(gathered), return_counts=True)
        rows = [*_chunks("once", at[count == 1]), *_chunks("twice", at[count > 1])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["chunk", "which", "places"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, which, places in zip(*(batch.column(c).to_pylist() for c in ("chunk", "which", "places")), strict=True):
                at = np.frombuffer(places, np.uint16)
                known = twice.setdefault(chunk, np.zeros(CHUNK, bool))
                if which == "twice":
                    known[at] = True
                else:
                    before = once.setdefault(chunk, np.zeros(CHUNK, bool))
                    known[at[before[at]]] = True
                    before[at] = True
        if twice:
            yield pa.RecordBatch.from_arrays([pa.array(list(twice)), pa.array([np.packbits(x, bitorder="little").tobytes() for x in twice.values()])], names=["chunk", "bitmap"])

    parts = max(shuffle_partitions(docs.sparkSession), bits // MERGED)
    merged = docs.mapInArrow(seen, "chunk long, which string, places binary").repartition(parts, "chunk").mapInArrow(merge, "chunk long, bitmap binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most MAX_BITS in all
        bitmap[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(row.bitmap, np.uint8)[: len(bitmap)]
    return bitmap


def filter_bits(docs: DataFrame) -> int:
    wanted, bits = BITS_PER_LINE * text_bytes(docs) // LINE_BYTES, CHUNK
    while bits < min(MAX_BITS, wanted):
        bits *= 2
    return bits


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """docs: doc_id, text. One row (hi, lo, first_doc) for each key found in at least min_docs documents."""
    spark = docs.sparkSession
    bits = filter_bits(docs)
    held = spark.sparkContext.broadcast(repeated_filter(docs, bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        for part in text_slices(batches):
            offsets, lines = lines_of(part.column("text"))
            codes, digest, usable = digests(lines, min_chars)
            places = bit_places(digest, bits)
            usable &= ((bitmap[places >> 3] >> (places & 7)) & 1).all(axis=1)
            if not usable.any():
                continue
            ids = part.column("doc_id")
            order = np.asarray(pc.array_sort_indices(ids))  # nulls last
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            first = np.full(len(digest), len(ids))
            np.minimum.at(first, codes, np.repeat(rank, np.diff(offsets)))
            count = by_document(offsets, codes, len(digest))
            chosen = digest[usable]
            yield pa.RecordBatch.from_arrays([pa.array(signed(chosen[:, 0].copy())), pa.array(signed(chosen[:, 1].copy())), pa.array(count[usable]), ids.take(pa.array(order[first[usable]]))], names=["hi", "lo", "n", "first_doc"])

    rows = docs.mapInArrow(suspects, f"hi long, lo long, n long, first_doc {docs.schema['doc_id'].dataType.simpleString()}")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc")).where(F.col("n") >= min_docs).select("hi", "lo", "first_doc")


def drop_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, text of the lines that stay.

    keep: 'first' leaves each repeated line at its first place (in the smallest id, its first line there), 'none' drops all.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = materialise(repeated_lines(docs, min_docs, min_chars), "lines")
    if keep != "first":
        keys = keys.select("hi", "lo", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("first_doc"))
    held = None
    if is_small(keys, broadcast_bytes):
        held = spark.sparkContext.broadcast(sorted_keys(keys.toArrow().combine_chunks()))
    else:
        docs = _with_own_keys(docs, keys, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, lines = lines_of(part.column("text"))
            codes, digest, usable = digests(lines, min_chars)
            table, firsts = held.value if held is not None else sorted_keys(pa.Table.from_struct_array(part.column("own").flatten()))
            hi, lo = signed(digest[:, 0].copy()), signed(digest[:, 1].copy())
            dropped, found = np.zeros(len(digest), bool), np.zeros(len(digest), np.int64)
            at, todo = np.searchsorted(table[:, 0], hi), usable.copy()
            while todo.any():  # digests with an equal first half are rare
                todo &= at < len(table)
                todo[todo] = table[at[todo], 0] == hi[todo]
                same = np.flatnonzero(todo)
                same = same[table[at[same], 1] == lo[same]]
                dropped[same], found[same], todo[same] = True, at[same], False
                at = at + 1
            gone = dropped[codes]
            ids = part.column("doc_id").to_pylist()
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            n_dropped = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own = gone[a:b]
                if keep == "first" and own.any():
                    seen: set = set()
                    for j in np.flatnonzero(own):
                        c = codes[a + j]
                        if c not in seen and ids[i] is not None and ids[i] == firsts[found[c]].as_py():
                            own[j] = False
                        seen.add(c)
                n_dropped.append(int(own.sum()))
                if n_dropped[-1]:
                    texts[i] = "\n".join(lines.slice(a, b - a).filter(pa.array(~own)).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string")


def sorted_keys(listed: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Rows (hi, lo) in order, and the first document of each."""
    table = np.stack([np.asarray(listed.column(c)).astype(np.int64) for c in ("hi", "lo")], axis=1)
    order = np.lexsort((table[:, 1], table[:, 0]))
    firsts = listed.column("first_doc").combine_chunks() if len(order) else pa.array([], pa.null())
    return table[order], firsts.take(pa.array(order))


def _with_own_keys(docs: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    """Add to each document the confirmed keys among its lines (column own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, lines = lines_of(part.column("text"))
            codes, digest, usable = digests(lines, min_chars)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            pair = np.unique(owner * max(len(digest), 1) + codes)
            doc, code = pair // max(len(digest), 1), pair % max(len(digest), 1)
            doc, code = doc[usable[code]], code[usable[code]]
            chosen = digest[code]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(signed(chosen[:, 0].copy())), pa.array(signed(chosen[:, 1].copy()))], names=["doc_id", "hi", "lo"])

    found = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hi long, lo long").join(keys, ["hi", "lo"])
    own = found.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo", "first_doc")).alias("own")).withColumnRenamed("doc_id", "own_id")
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select("doc_id", "text", F.coalesce("own", F.array().cast(own.schema["own"].dataType)).alias("own"))
