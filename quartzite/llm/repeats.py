"""Candidates for repeated passages: windows whose minimiser occurs more than once.

A window of `window` words is represented by the smallest hash of its `k`-word grams. Equal windows have equal minimisers,
so only windows whose minimiser stands at two places or more can repeat. Pass one shuffles the minimisers alone (a share of
2 / (window - k + 2) of the words, aggregated in each batch, so a minimiser that every document has leaves a row a batch)
and leaves a bitmap of those that repeat, which grows with the corpus up to 2 ** MOST_BITS bits (128 MB); a bit that two
minimisers share only lets more through. Pass two reads the documents again and emits their runs of consecutive windows with
one repeated minimiser.

Equal runs have equal digests and are resolved once, at their first place (smallest id, then earliest start): there a
resolver says which windows of the run start earlier still, in another run with the same minimiser; everywhere else the
whole run is repeated. Only the last step, which cuts texts, joins the texts, with the ranges of their repeated windows.

A resolver gets whole groups of different runs with one minimiser while these are at most GROUP. A minimiser with more of them
would be one task's work that grows with the corpus, so its windows are settled each on its own, by an aggregate over 128-bit
digests of their words. Digests of runs have 128 bits too, made from two independent hashes of each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS_A_PART, bounded_batches, discard, in_order, materialise, packed_by, shuffle_partitions, text_bytes, text_slices, unpacked, window_hashes, word_digests, word_lists

GRAM = 8
#: Powers of two between which the bitmap of repeated minimisers has its bits: eight for each minimiser of the corpus.
LEAST_BITS, MOST_BITS = 20, 30
CHUNK_BITS = 13
ANCHORS_PER_TASK = 4_000_000
#: Different runs of one minimiser that a task settles together.
GROUP = 1000
RANGES = "d1 long, d2 long, ranges array<struct<a:int,b:int>>"
#: Bytes of a word and its separator, roughly.
WORD_BYTES = 6


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """The minimum or maximum of each `width` neighbours (len - width + 1 of them), by doubling."""
    span = 1
    while 2 * span <= width:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def minima(texts: pa.Array, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Word digests, offsets, gram hashes, each window's minimiser (0 where a window would leave its text), and the words."""
    offsets, flat = word_lists(texts, lower=False)
    words = word_digests(flat)
    n = len(words) - window + 1
    if n <= 0:
        return words, offsets, np.zeros(0, np.uint64), np.zeros(0, np.uint64), flat
    grams = window_hashes(words[:, 0], k)
    low = sliding(np.minimum, grams, window - k + 1)
    edge = np.zeros(len(words) + 2, np.int32)
    long = np.diff(offsets) >= window
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - window + 1, -1)
    low[np.cumsum(edge)[:n] <= 0] = 0
    return words, offsets, grams, low, flat


class Bitmap:
    """Packed bits, one for each value of a hash's first `bits` bits."""

    def __init__(self, bits: int):
        self.bits, self.packed = bits, np.zeros(1 << (bits - 3), np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        bit = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return ((self.packed[bit >> 3] >> (bit & 7)) & 1) > 0

    def fill(self, rows: DataFrame) -> Bitmap:
        """Set the bits of the bitmaps of chunks in rows."""
        size = 1 << (CHUNK_BITS - 3)
        for row in rows.toLocalIterator():
            self.packed[row.chunk * size : (row.chunk + 1) * size] |= np.frombuffer(row.bitmap, np.uint8)
        return self


CHUNKS = "chunk long, bitmap binary"


def chunks(h: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The bits of these hashes, a row for each chunk that has any."""
    bit = np.sort((h >> np.uint64(64 - bits)).astype(np.int64))
    chunk = bit >> CHUNK_BITS
    edges = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(bit)) if len(bit) else np.zeros(0, np.int64)
    for at in range(0, len(edges) - 1, 4096):
        found = []
        for a, b in zip(edges[at : at + 4096], edges[at + 1 : at + 4097], strict=False):
            own = np.zeros(1 << CHUNK_BITS, np.uint8)
            own[bit[a:b] & ((1 << CHUNK_BITS) - 1)] = 1
            found.append((int(chunk[a]), np.packbits(own, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found]), pa.array([x for _, x in found])], names=["chunk", "bitmap"])


def minimisers(size: int, window: int, k: int) -> int:
    """About how many minimisers a text of so many bytes has."""
    return 2 * size // WORD_BYTES // (window - k + 2)


def repeated_bitmap(docs: DataFrame, window: int, k: int) -> Bitmap:
    expected = minimisers(text_bytes(docs), window, k)
    bits = int(np.clip((8 * expected).bit_length(), LEAST_BITS, MOST_BITS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=6 << 20):
            _, _, grams, low, _ = minima(part.column("text"), window, k)
            if not len(low):
                continue
            pad = np.zeros(window - k, np.uint64)
            top = sliding(np.maximum, np.concatenate([pad, low, pad]), window - k + 1)
            value, count = np.unique(grams[(grams == top) & (top > 0)], return_counts=True)
            chunk = value >> np.uint64(64 - bits + CHUNK_BITS)
            yield packed_by(chunk % np.uint64(BUCKETS_A_PART * parts), value=value.view(np.int64), again=count > 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = unpacked(batches, "value", "again")
        if not columns:
            return
        value, again = columns[0].view(np.uint64), columns[1]
        order = np.argsort(value)
        value, again = value[order], again[order]
        again[1:] |= value[1:] == value[:-1]
        yield from chunks(value[again], bits)

    parts = max(shuffle_partitions(docs.sparkSession), expected // ANCHORS_PER_TASK)
    return Bitmap(bits).fill(docs.select("text").mapInArrow(emit, "bucket long, value array<long>, again array<boolean>").repartition(parts, "bucket").mapInArrow(count, CHUNKS))


def bitmap_of(df: DataFrame, column: str, expected: int) -> Bitmap:
    """A bitmap of the hashes in a column of about so many rows."""
    bits = int(np.clip((8 * expected).bit_length(), LEAST_BITS, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.asarray(batch.column("h")).view(np.uint64) for batch in batches]
        if found:
            yield from chunks(np.concatenate(found), bits)

    chunk = F.shiftrightunsigned(column, 64 - bits + CHUNK_BITS)
    parts = shuffle_partitions(df.sparkSession)
    return Bitmap(bits).fill(df.select(F.col(column).alias("h"), chunk.alias("chunk")).repartition(parts, "chunk").select("h").mapInArrow(run, CHUNKS))


def candidate_runs(docs: DataFrame, window: int, k: int) -> DataFrame:
    """docs: doc, th, text. Runs of candidate windows; content (the words) only at a digest's first place within a batch."""
    held = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(docs, window, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, offsets, _, low, flat = minima(part.column("text"), window, k)
            good = (low > 0) & held.value.holds(low)
            if not good.any():
                continue
            text = np.searchsorted(offsets, np.arange(len(low)), "right") - 1
            first = good.copy()
            first[1:] &= ~good[:-1] | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(first)
            last = good.copy()
            last[:-1] &= ~good[1:] | first[1:]
            r = np.flatnonzero(last) + 1 - begin
            # Runs in which a window repeats.
            at = np.flatnonzero(good)
            of = np.repeat(np.arange(len(begin)), r)
            whole = window_hashes(words[:, 0], window)[at]
            order = np.lexsort((whole, of))
            same = (of[order][1:] == of[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            loops = np.zeros(len(begin), bool)
            loops[of[order][1:][same]] = True
            raw, digests = words.tobytes(), []
            for a, n in zip(begin.tolist(), r.tolist(), strict=True):
                digests.append(xxhash.xxh3_128_digest(raw[16 * a : 16 * (a + n + window - 1)]))
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            _, new = np.unique(digest[:, 0], return_index=True)
            new.sort()
            size = r[new] + window - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            taken = flat.take(pa.array(np.repeat(begin[new] - ends[:-1], size) + np.arange(ends[-1])))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken), " ")
            place = np.full(len(begin), -1)
            place[new] = np.arange(len(new))
            owner = pa.array(text[begin])
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(low[begin].view(np.int64)), part.column("doc").take(owner), part.column("th").take(owner), pa.array((begin - offsets[text[begin]]).astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(loops), joined.take(pa.array(place, mask=place < 0))],
                names=["d1", "d2", "v", "doc", "th", "start", "r", "loops", "content"],
            )

    runs = f"d1 long, d2 long, v long, doc {docs.schema['doc'].dataType.simpleString()}, th long, start int, r int, loops boolean, content string"
    return materialise(docs.mapInArrow(run, runs), "runs")


#: Gets the words of each run, the number of its group (ascending), and the window's length.
Resolver = Callable[[list[list[str]], np.ndarray, int], list[np.ndarray]]


def resolve(runs: DataFrame, window: int, resolver: Resolver, limit: int = GROUP) -> DataFrame:
    """d1, d2, first (doc, start), ranges: the windows of a run that start earlier than at its first place.

    Only runs that share their minimiser with another one, or repeat a window themselves, need a resolver and their contents. It
    gets the words of groups of runs with one minimiser, in the order of their first places, and gives for each run a mask of windows.
    """
    distinct = runs.groupBy("d1", "d2").agg(F.min("v").alias("v"), F.min(F.struct("doc", "start")).alias("first"), F.bool_or("loops").alias("loops"))
    distinct = materialise(distinct, "distinct")
    # Written first, so that the join is one of two plain shuffles and a frequent minimiser can be split.
    several = materialise(distinct.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bool_or("loops").alias("loops")).where("n > 1 OR loops").select("v", "n"), "several")
    needed = materialise(distinct.join(several, "v").select("d1", "d2", "v", "n", "first"), "needed")
    held = runs.sparkSession.sparkContext.broadcast(bitmap_of(needed, "d1", needed.count()))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.holds(np.asarray(batch.column("d1")).view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("v", "d1", "d2", "content")), strict=True)
            whole = len(rows)  # all but the last group, which the next batch may go on with
            while whole and rows[whole - 1][0] == rows[-1][0]:
                whole -= 1
            yield table(settle(rows[:whole]))
            rows = rows[whole:]
        yield table(settle(rows))

    def settle(rows: list) -> list:
        if not rows:
            return []
        v = np.array([row[0] for row in rows])
        group = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])
        out = []
        for row, mask in zip(rows, resolver([row[3].split(" ") for row in rows], group, window), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            if len(edge):
                out.append((row[1], row[2], [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]))
        return out

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["d1", "d2", "ranges"])

    contents = runs.where("content IS NOT NULL").select("d1", "d2", "content").mapInArrow(wanted, "d1 long, d2 long, content string")
    contents = contents.groupBy("d1", "d2").agg(F.max("content").alias("content"))
    placed = needed.join(contents, ["d1", "d2"])
    ordered = placed.where(F.col("n") <= limit).repartition(shuffle_partitions(runs.sparkSession), "v").sortWithinPartitions("v", "first")
    ranges = ordered.select("v", "d1", "d2", "content").mapInArrow(run, RANGES)
    if needed.where(F.col("n") > limit).limit(1).count():
        ranges = ranges.unionByName(_by_windows(placed.where(F.col("n") > limit), window))
    out = materialise(distinct.select("d1", "d2", "first").join(ranges, ["d1", "d2"], "left"), "ranges")
    for done in (distinct, several, needed):
        discard(done)
    return out


def _by_windows(placed: DataFrame, window: int) -> DataFrame:
    """What a resolver gives, for minimisers with so many different runs that no task may hold them together: every window is compared by its 128-bit hash, and its first place found by an aggregate."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split(" ") for t in batch.column("content").to_pylist()]
            words = word_digests(pa.array([w for t in texts for w in t], pa.string()))
            size = np.array([len(t) - window + 1 for t in texts])
            ends = np.cumsum([0, *map(len, texts)])
            at = np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            owner = np.repeat(np.arange(len(texts)), size)
            i = at - ends[:-1][owner]
            w1, w2 = (window_hashes(np.ascontiguousarray(words[:, lane]), window, lane + 1)[at].view(np.int64) for lane in (0, 1))
            d1, d2, start = (np.asarray(batch.column(c))[owner] for c in ("d1", "d2", "start"))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (d1, d2, i, w1, w2)), batch.column("doc").take(pa.array(owner)), pa.array(start + i)], names=["d1", "d2", "i", "w1", "w2", "doc", "place"])

    rows = placed.select("d1", "d2", "content", "first.doc", F.col("first.start").cast("long").alias("start"))
    rows = rows.mapInArrow(emit, f"d1 long, d2 long, i long, w1 long, w2 long, doc {rows.schema['doc'].dataType.simpleString()}, place long")
    rows = materialise(rows, "windows")
    least = materialise(rows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "place")).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1"), "least")
    later = rows.join(least, ["w1", "w2"]).where(F.struct("doc", "place") > F.col("least"))
    one = F.transform(F.collect_set(F.col("i").cast("int")), lambda i: F.struct(i.alias("a"), (i + 1).alias("b")))
    return later.groupBy("d1", "d2").agg(one.alias("ranges"))


def cut_repeats(docs: DataFrame, window: int, resolver: Resolver, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, text of the kept words, joined by one space. Ids may be of any type that has an order."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), in_order(F.col(id_col)).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"))
    runs = candidate_runs(docs.select("doc", "th", "text"), window, min(k, window))
    found = resolve(runs, window, resolver, group)
    places = runs.select("d1", "d2", "doc", "th", "start", "r").join(found, ["d1", "d2"])
    own = F.transform("ranges", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("r")).alias("b")))
    places = places.select("doc", "th", F.when(F.struct("doc", "start") == F.col("first"), own).otherwise(whole).alias("w")).where("w IS NOT NULL")
    spans = materialise(places.groupBy("doc", "th").agg(F.flatten(F.collect_set("w")).alias("w")), "spans")
    discard(runs)
    discard(found)
    joined = docs.join(spans, ["doc", "th"], "left").select("doc_id", "text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, flat = word_lists(part.column("text"), lower=False)
            gone = np.zeros(len(flat) + 1, np.int32)
            lists = part.column("w")
            owner = np.repeat(offsets[:-1], np.asarray(lists.value_lengths().fill_null(0)))
            ranges = lists.flatten()
            if len(ranges):
                np.add.at(gone, owner + np.asarray(ranges.field("a")), 1)
                np.add.at(gone, owner + np.asarray(ranges.field("b")) + window - 1, -1)
            keep = np.cumsum(gone)[:-1] == 0
            ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(ends)), pc.binary_join(kept, " ")], names=["doc_id", "n_words", "n_removed", "text"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, text string")
