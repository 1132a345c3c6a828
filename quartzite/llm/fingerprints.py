"""Fingerprints of documents by consistent weighted sampling.

A document is a set of weighted terms: its word shingles (with WORDS - 1 marks before the first and after the last word, so that short
texts have shingles too) and how often each occurs. For each of SAMPLES samples a term draws r and c from Gamma(2, 1) and b from
Uniform(0, 1), always the same ones; with weight w it stands at t = floor(ln w / r + b) and has the key ln c - r (t - b + 1). The term of
the least key, with its t, is the sample. Two documents agree in a sample with a probability that is their generalised Jaccard similarity:
the sum of the smaller weights over the sum of the larger ones. A fingerprint keeps 16 bits of each sample.

The draws are taken from a pool of POOL triples, sorted by the key for weight one, and a term's hash in a sample names its triple. Terms
of weight one, nearly all of them, are therefore in the order of their hashes, and only heavier terms need the pool. Terms with the same
triple are told apart by the rest of the hash.

compare_edited needs each document beside the next one: one range sort of the texts by id, after which a task holds one document at a
time. The first and the last rows of partitions, one each, meet afterwards in a join by partition number.

Defined results: a null text counts as empty; an empty text, or one of blanks, has a single term, that of no words; equal texts have equal
fingerprints; rows of equal ids stand in the order of a hash of their texts, null ids after all others; an empty table gives no rows.
Other columns are not read. Words are compared by 64-bit hashes, shingles by 48 bits of one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, mix, shuffle_partitions, text_slices, window_hashes, word_hashes, word_lists

SAMPLES = 128
WORDS = 5
POOL_BITS = 20
SLICE_BYTES = 1 << 20
ROWS = 1 << 15
LOW = np.uint64((1 << 48) - 1)


@functools.cache
def pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c, b and the key of weight one of each triple, by rising key. The draws are the same everywhere."""
    rng = np.random.Generator(np.random.PCG64(12))
    n = 1 << POOL_BITS
    r, c, b = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
    order = np.argsort(c - r * (1 - b), kind="stable")
    r, c, b = r[order], c[order], b[order]
    return r, c, b, c - r * (1 - b)


def terms(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of each text's terms, the terms' hashes (48 bits) and their counts."""
    offsets, flat = word_lists(texts, "space")
    n, marks = len(texts), words - 1
    padded = np.zeros(len(flat) + n * 2 * marks, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(flat)) + (2 * owner + 1) * marks] = word_hashes(flat)
    begin = offsets + 2 * marks * np.arange(n + 1)
    size = np.diff(begin) - marks  # windows of each padded text, of which one without words has words - 1 alike
    grams = window_hashes(padded, words)
    of = np.repeat(np.arange(n), size)
    grams = grams[np.arange(len(of)) + marks * of] if len(of) else np.zeros(0, np.uint64)
    blank = (np.diff(offsets) == 0)[of]
    if blank.any():
        keep = ~blank | np.concatenate([[True], of[1:] != of[:-1]])
        grams, of = grams[keep], of[keep]
    keys = np.sort(of.astype(np.uint64) << np.uint64(48) | (grams >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    ends = np.searchsorted(keys >> np.uint64(48), np.arange(n, dtype=np.uint64), "right")
    return ends, keys & LOW, counts


def sampled(ends: np.ndarray, hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """For each text (ending where `ends` says, none without terms) and sample the hash of the chosen term and its t: a row for each text."""
    r, c, b, key = pool()
    shift = np.uint64(64 - POOL_BITS)
    n = len(ends)
    heavy = np.flatnonzero(weights > 1)
    heavy_of = np.searchsorted(ends, heavy, "right")
    texts, heavy_begin = np.unique(heavy_of, return_index=True)
    log_w = np.log(weights[heavy])
    base = mix(hashes + np.uint64(1))
    single = base.copy()
    begin = np.concatenate([[0], ends[:-1]])
    out = np.empty((samples, n), np.uint64)
    x = np.empty_like(base)
    y = np.empty_like(base)
    for j in range(samples):
        np.add(single, np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), out=x)
        np.right_shift(x, np.uint64(32), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
        np.right_shift(x, np.uint64(29), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
        h = x[heavy]
        x[heavy] = np.uint64(0xFFFFFFFFFFFFFFFF)
        best = np.minimum.reduceat(x, begin) if n else x[:0]
        if len(h):
            at = (h >> shift).astype(np.int64)
            t = np.floor(log_w / r[at] + b[at])
            a = c[at] - r[at] * (t - b[at] + 1)
            order = np.lexsort((h, a, heavy_of))[heavy_begin]
            least, light = a[order], key[(best[texts] >> shift).astype(np.int64)]
            # A text all of whose terms are heavy has no light one; a greatest hash stands for none.
            none = best[texts] == np.uint64(0xFFFFFFFFFFFFFFFF)
            wins = none | (least < light) | ((least == light) & (h[order] < best[texts]))
            ident = h[order] + t[order].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            best[texts[wins]] = ident[wins]
        out[j] = best
    return np.ascontiguousarray(out.T)


def signatures(texts: pa.Array, samples: int = SAMPLES, words: int = WORDS) -> np.ndarray:
    """16 bits of each sample of each text: a row for each text."""
    return (mix(sampled(*terms(texts, words), samples)) >> np.uint64(48)).astype("<u2")


def binary(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(rows.shape[1] * 2), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def fingerprints(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (binary, two bytes a sample) of each row of docs. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary(signatures(part.column("text"), samples, words))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def likeness(one: Column, other: Column) -> Column:
    """The estimated generalised Jaccard similarity of two fingerprints: the share of samples in which they agree."""
    a, b = F.hex(one), F.hex(other)
    places = F.sequence(F.lit(0), (F.length(a) / 4 - 1).cast("int"))
    same = F.filter(places, lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) * 4 / F.length(a)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, limit=SLICE_BYTES):
        for a in range(0, part.num_rows, ROWS):
            yield part.slice(a, ROWS)


def edited(text: str, after: str) -> str:
    """text, whose last third (of code points, rounded down) is replaced by as many of the first ones of another text, or by all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compared(ids: pa.Array, own: list[str], after: list[str], own_marks: np.ndarray, after_marks: np.ndarray, samples: int, words: int) -> list[pa.Array]:
    """The columns of RESULT, where the texts' own fingerprints are known."""
    texts = [edited(a, b) for a, b in zip(own, after, strict=True)]
    marks = signatures(pa.array(texts, pa.string()), samples, words)
    digests = [hashlib.sha256(t.encode()).digest() for t in texts]
    near = lambda other: pa.array((own_marks == other).mean(axis=1) if len(own) else np.zeros(0))
    return [ids, pa.array([len(t) for t in own], pa.int64()), pa.array(digests, pa.binary()), binary(own_marks), binary(marks), near(marks), near(after_marks)]


RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_edited(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row beside the next one by descending id (after the last the first): doc_id and RESULT.

    The edited text has its last third replaced by the beginning of the next text. near_edited and near_next are the likeness of a text's
    fingerprint to that of its edited form and to that of the next text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # Rows that repeat are parted by where they stand, so that no partition needs all of them.
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of all rows but the partition's last; its first and its last row as they are."""
        part, held = TaskContext.get().partitionId(), None
        for slice_ in bounded(batches):
            ids, own, marks = slice_.column("doc_id"), slice_.column("text").to_pylist(), signatures(slice_.column("text"), samples, words)
            if held is None:
                yield edge(ids[:1], own[0], part, 1)
            else:
                ids, own, marks = pa.concat_arrays([held[0], ids]), [held[1], *own], np.concatenate([held[2], marks])
            held = ids[-1:], own[-1], marks[-1:]
            if len(own) > 1:
                found = _compared(ids[:-1], own[:-1], own[1:], marks[:-1], marks[1:], samples, words)
                none = len(own) - 1
                yield pa.RecordBatch.from_arrays([*found, pa.nulls(none, pa.string()), pa.array([part] * none, pa.int32()), pa.array([0] * none, pa.int32())], names=names)
        if held is not None:
            yield edge(held[0], held[1], part, 2)

    def edge(ids: pa.Array, text: str, part: int, kind: int) -> pa.RecordBatch:
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([ids, *blank, pa.array([text], pa.string()), pa.array([part], pa.int32()), pa.array([kind], pa.int32())], names=names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, after = batch.column("text")[i : i + 1], batch.column("after")[i : i + 1]
                marks = signatures(pa.concat_arrays([own, after]), samples, words)
                yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id")[i : i + 1], own.to_pylist(), after.to_pylist(), marks[:1], marks[1:], samples, words), names=NAMES)

    names = [*NAMES, "text", "part", "edge"]
    written = materialise(dealt.mapInArrow(run, f"doc_id {kind}, {RESULT}, text string, part int, edge int"), "compared")
    parts = sorted(r.part for r in written.where("edge = 1").select("part").collect())  # a number for each partition
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    last = written.where("edge = 2").select("doc_id", "text", "part").join(F.broadcast(follows), "part")
    first = written.where("edge = 1").select(F.col("text").alias("after"), F.col("part").alias("next"))
    pairs = last.join(first.hint("merge"), "next").select("doc_id", "text", "after")
    return written.where("edge = 0").select(*NAMES).unionByName(pairs.mapInArrow(close, f"doc_id {kind}, {RESULT}"))


