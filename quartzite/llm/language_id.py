"""Language identification of mixed-language text.

A model of character n-grams is learned from labelled documents. The script ranges of a word's letters narrow the
languages it can be to those that use its main script, as long as there is one; each word gets a log-likelihood under each of
these and none of the others; Viterbi over a text's words with a penalty for every switch labels spans, and the language with
the most letters is the text's.

The model is fitted on about SAMPLE documents of each language, chosen by a hash of their ids; its tables have BUCKETS
hashed n-grams for each language, whatever the size of the corpus. Every document is labelled.

Defined results: a text that is null or has no letter has no span, the language 'und' and score 0; without any labelled document
every text is 'und'; rows whose language is null are not learned from; of languages with equally many letters the first
in order of their names wins, and of equally good ways to label a word that of the first; an empty table gives no rows; only id, text and language are read, and language and id
never take part in labelling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, sampled, text_slices

SAMPLE = 4000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 12.0
FLOOR = -12.0
SLICE = 6 << 20
UNDETERMINED = "und"
NOT_LETTERS = r"[^\pL\pM]+"
#: First code points of script ranges, and the script that begins there (0: other).
SCRIPT_STARTS = [0x0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xE00, 0xE80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0]
SCRIPT_NAMES = ["other", "Latin", "other", "Greek", "Cyrillic", "other", "Hebrew", "Arabic", "other", "Devanagari", "other", "Thai", "other", "Hangul", "other", "Latin", "Greek", "other", "Kana", "other", "Han", "other", "Hangul", "other"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
#: A language uses a script if at least this share of its sampled letters is in it.
SCRIPT_SHARE = 0.005


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(texts, pattern=NOT_LETTERS)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if pc.any(pc.match_substring_regex(texts, r"\pM")).as_py():
        full = np.asarray(pc.match_substring_regex(flat, r"\pL"))  # marks without a letter are no word
    return np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]], flat.filter(pa.array(full))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: owner and bucket of each n-gram (boundaries included), length and main script of each word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1)  # each word's end, after the leading boundary
    owner = np.repeat(np.arange(len(words)), size + 1)  # a boundary belongs to the word it precedes
    all_owners, buckets = [], []
    running = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(points) - n + 1
        running = running[:m] * np.uint64(0x100000001B3) + points[n - 1 : n - 1 + m] + np.uint64(1)
        at = np.arange(min(m, len(owner)))
        at = at[(at + n <= end[owner[at]] + 1) & ((n > 1) | (points[at] != 32))]
        if n in ORDERS:
            all_owners.append(owner[at])
            buckets.append((mix(running[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    script = np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES])[np.searchsorted(SCRIPT_STARTS, points[: len(owner)], "right") - 1]
    counts = np.zeros((len(words), len(SCRIPTS)), np.int32)
    letters = points[: len(owner)] != 32
    np.add.at(counts, (owner[letters], script[letters]), 1)
    return np.concatenate(all_owners), np.concatenate(buckets), size, counts.argmax(axis=1)


class Model:
    """Log-likelihoods of n-gram buckets (languages x BUCKETS) and the scripts each language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.05
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else counts
        self.table = (table - table.max(axis=0, keepdims=True) if languages else table).astype(np.float32).T.copy()
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word's score under each language (0 for the best, FLOOR at least, no chance for one that its script excludes), and its letters."""
        owner, bucket, size, script = grams(words)
        order = np.argsort(owner, kind="stable")
        begin = np.searchsorted(owner[order], np.arange(len(words)))
        score = np.add.reduceat(self.table[bucket[order]], begin, axis=0)
        allowed = self.uses[:, script].T
        score = np.where(allowed | ~allowed.any(axis=1, keepdims=True), score, -np.inf)
        return np.where(np.isfinite(score), np.maximum(score - score.max(axis=1, keepdims=True), FLOOR), score).astype(np.float32), size


def viterbi(score: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; score: words x languages, texts laid end to end, all texts advance together."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    length, start = length[order], offsets[:-1][order]
    n, kinds = score.shape
    label = np.zeros(n, np.int32)
    if not n:
        return label
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts with more than t words
    stay = np.zeros((n, kinds), bool)
    best_before = np.zeros(n, np.int32)
    value = np.zeros((len(length), kinds), np.float32)
    for t in range(int(length[0])):
        k = alive[t]
        v, at = value[:k], start[:k] + t
        top = v.max(axis=1, keepdims=True) - np.float32(penalty)
        if t:
            best_before[at] = v.argmax(axis=1)
            stay[at] = v >= top
            np.maximum(v, top, out=v)
        v += score[at]
    current = value.argmax(axis=1).astype(np.int32)
    for t in range(int(length[0]) - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        now = current[:k]
        label[at] = now
        if t:
            current[:k] = np.where(stay[at, now], now, best_before[at])
    return label


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows of docs whose language is known, about `sample` of each language."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(totals)
    number = {lang: k for k, lang in enumerate(languages)}
    shares = F.map_from_arrays(F.array(*map(F.lit, languages)), F.array(*(F.lit(sample / totals[lang]) for lang in languages)))
    chosen = sampled(known, shares[F.col("lang")]) if languages else known

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
        for part in text_slices(batches):
            offsets, flat = words_of(part.column("text"))
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            lang = np.array([number[x] for x in part.column("lang").to_pylist()])[np.repeat(np.arange(part.num_rows), np.diff(offsets))]
            owner, bucket, size, script = grams(coded.dictionary.to_pylist())
            seen = np.zeros((len(coded.dictionary), len(languages)), np.int64)
            np.add.at(seen, (np.asarray(coded.indices), lang), 1)
            for k in range(len(languages)):
                total[k, :BUCKETS] += np.bincount(bucket, weights=seen[owner, k], minlength=BUCKETS)
                total[k, BUCKETS:] += np.bincount(script, weights=seen[:, k] * size, minlength=len(SCRIPTS))
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(total[k, at])], names=["lang", "place", "n"])

    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    for r in chosen.mapInArrow(count, "lang long, place long, n double").groupBy("lang", "place").agg(F.sum("n").alias("n")).toLocalIterator() if languages else []:
        counts[r.lang, r.place] = r.n
    return Model(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score (share of its letters in that language's spans), spans of words with their languages."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        kinds = len(model.languages)
        for part in text_slices(batches, limit=SLICE):
            offsets, flat = words_of(part.column("text"))
            n = part.num_rows
            letters = np.zeros((n, max(kinds, 1)))
            spans: list[list] = [[] for _ in range(n)]
            if len(flat) and kinds:
                coded = flat.dictionary_encode()
                codes = np.asarray(coded.indices)
                score, size = model.scores(coded.dictionary.to_pylist())
                label = viterbi(score[codes], offsets, penalty)
                owner = np.repeat(np.arange(n), np.diff(offsets))
                letters = np.bincount(owner * kinds + label, weights=size[codes], minlength=n * kinds).reshape(n, kinds)
                begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])]))
                for a, b in zip(begin, [*begin[1:], len(label)], strict=True):
                    first = offsets[owner[a]]
                    spans[owner[a]].append({"lang": model.languages[label[a]], "start": int(a - first), "stop": int(b - first)})
            total = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            names = [model.languages[k] if t else UNDETERMINED for k, t in zip(best, total, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(letters.max(axis=1) / np.maximum(total, 1)), pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,start:int,stop:int>>")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept for testing: those whose CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
