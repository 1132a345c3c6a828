"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or nothing on every document. Expectation-maximisation over the counts of
vote patterns of the whole corpus (3 ** labellers rows at most) estimates how each labeller votes on good and on junk
documents, without any hand-made label, and gives each pattern its posterior; a labeller that says nothing counts neither way. The posteriors then train a linear scorer
over hashed word shapes, on about SAMPLE documents chosen by a hash of id and text, equal rows once, or fewer where these would have more than
SAMPLE_WORDS words (the documented bound of the fit, whatever the size of the corpus). Every document is voted on, and every
document is scored by the linear model. `Scorer.accuracy` tells how each labeller was found to vote.

Defined results: a text that is null or has no word has score 0 and isn't kept; repeated rows are scored each on its own;
an empty table gives no rows; a corpus whose posteriors are all alike gives every document with words that posterior; `filter_quality`
keeps every column as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bounded_batches, sampled, text_slices, word_lists

GOOD, JUNK, ABSTAIN = 1, 0, 2
SAMPLE = 20_000
SAMPLE_WORDS = 10_000_000
FEATURES = 1 << 14
THRESHOLD = 0.5
#: Words from which on a share of words says something.
ENOUGH = 15


def _share(flag: pa.Array) -> np.ndarray:
    return np.asarray(pc.cast(flag, pa.int8())).astype(float)


def measures(texts: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array, np.ndarray, np.ndarray]:
    """Offsets of the words; shares for each document; the distinct words, their codes and whether each word repeats the one before."""
    offsets, flat = word_lists(texts, lower=False)
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    n, count = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), count)
    chars = np.asarray(pc.utf8_length(words)).astype(float)
    letters = chars - np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"\pL", "")))
    upper = chars - np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"\p{Lu}", "")))
    odd = chars - np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"[#$%&*|<>{}\[\]\\^~=_@+]", "")))
    marks = _share(pc.ends_with(words, "!"))
    short = (chars <= 3) & (letters == chars)
    ends = _share(pc.match_substring_regex(words, r"[.?!]$"))
    total = lambda x: np.bincount(owner, weights=x[codes], minlength=n)
    same = np.zeros(len(codes), bool)
    if len(codes):
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    size = np.maximum(count, 1)
    # The longest run of one word, and the share of a document's commonest word.
    begin = np.flatnonzero(~same)
    run = np.zeros(n, np.int64)
    np.maximum.at(run, owner[begin], np.diff(np.concatenate([begin, [len(codes)]])))
    pair, often = np.unique(owner * max(len(words), 1) + codes, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pair // max(len(words), 1), often)
    shares = {
        "odd": total(odd) / np.maximum(total(chars), 1),
        "upper": total(upper) / np.maximum(total(letters), 1),
        "marks": total(marks) / size,
        "short": total(short.astype(float)) / size,
        "ends": total(ends) / size,
        "same": np.bincount(owner, weights=same, minlength=n) / size,
        "run": run,
        "top": top / size,
        "letters": total(letters) / np.maximum(total(chars), 1),
        "words": count.astype(float),
    }
    return offsets, shares, words, codes, same


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Each labeller's vote on each document (documents x labellers)."""
    enough = s["words"] >= ENOUGH

    def vote(junk: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(junk, JUNK, np.where(good, GOOD, ABSTAIN))

    return np.stack(
        [
            vote(s["odd"] > 0.05, s["odd"] < 0.02),
            vote(s["upper"] > 0.5, s["upper"] < 0.2),
            vote(s["marks"] > 0.3, s["marks"] < 0.1),
            vote(enough & (s["same"] > 0.1), enough & (s["same"] < 0.03)),
            vote(s["run"] >= 6, enough & (s["run"] <= 3)),
            vote(enough & ((s["top"] > 0.25) | (s["same"] > 0.3)), enough & (s["top"] < 0.15) & (s["same"] < 0.03)),
            vote(enough & (s["short"] < 0.05), enough & (s["short"] > 0.15)),
            vote(enough & ((s["ends"] < 0.01) | (s["ends"] > 0.6)), enough & (s["ends"] > 0.02) & (s["ends"] < 0.35)),
            vote(enough & (s["letters"] < 0.75), s["letters"] > 0.9),
        ],
        axis=1,
    )


#: What each labeller looks at.
NAMES = ["odd marks", "capitals", "exclamation", "word repeats", "runs of a word", "commonest word", "short words", "sentence ends", "letters"]
LABELLERS = len(NAMES)


def shape_buckets(words: pa.Array) -> np.ndarray:
    """A hashed shape for each distinct word: runs of capitals, small letters and digits become A, a and 0; marks stay."""
    for pattern, to in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}\pM]+", "a"), (r"\pN+", "0")):
        words = pc.replace_substring_regex(words, pattern, to)
    coded = words.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) % FEATURES for w in coded.dictionary.to_pylist()], np.int64)
    return table[np.asarray(coded.indices)] if len(table) else np.zeros(0, np.int64)


def features(offsets: np.ndarray, words: pa.Array, codes: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, feature, value): hashed shapes, pairs of shapes and repeats, each document of length one."""
    n = len(offsets) - 1
    shape = shape_buckets(words)[codes]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pair = (shape[:-1] * 31 + shape[1:] * 17 + 7) % FEATURES
    inner = owner[1:] == owner[:-1]
    again = np.full(int(same.sum()), xxhash.xxh3_64_intdigest("same word again") % FEATURES, np.int64)
    key = np.concatenate([owner, owner[1:][inner], owner[same]]) * FEATURES + np.concatenate([shape, pair[inner], again])
    key, value = np.unique(key, return_counts=True)
    doc, feature, value = key // FEATURES, key % FEATURES, value.astype(float)
    return doc, feature, value / np.sqrt(np.bincount(doc, weights=value**2, minlength=n))[doc]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of votes): each pattern's probability of good, and how often each labeller that votes on junk and on good documents votes junk and good (labeller, truth, vote)."""
    prior = 0.8
    # To begin with, a vote for junk is taken to be rarer and surer than a vote for good.
    accuracy = np.tile(np.array([[0.35, 0.65], [0.03, 0.97]]), (patterns.shape[1], 1, 1))  # labeller, truth, vote
    if not len(counts):
        return np.zeros(0), accuracy
    p, voted = np.zeros(len(counts)), patterns != ABSTAIN
    vote = np.where(voted, patterns, 0)
    for _ in range(rounds):
        log = np.stack([np.where(voted, np.log(accuracy[np.arange(patterns.shape[1]), y, vote]), 0).sum(axis=1) for y in (JUNK, GOOD)])
        log += np.log([[1 - prior], [prior]])
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        weight = np.stack([counts * (1 - p), counts * p])
        prior = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        for k in range(patterns.shape[1]):
            seen = np.stack([np.bincount(vote[:, k], weights=w * voted[:, k], minlength=2) for w in weight]) + 1
            accuracy[k] = seen / seen.sum(axis=1, keepdims=True)
    return p, accuracy


def train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft targets by accelerated gradient steps; the last weight is the intercept."""
    n = max(len(target), 1)
    weights, ahead, pace = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), 1.0
    for _ in range(rounds):
        z = np.bincount(doc, weights=value * ahead[feature], minlength=len(target)) + ahead[-1]
        error = 1 / (1 + np.exp(-z)) - target
        gradient = np.append(np.bincount(feature, weights=value * error[doc], minlength=FEATURES), error.sum()) / n + decay * ahead
        step = ahead - rate * gradient
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, weights, pace = step + (pace - 1) / following * (step - weights), step, following
    return weights


class Scorer:
    def __init__(self, posterior: dict[int, float], weights: np.ndarray, accuracy: np.ndarray):
        self.posterior, self.weights = posterior, weights
        #: Of each labeller: the share of its votes that are right, on junk and on good documents, as estimated.
        self.accuracy = {name: (float(a[JUNK, JUNK]), float(a[GOOD, GOOD])) for name, a in zip(NAMES, accuracy, strict=True)}

    def score(self, offsets, words, codes, same) -> np.ndarray:
        doc, feature, value = features(offsets, words, codes, same)
        z = np.bincount(doc, weights=value * self.weights[feature], minlength=len(offsets) - 1) + self.weights[-1]
        return np.where(np.diff(offsets) > 0, 1 / (1 + np.exp(-z)), 0.0)


def codes_of(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def sampled_share(documents: int, words: int, sample: int = SAMPLE) -> float:
    """The share of a corpus that makes about `sample` documents and at most about SAMPLE_WORDS words."""
    return min(1.0, sample / max(documents, 1), SAMPLE_WORDS / max(words, 1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Votes of the whole corpus, their posteriors, and the linear scorer learned from about `sample` documents."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, long = np.zeros(3**LABELLERS, np.int64), np.zeros(3**LABELLERS, np.int64)
        for part in text_slices(batches):
            offsets, shares, *_ = measures(part.column("text"))
            size = np.diff(offsets)
            code = codes_of(votes(shares))
            seen += np.bincount(code[size > 0], minlength=len(seen))
            long += np.bincount(code, weights=size, minlength=len(long)).astype(np.int64)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(long[at])], names=["pattern", "n", "words"])

    found = rows.select("text").mapInArrow(count, "pattern long, n long, words long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).orderBy("pattern").collect()
    pattern = np.array([r.pattern for r in found], np.int64)
    posterior, accuracy = estimate(pattern[:, None] // 3 ** np.arange(LABELLERS) % 3, np.array([r.n for r in found], float))
    of = dict(zip(pattern.tolist(), posterior.tolist(), strict=True))
    share = sampled_share(sum(r.n for r in found), sum(r.words for r in found), sample)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, shares, words, codes, same = measures(part.column("text"))
            doc, feature, value = features(offsets, words, codes, same)
            edges = np.searchsorted(doc, np.arange(len(offsets)))
            full = np.diff(offsets) > 0
            target = [of[c] if f else None for c, f in zip(codes_of(votes(shares)).tolist(), full, strict=True)]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.float64()), lists(feature.astype(np.int32)), lists(value.astype(np.float32))], names=["target", "feature", "value"])

    table = sampled(rows, share).select("text").mapInArrow(examples, "target double, feature array<int>, value array<float>").where("target IS NOT NULL").toArrow().combine_chunks()
    lists = table.column("feature").combine_chunks() if table.num_rows else None
    if lists is None:
        return Scorer(of, np.zeros(FEATURES + 1), accuracy)
    doc = np.repeat(np.arange(table.num_rows), np.asarray(pc.list_value_length(lists)))
    weights = train(doc, np.asarray(lists.flatten()), np.asarray(table.column("value").combine_chunks().flatten()).astype(float), np.asarray(table.column("target")))
    return Scorer(of, weights, accuracy)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, score (0 to 1), posterior of its votes (null without words), kept."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, shares, words, codes, same = measures(part.column("text"))
            s = held.value.score(offsets, words, codes, same)
            weak = [held.value.posterior.get(c) if f else None for c, f in zip(codes_of(votes(shares)).tolist(), np.diff(offsets) > 0, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array(weak, pa.float64()), pa.array(s >= threshold)], names=["doc_id", "score", "posterior", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, posterior double, kept boolean")


def filter_quality(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the scorer keeps, all their columns as they were."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, f"c{names.index(text_col)}"):
            offsets, _, words, codes, same = measures(part.column(f"c{names.index(text_col)}"))
            yield part.filter(pa.array(held.value.score(offsets, words, codes, same) >= threshold))

    schema = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)])
    return docs.toDF(*schema.names).mapInArrow(run, schema).toDF(*names)
