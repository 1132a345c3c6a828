"""The Merkle manifest, fingerprints and ranked search against plain versions, on small and awkward tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quartzite.llm")

from helpers import AWKWARD, corpus, empty, frame
from pyspark.sql import functions as F
from quartzite.llm import fingerprints, merkle, ranked_search


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def gathered(nodes):
    """Each of the nodes' siblings, level by level, and the root."""
    proofs, owner, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [range(a, min(a + 3, len(level))) for a in range(0, len(level), 3)]
        for run in runs:
            for k in run:
                for leaf in owner[k]:
                    proofs[leaf] += [level[j] for j in run if j != k]
        owner = [[x for k in run for x in owner[k]] for run in runs]
        level = [sha("".join(level[k] for k in run)) for run in runs]
    return proofs, level[0]


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text. A counter of (doc_id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0], leaf_of(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        inner[name] = gathered([x[2] for x in groups[name]])
    upper, root = gathered([inner[name][1] for name in names])
    return Counter((doc, leaf, inner[name][1], root, sha("".join(proof + last))) for name, last in zip(names, upper, strict=True) for (_, doc, leaf), proof in zip(groups[name], inner[name][0], strict=True))


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(out):
    t = merkle.text_of
    rows = out.select("doc_id", t(F.col("leaf")).alias("l"), t(F.col("subroot")).alias("s"), t(F.col("root")).alias("r"), merkle.proof_digest(F.col("path")).alias("p"), merkle.folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert all(r.f == r.r for r in rows)
    return Counter((r.doc_id, r.l, r.s, r.r, r.p) for r in rows)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    """Groups of 1 to 100 leaves in blocks of 3, 9 and 729; awkward texts, null ids and sources, equal ids, rows that repeat."""
    rows = [(i, f"s{size}", "é", i, f"t\n{i}") for size in (1, 2, 3, 4, 9, 10, 27, 28, 100) for i in range(size)]
    rows += [(i, s, None, None, t) for i, t in enumerate(AWKWARD) for s in (None, "", "ß", "z")]
    rows += [(None, "s9", "x", 1, "a"), (None, None, "x", 1, "b"), (5, "s10", "x", 1, "another"), *[(7, "s4", "x", 7, "t")] * 30]
    docs = spark.createDataFrame(rows, KIND).repartition(5).withColumn("root", F.lit("clash")).withColumn("g", F.lit(1)).withColumn("pos", F.lit(2))
    assert manifest_rows(merkle.manifest(docs, height=height)) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND)).count() == 0
    one = [(3, None, None, None, None)]
    assert manifest_rows(merkle.manifest(spark.createDataFrame(one, KIND))) == plain_manifest(one)


def test_manifest_finds_what_changed(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(60)]
    stored = merkle.manifest(spark.createDataFrame(rows, KIND), height=2)
    now = [(i, s, lang, n, t + "!" if i in (4, 50) else t) for i, s, lang, n, t in rows if i != 17]
    bad = {r.doc_id for r in merkle.verify(spark.createDataFrame(now, KIND), stored).collect() if not r.verified}
    assert bad == {4, 17, 50}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    padded = [None] * (k - 1) + words + [None] * (k - 1)
    return Counter(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1)) if words else Counter([()])


def generalised_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


TEXTS = [*corpus(40), *AWKWARD, "la la la la la la " * 20, "a b a b a b a b c d", "la la la la la la " * 19 + "end"]


def test_terms_are_counted_shingles():
    ends, hashes, counts = fingerprints.terms(pa.array(TEXTS, pa.string()), 3)
    for i, text in enumerate(TEXTS):
        a, b = (0 if i == 0 else ends[i - 1]), ends[i]
        assert sorted(counts[a:b]) == sorted(shingles(text, 3).values())
        assert len(set(hashes[a:b].tolist())) == b - a


def test_samples_are_those_of_the_definition():
    """The kernel, which orders terms of weight one by their hashes, against a scalar version that draws r, c and b for every term."""
    r, c, b, key = fingerprints.pool()
    assert (np.diff(key) >= 0).all()
    ends, hashes, counts = fingerprints.terms(pa.array(TEXTS, pa.string()), 2)
    own = fingerprints.sampled(ends, hashes, counts, 6)
    base = fingerprints.mix(hashes + np.uint64(1))
    wrap = (1 << 64) - 1
    for i in range(len(TEXTS)):
        a, z = (0 if i == 0 else ends[i - 1]), ends[i]
        for j in range(6):
            best = None
            for x, w in zip(base[a:z].tolist(), counts[a:z].tolist(), strict=True):
                x = (x + (j + 1) * 0x9E3779B97F4A7C15) & wrap
                x ^= x >> 32
                x = x * 0xBF58476D1CE4E5B9 & wrap
                x ^= x >> 29
                x = x * 0x94D049BB133111EB & wrap
                at = x >> (64 - fingerprints.POOL_BITS)
                t = math.floor(math.log(w) / r[at] + b[at])
                best = min(best or (9e9,), (c[at] - r[at] * (t - b[at] + 1), x, t))
            assert own[i, j] == (best[1] + best[2] * 0xD6E8FEB86659FD93) & wrap


def test_collision_rate_is_generalised_jaccard():
    """Pairs of texts with many repeated words, 2,000 samples: within five standard deviations, and without a bias."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        texts.append(" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(5, 80)).clip(0, 25)))
    marks = fingerprints.signatures(pa.array(texts), 2000, 1)
    errors = []
    for i in range(len(texts)):
        for j in range(i):
            true = generalised_jaccard(shingles(texts[i], 1), shingles(texts[j], 1))
            errors.append(((marks[i] == marks[j]).mean() - true) / math.sqrt(max(true * (1 - true), 1e-4) / 2000))
    assert max(map(abs, errors)) < 5 and abs(np.mean(errors)) < 0.3


def test_compare_edited(spark):
    """Ids that skip and repeat, nulls, and texts beside each other by falling id."""
    docs = [(i * 7 % 211, t) for i, t in enumerate(TEXTS)]
    wide = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("part", F.lit("x")).withColumn("fingerprint", F.lit(0)).withColumn("edge", F.lit(1))
    out = {r.doc_id: r for r in fingerprints.compare_edited(wide).collect()}
    plain = {r.doc_id: bytes(r.fingerprint) for r in fingerprints.fingerprints(wide).collect()}
    docs.sort(reverse=True)
    share = lambda a, b: sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) * 2 / len(a)
    assert len(out) == len(docs)
    exact = {}
    for (doc, own), (after_id, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        own, after = own or "", after or ""
        text = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        r = out[doc]
        assert (r.n_chars, bytes(r.edited_sha256).hex(), bytes(r.fingerprint)) == (len(own), sha(text), plain[doc])
        assert bytes(r.edited_fingerprint) == fingerprints.signatures(pa.array([text]))[0].tobytes()
        assert abs(r.near_edited - share(plain[doc], bytes(r.edited_fingerprint))) < 1e-9 and abs(r.near_next - share(plain[doc], plain[after_id])) < 1e-9
        exact[doc] = generalised_jaccard(shingles(own, 5), shingles(text, 5))
    assert np.mean([abs(out[d].near_edited - j) for d, j in exact.items()]) < 0.04
    by_text = defaultdict(set)
    for doc, text in docs:
        by_text[text or ""].add(plain[doc])
    assert all(len(x) == 1 for x in by_text.values())
    table = spark.createDataFrame([(d, plain[d], plain[docs[0][0]]) for d in plain], "d long, a binary, b binary")
    assert all(abs(r.x - share(plain[r.d], plain[docs[0][0]])) < 1e-9 for r in table.select("d", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect())


def test_compare_edited_of_few_rows(spark):
    kind = "doc_id long, text string"
    assert fingerprints.compare_edited(empty(spark)).count() == 0
    [r] = fingerprints.compare_edited(spark.createDataFrame([(1, "abcdef")], kind)).collect()
    assert bytes(r.edited_sha256).hex() == sha("abcdab") and r.near_next == 1
    same = spark.createDataFrame([(None, None)] * 40 + [(4, "x y z")] * 60 + [(None, "tail")], kind).repartition(6)
    rows = fingerprints.compare_edited(same).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == {(None, 0): 40, (4, 5): 60, (None, 4): 1}


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "") and [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def plain_search(docs, items, top):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, bag, sum(bag.values())) for d, bag in bags if bag]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = Counter()
    for item, text in items:
        scores = []
        for d, bag, size in bags:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m)) for w in terms_of(text) if bag[w])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        scores.sort(key=lambda x: x[:3])
        out.update((item, k + 1, x[3], -x[0]) for k, x in enumerate(scores[:top]))
    return out


ITEMS = [(0, "w1 w2 w3 W1"), (1, None), (2, "nothing known"), (3, "w5"), (3, "w6 w7"), (None, "w8 w9"), (4, " ".join(f"w{i}" for i in range(200))), (5, "one a b c 中文"), (6, "")]


@pytest.mark.parametrize(("shard_docs", "items_per_block", "cells", "top"), [(7, 4, 8, 3), (50, 100, 1 << 17, 10), (4096, 100, 300, 1)])
def test_search(spark, monkeypatch, shard_docs, items_per_block, cells, top):
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    texts = [*corpus(150), *AWKWARD, *["w1 w2 w3"] * 25, *["w5 " * 30] * 12]
    docs = [(None if i % 50 == 3 else i * 37 % 4001, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit("x")).withColumn("n", F.lit(0)).withColumn("terms", F.lit(0))
    queries = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("x"))
    out = Counter(tuple(r) for r in ranked_search.search(table, queries, top, items_per_block=items_per_block, shard_docs=shard_docs).collect())
    assert out == plain_search(docs, ITEMS, top)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(empty(spark), items).count() == 0
    assert ranked_search.search(frame(spark, corpus(5)), items.limit(0)).count() == 0
    assert ranked_search.search(frame(spark, [None, "", "!?"]), items).count() == 0


def test_wand_skips_documents(monkeypatch):
    """A term in all documents and a rare one: once a heap is full, documents with the common term alone are passed over."""
    size = 5000
    rare = np.arange(0, size, 100)
    terms = np.concatenate([np.zeros(size, np.int64), np.ones(len(rare), np.int64)])
    docs = np.concatenate([np.arange(size), rare])
    scores = np.concatenate([np.full(size, 10), np.full(len(rare), 1000)])
    shard = ranked_search.Shard(size, terms, docs, scores)
    steps = []
    own = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: (steps.append(1), own(*a, **k))[1])
    heaps = np.zeros((1, 10), np.int64)
    _, found, best = ranked_search.wand(shard, np.array([[0, 1]]), np.array([[1, 1]]), heaps)
    assert (heaps == 1010).all() and set(rare) <= set(found.tolist()) and len(steps) < 2 * len(rare) + 950


def test_fingerprint_query_against_brute_force(spark):
    """The whole query on the smallest tables: edited texts, and likeness near the generalised Jaccard similarity of each pair."""
    import os

    from quartzite.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    out = {r.doc_id: r for r in queries.op12_fingerprints(spark, folder).collect()}
    assert len(out) == len(docs)
    errors, marks = [], defaultdict(set)
    for (doc, own), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        text, r = fingerprints.edited(own, after), out[doc]
        assert (r.n_chars, r.edited_sha256, len(r.fingerprint), len(r.edited_fingerprint)) == (len(own), sha(text), 512, 512)
        marks[own].add(r.fingerprint)
        marks[text].add(r.edited_fingerprint)
        for near, other in ((r.near_edited, text), (r.near_next, after)):
            true = generalised_jaccard(shingles(own, 5), shingles(other, 5))
            errors.append((near - true) / math.sqrt(max(true * (1 - true), 0.01) / 128))
    assert max(map(abs, errors)) < 5 and abs(np.mean(errors)) < 0.3 and all(len(m) == 1 for m in marks.values())
