"""The whole results of language identification and of the quality classifier against plain versions, written from their definitions."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quartzite.llm")

import xxhash
from helpers import AWKWARD
from pyspark.sql import functions as F
from quartzite.llm import language_id, quality

SF = "/root/testdata/sf0.001"
WRAP = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 6000")
    return table.unionByName(extra, allowMissingColumns=True).cache()


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & WRAP
    return x ^ (x >> 31)


def letters(text):
    """Lower-cased words of letters and the marks between them."""
    words = re.split(r"[^\w]|[\d_]", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()))
    return [w for w in words if w and any(unicodedata.category(c)[0] == "L" for c in w)]


def grams_of(word):
    points = [ord(c) for c in f" {word} "]
    for n in language_id.ORDERS:
        for i in range(len(points) - n + 1):
            if n > 1 or points[i] != 32:
                h = 0
                for p in points[i : i + n]:
                    h = (h * 0x100000001B3 + p + 1) & WRAP
                yield mixed((h + n) & WRAP) % language_id.BUCKETS


def script_of(word):
    counts = Counter()
    for c in word:
        at = max(i for i, s in enumerate(language_id.SCRIPT_STARTS) if s <= ord(c))
        counts[language_id.SCRIPT_NAMES[at]] += 1
    return min(counts, key=lambda s: (-counts[s], s))


def plain_language(learn, texts, penalty=language_id.PENALTY):
    languages = sorted({lang for _, lang in learn})
    grams, scripts = {k: Counter() for k in languages}, {k: Counter() for k in languages}
    for text, lang in learn:
        for word in letters(text):
            grams[lang].update(grams_of(word))
            scripts[lang][script_of(word)] += len(word)
    log = {k: (lambda b, c=grams[k], total=sum(grams[k].values()) + 0.05 * language_id.BUCKETS: math.log((c[b] + 0.05) / total)) for k in languages}
    known: dict[str, list[float]] = {}

    def score(word):
        if word not in known:
            total = [sum(np.float32(log[k](b) - max(log[x](b) for x in languages)) for b in grams_of(word)) for k in languages]
            s = script_of(word)
            allowed = [scripts[k][s] >= language_id.SCRIPT_SHARE * max(sum(scripts[k].values()), 1) for k in languages]
            total = [x if ok or not any(allowed) else -math.inf for x, ok in zip(total, allowed, strict=True)]
            known[word] = [max(x - max(total), language_id.FLOOR) if x > -math.inf else x for x in total]
        return known[word]

    out = []
    for text in texts:
        words = letters(text)
        if not words:
            out.append(("und", 0.0))
            continue
        best, back = list(score(words[0])), []
        for word in words[1:]:
            top = max(best)
            switch = [top - penalty > b for b in best]
            back.append([best.index(top) if s else k for k, s in enumerate(switch)])
            best = [max(b, top - penalty) + s for b, s in zip(best, score(word), strict=True)]
        path = [best.index(max(best))]
        for step in reversed(back):
            path.append(step[path[-1]])
        count = Counter()
        for word, k in zip(words, reversed(path), strict=True):
            count[k] += len(word)
        first = min(count, key=lambda k: (-count[k], k))
        out.append((languages[first], count[first] / sum(count.values())))
    return out


def test_language_identification_as_a_whole(spark, docs):
    """Every document's language and score: the sample holds all rows here, so both versions learn from the same ones."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    rows = docs.select("doc_id", "text", "lang", language_id.held_out().alias("held")).collect()
    expected = plain_language([(r.text, r.lang) for r in rows if not r.held and r.lang], [r.text for r in rows])
    wrong = [r.doc_id for r, (lang, score) in zip(rows, expected, strict=True) if got[r.doc_id][0] != lang or abs(got[r.doc_id][1] - score) > 0.02]
    assert len(got) == len(rows) > 150 and len(wrong) <= 1, wrong  # sums of single precision may tip a word


def shape_of(word):
    for test, to in ((lambda c: unicodedata.category(c) == "Lu", "A"), (lambda c: unicodedata.category(c) in ("Ll", "Lo", "Lt", "Lm") or unicodedata.category(c)[0] == "M", "a"), (lambda c: unicodedata.category(c)[0] == "N", "0")):
        out, run = [], False
        for c in word:
            if test(c):
                if not run:
                    out.append(to)
                run = True
            else:
                out.append(c)
                run = False
        word = "".join(out)
    return xxhash.xxh3_64_intdigest(word) % quality.FEATURES


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return None
    n, chars = len(words), sum(map(len, words))
    kind = Counter(unicodedata.category(c) for w in words for c in w)
    total_letters = sum(v for k, v in kind.items() if k[0] == "L")
    same = [i > 0 and words[i] == words[i - 1] for i in range(n)]
    run = longest = 0
    for s in same:
        run = run + 1 if s else 1
        longest = max(longest, run)
    is_letters = lambda w: all(unicodedata.category(c)[0] == "L" for c in w)
    return words, same, {
        "odd": sum(c in "#$%&*|<>{}[]\\^~=_@+" for w in words for c in w) / chars, "upper": kind["Lu"] / max(total_letters, 1), "marks": sum(w.endswith("!") for w in words) / n, "short": sum(len(w) <= 3 and is_letters(w) for w in words) / n,
        "ends": sum(w[-1] in ".?!" for w in words) / n, "same": sum(same) / n, "run": longest, "top": max(Counter(words).values()) / n, "letters": total_letters / chars, "words": n,
    }


def plain_votes(s):
    enough = s["words"] >= quality.ENOUGH
    say = lambda junk, good: quality.JUNK if junk else quality.GOOD if good else quality.ABSTAIN
    return (
        say(s["odd"] > 0.05, s["odd"] < 0.02), say(s["upper"] > 0.5, s["upper"] < 0.2), say(s["marks"] > 0.3, s["marks"] < 0.1), say(enough and s["same"] > 0.1, enough and s["same"] < 0.03),
        say(s["run"] >= 6, enough and s["run"] <= 3), say(enough and (s["top"] > 0.25 or s["same"] > 0.3), enough and s["top"] < 0.15 and s["same"] < 0.03), say(enough and s["short"] < 0.05, enough and s["short"] > 0.15),
        say(enough and (s["ends"] < 0.01 or s["ends"] > 0.6), enough and s["ends"] > 0.02 and s["ends"] < 0.35), say(enough and s["letters"] < 0.75, s["letters"] > 0.9),
    )


def test_quality_as_a_whole(spark, docs):
    """Votes, posteriors and the scores of every document; equal rows count once in the fit, as in the sample."""
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    measured = {d: plain_measures(t) for d, t in rows.items()}
    votes = {d: plain_votes(m[2]) for d, m in measured.items() if m}
    patterns = Counter(votes.values())
    listed = sorted(patterns)
    posterior, _ = quality.estimate(np.array(listed), np.array([patterns[p] for p in listed], float))  # itself held against a plain version
    of = dict(zip(listed, posterior.tolist(), strict=True))
    vectors = {}
    for d, m in measured.items():
        if m:
            words, same, _ = m
            shapes = [shape_of(w) for w in words]
            counts = Counter(shapes) + Counter((a * 31 + b * 17 + 7) % quality.FEATURES for a, b in zip(shapes, shapes[1:], strict=False)) + Counter({xxhash.xxh3_64_intdigest("same word again") % quality.FEATURES: sum(same)})
            norm = math.sqrt(sum(v * v for v in counts.values()))
            vectors[d] = {k: v / norm for k, v in counts.items() if v}
    ids = sorted(vectors)
    used = sorted({k for v in vectors.values() for k in v})
    place = {k: i for i, k in enumerate(used)}
    x = np.zeros((len(ids), len(used) + 1))
    x[:, -1] = 1
    for i, d in enumerate(ids):
        for k, v in vectors[d].items():
            x[i, place[k]] = np.float32(v)
    target = np.array([of[votes[d]] for d in ids])
    weights = ahead = np.zeros(x.shape[1])
    pace = 1.0
    for _ in range(150):
        gradient = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - target) / len(ids) + 1e-5 * ahead
        step = ahead - 4.0 * gradient
        following = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        ahead, weights, pace = step + (pace - 1) / following * (step - weights), step, following
    scores = dict(zip(ids, (1 / (1 + np.exp(-(x @ weights)))).tolist(), strict=True))
    assert len(got) == len(rows) > 150
    for d in rows:
        if d in scores:
            assert got[d].posterior == pytest.approx(of[votes[d]], abs=1e-9) and got[d].score == pytest.approx(scores[d], abs=1e-4) and got[d].kept == (got[d].score >= 0.5), d
        else:
            assert got[d].score == 0 and got[d].posterior is None and not got[d].kept
