"""Words, hashes and suffix structures against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quartzite.llm")

from quartzite.llm import common, fm_index, repeats, substring_dedup, suffix_array_dedup

TEXTS = ["", None, "Hello  World\tfoo", " lead", "trail ", "Été Café-bar 42x", " nbsp em", "a\x0bb\x0cc\rd\n", "x" * 5000]


def test_words_match_regular_expressions():
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for kind, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        offsets, flat = common.word_lists(pa.array(TEXTS, pa.string()), kind)
        words = flat.to_pylist()
        assert [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [re.findall(pattern, lower(t)) for t in TEXTS]


def test_sliced_arrays_and_windows():
    offsets, flat = common.word_lists(pa.array(TEXTS, pa.string()).slice(2, 4))
    assert offsets[0] == 0 and offsets[-1] == len(flat)
    h = common.word_hashes(pa.array(list("abcabc")))
    w = common.window_hashes(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3 and len(common.window_hashes(h, 9)) == 0


def test_fm_index_finds_all_occurrences():
    rng = random.Random(5)
    for trial in range(30):
        runs = [[rng.randint(1, 4) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 6))]
        text = np.array([x for r in runs for x in [*r, 0]])
        index = fm_index.FMIndex(text, sample=rng.choice([1, 3, 8]))
        n = rng.randint(1, 4)
        phrases = np.array([[rng.randint(1, 5) for _ in range(n)] for _ in range(20)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), low, high, strict=True):
            expected = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_sliding_extremes():
    x = np.random.default_rng(0).integers(0, 100, 60)
    for width in (1, 2, 5, 13, 60):
        assert repeats.sliding(np.minimum, x, width).tolist() == [x[i : i + width].min() for i in range(61 - width)]


def brute_seen(contents, group, window):
    known, out = set(), []
    for g, c in zip(group, contents, strict=True):
        windows = [(g, *c[i : i + window]) for i in range(len(c) - window + 1)]
        out.append([])
        for w in windows:
            out[-1].append(w in known)
            known.add(w)
    return out


def groups_of_runs(rng, window, k, groups):
    """Different runs of windows with one minimiser, group after group, from small corpora in which grams recur often."""
    contents, group = [], []
    while len(set(group)) < groups:
        base = [rng.choice("abcd"[: rng.randint(2, 4)]) for _ in range(rng.randint(window, 4 * window))]
        texts = [base]
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice("abcd")
            texts.append(copy)
        runs = {}
        for text in texts:
            grams = common.window_hashes(common.word_digests(pa.array(text))[:, 0], k)
            low = [int(grams[i : i + window - k + 1].min()) for i in range(len(text) - window + 1)]
            edges = [0, *(i for i in range(1, len(low)) if low[i] != low[i - 1]), len(low)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                runs.setdefault(low[i], {})[tuple(text[i : j + window - 1])] = None
        for own in runs.values():
            group += [len(set(group))] * len(own)
            contents += own
    return [list(c) for c in contents], np.array(group)


@pytest.mark.parametrize("resolver", [lambda c, g, n, k: substring_dedup.seen_before(c, g, n), suffix_array_dedup.matched_before])
def test_resolvers_match_sets_of_windows(resolver):
    rng = random.Random(7)
    for trial in range(400):
        window = rng.randint(2, 7)
        k = rng.randint(1, min(3, window))
        contents, group = groups_of_runs(rng, window, k, 25)
        got = resolver(contents, group, window, k)
        assert [m.tolist() for m in got] == brute_seen(contents, group, window)


def test_equal_lane_hashes_do_not_make_equal_digests():
    digest = common.word_digests(pa.array(["a", "b", "a"]))
    assert digest.shape == (3, 2) and (digest[0] == digest[2]).all() and (digest[0] != digest[1]).all()
    assert common.word_digests(pa.array([], pa.string())).shape == (0, 2)
