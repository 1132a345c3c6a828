"""Each operator against a brute-force version, and its defined results for awkward rows."""

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from helpers import AWKWARD, corpus, empty, frame
from pyspark.sql import functions as F

pytest.importorskip("quartzite.llm")

from quartzite.llm import common, components, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, quality, repeats, substring_dedup, suffix_array_dedup, url_filter

TEXTS = corpus() + AWKWARD + ["", None, "one"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_decontamination(spark):
    items = [(0, TEXTS[5]), (1, "w1 w2"), (2, None), (3, ""), (4, " ".join((TEXTS[3] or "").split()[2:30])), (5, "a b c"), (6, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in TEXTS]
    expected = {}
    for d, ws in enumerate(words):
        hit, found = set(), set()
        for item, text in items:
            iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
            n = min(10, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(item)
        expected[d] = (len(ws), len(hit), sorted(found))
    for block in (100, 2):
        got = decontaminate.contamination(frame(spark, TEXTS), bench, items_per_block=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == expected
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got)
    clean = decontaminate.contamination(frame(spark, TEXTS), bench, clean=True)
    assert clean.columns == frame(spark, TEXTS).columns
    again = decontaminate.contamination(clean, bench.where("item_id <> 1")).where("n_hit > 0").count()
    assert again == 0 and clean.count() == len(TEXTS)
    untouched = {d for d, (_, n, _) in expected.items() if n == 0}
    assert all(r.text == TEXTS[r.doc_id] for r in clean.collect() if r.doc_id in untouched)
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(frame(spark, TEXTS), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_with_null_item_ids(spark):
    docs = frame(spark, ["u v alpha beta w", "gamma x y delta", "alpha z", "gamma delta"])
    items = [(None, "alpha beta"), (7, "gamma"), (None, "delta"), (8, "x y"), (7, "y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (100, 1, 2):
        got = decontaminate.contamination(docs, bench, items_per_block=block).collect()
        assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == {0: (2, [None]), 1: (4, [7, 8, None]), 2: (0, []), 3: (2, [7, None])}
        assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in got} == {0: [(2, 4)], 1: [(0, 4)], 2: [], 3: [(0, 2)]}
        clean = decontaminate.contamination(docs, bench, clean=True, items_per_block=block).collect()
        assert {r.doc_id: r.text.split() for r in clean} == {0: ["u", "v", "w"], 1: [], 2: ["alpha", "z"], 3: []}
    named = spark.createDataFrame([(f"item {i}" if i else None, t) for i, t in items], "item_id string, text string")
    got = decontaminate.contamination(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), named, items_per_block=2).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == {"d0": (2, [None]), "d1": (4, ["item 7", "item 8", None]), "d2": (0, []), "d3": (2, ["item 7", None])}


def test_decontamination_where_many_items_share_a_phrase(spark):
    """A phrase of 5,000 items in 1,000 places is searched once: the pairs of items and places never exist at once."""
    import resource
    import time

    shared = " ".join(f"p{i}" for i in range(10))
    items = [(i, f"{shared} own{i} tail") for i in range(5000)]
    vocabulary, phrases, having, ids = decontaminate.phrases_of(items, 10)
    assert sum(len(x[0]) for x in phrases.values()) == 1 + 2 * 5000 and max(map(len, having)) == 5000
    texts = pa.array([" x ".join([shared] * 500), "none", " y ".join([shared] * 500), shared + " own7 tail"])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    _, hit, pairs = decontaminate.scan(texts, vocabulary, phrases)
    assert time.time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert len(pairs) == 5 and hit.sum() == 2 * 5000 + 12
    docs = spark.createDataFrame(list(enumerate(texts.to_pylist())), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    every = list(range(5000))
    assert got == {0: (5000, every), 1: (0, []), 2: (5000, every), 3: (12, every)}
    assert {r.doc_id: len(r["items"]) for r in decontaminate.contamination(docs, bench, items_per_block=1700).collect()} == {0: 5000, 1: 0, 2: 5000, 3: 5000}


def test_exact_dedup(spark):
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    got = {r.doc_id: r for r in exact_dedup.deduplicate(frame(spark, TEXTS)).collect()}
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert bytes(got[i].digest).hex() == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.deduplicate(empty(spark)).count() == 0
    named = frame(spark, TEXTS).selectExpr("format_string('d%03d', doc_id) AS doc_id", "text", "1 AS batch", "2 AS keep_id")
    for r in exact_dedup.deduplicate(named).collect():
        assert int(r.keep_id[1:]) == got[int(r.doc_id[1:])].keep_id and r.group_size == got[int(r.doc_id[1:])].group_size
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_digest_index_keeps_what_it_has_seen(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    batches = {"one": frame(spark, ["a", "b", "b"]), "two": frame(spark, ["b", "c", None])}
    rows = lambda name: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(batches[name], index, name).collect())
    expected = {"one": [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True)], "two": [(0, 2, 1, False), (1, 1, 1, True), (2, 2, 1, True)]}
    assert rows("one") == expected["one"] and rows("two") == expected["two"]
    # A batch that is given again, in part too, changes nothing.
    assert rows("two") == expected["two"] and rows("one") == expected["one"] and index.table().count() == 4
    kept = exact_dedup.drop_duplicates(batches["two"], index, "two")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "c"), (2, None)]
    index.compact()
    assert index.table().count() == 4 and rows("two") == expected["two"]
    assert exact_dedup.deduplicate(empty(spark), index, "none").count() == 0
    index.drop()
    assert not index.exists()


APPLICATION = """
import sys
sys.path.insert(0, {root!r})
from quartzite.llm import exact_dedup
from quartzite.session import session
spark = session("batch", **{{"spark.master": "local[2]", "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": {base!r} + "/warehouse", "spark.checkpoint.dir": {base!r} + "/shared"}})
docs = spark.createDataFrame([(i, f"text {{i}}") for i in range({first}, {last})], "doc_id long, text string")
index = exact_dedup.DigestIndex(spark, {base!r} + "/index")
kept = exact_dedup.deduplicate(docs, index, "{batch}").where("kept").count()
print("RESULT", kept, index.table().count(), len(index._files(index.state)))
"""


def test_digest_index_outlives_its_application(tmp_path):
    """Applications of their own, one after the other, each with a new in-memory catalog: the second knows what the first has seen, in however many buckets it would have made."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])

    def run(first, last, batch):
        code = APPLICATION.format(root=root, base=str(tmp_path), first=first, last=last, batch=batch)
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        return [tuple(map(int, x.split()[1:])) for x in out.stdout.splitlines() if x.startswith("RESULT")][0]

    assert run(0, 1000, "one")[:2] == (1000, 1000)
    assert run(500, 1500, "two")[:2] == (500, 1500)
    assert run(500, 1500, "two")[:2] == (500, 1500)


def test_digest_index_compacts_and_refuses_other_files(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=2, most_files=3)
    for k in range(9):
        index.append(exact_dedup.with_digest(frame(spark, [f"{k} {i}" for i in range(20)] + ["all"])), f"batch {k}")
        assert index.table().count() == 20 * (k + 1) + 1 and len(index._files(index.state)) <= 6
    assert index.state["version"] > 0 and len([n for n in common.listing(spark, index.path) if n.startswith("data-")]) == 1
    again = exact_dedup.DigestIndex(spark, index.path, buckets=7)
    assert again.state["buckets"] == 2 and again.table().count() == 181
    common.write_new(spark, f"{index.path}/_versions/000000099.json", "{lost while wri")
    assert again.table().count() == 181
    common.write_new(spark, str(tmp_path / "other" / "file"), "x")
    with pytest.raises(ValueError, match="no digest index"):
        exact_dedup.DigestIndex(spark, str(tmp_path / "other")).append(exact_dedup.with_digest(frame(spark, ["a"])), "one")


def test_digest_index_stays_where_it_lies(spark):
    """Only the new digests move when a batch meets the index, whatever the number of its buckets."""
    for buckets in (4, 6):
        index = exact_dedup.DigestIndex(spark, buckets=buckets)
        index.append(exact_dedup.with_digest(frame(spark, ["a", "b"])), "one")
        new = common.materialise(exact_dedup.with_digest(frame(spark, ["b", "c", "c"])), "new")
        lacking = index.lacking(new)
        plan = lacking._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Exchange hashpartitioning(digest") == 1 and "LeftAnti" in plan
        assert f"SelectedBucketsCount: {buckets} out of {buckets}" in plan.partition("Exchange")[2]
        assert [r.keep_id for r in lacking.collect()] == [2]
        index.drop()


def test_drop_duplicates_with_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "b"), (None, "c"), (None, "c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (10**6, 0):
        got = sorted((r.text or "", r.doc_id or 0) for r in exact_dedup.drop_duplicates(df, broadcast_bytes=limit).collect())
        assert got == [("", 5), ("a", 1), ("b", 3), ("c", 0)]


def brute_lines(texts, least, keep):
    where = defaultdict(set)
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for d, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if key(line):
                where[key(line)].add(d)
    out, seen = {}, set()
    for d, t in enumerate(texts):
        kept = []
        lines = (t or "").split("\n")
        for line in lines:
            k = key(line)
            repeated = len(where[k]) >= least if k else False
            if not repeated or (keep == "first" and k not in seen):
                kept.append(line)
            if repeated:
                seen.add(k)
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("keep,least,broadcast", [("none", 3, 10**6), ("first", 2, 10**6), ("none", 2, 0), ("first", 2, 0)])
def test_line_dedup(spark, keep, least, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "FLUSH", 50)
    texts = ["\n".join(t.split(" w")) if t else t for t in TEXTS] + [" Same \nx", "same\ny", "SAME\r\nz", "same"]
    got = line_dedup.drop_lines(frame(spark, texts), least, 1, keep, broadcast_bytes=broadcast).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == brute_lines(texts, least, keep)
    named = frame(spark, texts).selectExpr("format_string('d%03d', doc_id) AS doc_id", "text")
    got = line_dedup.drop_lines(named, least, 1, keep, broadcast_bytes=broadcast).collect()
    assert {int(r.doc_id[1:]): (r.n_lines, r.n_dropped, r.text) for r in got} == brute_lines(texts, least, keep)


def test_suspected_lines_stay_few_as_tables_grow(spark):
    """Lines that occur once are hardly ever suspected, in tables of any size, because the filters grow with them."""
    shares = []
    for n in (2000, 20000):
        docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws('\n', transform(sequence(1, 10), i -> concat('a line of its own, ', sha2(concat(id, '-', i), 256))), 'shared') AS text")
        docs = common.materialise(docs, "docs")
        bits = line_dedup.filter_bits(docs)
        bitmap = line_dedup.repeated_filter(docs, bits, 1)
        table = pa.table(docs.limit(1000).toArrow())
        _, lines = line_dedup.lines_of(table.column("text").combine_chunks())
        _, digest, _ = line_dedup.digests(lines, 1)
        places = line_dedup.bit_places(digest, bits)
        shares.append(((bitmap[places >> 3] >> (places & 7)) & 1).all(axis=1).mean())
    assert max(shares) < 0.01


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_lines(empty(spark)).count() == 0


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("k,num,den,block", [(4, 85, 100, 4000), (5, 80, 100, 3), (1, 50, 100, 2)])
def test_jaccard_join(spark, k, num, den, block):
    texts = corpus(n=90, seed=k) + AWKWARD
    got = jaccard_join.similar_groups(frame(spark, texts), k, num, den, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, k, num, den)


def test_jaccard_join_of_chained_texts(spark):
    """A component of candidates that chance tokens chain together, with links at far places, beside a family of near copies."""
    import random

    rng = random.Random(8)
    texts = []
    for i in range(60):
        own = [f"u{i}_{j}" for j in range(12)]
        texts.append(" ".join([*(f"c{i}" for _ in range(1)), *own, f"c{i + 1}"]))
    texts += [t.replace("_3 ", "_x ") for t in texts[::9]]
    base = [f"f{j}" for j in range(60)]
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(60)] = f"z{rng.randrange(4)}"
        texts.append(" ".join(copy))
    for k, num in ((1, 70), (2, 60)):
        got = jaccard_join.similar_groups(frame(spark, texts), k, num, 100, block=7).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, k, num, 100)


def test_jaccard_bounds_lose_nothing():
    t = jaccard_join.Threshold(85, 100)
    for n in range(1, 300):
        for m in range(t.smallest_partner(n), n + 1):
            need = t.overlap(n, m)
            assert 100 * need >= 85 * (n + m - need) and 100 * (need - 1) < 85 * (n + m - need + 1)
            shared = min(int(t.extra(n)), int(t.extra(m)))
            assert n - need + shared <= t.beginning(n) and m - need + shared <= t.beginning(m)
            assert shared >= t.shared(n) and shared >= 1


def test_drop_similar_and_nothing(spark):
    texts = corpus(n=40) + [None, "", "one", "ONE"]
    expected = {i for i, (n, c) in brute_components(texts, 5, 80, 100).items() if i == c or not n}
    df = frame(spark, texts)
    for limit in (10**6, 0):
        out = jaccard_join.drop_similar(df, broadcast_bytes=limit)
        assert out.columns == df.columns and {r.doc_id for r in out.collect()} == expected
    assert jaccard_join.similar_groups(empty(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[200 + i] for i in range(30)} == {100} and got[301] == 300


def brute_repeats(texts, window):
    where = defaultdict(list)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            where[tuple(ws[i : i + window])].append((d, i))
    gone = defaultdict(set)
    for places in where.values():
        for d, i in places[1:]:
            gone[d].update(range(i, i + window))
    return {d: (len(ws), len(gone[d]), " ".join(w for i, w in enumerate(ws) if i not in gone[d])) for d, ws in enumerate(words)}


@pytest.mark.parametrize("window,operator", [(20, substring_dedup.deduplicate_substrings), (9, substring_dedup.deduplicate_substrings), (50, suffix_array_dedup.deduplicate_passages), (12, suffix_array_dedup.deduplicate_passages)])
@pytest.mark.parametrize("group", [1000, 1])
def test_repeated_passages(spark, window, operator, group):
    texts = corpus(n=80, seed=window, words=60) + AWKWARD + ["w w w w w x w w w w w w w w w w w w w w w w w w w w w"] * 2
    got = operator(frame(spark, texts), window, group=group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_repeats(texts, window)
    assert operator(empty(spark), window).count() == 0
    named = frame(spark, texts).selectExpr("if(doc_id = 79, null, format_string('d%03d', doc_id)) AS doc_id", "text")
    order = [*range(79), *range(80, len(texts)), 79]  # a null id comes last
    expected = {d: x for d, x in zip(order, brute_repeats([texts[i] for i in order], window).values(), strict=True)}
    got = operator(named, window, group=group).collect()
    assert {79 if r.doc_id is None else int(r.doc_id[1:]): (r.n_words, r.n_removed, r.text) for r in got} == expected


@pytest.mark.parametrize("window,shard", [(5, 40), (12, 10**6)])
def test_remove_known(spark, window, shard):
    """Every word of a run of words that a reference text holds goes, whatever shard it is in; the reference is not changed by documents."""
    texts = corpus(n=60, seed=9, words=30) + AWKWARD
    known = [texts[3], " ".join((texts[9] or "").split()[5:50]), None, "", "a b", texts[3], " ".join(f"r{i}" for i in range(300)), "q " * 100]
    texts += ["x " + " ".join(f"r{i}" for i in range(20, 120)) + " y", "q " * 30 + "z " + "q " * 4]
    windows = set()
    for t in known:
        ws = (t or "").split()
        windows |= {tuple(ws[i : i + window]) for i in range(len(ws) - window + 1)}
    expected = {}
    for d, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {j for i in range(len(ws) - window + 1) if tuple(ws[i : i + window]) in windows for j in range(i, i + window)}
        expected[d] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))
    reference = spark.createDataFrame([(t,) for t in known], "text string")
    got = substring_dedup.remove_known(frame(spark, texts), reference, window, shard_words=shard).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == expected
    assert substring_dedup.remove_known(frame(spark, texts), reference.limit(0), window).where("n_removed > 0").count() == 0
    assert substring_dedup.remove_known(empty(spark), reference, window).count() == 0


@pytest.mark.parametrize("operator", [substring_dedup.deduplicate_substrings, suffix_array_dedup.deduplicate_passages])
def test_three_texts_with_a_recurring_minimiser(spark, operator):
    """Passages that match at the second place of a minimiser, in texts whose first places do not match."""
    phrase, core = [f"p{i}" for i in range(8)], [f"c{i}" for i in range(37)]
    texts = [" ".join(x) for x in (phrase + core + phrase + [f"t{i}" for i in range(60)], ["x", *core, *phrase, *(f"t{i}" for i in range(60))], ["y", *phrase, *core, *phrase])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in operator(frame(spark, texts), 50).collect()}
    assert got == brute_repeats(texts, 50)


@pytest.mark.parametrize("operator", [substring_dedup.deduplicate_substrings, suffix_array_dedup.deduplicate_passages])
def test_passages_whose_minimiser_recurs(spark, operator):
    """A holds the minimiser twice, and B's only passage starts at its second place."""
    from quartzite.llm.common import window_hashes, word_digests

    def least(words):
        return int(window_hashes(word_digests(pa.array(words))[:, 0], 8).argmin())

    for seed in range(10_000):
        v, middle, tail = ([f"{kind}{seed}_{i}" for i in range(n)] for kind, n in (("v", 8), ("m", 22), ("t", 42)))
        if least(v + middle + v + tail) == least(v + tail) == 0:
            break
    texts = [" ".join(v + middle + v + tail), " ".join(v + tail)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in operator(frame(spark, texts), 50).collect()}
    assert got == brute_repeats(texts, 50) == {0: (80, 0, texts[0]), 1: (50, 50, "")}


def test_url_filter_beyond_the_broadcast(spark, monkeypatch):
    urls = ["http://a.com/en/1", "HTTP://WWW.Example.COM/en/?q", "x", None, "https://b.net/fr", "https://b.net/fr/", "http://com", "http://com/", "http://c.org/#://d.com/", "http://user@e.com:80/en/", "http://a.com/en/1", "https://" + "a." * 20000 + "net/fr/x", "https://" + "b" * 50000 + "/", "x://net/fr"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/fr/")] + [("block", f"site{i}.org", "/") for i in range(40)]

    def judge(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        before = re.match(r"[^?#]*", rest)[0]
        host, path = lower(re.match("[^/]*", before)[0]), before[len(re.match("[^/]*", before)[0]) :]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    expected = sorted(map(str, [(i, *judge(u)) for i, u in enumerate(urls)] + [(0, *judge(urls[0]))]))
    for limit in (10, 10**6):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        got = url_filter.judge(pages, url_filter.rules_from(spark, rules)).collect()
        assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == expected
    none = url_filter.judge(pages, url_filter.rules_from(spark, rules).limit(0))
    assert none.count() == len(urls) + 1 and none.where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def check_packing(pieces, tokens, segments, loss, documents):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(documents)
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        assert [x for p in ps for x in p["ids"]] == documents[d]
        assert all(p.doc_tokens == len(documents[d]) for p in ps)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        total = sum(p.length for p in ps)
        assert total <= tokens and len(ps) <= segments and sum(p.loss for p in ps) <= loss
        assert total == tokens or total & (total - 1) == 0


def test_packing_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = TEXTS + ["<|endoftext|> a<|endoftext|>", "it's  \t  12½ \U0001f600‍"]
    expected = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    check_packing(packing.pack(frame(spark, texts), path).collect(), 2048, 64, 2048, expected)
    small = packing.pack(frame(spark, texts), path, tokens=64, segments=3, loss=50, pool=4).collect()
    check_packing(small, 64, 3, 50, expected)
    assert packing.pack(empty(spark), path).count() == 0
    long = [" " * 1_000_000, "x" * 200_000, "\n \t" * 50_000, " ".join("word" for _ in range(50_000))]
    named = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(long)] + [(None, "x")], "doc_id string, text string")
    expected = {f"d{i}": [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(long)} | {None: [*plain.encode("x").ids, 1]}
    check_packing(packing.pack(named, path).collect(), 2048, 64, 2048, expected)


def test_fast_encoder_gives_the_ids_of_the_library():
    """Every seventh code point beside letters, digits, blanks and marks; and files for which the proof must fail."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    encode = packing.load_encoder(path, packing.merges_by_rank(spec))
    points = [chr(i) for i in [*range(0x3000), *range(0x3000, 0x110000, 7)] if not 0xD800 <= i < 0xE000]
    texts = [f"a{x}b 1{x}2 {x}{x} .{x}'s \n{x}\n" for x in points]
    plain = Tokenizer.from_file(path)
    assert [encode(t) for t in texts] == [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    merges = spec["model"]["merges"]
    swapped = [*merges[:1000], merges[1001], merges[1000], *merges[1002:]]
    assert packing.merges_by_rank(spec | {"model": spec["model"] | {"merges": swapped}}) is None
    assert packing.merges_by_rank(spec | {"normalizer": {"type": "NFC"}}) is None
    assert packing.load_encoder(path)("a  b") == plain.encode("a  b").ids
    assert packing.has_long_run("\n \t" * 2000) and packing.has_long_run("x" * 5000) and not packing.has_long_run("x  " * 5000)


def test_packing_examples_under_a_loss_limit(spark):
    rows = [(i, list(range(i % 37 + 1)), [j % 3 == 0 and 1 or 0 for j in range(i % 37 + 1)]) for i in range(200)] + [(200, None, None), (201, [5] * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss_mask array<int>").repartition(2)
    got = packing.pack_examples(df, tokens=128, segments=8, loss=40, pool=16).collect()
    check_packing(got, 128, 8, 40, {i: ids for i, ids, _ in rows if ids})
    assert not [r for r in got if r.doc_id == 200]  # an example without ids has no piece
    import public_tokenizers

    with pytest.raises(Exception, match="at least 1"):
        packing.pack(frame(spark, ["a"]), public_tokenizers.path("byte_bpe_50k.json"), loss=0).collect()


def test_language_id(spark):
    en, de = ["the thing that was with them", "which of these there"], ["der ist nicht und schön", "über die straße"]
    ru = ["это просто текст"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t * 3, "en") for t in en] + [(t * 3, "de") for t in de] + [(t, "ru") for t in ru] + [("zzz", None), (None, "en")])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    texts = ["the thing that was with them", "текст", None, "", "123 !!", "the thing that was with them which of these there это просто текст это", "中文", "\u0301 \u0302"]
    out = {r.doc_id: r for r in language_id.identify(frame(spark, texts), model).collect()}
    assert [out[i].lang_pred for i in range(5)] == ["en", "ru", "und", "und", "und"] and out[2].score == 0
    assert [(s.lang, s.start, s.stop) for s in out[5].spans] == [("en", 0, 10), ("ru", 10, 14)]
    assert out[6].lang_pred in model.languages and out[7].lang_pred == "und"
    nothing = language_id.fit(empty(spark))
    assert language_id.identify(frame(spark, texts), nothing).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty(spark), model).count() == 0


def test_viterbi_matches_exhaustive_search():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    lengths = [0, 1, 5, 3]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    score = rng.normal(size=(sum(lengths), 3)).astype(np.float32)
    label = language_id.viterbi(score, offsets, 0.7)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        value = lambda path: sum(score[a + i, k] for i, k in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(label[a:b].tolist()) - best) < 1e-4


def test_viterbi_with_excluded_and_many_languages():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    score = rng.normal(size=(7, 3)).astype(np.float32)
    score[[0, 2, 3], [0, 1, 2]] = -np.inf
    score[5] = [-np.inf, -np.inf, 0]
    label = language_id.viterbi(score, np.array([0, 7]), 0.7)
    value = lambda path: sum(score[i, k] for i, k in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))
    assert abs(value(label.tolist()) - max(map(value, itertools.product(range(3), repeat=7)))) < 1e-4
    many = np.full((4, 300), -1.0, np.float32)
    many[:, 250] = 0
    assert language_id.viterbi(many, np.array([0, 1, 4]), 2.0).tolist() == [250] * 4


def test_more_than_127_languages(spark):
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 26)}"] * 5), f"l{i:03d}") for i in range(150)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, [t for _, t, _ in rows]), model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_samples_of_huge_corpora_are_not_empty(spark):
    """The share that a corpus of 1e11 rows leaves still chooses rows, and about as many as it should."""
    from quartzite.llm.common import sample_share

    n = 2_000_000
    for wanted in (1.0, 0.3, 1e-3):
        found = spark.range(n).where(sample_share(wanted, F.col("id"))).count()
        assert abs(found - wanted * n) <= 5 * (wanted * n) ** 0.5
    assert quality.sampled_share(10**11, 10**15) == pytest.approx(1e-8) and quality.sampled_share(10**11, 10**11) == pytest.approx(2e-7)
    least = F.shiftrightunsigned(F.xxhash64("id"), 1)
    smallest = spark.range(n).agg(F.min(least)).first()[0]
    assert spark.range(n).where(sample_share((smallest + 2**20) / 2**63, F.col("id"))).count() >= 1


def test_samples_of_null_and_repeated_rows(spark):
    """Null ids don't go together, and of rows that repeat one is learned from."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert 50 < common.sampled(rows, 100 / 20_000).count() < 160
    alike = rows.withColumn("text", F.lit("the same"))
    assert common.sampled(rows.unionByName(alike), 1.0).count() == 20_001 and common.sampled(alike.unionByName(rows), 100 / 40_000).count() < 100


def test_estimate_is_expectation_maximisation():
    """Against a plain version, one document at a time; and a labeller that is often wrong is found out."""
    import numpy as np

    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.8
    right = [0.95, 0.9, 0.85, 0.55]
    votes = np.stack([np.where(rng.random(3000) < 0.2, 2, np.where(rng.random(3000) < r, truth, ~truth)) for r in right], axis=1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    got, accuracy = quality.estimate(patterns, counts.astype(float), rounds=30)
    prior, rate = 0.8, [[[0.35, 0.65], [0.03, 0.97]] for _ in right]
    for _ in range(30):
        p = []
        for row in votes.tolist():
            like = [1 - prior, prior]
            for k, v in enumerate(row):
                if v != 2:
                    like = [like[y] * rate[k][y][v] for y in (0, 1)]
            p.append(like[1] / sum(like))
        prior = sum(p) / len(p)
        for k in range(len(right)):
            seen = [[1.0, 1.0], [1.0, 1.0]]
            for row, x in zip(votes.tolist(), p, strict=True):
                if row[k] != 2:
                    seen[0][row[k]] += 1 - x
                    seen[1][row[k]] += x
            rate[k] = [[v / sum(s) for v in s] for s in seen]
    assert np.allclose(got[where.ravel()], p, atol=1e-6) and np.allclose(accuracy, rate, atol=1e-6)
    assert accuracy[0, 0, 0] > 0.85 and accuracy[3, 0, 0] < 0.7 and accuracy[3, 1, 1] < 0.7


def test_quality(spark):
    import random

    rng = random.Random(0)
    words = ["the", "of", "and", "in"] * 5 + ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(4, 9))) for _ in range(80)] + ["end."] * 8
    good = [" ".join(rng.choice(words) for _ in range(60)).capitalize() for _ in range(60)]
    caps = [t.upper().replace(" ", "!! ") for t in good[:8]]
    marks = [t.replace(" ", "### ") for t in good[8:16]]
    same = ["Spam " * 40 for _ in range(8)]
    texts = good + caps + marks + same + [None, "", "   "]
    df = frame(spark, texts)
    scorer = quality.fit(df)
    assert list(scorer.accuracy) == quality.NAMES and all(0 <= x <= 1 for pair in scorer.accuracy.values() for x in pair)
    out = {r.doc_id: r for r in quality.score(df, scorer).collect()}
    assert all(out[i].kept for i in range(60)) and not any(out[i].kept for i in range(60, len(texts)))
    assert out[len(texts) - 1].score == 0 and out[len(texts) - 1].posterior is None
    kept = quality.filter_quality(df, scorer)
    assert kept.columns == df.columns and kept.count() == 60
    assert quality.score(empty(spark), quality.fit(empty(spark))).count() == 0
    alike = frame(spark, ["word " * 3])
    assert quality.score(alike, quality.fit(alike)).count() == 1


def test_null_and_repeated_ids(spark):
    """Each row of a table with null and repeated ids has its row, and equal rows have equal results."""
    texts = [*corpus(n=12), None, "", "one two three four five six seven eight nine ten eleven twelve"]
    rows = [(None if i % 4 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, texts[3]), (None, texts[2])], "item_id long, text string")
    model = language_id.fit(df.withColumn("lang", F.lit("xx")))
    results = {
        "1": decontaminate.contamination(df, bench),
        "2": language_id.identify(df, model),
        "3": exact_dedup.deduplicate(df),
        "4": line_dedup.drop_lines(df, 2, 1, "first"),
        "5": jaccard_join.similar_groups(df),
        "6": substring_dedup.deduplicate_substrings(df, 5),
        "9": quality.score(df, quality.fit(df)),
        "10": suffix_array_dedup.deduplicate_passages(df, 6),
    }
    for name, out in results.items():
        assert out.count() == len(rows), name
    same = {str(r) for r in substring_dedup.deduplicate_substrings(df.where("doc_id = 3"), 5).where(F.col("n_words") == len(texts[3].split())).collect()}
    assert len(same) == 1
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    assert packing.pack(df, path).agg(F.sum("length")).first()[0] >= len(rows)


def test_very_long_texts(spark):
    """Texts of a million characters and more, among short ones, in every operator that reads texts."""
    import public_tokenizers

    again = " ".join(f"w{i % 5000}" for i in range(120_000))
    lines = "\n".join(f"line {i % 300} of {i}" if i % 3 else "always the same" for i in range(60_000))
    texts = [again, lines, "x" * 1_500_000, " " * 1_500_000, "short text of a few words", None, "always the same", "é" * 700_000]
    df = frame(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.deduplicate_substrings(df, 20).collect()}
    assert got == brute_repeats(texts, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in suffix_array_dedup.deduplicate_passages(df, 50).collect()}
    assert got == brute_repeats(texts, 50)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_lines(df, 2, 1, "none").collect()}
    assert got == brute_lines(texts, 2, "none")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, [*texts, again + " more"]), 4, 85, 100).collect()}
    assert got == brute_components([*texts, again + " more"], 4, 85, 100)
    bench = spark.createDataFrame([(1, "few words"), (2, " ".join(f"w{i}" for i in range(40, 60)))], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect()}
    assert found[0] == (120_000, 24 * 20, [2]) and found[4][1:] == (2, [1]) and found[2] == (1, 0, [])
    model = language_id.fit(df.withColumn("lang", F.when(F.col("doc_id") < 3, "aa").otherwise("bb")))
    out = {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()}
    assert len(out) == len(texts) and out[3] == "und" and out[5] == "und"
    assert quality.score(df, quality.fit(df)).count() == len(texts)
    assert exact_dedup.deduplicate(df).where("kept").count() == len(set(t or "" for t in texts))
    lengths = {r.doc_id: r.n for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert len(lengths) == len(texts) and lengths[5] == 1 and lengths[3] == 1_500_001


def test_equally_many_letters_and_equally_good_languages(spark):
    """Of languages that are equally good for a text the first in order of their names wins."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aaaa", "zz"), ("aaaa", "mm"), ("bbbb", "kk")])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, ["aaaa aaaa", "aaaa " * 3 + "bbbb " * 3]), model).collect()}
    assert out == {0: "mm", 1: "kk"}
