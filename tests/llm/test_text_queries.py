"""The opN_ queries against SQL on the smallest tables, held-out accuracy, and the pipeline against brute force."""

import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quartzite.llm")

import corpus_pipeline
import public_tokenizers
from quartzite.llm import queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    own = queries.QUERIES[name](spark, SF).toPandas()
    other = duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(own.columns) == sorted(other.columns)
    rows = lambda f: sorted(tuple(None if v != v else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert list(map(str, rows(own))) == list(map(str, rows(other)))


def test_language_of_held_out_documents(spark, duck):
    out = queries.op2_language_id(spark, SF).where("held_out").toPandas().merge(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchdf(), on="doc_id")
    assert len(out) > 30 and (out.lang == out.lang_pred).mean() >= 0.97
    assert out.score.between(0, 1).all()


def test_spans_of_mixed_texts(spark, duck):
    """Held-out texts of two languages laid end to end: most words lie in spans of their own language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.language_id.fit(docs.where(~queries.language_id.held_out()))
    held = docs.where(queries.language_id.held_out()).where("lang IS NOT NULL AND n_chars > 200").select("doc_id", "text", "lang").orderBy("doc_id").limit(40).collect()
    pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if a.lang != b.lang]
    assert len(pairs) > 5
    size = lambda text: len(queries.language_id.words_of(pa.array([text]))[1])
    out = queries.language_id.identify(spark.createDataFrame([(i, f"{a.text}\n{b.text}") for i, (a, b) in enumerate(pairs)], "doc_id long, text string"), model).collect()
    right = total = 0
    for r in out:
        a, b = pairs[r.doc_id]
        lang = [a.lang] * size(a.text) + [b.lang] * size(b.text)
        assert [(s.start, s.stop) for s in r.spans] == [*zip([0, *(s.stop for s in r.spans)][:-1], [s.stop for s in r.spans], strict=True)] and r.spans[-1].stop == len(lang)
        right += sum(x == s.lang for s in r.spans for x in lang[s.start : s.stop])
        total += len(lang)
    assert right / total >= 0.95


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_quality_against_labels(spark, folder):
    out = queries.op9_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good, junk = out[out.quality == 1], out[out.quality == 0]
    rank = out.score.rank()
    auc = (rank[good.index].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(junk))
    assert auc >= 0.99 and good.kept.mean() >= 0.99 and junk.kept.mean() <= 0.05


def test_packing_is_whole(spark, duck):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    places, rooms = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, SF).collect():
        ids = np.array(expected[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(expected[r.doc_id])
        places[r.doc_id].append((r.start, r.length))
        rooms[r.sequence_id].append((r.offset, r.length))
    for parts, size in [*((p, len(expected[d])) for d, p in places.items()), *((p, None) for p in rooms.values())]:
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] == (size or ends[-1]) and (size or ends[-1] <= 2048)
    assert set(places) == set(expected)


def words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    results = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        results.append({r.doc_id: r.text for r in docs.collect()})
    rated, exact, near, clean = results
    scored = {r.doc_id: r.kept for r in queries.op9_quality(spark, SF).collect()}
    assert rated == {d: t for d, t in texts.items() if scored[d]}
    last = {}
    for d in sorted(rated):
        last[rated[d]] = d
    assert exact == {d: t for t, d in last.items()}

    shingles = {}
    for d, t in exact.items():
        ws = words(t, r"[^\x20\x09-\x0D]+")
        shingles[d] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}
    group = {d: d for d in exact}
    ids = sorted(exact)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[:i]:
                both = len(shingles[a] & shingles[b])
                if group[a] != group[b] and both and 100 * both >= 80 * (len(shingles[a]) + len(shingles[b]) - both):
                    low, high = sorted((group[a], group[b]))
                    group = {d: low if g == high else g for d, g in group.items()}
                    changed = True
    assert set(near) == {d for d in exact if group[d] == d} and all(near[d] == exact[d] for d in near)

    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = words(r.text, pattern)
        n = min(10, len(ws))
        grams |= {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
    sizes = {len(g) for g in grams}
    assert set(clean) == set(near)
    for d, t in near.items():
        ws = words(t, pattern)
        hit = {j for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in grams for j in range(i, i + n)}
        assert words(clean[d], pattern) == [w for j, w in enumerate(ws) if j not in hit]
        assert hit or clean[d] == t
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in stages["packing"](spark, docs, SF).collect():
        pieces[r.doc_id].append((r.start, r["ids"]))
    for d, t in clean.items():
        assert [x for _, ids in sorted(pieces[d]) for x in ids] == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_pipeline_on_awkward_tables(spark):
    """No rows; and null ids and texts, repeated rows and columns with names of the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = {"kept": True, "digest": b"x", "component_id": 1, "score": 0.5, "n_hit": 3, "batch": "b", "spans": None, "c0": 1, "__c0": 2}
    wide = docs.where("doc_id < 40")
    for name, value in names.items():
        wide = wide.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    some = wide.where("doc_id < 5")
    nulls = some.withColumn("doc_id", F.lit(None).cast("long")).unionByName(some.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1000))
    for table in (docs.limit(0), wide.limit(0), wide.unionByName(some).unionByName(nulls)):
        current, before = table, None
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = queries.exact_dedup.materialise(stage(spark, current, SF), "stage")
            assert current.columns == table.columns
            before = current.count() if before is None else before
            assert current.count() <= before
        packed = corpus_pipeline.STAGES[-1][1](spark, current, SF)
        assert packed.select("doc_id").distinct().count() == current.select("doc_id").distinct().count()
        assert (before == 0) == (table.limit(1).count() == 0)
    keys = [tuple(r) for r in current.select("doc_id", "text").collect()]
    assert len(set(keys)) == len(keys)
