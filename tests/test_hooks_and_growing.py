"""Models and descriptors that users register, substring matches, growing files and the ledger sink."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import descriptors, eos, fits, match, select
from quartzite.sources import files, trajectories
from quartzite.streaming import growing
from test_ranges import trajectory


def bm(v, e0, v0, b0, b0p):
    x = (v0 / v) ** (2 / 3)
    return e0 + 9 * v0 * b0 / 16 * ((x - 1) ** 3 * b0p + (x - 1) ** 2 * (6 - 4 * x))


def vinet(v, e0, v0, b0, b0p):
    x, eta = (v / v0) ** (1 / 3), 1.5 * (b0p - 1)
    return e0 + 9 * b0 * v0 / eta**2 * (1 + (eta * (1 - x) - 1) * math.exp(eta * (1 - x)))


TRUE = {"a": (-10.0, 60.0, 0.6, 4.2), "b": (-500.0, 100.0, 0.9, 5.5), "c": (3.0, 45.0, 0.3, 3.1)}
NAMES = ["e0", "v0", "b0", "b0p"]


def start():
    return [F.min("e"), F.min_by("v", "e"), F.lit(0.5), F.lit(4.0)]



@pytest.mark.parametrize(("name", "curve"), [("birch_murnaghan", bm), ("vinet", vinet)])
def test_fits_give_parameters_back(spark, name, curve):
    rows = [(k, p[1] * s, curve(p[1] * s, *p)) for k, p in TRUE.items() for s in np.linspace(0.85, 1.15, 13).tolist()]
    rows += [("few", 50.0, 1.0), ("few", 51.0, 2.0), ("a", None, 1.0), ("b", 100.0, None), ("c", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, e double").repartition(4)
    out = {r.k: r for r in fits.fit(df, ["k"], "v", "e", name, start(), NAMES).collect()}
    for k, p in TRUE.items():
        assert [out[k][c] for c in NAMES] == pytest.approx(p, rel=1e-5) and out[k].converged and out[k].n == 13 and out[k].rounds < 40
    assert out["few"].e0 is None and not out["few"].converged


def test_fit_of_noisy_points_is_least_squares(spark):
    """The non-linear fit and the closed form of the linear one reach the same sum of squares."""
    rng = np.random.default_rng(2)
    rows = [(k, v, bm(v, *p) + rng.normal(0, 0.01)) for k, p in TRUE.items() for v in np.linspace(0.85, 1.15, 25) * p[1]]
    df = spark.createDataFrame([(k, float(v), float(e)) for k, v, e in rows], "k string, v double, e double")
    out = {r.k: r for r in fits.fit(df, ["k"], "v", "e", "birch_murnaghan", start(), NAMES).collect()}
    closed = {r.k: r for r in eos.fit(df, ["k"], "v", "e").collect()}
    for k in TRUE:
        assert out[k].e0 == pytest.approx(closed[k].e0, abs=1e-4) and out[k].v0 == pytest.approx(closed[k].v0, rel=1e-4) and out[k].b0p == pytest.approx(closed[k].b0p, rel=1e-2)


def test_fit_of_a_registered_model_within_bounds(spark):
    fits.register("decay", lambda x, a, rate: a * F.exp(-rate * x))
    rows = [("g", float(x), 3.0 * math.exp(-0.7 * x)) for x in range(8)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    free = fits.fit(df, ["k"], "x", "y", "decay", [F.lit(1.0), F.lit(0.1)], ["a", "rate"]).first()
    assert (free.a, free.rate) == pytest.approx((3.0, 0.7), rel=1e-5) and free.sse < 1e-10
    held = fits.fit(df, ["k"], "x", "y", "decay", [F.lit(1.0), F.lit(0.1)], ["a", "rate"], bounds=[(0.0, 10.0), (0.0, 0.5)]).first()
    assert held.rate <= 0.5 and held.sse > free.sse
    weighted = df.withColumn("w", F.when(F.col("x") < 2, 0.0).otherwise(1.0)).withColumn("y", F.when(F.col("x") < 2, 99.0).otherwise(F.col("y")))
    assert fits.fit(weighted, ["k"], "x", "y", "decay", [F.lit(1.0), F.lit(0.1)], ["a", "rate"], weight="w").first().rate == pytest.approx(0.7, rel=1e-4)
    assert fits.fit(df.limit(0), ["k"], "x", "y", "decay", [F.lit(1.0), F.lit(0.1)], ["a", "rate"]).count() == 0


def atoms(rows):
    return [{"idx": i, "symbol": s, "pos": p, "vel": None, "force": None} for i, (s, p) in enumerate(rows)]


def test_descriptors(spark):
    from quartzite import schema

    rng = random.Random(4)
    made = []

    @descriptors.register("mean_height")
    def mean_height(scale):
        return lambda symbols, x, cell: np.array([scale * x[:, 2].mean() if len(x) else 0.0, len(symbols)])

    rows = []
    for k in range(30):
        n = rng.randint(0, 6)
        space, cell = ("fractional", [4.0, 0.0, 0.0, 1.0, 5.0, 0.0, 0.0, 0.0, 6.0]) if k % 2 else ("cartesian", [4.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 6.0] if k % 3 else None)
        made.append((k, space, cell, [(rng.choice("HO"), [rng.random() * (1 if k % 2 else 4) for _ in range(3)]) for _ in range(n)]))
        rows.append({"path": "p", "frame_index": k, "n_atoms": n, "cell": cell, "coord_space": space, "atoms": atoms(made[-1][3])})
    df = spark.createDataFrame(rows, schema.FRAME).repartition(3)
    got = {r.frame_index: r.vector for r in descriptors.described(df, "distance_histogram", cutoff=3.0, bins=6).collect()}
    heights = {r.frame_index: r.vector for r in descriptors.described(df, "mean_height", scale=2.0).collect()}
    shares = {r.frame_index: r.vector for r in descriptors.described(df, "composition", elements=["H", "O"]).collect()}
    for k, space, cell, own in made:
        lattice = np.array(cell).reshape(3, 3) if cell else None
        x = [np.array(p) @ lattice if space == "fractional" else np.array(p) for _, p in own]
        bins = [0] * 6
        for i in range(len(x)):
            for j in range(i):
                gap = x[i] - x[j]
                if cell:
                    part = gap @ np.linalg.inv(lattice)
                    gap = (part - np.round(part)) @ lattice
                d = float(np.sqrt((gap**2).sum()))
                if d < 3.0:
                    bins[int(d / 3.0 * 6)] += 1
        assert got[k] == pytest.approx([b / max(len(x), 1) for b in bins])
        assert heights[k] == pytest.approx([2 * np.mean([p[2] for p in x]) if x else 0, len(x)])
        assert sum(shares[k]) == pytest.approx(1 if x else 0)
    picks = select.farthest_points(descriptors.described(df, "distance_histogram", cutoff=3.0, bins=6), "frame_index", "vector", 5)
    assert picks.count() == 5


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_substrings(spark, block):
    rng = random.Random(3)
    needles = [(i, "".join(rng.choice("abAB-é") for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(1, None), (2, ""), (3, "ab"), (3, "ab")]
    texts = [(i, "".join(rng.choice("abAB-éÉ x") for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(1, None), (5, "xxabxx"), (5, "xxabxx"), (None, "ab")]
    a, b = spark.createDataFrame(needles, "l long, n string"), spark.createDataFrame(texts, "r long, h string").repartition(3)
    got = sorted(map(str, (tuple(x) for x in match.containment(a, b, "l", "r", "n", "h", block_chars=block, rows_a_batch=7).collect())))
    assert got == sorted(str((i, j)) for i, n in needles if n for j, h in texts if h and n.lower() in h.lower())
    assert match.containment(a.limit(0), b, "l", "r", "n", "h").count() == 0


@pytest.mark.parametrize("grammar", sorted(trajectories.GRAMMARS))
def test_whole_frames_wherever_the_text_is_cut(grammar):
    """Pieces of any size, the rest carried on: the frames of the whole text, once each; what stands at the end of a text is whole where another line follows or not."""
    rng = random.Random(grammar)
    for k in range(20):
        text = trajectory(grammar, rng, rng.randint(1, 8))
        expected = list(trajectories.GRAMMARS[grammar](text.splitlines(keepends=True)))
        tail, index, carried, found, at = "", 0, {}, [], 0
        while at < len(text):
            size = rng.choice([1, 7, 60, 400])
            tail += text[at : at + size]
            at += size
            end = tail.rfind("\n") + 1
            frames, left, index, carried = growing.whole_frames(grammar, tail[:end], index, carried)
            tail = left + tail[end:]
            found += frames
        assert found == expected


def test_growing_files_come_once(spark, tmp_path):
    """Frames are appended between micro-batches, cut anywhere, with the query stopped and started again; the sink is given a batch twice."""
    rng = random.Random(8)
    whole = {n: trajectory("extxyz", rng, 12) for n in ("a.xyz", "b.xyz")}
    folder = tmp_path / "runs"
    folder.mkdir()
    out = str(tmp_path / "out")
    ddl = "path string, frame_index long, n_atoms int"
    batches = []

    def run():
        sink = growing.ledger_sink(out, ["path", "frame_index", "n_atoms"])

        def write(df, number):
            batches.append(number)
            sink(df, number)
            sink(df, number)

        q = growing.growing_frames(spark, str(folder), "extxyz", ".xyz").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for cut in (0.3, 0.55, 1.0):
        for name, text in whole.items():
            (folder / name).write_text(text[: int(len(text) * cut)])
        run()
    got = growing.ledger_table(spark, out, ddl).collect()
    expected = {(r.path, r.frame_index, r.n_atoms) for r in files.read_trajectories(spark, str(folder), "extxyz").collect()}
    assert len(got) == len(expected) and {(r.path, r.frame_index, r.n_atoms) for r in got} == expected and len({r.batch for r in got}) >= 2


def test_half_a_batch_is_written_over(spark, tmp_path):
    """A batch that failed before the ledger had it: its files don't count, and are replaced."""
    path, sink = str(tmp_path / "t"), growing.ledger_sink(str(tmp_path / "t"))
    spark.range(5).write.parquet(f"{path}/batches/000000000001")
    assert growing.ledger_table(spark, path, "id long").count() == 0
    sink(spark.range(3), 0)
    sink(spark.range(10, 12), 1)
    sink(spark.range(99), 1)
    assert sorted((r.batch, r.id) for r in growing.ledger_table(spark, path, "id long").collect()) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11)]
