"""Operators against brute force and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.functions import geometry, rules, text
from quartzite.operators import eos, errors, frames, match, motion, pairs, select, series, stats


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_unwrap_schemes_agree_in_a_fixed_cell(spark):
    rng = np.random.default_rng(1)
    path = np.cumsum(rng.normal(0, 0.1, 200)) + 0.5
    rows = [(i, float(x % 1), float(x % 1) * 8, 8.0) for i, x in enumerate(path)]
    df = spark.createDataFrame(rows, "i int, s double, w double, l double").withColumn("run", F.lit(1))
    got = {}
    for scheme, column in (("displacement", "s"), ("lattice", "s"), ("hybrid", "w")):
        out = motion.unwrap(df, ["run"], ["i"], column, scheme, length="l").orderBy("i")
        got[scheme] = np.array([r.unwrapped for r in out.collect()])
    expected = (path - path[0] + path[0] % 1) * 8
    for scheme in got:
        assert np.allclose(got[scheme], expected), scheme


def test_msd_and_correlation_match_loops(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    n = len(x)
    msd = [np.mean([((x[i + k] - x[i]) ** 2).sum() for i in range(n - k)]) for k in range(n)]
    acf = [np.mean([x[i + k] @ x[i] for i in range(n - k)]) for k in range(n)]
    assert np.allclose(motion.displacement_all_origins(x), msd)
    assert np.allclose(motion.autocorrelation(x), acf)


def test_msd_keeps_every_lag_of_a_long_run(spark):
    rng = np.random.default_rng(5)
    x = {atom: rng.normal(size=n).cumsum() for atom, n in ((0, 600), (1, 600), (2, 300))}
    df = spark.createDataFrame([(a, i, float(v)) for a, s in x.items() for i, v in enumerate(s)], "atom int, i int, x double")
    got = {r.lag: (r.msd, r.atoms) for r in motion.msd_all_origins(df, [], ["atom"], [], "i", ["x"]).collect()}
    assert sorted(got) == list(range(600))
    for k in (0, 1, 255, 256, 299, 300, 301, 599):
        each = [np.mean((s[k:] - s[: len(s) - k]) ** 2) for s in x.values() if k < len(s)]
        assert np.isclose(got[k][0], np.mean(each)) and got[k][1] == len(each)


def test_inefficiency_of_noise_and_of_a_constant():
    assert motion.inefficiency(np.ones(50)) == 1.0
    assert motion.inefficiency(np.random.default_rng(0).normal(size=5000)) < 1.3
    assert motion.inefficiency(np.repeat(np.random.default_rng(0).normal(size=500), 10)) > 5


def test_eos_fit_gives_parameters_back(spark):
    v = np.linspace(90, 112, 9)
    rows = [("a", float(x), float(eos.curve(x, -50.0, 100.0, 0.9, 4.3))) for x in v] + [("b", 1.0, 1.0)]
    out = {r.k: r for r in eos.fit(spark.createDataFrame(rows, "k string, v double, e double"), ["k"], "v", "e").collect()}
    assert math.isclose(out["a"].v0, 100, rel_tol=1e-6) and math.isclose(out["a"].b0_gpa, 0.9 * eos.GPA, rel_tol=1e-4)
    assert math.isclose(out["a"].b0p, 4.3, rel_tol=1e-3) and out["b"].v0 is None
    p = value(spark, eos.pressure(F.lit(90.0), F.lit(100.0), F.lit(0.9), F.lit(4.3)))
    slope = (eos.curve(90 - 1e-4, 0, 100.0, 0.9, 4.3) - eos.curve(90 + 1e-4, 0, 100.0, 0.9, 4.3)) / 2e-4
    assert math.isclose(p, slope, rel_tol=1e-5)


def test_binned_pairs_match_all_pairs(spark):
    x = np.random.default_rng(3).uniform(-1, 1, (150, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "idx int, x double, y double, z double")
    got = {(r.i, r.j) for r in pairs.binned_pairs(df, [], 0.3, ["x", "y", "z"]).collect()}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if np.linalg.norm(x[i] - x[j]) < 0.3}


def test_periodic_bins_match_all_pairs(spark):
    """Skewed, long, small and wide cells, positions outside the cell, and frames without a cell."""
    import itertools

    rng = np.random.default_rng(5)
    cells = [np.diag([6.0, 7.0, 8.0]), np.array([[6.0, 0, 0], [3.0, 6.0, 0], [-2.0, 2.5, 7.0]]), np.diag([1.5, 2.0, 40.0]), np.array([[9.0, 0, 0], [-4.4, 8.0, 0], [0, 0, 2.1]])]
    rows, expected = [], set()
    for f, cell in enumerate(cells):
        frac = rng.uniform(-1.2, 1.7, (60, 3))
        rows += [(f, i, "A", x.tolist(), cell.ravel().tolist()) for i, x in enumerate(frac)]
        around = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
        for i, j in itertools.combinations(range(60), 2):
            d = frac[i] - frac[j]
            d = d - np.round(d)
            near = np.linalg.norm((d + around) @ cell, axis=1).min()
            if near < 1.9:
                expected.add((f, i, j, round(near, 6)))
    rows += [(9, 0, "A", [0.0, 0.0, 0.0], None), (9, 1, "A", None, cells[0].ravel().tolist()), (9, 2, "A", [0.0, 0.0, 0.0], cells[0].ravel().tolist())]
    df = spark.createDataFrame(rows, "frame int, idx int, symbol string, frac array<double>, cell array<double>")
    got = pairs.frame_pairs(df, ["frame"], 1.9, exact=True).collect()
    assert {(r.frame, r.i, r.j, round(r.distance, 6)) for r in got} == expected and len(got) == len(expected)


def test_pairs_of_large_frames_grow_with_the_near_ones(spark):
    """At one density, four times the atoms of one frame meet about four times as many candidates, not sixteen times."""
    def candidates(n):
        side = (n / 2) ** (1 / 3)
        z, s = F.lit(0.0), F.lit(side)
        df = spark.range(n).select(F.lit(0).alias("frame"), F.col("id").alias("idx"), F.lit("A").alias("symbol"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("frac"), F.array(s, z, z, z, s, z, z, z, s).alias("cell"))
        return pairs.frame_pairs(df, ["frame"], 1.0).count()

    small, large = candidates(1000), candidates(4000)
    assert 3 < large / small < 5


def test_exact_image_in_a_skewed_cell(spark):
    cell = [4.0, 0.0, 0.0, 3.5, 2.0, 0.0, 0.0, 0.0, 5.0]
    a, b = np.array([0.05, 0.1, 0.2]), np.array([0.55, 0.45, 0.9])
    m = np.array(cell).reshape(3, 3)
    best = min(np.linalg.norm((a - b + np.array([i, j, k])) @ m) for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4))
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert math.isclose(value(spark, geometry.exact_image_distance(arr(a), arr(b), arr(cell))), best)


def test_farthest_points_of_a_grid_with_ties_and_copies(spark):
    x = np.array([[i % 4, i // 4 % 4] for i in range(40)], float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "i int, v array<double>").repartition(3)
    far, near, picks = np.linalg.norm(x - x.mean(axis=0), axis=1), np.full(40, np.inf), []
    for _ in range(25):
        picks.append(int(far.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
        near[picks[-1]] = -np.inf
        far = near
    for ahead in (2, 7, 100):
        assert [r.i for r in select.farthest_points(df, "i", "v", 25, ahead=ahead).orderBy("rank").collect()] == picks


def test_lags_of_series_that_batches_break(spark):
    """Null keys, runs over several batches, and a group of atoms of unequal lengths."""
    rng = np.random.default_rng(1)
    own = {("a", 1, "x"): 700, ("a", 2, "x"): 300, ("a", None, "y"): 5, (None, 1, "x"): 40, ("b", 1, None): 1}
    data = {k: rng.normal(size=(n, 2)) for k, n in own.items()}
    rows = [(*k, i, *map(float, v)) for k, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "run string, atom int, kind string, i int, x double, y double").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.run, r.kind, r.lag): (r.msd, r.atoms) for r in motion.msd_all_origins(df, ["run"], ["atom"], ["kind"], "i", ["x", "y"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expected = {}
    for (run, _, kind), x in data.items():
        for lag in range(len(x)):
            d = x[lag:] - x[: len(x) - lag]
            expected.setdefault((run, kind, lag), []).append((d * d).sum(axis=1).mean())
    assert set(got) == set(expected) and all(np.isclose(got[k][0], np.mean(v)) and got[k][1] == len(v) for k, v in expected.items())


def test_farthest_points_match_a_loop(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i int, v array<double>")
    far, near, picks = np.linalg.norm(x - x.mean(axis=0), axis=1), np.full(60, np.inf), []
    for _ in range(6):
        picks.append(int(far.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
        near[picks[-1]] = -np.inf
        far = near
    for ahead in (1, 3, 64):
        got = [r.i for r in select.farthest_points(df, "i", "v", 6, checkpoint_every=2, ahead=ahead).orderBy("rank").collect()]
        assert got == picks
    assert select.farthest_points(df, "i", "v", 100).count() == 60


def test_culling_in_bounded_chunks_keeps_far_points(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.01, (3000, 3))
    corners = rng.choice(3000, 8, replace=False)
    x[corners] += 10 * np.array([(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i int, v array<double>")
    left = []
    last = select.farthest_points
    monkeypatch.setattr(select, "farthest_points", lambda rows, *rest: left.append(rows.count()) or last(rows, *rest))
    got = select.hierarchical_selection(df, "i", "v", 8, chunk_rows=100)
    assert {r.i for r in got.collect()} == set(corners.tolist()) and left[0] <= 100
    assert select.hierarchical_selection(df, "i", "v", 0.01, chunk_rows=100).count() == 30
    assert select.hierarchical_selection(df.limit(5), "i", "v", 8, chunk_rows=100).count() == 5
    sizes = df.groupBy(F.pmod(F.xxhash64(F.lit(0), "i"), F.lit(30))).count().agg(F.max("count")).first()[0]
    assert sizes < 200


def test_sizes_and_allocation(spark):
    assert [select.target_size(s, n) for s, n in ((0.5, 5), (0.5, 7), (3, 2), (0.001, 10))] == [2, 4, 2, 1]
    df = spark.createDataFrame([(g,) for g, n in (("a", 70), ("b", 25), ("c", 5)) for _ in range(n)], "g string")
    assert {r.g: r.take for r in select.allocation(df, "g", 10).collect()}["c"] >= 1
    assert sum(r.take for r in select.allocation(df, "g", 10, strict=True).collect()) == 10


def test_worst_drops_nan_after_the_limit(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "i int, m double")
    assert [r.i for r in errors.worst(df, "m", 2, ["i"]).collect()] == [3]


def test_histogram_keeps_the_upper_edge_and_pads_a_flat_range(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    assert {r.bin: r.n for r in stats.density_histogram(df, [], "x", 2).collect()} == {0: 1, 1: 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert stats.density_histogram(flat, [], "x", 4).first().n == 2


def test_text_builders(spark):
    assert value(spark, text.three_floats(F.lit("a 1.5\0-2e1 .25 9"))) == [1.5, -20.0, 0.25]
    assert value(spark, text.three_floats(F.lit("1 2"))) is None
    assert value(spark, text.normal_symbol(F.lit("mn_pv"))) == "Mn"
    assert value(spark, text.header_value(F.lit("free_energy=-2 energy=-1"), "energy")) == "-1"
    assert value(spark, text.property_offset(F.lit("species:S:1:pos:R:3:vel:R:3"), "vel")) == 4
    assert value(spark, text.path_temperature(F.lit("/a/3k/x"))) == 3.0
    assert value(spark, text.strict_path_temperature(F.lit("/a/3k/300K/x"))) == 300.0
    assert value(spark, text.strain_percent(F.lit("/a/MnO2/V_-2.5%/OUTCAR"))) == -2.5
    assert value(spark, text.compound(F.lit("/a/MnO2/V_-2.5%/OUTCAR"))) == "MnO2"
    assert value(spark, text.under_any(F.lit("/data/runs2/x"), ["/data/runs"])) is False


def test_rules(spark):
    assert value(spark, rules.kpoint_grid(F.array(F.lit(3.0), F.lit(30.0), F.lit(9.0)))) == [8, 1, 3]
    assert value(spark, rules.never_rising(F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)), F.array(F.lit(3.0), F.lit(5.0), F.lit(4.0)))) == [3.0, 3.0, 4.0]
    assert value(spark, rules.violations(F.create_map(F.lit("A"), F.lit("1")), {"A": "1", "B": "2"})) == ["B: wanted 2, found nothing"]


def test_fingerprint_ignores_order_and_small_noise(spark):
    arr = lambda rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    cell = F.array(*[F.lit(float(x)) for x in (4, 0, 0, 0, 4, 0, 0, 0, 4)])
    syms = lambda *s: F.array(*map(F.lit, s))
    a = value(spark, frames.fingerprint(F.lit(2), syms("O", "Mn"), arr([(0, 0, 0), (1, 1, 1)]), cell))
    b = value(spark, frames.fingerprint(F.lit(2), syms("Mn", "O"), arr([(1, 1, 1.00001), (0, 0, 0)]), cell))
    c = value(spark, frames.fingerprint(F.lit(2), syms("Mn", "O"), arr([(1, 1, 1.01), (0, 0, 0)]), cell))
    assert a == b != c


def test_repeated_paths_and_owners(spark):
    df = spark.createDataFrame([("/a/./b", 1), ("/a/b", 2), ("/a/c/../b/", 3), ("/d", 4)], "p string, o int")
    assert frames.drop_repeated_paths(df, "p", ["o"]).count() == 2
    roots = spark.createDataFrame([("/a", 0), ("/a/b", 1)], "r string, place int")
    paths = spark.createDataFrame([("/a/b/x",), ("/a/bc",)], "p string")
    assert {x.p: x.r for x in match.owner(paths, "p", roots, "r").collect()} == {"/a/b/x": "/a/b", "/a/bc": "/a"}
    assert {x.p: x.r for x in match.owner(paths, "p", roots, "r", "first", "place").collect()} == {"/a/b/x": "/a", "/a/bc": "/a"}


def test_learning_curve_rules(spark):
    rows = [("r", "train_loss_epoch", 1, 0, 1.0), ("r", "train_loss_epoch", 1, 1, 2.0), ("r", "val_x", 1, 0, 3.0), ("r", "val_x", 2, 0, 4.0)]
    df = spark.createDataFrame(rows, "run string, metric string, epoch int, row int, value double")
    got = {(r.metric, r.epoch): r.value for r in frames.learning_curve(df, ["run"], "epoch", ["row"]).collect()}
    assert got == {("train_loss_epoch", 1): 2.0, ("val_x", 1): 3.0}


def test_running_sum_over_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("run"), F.col("id").alias("i"))
    out = series.running_sum(df, ["run"], "i", F.col("i").cast("double"), "s", block=64)
    assert out.where("s <> i * (i + 1) / 2").count() == 0 and out.count() == 1000


def test_uniform_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from quartzite.operators import select

    df = spark.range(500).repartition(7)
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64(F.lit(9), "id").alias("h")).collect()}
    got = {r.id for r in select.uniform_sample(df, 40, ["id"], seed=9).collect()}
    assert got == set(sorted(hashes, key=lambda k: (hashes[k], k))[:40]) and select.uniform_sample(df, 900, ["id"]).count() == 500


def test_places_of_a_whole_table(spark):
    from quartzite.operators import series

    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)] + [(5, 9), (None, 1)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = {(r.a, r.b): r.place for r in series.placed(df, ["a", "b"], "place").collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert series.placed(df.limit(0), ["a"], "place").count() == 0


def test_error_stats(spark):
    from quartzite.operators import errors

    rows = [("a", 1.0, 1.5), ("a", 2.0, 1.0), ("b", 0.0, 0.0)]
    out = {r.k: r for r in errors.error_stats(spark.createDataFrame(rows, "k string, ref double, pred double").repartition(3), ["k"], "ref", "pred").collect()}
    assert out["a"].mae == 0.75 and abs(out["a"].rmse - 0.625**0.5) < 1e-12 and out["b"].rmse == 0


@pytest.mark.parametrize("block", [1, 4, 7, 100])
def test_lags_in_blocks(spark, block):
    """Any length of blocks gives what the kernels over whole series give, for products and displacements, of series of unequal length."""
    import random

    from quartzite.operators import motion

    rng = random.Random(block)
    rows = [(f"r{a % 2}", a, i, rng.gauss(0, 1), rng.gauss(0, 2)) for a, n in enumerate((1, 5, 23, 30, 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, atom long, i long, x double, y double").repartition(3)
    for kernel, whole in ((motion.products, motion.autocorrelation), (motion.square_gaps, motion.displacement_all_origins)):
        for by in (["run"], []):
            expected = {(*[r[c] for c in by], r.lag): (r.v, r.atoms) for r in motion.per_atom_lags(df, by, ["run", "atom"], [], "i", ["x", "y"], whole, "v", lambda n: n).collect()}
            got = {(*[r[c] for c in by], r.lag): (r.v, r.atoms) for r in motion.blocked_lags(df, by, ["run", "atom"], [], "i", ["x", "y"], block, "v", kernel).collect()}
            assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)
    few = motion.blocked_lags(df, ["run"], ["atom"], [], "i", ["x"], block, "v", most=9)
    assert few.agg({"lag": "max"}).first()[0] == 9
