"""Matches whose pairs are many: none are listed that aren't asked for, and those that are come from many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import fits, match


def brute(left, right, strategies):
    """All pairs, in the plain way; ids with null keys or places match nothing."""
    best = {}
    for p, columns in enumerate(strategies):
        for row in left:
            found = {r[0] for r in right if all(row[x] is not None and row[x] == r[y] for x, y in columns)}
            if found and row[3] is not None:
                q, held = best.get((row[0], row[3]), (p, set()))
                if q == p:
                    best[row[0], row[3]] = (p, held | found)
    out = []
    for row in left:
        own = [(v, *x) for (i, v), x in best.items() if i == row[0]]
        for v, p, found in own:
            s = sorted(r for r in found if r is not None)
            out.append((row[0], s[v] if 0 <= v < len(s) else s[0] if s else None, f"s{p}"))
        if not own:
            out.append((row[0], None, None))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(2))
def test_prioritised_places(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    left = [(pick(i, i, i, i - 1), pick(1, 2, 3, None), pick(0, 1), pick(0, 1, 2, 5, 99, -1, None)) for i in range(60)]
    right = [(pick(r, r, None), pick(1, 2, 4, None), pick(0, 1, None)) for r in range(40)] + [(None, 3, 0)]
    a, b = spark.createDataFrame(left, "l int, x int, y int, v int"), spark.createDataFrame(right, "r int, x2 int, y2 int")
    got = match.prioritised(a, b, "l", "r", [("s0", [("x", "x2"), ("y", "y2")]), ("s1", [("x", "x2")])], "v")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == brute(left, right, [[(1, 1), (2, 2)], [(1, 1)]])


def test_prioritised_lists_no_pairs(spark):
    """2 million rows and 200,000 with one key: 4e11 pairs."""
    a, b = spark.range(2_000_000).select("id", F.lit(1).alias("k"), (F.col("id") % 3).alias("v")), spark.range(200_000).select(F.col("id").alias("r"), F.lit(1).alias("k"))
    got = match.prioritised(a, b, "id", "r", [("one", [("k", "k")])], "v")
    assert got.where("r = id % 3 AND strategy = 'one'").count() == 2_000_000


def test_frequent_tokens_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(match, "PAIRS", 1000)
    a = spark.createDataFrame([(i, "Red" if i % 3 else "blue") for i in range(600)] + [(7, None)], "l int, n string")
    b = spark.createDataFrame([(i, "red RED x" if i % 2 else "blue-red") for i in range(90)] + [(91, None)], "r int, h string")
    got = match.shared_tokens(a, b, "l", "r", "n", "[a-z]+", "h")
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted([(i, r) for i in range(600) for r in range(90) if i % 3 or r % 2 == 0])
    assert got.rdd.getNumPartitions() >= 30 and got.rdd.glom().map(len).max() < len(rows) / 8


def test_rows_are_repeated_no_more_in_larger_tables(spark, monkeypatch):
    """How often rows are dealt depends on the cores: twice the rows are twice the shuffle, not eight times."""
    dealt, kind = [], type(spark.range(1))
    whole = kind.repartition
    monkeypatch.setattr(match, "PAIRS", 100)
    monkeypatch.setattr(kind, "repartition", lambda self, *to: dealt.append(self.count()) or whole(self, *to))
    for times in (1, 2):
        a = spark.range(2000 * times).select(F.col("id").alias("l"), F.lit("Red").alias("n"))
        b = spark.range(200 * times).select(F.col("id").alias("r"), F.lit("a red b").alias("h"))
        got = match.shared_tokens(a, b, "l", "r", "n", "[a-z]+", "h")
        assert got.count() == got.distinct().count() == 400_000 * times**2
    one, two = sum(dealt[:2]), sum(dealt[2:])
    assert one < 20 * 2200 and two < 2.2 * one


def test_grids_of_tokens_of_all_shapes(spark, monkeypatch):
    """Long on either side, equal ids, null ids, rare tokens, tokens of one side only."""
    monkeypatch.setattr(match, "PAIRS", 50)
    left = [(i, "long") for i in range(300)] + [(i % 3, "wide") for i in range(5)] + [(None, "even"), (1, "even")] * 20 + [(8, "rare"), (9, "own"), (4, None)]
    right = [(1, "long"), (None, "long rare"), (2, "other")] + [(i % 90, "WIDE even") for i in range(180)]
    a, b = spark.createDataFrame(left, "l int, n string"), spark.createDataFrame(right, "r int, h string")
    got = match.shared_tokens(a, b, "l", "r", "n", "[a-z]+", "h")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, r)) for i, n in left for r, h in right if n in h.lower().split())


def test_needles_stay_off_the_driver(spark, monkeypatch):
    """Blocks of needles are bounded in number, and written by tasks."""
    monkeypatch.setattr(match, "BLOCKS", 4)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    a = spark.range(3000).select(F.col("id").alias("l"), F.col("id").cast("string").alias("n"))
    b = spark.range(50).select(F.col("id").alias("r"), F.concat(F.lit("x"), F.col("id") * 997).alias("h"))
    got = match.containment(a, b, "l", "r", "n", "h", block_chars=16)
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, r) for n in range(3000) for r in range(50) if str(n) in f"x{r * 997}")


def test_fit_beside_a_large_spread(spark):
    """The slope of points far above and below the line: sums of squares differ by less than their rounding near the least."""
    rng = np.random.default_rng(3)
    x, y = np.tile(np.arange(20.0), 500), 1e6 * rng.normal(size=10000) + 9e6
    y += 1000 * x
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    got = fits.fit(df, ["k"], "x", "y", lambda x, a, q: a + F.exp(q) * x, [F.avg("y"), F.lit(0.0)], ["a", "q"]).first()
    slope, cut = np.polyfit(x, y, 1)
    assert got.converged and abs(got.q - np.log(slope)) < 1e-6 and abs(got.a - cut) < 1e-2


def rising(df):
    return {r.k: r for r in fits.fit(df, ["k"], "x", "y", lambda x, a, q: a + F.exp(q) * x, [F.avg("y"), F.lit(0.0)], ["a", "q"]).collect()}


def copies(spark, slopes, shift):
    """Series of 50 rows about lines, each many times over at offsets that are far apart."""
    rng = np.random.default_rng(5)
    own = [(k, float(x), 100 + s * x + rng.normal(0, 30)) for k, s in enumerate(slopes) for _ in range(4) for x in range(50)]
    rows = [(k, x, y + shift * c) for c in range(60) for k, x, y in own]
    fitted = {}
    for k in range(len(slopes)):
        x, y = (np.array([r[i] for r in rows if r[0] == k], np.longdouble) for i in (1, 2))
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        fitted[k] = float(slope), float(y.mean() - slope * x.mean())
    return spark.createDataFrame(rows, "k int, x double, y double").repartition(4), fitted


def test_fit_of_copies_that_lie_far_apart(spark):
    """Offsets of some 3e7: slopes are less than the rounding of the squares, and derivatives have few digits over narrow differences."""
    df, fitted = copies(spark, [0.1, 0.5, 1.0, 2.5], 1_000_000)
    for r in rising(df).values():
        slope, cut = fitted[r.k]
        assert r.converged and abs(r.q - np.log(slope)) < 1e-6 and abs(r.a - cut) < 1e-5


def test_fit_without_a_least_has_not_converged(spark):
    """exp(q) can't be negative: the least squares of falling series lie at infinity. A slope of one, q = 0, is a fit like others."""
    df, fitted = copies(spark, [-0.4, 0.6, -3.0, 1.0], 1500)
    got = rising(df)
    assert [got[k].converged for k in range(4)] == [fitted[k][0] > 0 for k in range(4)] == [False, True, False, True]
    assert all(abs(got[k].q - np.log(fitted[k][0])) < 1e-8 for k in (1, 3))


def test_fit_of_undetermined_parameters_has_not_converged(spark):
    df = spark.createDataFrame([(1, 2.0, float(y)) for y in range(9)], "k int, x double, y double")
    got = fits.fit(df, ["k"], "x", "y", lambda x, a, b: a + b * x, [F.lit(1.0), F.lit(1.0)], ["a", "b"]).first()
    assert not got.converged and got.rounds < 40 and abs(got.sse - 60) < 1e-9
