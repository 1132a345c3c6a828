"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quartzite.operators import motion
from quartzite.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted(([str(clean(v)) for v in r] for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    own = queries.QUERIES[name](spark, SF).toPandas()
    other = duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


@pytest.fixture(scope="module")
def series():
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    return {int(u): g["value"].to_numpy(float) for u, g in events.groupby("user_id")}


def mean_correlation(own):
    """The mean over series of mean(x[i] * x[i + k]), for every k (all of these are shorter than 256)."""
    at = lambda x, k: sum(x[i] * x[i + k] for i in range(len(x) - k)) / (len(x) - k)
    return np.array([np.mean([at(x, k) for x in own if k < len(x)]) for k in range(max(map(len, own)))])


def test_velocity_correlation_has_every_lag(spark, series):
    got = queries.velocity_correlation(spark, SF).toPandas().sort_values("lag")
    expected = mean_correlation(list(series.values()))
    assert got["lag"].tolist() == list(range(len(expected)))
    assert np.allclose(got["vacf"], expected, atol=1e-3) and np.allclose(got["vacf_norm"], expected / expected[0], atol=1e-6)
    assert got["atoms"].tolist() == [sum(k < len(x) for x in series.values()) for k in range(len(expected))]


def test_power_spectrum_transforms_every_lag(spark, series):
    got = queries.power_spectrum(spark, SF).toPandas()
    for species in range(3):
        own = got[got["species"] == species].sort_values("k")
        c = mean_correlation([x for u, x in series.items() if u % 3 == species])
        n, m = len(c), 2 * len(c) - 1
        assert len(own) == n
        for k in range(n):
            s = (c[0] + sum(2 * c[t] * np.cos(2 * np.pi * k * t / m) for t in range(1, n))) * 1e-15 * 2.99792458e10
            assert np.isclose(own["s"].iloc[k], 2 * s if k else s, atol=1e-4)
            assert np.isclose(own["nu"].iloc[k], k / (m * 1e-15) / 2.99792458e10, atol=1e-4)


def test_power_spectrum_integrates_to_lag_zero(spark):
    """For a correlation that dies away the integral is its value at lag 0; with unit_area it is one; one lag gives zeros."""
    lags = [(0, t, 4.0 * 0.8**t * np.cos(0.9 * t)) for t in range(200)] + [(1, 0, 4.0)]
    df = spark.createDataFrame([(k, t, float(v)) for k, t, v in lags], "key int, lag int, v double")
    got = motion.power_spectrum(df, ["key"], "v", 2.0).toPandas().sort_values("k")
    whole = got[got["key"] == 0]
    assert abs(whole["cumint"].iloc[-1] - 4.0) < 0.02
    assert np.allclose(whole["cumint"].iloc[-1], np.trapezoid(whole["s"], whole["nu"]))
    assert got[got["key"] == 1][["k", "nu", "s", "cumint"]].to_numpy().tolist() == [[0, 0, 0, 0]]
    one = motion.power_spectrum(df.where("key = 0"), ["key"], "v", 2.0, unit_area=True).toPandas().sort_values("k")
    assert np.isclose(one["cumint"].iloc[-1], 1.0) and np.allclose(one["s"] * whole["cumint"].iloc[-1], whole["s"])


def brute_start(x):
    best = (0, 1.0, float(len(x)))
    last = max(1, min(len(x) // 2, len(x) - 10))
    for start in sorted({int(k * last / max(last - 1, 1)) for k in range(last)}) if len(x) >= 10 else []:
        d, g = x[start:] - x[start:].mean(), 1.0
        for t in range(1, len(d)):
            c = np.mean(d[t:] * d[: len(d) - t]) / np.mean(d * d)
            if c <= 0:
                break
            g += 2 * c * (1 - t / len(d))
        if not start or len(d) / g > best[2] * (1 + 1e-12):
            best = (start, g, len(d) / g)
    return best


def test_equilibration_tries_every_start(spark, series):
    got = {r.user_id: (r.start, r.inefficiency, r.n_effective) for r in queries.equilibration_start(spark, SF).collect()}
    assert set(got) == set(series)
    assert all(got[u][0] == brute_start(x)[0] and np.allclose(got[u], brute_start(x), atol=1e-4) for u, x in series.items())


def test_equilibration_of_short_runs(spark):
    rng = np.random.default_rng(0)
    runs = {n: np.concatenate([np.linspace(9, 0, n // 2), rng.normal(size=n - n // 2)]) for n in (1, 5, 9, 10, 11, 14, 19, 20, 25, 60)}
    df = spark.createDataFrame([(n, i, float(v)) for n, x in runs.items() for i, v in enumerate(x)], "run int, i int, v double")
    rows = motion.equilibration(df, ["run"], "i", "v").collect()
    got = {r.run: (r.start, r.inefficiency, r.n_effective) for r in rows}
    assert all(r.capped == (r.run >= 10 and r.start == max(1, min(r.run // 2, r.run - 10)) and r.run > 11) for r in rows)
    assert all(got[n][0] == brute_start(x)[0] and np.allclose(got[n], brute_start(x)) for n, x in runs.items())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
