"""Trajectory operators: unwrapping, drift, displacement, correlation, spectra, temperature and equilibration.

Atom rows carry run, frame ordinal, atom and coordinates. Displacements over all origins and correlations are computed
for each atom with FFTs in Arrow-fed tasks (an atom's series is bounded by its run), and averaged by ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .series import ordered, up_to

#: Fixed values of physics: eV per amu A^2/fs^2, eV/K, cm/s.
KINETIC_EV = 103.642696
BOLTZMANN_EV = 8.617333262e-5
LIGHT_CM = 2.99792458e10
#: Sums by lag that a task holds before it hands them on.
LAGS_HELD = 1_000_000


def unwrap(df: DataFrame, atom: list[str], order: list[str], frac: str, scheme: str = "displacement", name: str = "unwrapped", length: str | None = None) -> DataFrame:
    """Coordinates without jumps across cell faces, one axis at a time.

    'displacement' and 'lattice' take fractional coordinates: steps are moved to the nearest image (halves to even) and summed,
    'displacement' times the length of each frame's cell, 'lattice' times the present one. 'hybrid' takes Cartesian coordinates
    in an orthogonal cell: as an offset is always a whole number of cells, its recursion is a running sum of floor(step / length + 1/2).
    """
    w = ordered(atom, order)
    step = F.col(frac) - F.lag(frac).over(w)
    if scheme == "hybrid":
        jump = F.coalesce(F.floor(step / F.col(length) + 0.5), F.lit(0)).cast("double")
        marked = df.withColumn("_k", jump)
        return marked.withColumn(name, F.col(frac) - F.col(length) * F.sum("_k").over(up_to(atom, order))).drop("_k")
    step = step - F.rint(step)
    size = F.col(length) if length else F.lit(1.0)
    first = F.col(frac) * size if scheme == "displacement" else F.col(frac)
    marked = df.withColumn("_s", F.coalesce(step * size if scheme == "displacement" else step, first))
    total = F.sum("_s").over(up_to(atom, order))
    return marked.withColumn(name, total if scheme == "displacement" else total * size).drop("_s")


def remove_drift(df: DataFrame, frame: list[str], mass: str, axes: list[str]) -> DataFrame:
    """Coordinates relative to each frame's centre of mass; null where a frame has no mass."""
    total = F.nullif(F.sum(mass), F.lit(0.0))
    centre = df.groupBy(*frame).agg(*[(F.sum(F.col(mass) * F.col(a)) / total).alias(f"_{a}") for a in axes])
    out = df.join(centre, frame)
    for a in axes:
        out = out.withColumn(a, F.col(a) - F.col(f"_{a}"))
    return out.drop(*[f"_{a}" for a in axes])


def single_origin_msd(df: DataFrame, run: list[str], atom: list[str], order: str, axes: list[str], by: list[str]) -> DataFrame:
    """Mean squared displacement from each atom's first frame, over the atoms of each group and frame."""
    first = df.groupBy(*run, *atom).agg(F.min_by(F.struct(*axes), order).alias("_0"))
    moved = df.join(first, [*run, *atom])
    square = sum((F.pow(F.col(a) - F.col(f"_0.{a}"), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.col(f"_0.{axes[0]}"), 2))
    return moved.groupBy(*run, *by, order).agg(F.avg(square).alias("msd"), F.count(F.lit(1)).alias("n"))


def lagged_pairs(df: DataFrame, key: list[str], ordinal: str, value: str, lags: int) -> DataFrame:
    """Pairs of values of one series up to `lags` rows apart: an equi-join on exploded ordinals, lags + 1 rows for each row."""
    left = df.select(*key, F.col(ordinal).alias("i"), F.col(value).alias("a")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("j", F.col("i") + F.col("lag"))
    right = df.select(*key, F.col(ordinal).alias("j"), F.col(value).alias("b"))
    return left.join(right, [*key, "j"])


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Unbiased autocorrelation of the columns of x at every lag, summed over columns."""
    n = len(x)
    f = np.fft.rfft(x, 2 * n, axis=0)
    return np.fft.irfft(np.abs(f) ** 2, axis=0)[:n].sum(axis=1) / (n - np.arange(n))


def displacement_all_origins(x: np.ndarray) -> np.ndarray:
    """Squared displacement at every lag, averaged over origins: two running sums and a correlation."""
    n = len(x)
    square = (x * x).sum(axis=1)
    ends = 2 * square.sum() - np.concatenate([[0.0], np.cumsum(square[::-1] + square)])[:n]
    return ends / (n - np.arange(n)) - 2 * autocorrelation(x)


def lag_limit(n: int, share: float = 0.5, least: int = 256) -> int:
    """Lags kept of n origins: a share of them, but not fewer than `least` (or n)."""
    return min(n, max(least, int(n * share)))


def per_atom_lags(df: DataFrame, run: list[str], atom: list[str], by: list[str], ordinal: str, axes: list[str], kernel: Callable[[np.ndarray], np.ndarray], name: str, limit: Callable[[int], int] = lag_limit) -> DataFrame:
    """A kernel over each atom's series, then the mean over the atoms of each group and lag.

    Series are sorted within partitions and streamed: a task holds one atom at a time, and the sums by lag of what it has seen.
    """
    group = list(dict.fromkeys([*run, *by]))
    keys = list(dict.fromkeys([*run, *atom, *by]))
    values = [F.col(a).cast("double").alias(f"_x{k}") for k, a in enumerate(axes)]
    rows = df.select(*keys, F.col(ordinal).alias("_i"), *values)
    rows = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, "_i").drop("_i")
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group), "_lag long, _total double, _n long"])
    types = [to_arrow_type(df.schema[c].dataType) for c in group]

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        held, last = [], None

        def close() -> None:
            x = np.concatenate(held)
            found = kernel(x)[: limit(len(x))]
            own = tuple(last[keys.index(c)] for c in group)
            total, n = sums.get(own, (np.zeros(0), np.zeros(0, np.int64)))
            longer = max(0, len(found) - len(n))
            total, n = np.pad(total, (0, longer)), np.pad(n, (0, longer))
            total[: len(found)] += found
            n[: len(found)] += 1
            sums[own] = total, n

        def emitted() -> pa.RecordBatch:
            size = [len(n) for _, n in sums.values()]
            columns = [pa.array([own[k] for own, m in zip(sums, size, strict=True) for _ in range(m)], t) for k, t in enumerate(types)]
            numbers = [np.concatenate([np.arange(m) for m in size]), np.concatenate([t for t, _ in sums.values()]), np.concatenate([n for _, n in sums.values()])]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, numbers)], names=[*group, "_lag", "_total", "_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(batch.column(f"_x{k}")) for k in range(len(axes))], axis=1)
            edge = np.zeros(batch.num_rows, bool)
            edge[0] = True
            for c in keys:
                code = np.asarray(batch.column(c).dictionary_encode(null_encoding="encode").indices)
                edge[1:] |= code[1:] != code[:-1]
            begin = np.flatnonzero(edge)
            for a, b in zip(begin, [*begin[1:], batch.num_rows], strict=True):
                key = tuple(batch.column(c)[int(a)].as_py() for c in keys)
                if held and key != last:
                    close()
                    held.clear()
                last = key
                held.append(x[a:b])
            if sum(len(n) for _, n in sums.values()) > LAGS_HELD:
                yield emitted()
                sums.clear()
        if held:
            close()
        if sums:
            yield emitted()

    summed = rows.mapInArrow(run_all, ddl)
    return summed.groupBy(*group, F.col("_lag").alias("lag")).agg((F.sum("_total") / F.sum("_n")).alias(name), F.sum("_n").alias("atoms"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each lag from -(len(a) - 1) to len(b) - 1 the sum over i of a[i] * b[i + lag], summed over columns."""
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    f = np.fft.irfft(np.conj(np.fft.rfft(a, size, axis=0)) * np.fft.rfft(b, size, axis=0), size, axis=0).sum(axis=1)
    return np.concatenate([f[size - len(a) + 1 :], f[: len(b)]])


def square_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As products, of |b[i + lag] - a[i]| squared."""
    square = lambda x: (x * x).sum(axis=1, keepdims=True)
    return products(np.ones((len(a), 1)), square(b)) + products(square(a), np.ones((len(b), 1))) - 2 * products(a, b)


def blocked_lags(df: DataFrame, run: list[str], atom: list[str], by: list[str], ordinal: str, axes: list[str], block: int, name: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] = products, most: int | None = None) -> DataFrame:
    """What per_atom_lags gives, for series of any length: by, lag, the mean over atoms, atoms; all lags, or those up to `most`.

    ordinal counts from 0 without gaps. A series is cut into blocks, a row each, which meet the blocks behind them as far as lags reach; a task holds two blocks
    at a time and sums by lag, each divided by the number of origins of its series, so sums of all pairs of blocks and atoms can be merged in any order.
    """
    group = list(dict.fromkeys([*run, *by]))
    keys = list(dict.fromkeys([*run, *atom, *by]))
    values = F.struct(F.col(ordinal).cast("long").alias("i"), F.array(*[F.col(a).cast("double") for a in axes]).alias("x"))
    rows = df.select(*keys, F.floor(F.col(ordinal) / block).cast("long").alias("_b"), values.alias("_v"))
    blocks = rows.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_v")).alias("_v")).select(*keys, "_b", F.col("_v.x").alias("_x"))  # `block` rows at most
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    last = F.floor((F.col("_size") - 1) / block) - F.col("_b")
    reach = last if most is None else F.least(last, F.lit(-(-(most + block) // block)))
    one = blocks.join(sizes, keys) if keys else blocks.withColumn("_size", sizes.select("_size").scalar())
    one = one.withColumn("_ahead", F.explode(F.sequence(F.lit(0).cast("long"), reach.cast("long")))).withColumnRenamed("_x", "_a").withColumn("_to", F.col("_b") + F.col("_ahead"))
    pairs = one.join(blocks.select(*keys, F.col("_b").alias("_to"), F.col("_x").alias("_c")), [*keys, "_to"])
    types = [to_arrow_type(df.schema[c].dataType) for c in group]
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group), "_from long, _total array<double>, _n array<long>"])

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def emitted() -> pa.RecordBatch:
            columns = [pa.array([k[0][i] for k in sums], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([k[1] for k in sums], pa.int64()), pa.array([v for v, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.list_(pa.int64()))], names=[*group, "_from", "_total", "_n"])

        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda c: batch.column(c)[r]  # noqa: E731, B023
                a, c = (np.stack(at(x).values.to_numpy(zero_copy_only=False)) for x in ("_a", "_c"))
                size, ahead, first = at("_size").as_py(), at("_ahead").as_py(), at("_b").as_py() == 0
                start = ahead * block - (block - 1)
                found = np.zeros(2 * block - 1)
                own = kernel(a, c)
                found[block - len(a) : block - len(a) + len(own)] = own
                lags = start + np.arange(2 * block - 1)
                good = (lags >= 0) & (lags < size) & (lags <= (size if most is None else most))
                found = np.where(good, found / np.maximum(size - lags, 1), 0.0)
                n = (good & first & (lags >= ahead * block)).astype(np.int64)  # the origin 0 of an atom has each lag once
                key = tuple(at(x).as_py() for x in group), start
                total, seen = sums.get(key, (0.0, 0))
                sums[key] = total + found, seen + n
            if len(sums) * block > LAGS_HELD:
                yield emitted()
                sums.clear()
        if sums:
            yield emitted()

    merged = pairs.mapInArrow(run_all, ddl).select(*group, "_from", F.posexplode(F.arrays_zip("_total", "_n")).alias("_k", "_z"))
    out = merged.groupBy(*group, (F.col("_from") + F.col("_k")).alias("lag")).agg((F.sum("_z._total") / F.sum("_z._n")).alias(name), F.sum("_z._n").alias("atoms"))
    return out.where("atoms > 0")


def msd_all_origins(df: DataFrame, run: list[str], atom: list[str], by: list[str], ordinal: str, axes: list[str]) -> DataFrame:
    """msd at every lag of the series: lag_limit is a rule for correlations."""
    return per_atom_lags(df, run, atom, by, ordinal, axes, displacement_all_origins, "msd", lambda n: n)


def velocity_correlation(df: DataFrame, run: list[str], atom: list[str], by: list[str], ordinal: str, axes: list[str]) -> DataFrame:
    """vacf and its value relative to lag 0 (null where that is 0)."""
    out = per_atom_lags(df, run, atom, by, ordinal, axes, autocorrelation, "vacf")
    zero = out.where("lag = 0").select(*run, *by, F.col("vacf").alias("_0"))
    out = out.join(zero, [*run, *by]) if [*run, *by] else out.withColumn("_0", zero.select("_0").scalar())
    return out.withColumn("vacf_norm", F.try_divide("vacf", "_0")).drop("_0")


def power_spectrum(vacf: DataFrame, key: list[str], value: str, dt_fs: float, unit_area: bool = False) -> DataFrame:
    """One-sided spectrum of a correlation of N lags over wave numbers in cm^-1, with its running integral: key, k, nu, s, cumint.

    The symmetric series of 2N - 1 lags is transformed and every frequency but zero doubled, so that the integral tends to the
    correlation at lag 0. unit_area divides by the whole integral. A correlation of one lag has one row of zeros.
    """
    fields = ", ".join(f"`{vacf.schema[c].name}` {vacf.schema[c].dataType.simpleString()}" for c in key)

    def run_one(k: tuple, group: pd.DataFrame) -> pd.DataFrame:
        c = group.sort_values("lag")[value].to_numpy(float)
        dt = dt_fs * 1e-15
        both = np.concatenate([c, c[:0:-1]])
        s = np.fft.rfft(both).real * dt if len(c) > 1 else np.zeros(1)
        s[1:] *= 2
        hz = np.fft.rfftfreq(len(both), dt)
        total = np.concatenate([[0.0], np.cumsum((s[1:] + s[:-1]) / 2 * np.diff(hz))])
        if unit_area and total[-1] > 0:
            s, total = s / total[-1], total / total[-1]
        out = pd.DataFrame({"k": np.arange(len(s)), "nu": hz / LIGHT_CM, "s": s * LIGHT_CM, "cumint": total})
        for name, v in zip(key, k, strict=True):
            out[name] = v
        return out[[*key, "k", "nu", "s", "cumint"]]

    return vacf.groupBy(*key).applyInPandas(run_one, f"{fields}, k long, nu double, s double, cumint double")


def kinetic_temperature(df: DataFrame, frame: list[str], mass: str, axes: list[str]) -> DataFrame:
    """Temperature of each frame from masses (amu) and velocities (A/fs), for 3N - 3 degrees of freedom; null for one atom."""
    square = sum((F.pow(a, F.lit(2.0)) for a in axes[1:]), F.pow(axes[0], F.lit(2.0)))
    energy = F.sum(F.col(mass) * square) * KINETIC_EV
    return df.groupBy(*frame).agg((energy / F.nullif((3 * F.count(F.lit(1)) - 3) * BOLTZMANN_EV, F.lit(0.0))).alias("temperature"))


def inefficiency(x: np.ndarray) -> float:
    """Statistical inefficiency: one and twice the normalised correlations, weighted by what is left, up to the first that isn't positive."""
    n = len(x)
    d = x - x.mean()
    if n < 3 or not (d * d).sum():
        return 1.0
    c = autocorrelation(d[:, None])
    c = c / c[0]
    stop = np.flatnonzero(c[1:] <= 0)
    stop = int(stop[0]) + 1 if len(stop) else n
    t = np.arange(1, stop)
    return float(max(1.0, 1 + 2 * ((1 - t / n) * c[1:stop]).sum()))


def equilibration(df: DataFrame, run: list[str], ordinal: str, value: str, candidates: int = 200, share: float = 0.5) -> DataFrame:
    """For each run the start that leaves the most effective samples: start, inefficiency, n_effective, capped. The first of equal ones wins.

    Starts go from 0 to a last one: a share of the run that leaves ten frames, or 1. They are spread evenly and are at most
    `candidates` and at most the number of the last one. capped tells that the best is the last one that was tried, where the run
    may still be drifting. A run of fewer than ten frames is kept whole and counts as uncorrelated.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in run)

    names = [*run, "start", "inefficiency", "n_effective", "capped"]

    def run_one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(ordinal)[value].to_numpy(float)
        if len(x) < 10:
            return pd.DataFrame([[*key, 0, 1.0, float(len(x)), False]], columns=names)
        last = max(1, min(int(len(x) * share), len(x) - 10))
        starts = np.unique(np.linspace(0, last, min(candidates, last)).astype(int))
        g = np.array([inefficiency(x[s:]) for s in starts])
        n = (len(x) - starts) / g
        best = int(n.argmax())
        capped = bool(starts[best] == starts[-1] and starts[-1] > 0)
        return pd.DataFrame([[*key, int(starts[best]), g[best], n[best], capped]], columns=names)

    return df.groupBy(*run).applyInPandas(run_one, f"{fields}, start long, inefficiency double, n_effective double, capped boolean")
