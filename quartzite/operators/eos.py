"""Equations of state: Birch-Murnaghan fits of energy over volume.

In x = V ** (-2/3) the third-order curve is an exact cubic, so a fit is a linear least-squares problem whose sums Spark
aggregates like any others: no run's points need to be together. The few coefficients of each compound are then
turned into (E0, V0, B0, B0') and their errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: GPa in one eV/A^3 (fixed value).
GPA = 160.21766208


def curve(v, e0, v0, b0, b1):
    """Energy at volume v (b0 in eV/A^3)."""
    x = (v0 / v) ** (2 / 3)
    return e0 + 9 * v0 * b0 / 16 * ((x - 1) ** 3 * b1 + (x - 1) ** 2 * (6 - 4 * x))


def pressure(v: Column, v0: Column, b0: Column, b1: Column) -> Column:
    """-dE/dV of the curve, in the units of b0."""
    s = F.pow(v0 / v, F.lit(1.0 / 3.0))
    return 1.5 * b0 * (F.pow(s, F.lit(7.0)) - F.pow(s, F.lit(5.0))) * (1 + 0.75 * (b1 - 4) * (s * s - 1))


def fit_sums(points: DataFrame, by: list[str], volume: str, energy: str) -> DataFrame:
    """Sums of powers of x = (V / mean V) ** (-2/3) and their products with the energy's distance from its mean."""
    scale = points.groupBy(*by).agg(F.avg(volume).alias("vbar"), F.avg(energy).alias("ebar"))
    x = F.pow(F.col(volume) / F.col("vbar"), F.lit(-2.0 / 3.0))
    rows = points.join(scale, by).where(F.col(volume).isNotNull() & F.col(energy).isNotNull()).withColumn("_x", x).withColumn("_y", F.col(energy) - F.col("ebar"))
    powers = [F.sum(F.pow("_x", F.lit(float(k)))).alias(f"x{k}") for k in range(7)]
    products = [F.sum(F.pow("_x", F.lit(float(k))) * F.col("_y")).alias(f"y{k}") for k in range(4)]
    return rows.groupBy(*by, "vbar", "ebar").agg(F.count(F.lit(1)).alias("n"), *powers, *products, F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.min_by(volume, F.struct(energy, volume)).alias("v_least"), F.min(energy).alias("e_least"))


def solve(row) -> tuple:
    """E0, V0, B0 (GPa), B0', their errors and R^2 from one row of sums; None where there is no minimum or are under four points."""
    none = (None,) * 9
    if row.n < 4:
        return none
    a = np.array([[getattr(row, f"x{i + j}") for j in range(4)] for i in range(4)])
    y = np.array([getattr(row, f"y{i}") for i in range(4)])
    try:
        c = np.linalg.solve(a, y)
    except np.linalg.LinAlgError:
        return none

    def parameters(c: np.ndarray) -> np.ndarray | None:
        roots = np.roots([3 * c[3], 2 * c[2], c[1]])
        roots = roots[np.isreal(roots)].real
        good = [x for x in roots if x > 0 and 2 * c[2] + 6 * c[3] * x > 0]
        if not good:
            return None
        x = min(good, key=lambda r: abs(r - 1))
        v0 = row.vbar * x**-1.5
        # Derivatives by V at the minimum, through x(V).
        curvature, third = 2 * c[2] + 6 * c[3] * x, 6 * c[3]
        d1, d2 = -2 / 3 * x / v0, 10 / 9 * x / v0**2
        e2 = curvature * d1**2
        e3 = third * d1**3 + 3 * curvature * d1 * d2
        b0 = v0 * e2
        return np.array([np.polyval(c[::-1], x) + row.ebar, v0, b0 * GPA, -1 - v0 * e3 / e2])

    p = parameters(c)
    if p is None:
        return none
    residual = max(row.yy - c @ y, 0.0)
    errors = [None] * 4
    if row.n > 4:
        covariance = np.linalg.inv(a) * residual / (row.n - 4)
        steps = 1e-6 * np.maximum(np.abs(c), 1e-9)
        moved = [(parameters(c + s * e), parameters(c - s * e), s) for s, e in zip(steps, np.eye(4), strict=True)]
        if all(u is not None and d is not None for u, d, _ in moved):
            j = np.stack([(u - d) / (2 * s) for u, d, s in moved], axis=1)
            errors = np.sqrt(np.maximum(np.diag(j @ covariance @ j.T), 0)).tolist()
    return (*p.tolist(), *errors, 1 - residual / row.yy if row.yy > 0 else None)


def fit(points: DataFrame, by: list[str], volume: str, energy: str) -> DataFrame:
    """One row for each group: e0, v0, b0_gpa, b0p, their errors (null with four points), r2, n, v_least, e_least; nulls where no fit is possible."""
    sums = fit_sums(points, by, volume, energy)
    names = ["e0", "v0", "b0_gpa", "b0p", "e0_err", "v0_err", "b0_gpa_err", "b0p_err", "r2"]
    keys = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for batch in batches:
            out = batch[[*by, "n", "v_least", "e_least"]].copy()
            solved = pd.DataFrame([solve(r) for r in batch.itertuples()], columns=names, index=batch.index, dtype=float)
            yield pd.concat([out, solved], axis=1)

    return sums.mapInPandas(run, f"{keys}, n long, v_least double, e_least double, " + ", ".join(f"{c} double" for c in names))


def optimal_volume(fits: DataFrame) -> DataFrame:
    """The fit's volume and energy, or where there is no fit the point of least energy (its errors are null)."""
    return fits.withColumn("volume", F.coalesce("v0", "v_least")).withColumn("energy", F.coalesce("e0", "e_least"))


def per_atom(points: DataFrame, volume: str, energy: str, atoms: str) -> DataFrame:
    """Volume and energy for one atom; points without a number of atoms are dropped."""
    kept = points.where(F.col(atoms) > 0)
    return kept.withColumn(volume, F.col(volume) / F.col(atoms)).withColumn(energy, F.col(energy) / F.col(atoms))


def strain_grid(df: DataFrame, volume: str, low: float, high: float, n: int) -> DataFrame:
    """Each row n times, with strains of its volume in percent, their scale of lengths, directory tags such as V_+02.5% and the strained volume."""
    strain = F.lit(low) + F.col("_i") * ((high - low) / max(n - 1, 1))
    grid = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("strain", strain).drop("_i")
    return grid.withColumns({"scale": F.pow(1 + F.col("strain") / 100, F.lit(1 / 3)), "tag": F.format_string("V_%+05.1f%%", "strain"), volume: F.col(volume) * (1 + F.col("strain") / 100)})


def reference_volume(points: DataFrame, by: list[str], strain: str, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """Each compound's directory with the smallest strain; of equal ones the compressed one first, then the first by order."""
    key = F.struct(F.abs(strain), strain, *(order or []))
    return points.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in keep])
