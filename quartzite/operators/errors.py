"""Error statistics of predictions against references, as partial and final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_state(ref: str, pred: str) -> list[Column]:
    """A mergeable state: count, sum of absolute errors, sum of squared errors. Pairs with a null are not counted."""
    d = F.col(pred) - F.col(ref)
    return [F.count(d).alias("n"), F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("abs_sum"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("sq_sum")]


def partial_errors(df: DataFrame, by: list[str], ref: str, pred: str) -> DataFrame:
    return df.groupBy(*by).agg(*error_state(ref, pred))


def merge_errors(states: DataFrame, by: list[str]) -> DataFrame:
    """MAE and RMSE from states; null where nothing was counted."""
    merged = states.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("abs_sum").alias("abs_sum"), F.sum("sq_sum").alias("sq_sum"))
    n = F.nullif(F.col("n"), F.lit(0))
    return merged.select(*by, "n", (F.col("abs_sum") / n).alias("mae"), F.sqrt(F.col("sq_sum") / n).alias("rmse"))


def error_stats(df: DataFrame, by: list[str], ref: str, pred: str) -> DataFrame:
    return merge_errors(partial_errors(df, by, ref, pred), by)


def error_cube(df: DataFrame, sets: list[list[str]], ref: str, pred: str) -> DataFrame:
    """The same statistics for several groupings at once (columns outside a grouping are null)."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    d = F.col(pred) - F.col(ref)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def base_frames(frames: DataFrame, by: list[str], ref: str, atoms: str, order: list[str], keep: list[str]) -> DataFrame:
    """Each group's frame of least reference energy per atom, the first of equal ones; columns keep come back as base_*."""
    key = F.struct((F.col(ref) / F.col(atoms)).alias("_e"), *order)
    usable = frames.where(F.col(ref).isNotNull() & (F.col(atoms) > 0))
    least = usable.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("_b"))
    return least.select(*by, *[F.col(f"_b.{c}").alias(f"base_{c}") for c in keep])


def relative_energy_errors(frames: DataFrame, by: list[str], ref: str, pred: str, atoms: str, order: list[str]) -> DataFrame:
    """RMSE of energies relative to each group's base frame, in all and per atom.

    The base is found by an aggregate and joined back, so no window gathers a group in one task.
    """
    base = base_frames(frames, by, ref, atoms, order, [ref, pred, atoms])
    return errors_from_base(frames.join(base, by) if by else frames.crossJoin(F.broadcast(base)), by, ref, pred, atoms)


def errors_from_base(joined: DataFrame, by: list[str], ref: str, pred: str, atoms: str) -> DataFrame:
    """RMSE of energies relative to the base_* columns of each row."""
    d = (F.col(pred) - F.col(f"base_{pred}")) - (F.col(ref) - F.col(f"base_{ref}"))
    per = (F.col(pred) / F.col(atoms) - F.col(f"base_{pred}") / F.col(f"base_{atoms}")) - (F.col(ref) / F.col(atoms) - F.col(f"base_{ref}") / F.col(f"base_{atoms}"))
    return joined.groupBy(*by).agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse_energy"), F.sqrt(F.avg(per * per)).alias("rmse_energy_per_atom"))


def absolute_errors(frames: DataFrame, by: list[str], ref: str, pred: str, atoms: str) -> DataFrame:
    """MAE and RMSE without a base frame; per atom they are divided by the mean number of atoms."""
    d = F.col(pred) - F.col(ref)
    out = frames.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(atoms).alias("mean_atoms"))
    mean = F.nullif(F.col("mean_atoms"), F.lit(0.0))
    return out.withColumn("mae_per_atom", F.col("mae") / mean).withColumn("rmse_per_atom", F.col("rmse") / mean)


def frame_rmse(atoms: DataFrame, frame: list[str], ref: str, pred: str) -> DataFrame:
    """RMSE over the components of each frame."""
    d = F.col(pred) - F.col(ref)
    return atoms.groupBy(*frame).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n"))


def worst(df: DataFrame, metric: str, n: int, tie: list[str]) -> DataFrame:
    """The n largest values; a NaN counts as largest and takes one of the n places, but is not returned."""
    top = df.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), *tie).limit(n)
    return top.where(~F.isnan(metric))


def array_rmse(ref: Column, pred: Column) -> Column:
    """RMSE between two arrays of a row; null where a length differs."""
    square = F.aggregate(F.zip_with(ref, pred, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(ref) == F.size(pred)) & (F.size(ref) > 0), F.sqrt(square / F.size(ref)))
