"""Grouped counts, shares, summaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_by(df: DataFrame, group: str, what: str, name: str = "n") -> DataFrame:
    """How many different values each group has; nulls are not counted."""
    return df.groupBy(group).agg(F.count_distinct(what).alias(name))


def rows_by(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def summed_order(sources: list[DataFrame], group: str, value: str, name: str = "total") -> DataFrame:
    """The sources one after the other, summed by group, largest first."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    return union.groupBy(group).agg(F.sum(value).alias(name)).orderBy(F.col(name).desc(), group)


def category_shares(df: DataFrame, category: Column, unknown: str = "Uncategorised") -> DataFrame:
    """Rows and percentage of each category; rows without one form their own only if there are any."""
    counts = df.groupBy(F.coalesce(category, F.lit(unknown)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("category", "n", (100.0 * F.col("n") / counts.agg(F.sum("n")).scalar()).alias("percent"))


def composition(atoms: DataFrame, by: list[str], symbol: str, count: Column | None = None) -> DataFrame:
    """Number and atomic percentage of each element in each group."""
    counts = atoms.groupBy(*by, symbol).agg((F.sum(count) if count is not None else F.count(F.lit(1))).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # over the few elements of a group, not its atoms
    return counts.select(*by, symbol, "n", F.try_divide(100.0 * F.col("n"), total).alias("percent"))


def thermo_summary(df: DataFrame, by: list[str], values: list[str], nan_aware: tuple[str, ...] = ("volume",)) -> DataFrame:
    """Mean and population standard deviation; a NaN counts as missing only in the columns named."""
    out = []
    for v in values:
        c = F.when(~F.isnan(F.col(v)), F.col(v)) if v in nan_aware else F.col(v)
        out += [F.avg(c).alias(f"{v}_mean"), F.stddev_pop(c).alias(f"{v}_std")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out)


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin between two edges; the last bin holds the upper edge; values outside, and a range of no width, give null."""
    place = F.floor((value - low) * F.lit(float(bins)) / F.nullif(high - low, F.lit(0.0)))
    return F.when((value >= low) & (value <= high), F.least(place, F.lit(bins - 1)).cast("int"))


def edges(df: DataFrame, by: list[str], value: str, pad: float = 0.5) -> DataFrame:
    """Lowest and highest value of each group; a range of no width is padded on both sides."""
    e = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    flat = F.col("low") == F.col("high")
    return e.select(*by, F.when(flat, F.col("low") - pad).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + pad).otherwise(F.col("high")).alias("high"))


def density_histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts and densities of each group over edges common to all groups; empty bins have no row.

    The edges are one row, read as a scalar, so the data are aggregated where they are.
    """
    whole = edges(df, [], value).select(F.struct("low", "high").alias("e")).scalar()
    binned = df.withColumn("_e", whole)
    binned = binned.withColumn("bin", bin_of(F.col(value).cast("double"), F.col("_e.low"), F.col("_e.high"), bins)).where("bin IS NOT NULL")
    counts = binned.groupBy(*by, "bin", "_e").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # over the bins of a group, not its rows
    width = (F.col("_e.high") - F.col("_e.low")) / bins
    return counts.select(*by, "bin", (F.col("_e.low") + F.col("bin") * width).alias("left_edge"), "n", (F.col("n") / (total * width)).alias("density"))


def histogram_mode(df: DataFrame, by: list[str], value: str, bins: int = 60) -> DataFrame:
    """Centre of the first fullest bin between each group's lowest and highest value."""
    e = edges(df, by, value)
    joined = df.join(e, by) if by else df.crossJoin(F.broadcast(e))
    binned = joined.withColumn("bin", bin_of(F.col(value).cast("double"), F.col("low"), F.col("high"), bins)).where("bin IS NOT NULL")
    counts = binned.groupBy(*by, "low", "high", "bin").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by, "low", "high").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return best.select(*by, (F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins).alias("mode"))


def volume_statistic(df: DataFrame, by: list[str], value: str, kind: str = "mean", bins: int = 60) -> DataFrame:
    """One statistic of each group: mean (with the sample standard deviation), median or histogram mode."""
    if kind == "mean":
        return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    if kind == "median":
        return df.groupBy(*by).agg(F.median(value).alias("median"))
    if kind == "mode":
        return histogram_mode(df, by, value, bins)
    raise ValueError(f"unknown statistic: {kind}")


def size_buckets(df: DataFrame, by: list[str], size: str, limits: tuple[int, int] = (50, 100)) -> DataFrame:
    """Rows with sizes up to the first limit, up to the second, and above."""
    s, (small, large) = F.col(size), limits
    return df.groupBy(*by).agg(F.count_if(s <= small).alias("small"), F.count_if((s > small) & (s <= large)).alias("medium"), F.count_if(s > large).alias("large"))


def average_cell(frames: DataFrame, by: list[str], cell: str = "cell") -> DataFrame:
    return frames.groupBy(*by).agg(F.array(*[F.avg(F.col(cell)[i]) for i in range(9)]).alias(cell))


def reduction(kept: Column, total: Column) -> Column:
    """Percentage that a selection leaves out; null for an empty total."""
    return 100.0 * (1 - F.try_divide(kept, total))


def progress(steps: Column, planned: Column) -> Column:
    """Percentage of planned steps done, to two decimals; null without a plan."""
    return F.round(F.try_divide(100.0 * steps, planned), 2)


def step_counters(df: DataFrame, job: str, ionic: str, config: str, report: str) -> DataFrame:
    """The largest (not the last) counters of each job."""
    return df.groupBy(job).agg(*[F.max(c).alias(c) for c in (ionic, config, report)])
