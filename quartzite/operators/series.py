"""Ordered operators over the rows of one run.

A run is bounded by its simulation, so windows are partitioned by run. `order` must be unique within a run. Where a
run could be too long for one task, running_sum takes blocks of ordinals and adds the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import WindowSpec


def ordered(run: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*run).orderBy(*order)


def up_to(run: list[str], order: list[str]) -> WindowSpec:
    return ordered(run, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_ordinal(df: DataFrame, run: list[str], order: list[str], name: str = "i") -> DataFrame:
    """0-based place of each row in its run."""
    return df.withColumn(name, (F.row_number().over(ordered(run, order)) - 1).cast("long"))


def skip_stride(df: DataFrame, ordinal: str, skip: int = 0, stride: int = 1, limit: int | None = None) -> DataFrame:
    """Every stride-th row by source ordinal, after skip rows; at most limit of them in each run."""
    i = F.col(ordinal)
    kept = df.where((i >= skip) & ((i - skip) % stride == 0))
    return kept if limit is None else kept.where((i - skip) / stride < limit)


def running_sum(df: DataFrame, run: list[str], ordinal: str, value: Column, name: str, block: int = 100_000) -> DataFrame:
    """Sum of a value over a run's rows so far. Blocks of ordinals are summed each in its own task, then offset."""
    df = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(ordinal) / block))
    totals = df.groupBy(*run, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*run, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy(*run, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.join(totals, [*run, "_block"]).withColumn(name, own + F.col("_before")).drop("_v", "_block", "_before")


def central_difference(df: DataFrame, run: list[str], order: list[str], value: str, dt: float, name: str = "velocity") -> DataFrame:
    """(next - previous) / 2 dt; rows without both neighbours are dropped."""
    w = ordered(run, order)
    out = df.withColumn(name, (F.lead(value).over(w) - F.lag(value).over(w)) / (2.0 * dt))
    return out.where(F.col(name).isNotNull())


def running_mean(df: DataFrame, run: list[str], order: list[str], value: str, window: int, name: str = "mean") -> DataFrame:
    """Mean of each full window of rows, at its last row; a run shorter than the window is returned as it is."""
    w = ordered(run, order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*run))
    out = df.withColumn("_n", size).withColumn("_i", F.row_number().over(w)).withColumn("_m", F.avg(value).over(w.rowsBetween(1 - window, 0)))
    out = out.withColumn(name, F.when(F.col("_n") < window, F.col(value).cast("double")).otherwise(F.col("_m")))
    return out.where((F.col("_n") < window) | (F.col("_i") >= window)).drop("_n", "_i", "_m")


def centred_mean(df: DataFrame, run: list[str], order: list[str], value: str, window: int, name: str = "smooth", pad: str = "edge") -> DataFrame:
    """Mean over an odd window centred on each row. Beyond the ends: 'edge' repeats the end values, 'zero' counts zeros."""
    half = (window if window % 2 else window + 1) // 2
    w = ordered(run, order)
    whole = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*run))
    inside = F.sum(value).over(w.rowsBetween(-half, half))
    if pad == "edge":
        before, after = F.greatest(half - i + 1, F.lit(0)), F.greatest(half - (n - i), F.lit(0))
        inside = inside + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return df.withColumn(name, inside / float(2 * half + 1))


def cumulative_trapezoid(df: DataFrame, run: list[str], order: list[str], x: str, y: str, name: str = "integral") -> DataFrame:
    """Integral of y over x up to each row, 0 at the first."""
    w = ordered(run, order)
    step = F.coalesce((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0, F.lit(0.0))
    return df.withColumn("_step", step).withColumn(name, F.sum("_step").over(up_to(run, order))).drop("_step")


def first_crossing(df: DataFrame, run: list[str], order: list[str], x: str, y: str, fraction: float) -> DataFrame:
    """First x of each run at which the running maximum of y reaches a fraction of the last running maximum."""
    peak = df.withColumn("_peak", F.max(y).over(up_to(run, order)))
    end = df.groupBy(*run).agg(F.max(y).alias("_end"))
    hit = peak.join(end, run).where(F.col("_peak") >= fraction * F.col("_end"))
    return hit.groupBy(*run).agg(F.min_by(x, F.struct(*order)).alias(x))


def last_above(df: DataFrame, run: list[str], order: list[str], x: str, y: str, floor: float) -> DataFrame:
    """Last x of each run whose y lies above a floor."""
    return df.where(F.col(y) > floor).groupBy(*run).agg(F.max_by(x, F.struct(*order)).alias(x))


def tail_mean(df: DataFrame, run: list[str], order: list[str], value: str, name: str = "tail_mean") -> DataFrame:
    """Mean of each row and all after it in its run."""
    return df.withColumn(name, F.avg(value).over(ordered(run, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)))


def equilibration_skip(df: DataFrame, run: list[str], ordinal: str, value: str, tail: float = 0.35, rtol: float = 5e-4, atol: float = 0.02, most: float = 0.55, least: int = 20) -> DataFrame:
    """How many rows of each run to leave out: the fewest, up to a share `most`, after which the mean agrees with the mean of the run's tail.

    Agreement is within the larger of the two tolerances; where none is reached the closest (first) one counts. A run under
    `least` rows leaves none out. The tail begins at the share 1 - tail, rounded half to even.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*run))
    share = min(0.49, max(0.05, tail))
    marked = tail_mean(df, run, [ordinal], value, "_rest").withColumn("_n", n)
    begin = F.greatest(F.lit(1), F.least(F.rint(F.col("_n") * (1 - share)), F.col("_n") - 2))
    marked = marked.withColumn("_ref", F.avg(F.when(F.col(ordinal) >= begin, F.col(value))).over(Window.partitionBy(*run)))
    error = F.abs(F.col("_rest") - F.col("_ref"))
    allowed = F.col(ordinal) <= F.least(F.col("_n") - 2, F.floor(F.col("_n") * most))
    close = allowed & (error <= F.greatest(F.lit(atol), rtol * F.abs(F.col("_ref"))))
    best = F.coalesce(F.min(F.when(close, F.col(ordinal))), F.min_by(F.col(ordinal), F.when(allowed, F.struct(error, F.col(ordinal)))))
    return marked.groupBy(*run).agg(F.when(F.max("_n") < least, F.lit(0)).otherwise(best).cast("long").alias("skip"))


def blocks(df: DataFrame, run: list[str], order: list[str], closes: Column, name: str = "block") -> DataFrame:
    """Number of the block of each row; a row that closes a block is its last row."""
    closed = F.sum(closes.cast("int")).over(ordered(run, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(closed, F.lit(0)).cast("long"))


def block_max(df: DataFrame, run: list[str], order: list[str], closes: Column, value: str) -> DataFrame:
    """Largest value of every closed block; rows after the last closing row belong to none."""
    marked = blocks(df.withColumn("_closes", closes), run, order, F.col("_closes"))
    out = marked.groupBy(*run, "block").agg(F.max(value).alias("block_max"), F.count(F.lit(1)).alias("n"), F.bool_or("_closes").alias("_closed"))
    return out.where("_closed").drop("_closed")


def next_good(df: DataFrame, run: list[str], ordinal: str, good: Column, share: float, name: str) -> DataFrame:
    """For each run the first good ordinal at or after a share of its length."""
    n = df.groupBy(*run).agg(F.floor(F.count(F.lit(1)) * share).alias("_target"))
    marked = df.select(*run, ordinal, good.alias("_good")).join(n, run)
    return marked.groupBy(*run).agg(F.min(F.when(F.col("_good") & (F.col(ordinal) >= F.col("_target")), F.col(ordinal))).alias(name))


def two_good(df: DataFrame, run: list[str], ordinal: str, good: Column) -> DataFrame:
    """First good ordinals at or after a third and two thirds of each run; the second comes after the first, else the run has no row."""
    sizes = df.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    marked = df.select(*run, ordinal, good.alias("_good")).join(sizes, run).where("_good")
    first = F.min(F.when(F.col(ordinal) >= F.floor(F.col("_n") / 3), F.col(ordinal))).alias("first")
    firsts = marked.groupBy(*run).agg(first)
    second = F.min(F.when((F.col(ordinal) >= F.floor(2 * F.col("_n") / 3)) & (F.col(ordinal) > F.col("first")), F.col(ordinal))).alias("second")
    both = marked.join(firsts, run).groupBy(*run, "first").agg(second)
    return both.where("first IS NOT NULL AND second IS NOT NULL")


def two_points(n: Column) -> Column:
    """Ordinals at a third and two thirds of n rows, without duplicates; empty for no rows."""
    return F.when(n > 0, F.array_distinct(F.array(F.floor(n / 3), F.floor(2 * n / 3)))).otherwise(F.array().cast("array<bigint>"))


def last_good(df: DataFrame, run: list[str], ordinal: str, good: Column) -> DataFrame:
    return df.where(good).groupBy(*run).agg(F.max(ordinal).alias("last_good"))


def least_row(df: DataFrame, by: list[str], value: str, order: list[str], keep: list[str]) -> DataFrame:
    """Each group's row of least value, the first of equal ones."""
    best = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*keep), F.struct(value, *order)).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in keep])


def nearest_to_least(df: DataFrame, by: list[str], value: str, x: str, order: list[str], n: int) -> DataFrame:
    """The n rows of each group whose x is nearest to the x of its row of least value; equal distances go by order."""
    least = least_row(df, by, value, order, [x]).withColumnRenamed(x, "_x")
    near = df.join(least, by).withColumn("distance", F.abs(F.col(x) - F.col("_x")))
    return near.withColumn("rank", F.row_number().over(ordered(by, ["distance", *order]))).where(F.col("rank") <= n).drop("_x")


def coverage_anchor(df: DataFrame, by: list[str], size: str, limit: int, order: list[str], keep: list[str]) -> DataFrame:
    """One row for each group: a smaller one than the limit if there is any, then the smallest, then the first."""
    key = F.struct((F.col(size) >= limit).alias("_big"), F.col(size), *order)
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in keep])


def last_write(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of rows with one key the last in order."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in keep])


def join_restarts(df: DataFrame, run: list[str], segment: str, step: str, name: str = "total_step") -> DataFrame:
    """Steps counted on through a run's segments: each segment goes on from the largest step before it."""
    top = df.groupBy(*run, segment).agg(F.max(step).alias("_top"))
    before = Window.partitionBy(*run).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    offset = top.select(*run, segment, F.coalesce(F.sum("_top").over(before), F.lit(0)).alias("_offset"))
    return df.join(offset, [*run, segment]).withColumn(name, F.col(step) + F.col("_offset")).drop("_offset")


def zip_rows(left: DataFrame, right: DataFrame, run: list[str], left_order: list[str], right_order: list[str], offset: int = 0) -> DataFrame:
    """Rows of two sources paired by their place in the run; the longer side is cut. The first `offset` rows of the right side are left out."""
    a = with_ordinal(left, run, left_order, "i")
    b = with_ordinal(right, run, right_order, "i").withColumn("i", F.col("i") - offset).where("i >= 0")
    return a.join(b, [*run, "i"])


def and_masks(a: DataFrame, b: DataFrame, run: list[str], ordinal: str, ok: str) -> DataFrame:
    """Two masks of a run combined by place where they are equally long; otherwise the first alone."""
    size = b.groupBy(*run).agg(F.count(F.lit(1)).alias("_nb"))
    own = a.groupBy(*run).agg(F.count(F.lit(1)).alias("_na")).join(size, run, "left")
    other = b.select(*run, ordinal, F.col(ok).alias("_other"))
    joined = a.join(own, run).join(other, [*run, ordinal], "left")
    both = F.when(F.col("_na").eqNullSafe(F.col("_nb")), F.col(ok) & F.col("_other")).otherwise(F.col(ok))
    return joined.withColumn(ok, both).drop("_na", "_nb", "_other")


def mask_frames(frames: DataFrame, mask: DataFrame, run: list[str], ordinal: str, ok: str) -> DataFrame:
    """Frames whose mask is true; a run whose mask and frames differ in number is left out altogether."""
    sizes = frames.groupBy(*run).agg(F.count(F.lit(1)).alias("_f")).join(mask.groupBy(*run).agg(F.count(F.lit(1)).alias("_m")), run).where("_f = _m").select(*run)
    return frames.join(sizes, run, "left_semi").join(mask.where(F.col(ok)).select(*run, ordinal), [*run, ordinal])


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row (from 0) in the order of the whole table: a range sort, numbers within its partitions, and the counts of the partitions before; no task holds more than a partition."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from ..plans.storage import scratch

    spark = df.sparkSession

    def number(batches):
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(count, count + batch.num_rows))], names=[*batch.schema.names, "_part", "_at"])
            count += batch.num_rows

    folder = scratch(spark, "placed")
    kind = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).mapInArrow(number, kind).write.parquet(folder)
    rows = spark.read.schema(kind).parquet(folder)
    before, total = [], 0
    for r in rows.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        before.append((r._part, total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).select(*df.columns, name)
