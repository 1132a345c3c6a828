"""Streaming forms: incremental ingestion, windows over late data and continued steps of restarted runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def landed(spark: SparkSession, path: str, ddl: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_means(events: DataFrame, time: str, by: list[str], value: str, width: str, delay: str) -> DataFrame:
    """Counts and means in tumbling windows; rows later than the delay are left out."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, width), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *by, "n", "mean")


def sessions(events: DataFrame, time: str, by: list[str], gap: str, delay: str | None = None) -> DataFrame:
    """Spans of activity that a gap ends: start, end, number of rows. Works on streams (with a delay) and tables."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def continued_steps(rows: DataFrame, run: str, step: str) -> DataFrame:
    """run, step, total_step: a step that does not rise begins a new segment, which goes on from the largest total before it.

    The state of a run is three numbers, kept over micro-batches.
    """
    kind = rows.schema[run].dataType.simpleString()

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offset, last, top = state.get if state.exists else (0, None, 0)
        for batch in batches:
            totals = []
            for s in batch[step].tolist():
                if last is not None and s <= last:
                    offset = top
                last, total = s, offset + s
                top = max(top, total)
                totals.append(total)
            yield pd.DataFrame({run: [key[0]] * len(batch), step: batch[step], "total_step": totals})
        state.update((offset, last if last is not None else 0, top))

    return rows.groupBy(run).applyInPandasWithState(advance, f"`{run}` {kind}, `{step}` long, total_step long", "offset long, last long, top long", "append", GroupStateTimeout.NoTimeout)
