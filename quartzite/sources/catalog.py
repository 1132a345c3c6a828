"""Directory listings as tables, and discovery over them. A listing is what Spark's file source sees; nothing is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, compound, parent_dir, strain_percent


def listing(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, dir, name, size, modified of all files below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    files = reader.load(path)
    return files.select("path", parent_dir(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def leaf_dirs(files: DataFrame, is_run: Column) -> DataFrame:
    """Directories of runs below which there is no other: an anti-join with the ancestors of all."""
    dirs = files.where(is_run).select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir")).distinct()
    number = F.coalesce(F.regexp_extract(base_name(F.col("dir")), r"^(\d+)", 1).try_cast("long"), F.lit(1 << 62))
    return dirs.join(above, "dir", "left_anti").withColumn("number", number).orderBy("number", "dir")


def run_ids(files: DataFrame, home: str) -> DataFrame:
    """Each file's run: its directory with the home folder as ~; a path listed twice is one."""
    d = F.col("dir")
    short = F.when(F.startswith(d, F.lit(home.rstrip("/") + "/")) | (d == home.rstrip("/")), F.concat(F.lit("~"), F.substring(d, len(home.rstrip("/")) + 1, 1 << 30))).otherwise(d)
    return files.dropDuplicates(["path"]).withColumn("run_id", short).orderBy("path")


def eos_dirs(files: DataFrame) -> DataFrame:
    """compound, vol_pct, path of files in directories such as X/V_+2.0%; a later path overwrites an earlier one."""
    from ..operators.series import last_write

    named = files.select("path", compound(F.col("path")).alias("compound"), strain_percent(F.col("path")).alias("vol_pct")).dropna()
    return last_write(named, ["compound", "vol_pct"], ["path"], ["path"])


def structure_files(files: DataFrame) -> DataFrame:
    """POSCAR and CONTCAR files outside V_* directories; an empty CONTCAR is none."""
    kept = files.where(F.col("name").rlike("^(POSCAR|CONTCAR)") & ~F.col("dir").rlike("(^|/)V_"))
    return kept.where(~(F.col("name").startswith("CONTCAR") & (F.col("size") == 0)))


def only_one(df: DataFrame, what: str) -> DataFrame:
    """The table if it has one row, else an error that says what is missing or ambiguous."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} {what}")
    return df
