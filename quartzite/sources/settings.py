"""Settings, logs and tables kept as text.

Settings are small files, read whole with column expressions. Logs are read by parsers that compose over byte ranges: their source is
`ranges.file_ranges`, which makes many tasks of a file, or path and text, one row a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBER, floats, last_number
from ..operators.series import ordered
from . import logs, ranges

#: Electronic steps allowed where a file does not say.
DEFAULT_NELM = 60
#: Texts of a run that failed (a pattern).
FAILURE = r"(?i)ZBRENT: fatal|BRMIX: very serious|Error EDDDAV|VERY BAD NEWS|aborting loop because hard stop"


def incar_map(text: Column) -> Column:
    """KEY -> value of an INCAR-like text; comments after ! or # are left out, of repeated keys the last counts, several entries on a line are parted by ;."""
    rows = F.split(F.regexp_replace(text, r"[!#][^\n]*", ""), r"[\n;]")
    entries = F.transform(F.filter(rows, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.upper(F.trim(F.split(x, "=", 2)[0])).alias("k"), F.trim(F.split(x, "=", 2)[1]).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def incar(files: DataFrame) -> DataFrame:
    """path, params."""
    return files.select("path", incar_map(F.col("text")).alias("params"))


def setting(params: Column, key: str, kind: str = "double") -> Column:
    """A setting as a number if its value is one, else null."""
    return F.trim(F.get(F.split(params[key], r"\s+"), F.lit(0))).try_cast(kind)


def electronic_limit(params: Column) -> Column:
    return F.coalesce(setting(params, "NELM", "int"), F.lit(DEFAULT_NELM))


def value_kind(value: Column) -> Column:
    """'int', 'float' or 'string': a single word that reads as a number is one."""
    return F.when(value.rlike(r"^[-+]?\d+$"), "int").when(value.rlike(f"^{NUMBER}$"), "float").otherwise("string")


def kpoints(files: DataFrame) -> DataFrame:
    """path, grid, n: the line after one that begins with Monkhorst or Gamma, else the first with three whole numbers; 1x1x1 and 0 where there is none."""
    named = F.regexp_extract("text", r"(?im)^\s*(?:monkhorst|gamma)[^\n]*\n\s*(\d+)\s+(\d+)\s+(\d+)", 0)
    bare = F.regexp_extract("text", r"(?m)^\s*(\d+)\s+(\d+)\s+(\d+)", 0)
    line = F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit("")))
    three = F.transform(F.slice(F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1)), -3, 3), lambda x: x.cast("int"))
    out = files.select("path", F.when(line.isNotNull(), three).alias("_g"))
    return out.select("path", F.coalesce("_g", F.array(F.lit(1), F.lit(1), F.lit(1))).alias("grid"), F.coalesce(F.aggregate("_g", F.lit(1), lambda a, x: a * x), F.lit(0)).alias("n"))


def potcar(files: DataFrame) -> DataFrame:
    """path, place, symbol, zval of every potential in a file."""
    found = F.regexp_extract_all("text", F.lit(r"(?s)(TITEL\s*=\s*[^\n]*.*?ZVAL\s*=\s*[\d.]+)"), F.lit(1))
    rows = files.select("path", F.posexplode(found).alias("place", "t"))
    return rows.select("path", "place", F.regexp_extract("t", r"TITEL\s*=\s*\S+\s+([A-Za-z]+)", 1).alias("symbol"), F.regexp_extract("t", r"ZVAL\s*=\s*([\d.]+)$", 1).cast("double").alias("zval"))


def report_energies(source: DataFrame) -> DataFrame:
    """path, place, e_pot: the second number of every e_b line of a REPORT."""
    found = ranges.scan(source, logs.Counted({"e_pot": rf"e_b>\s*{NUMBER}\s+({NUMBER})"}, {"e_pot": "e_b>"}))
    return found.select("path", "place", F.col("value").alias("e_pot"))


def eos_point(source: DataFrame) -> DataFrame:
    """path, volume, energy, pressure_gpa, max_force of an OUTCAR: the last volume, energy and pressure (kB to GPa), the largest force of the last block; without volume or energy there is no row."""
    out = ranges.ends(source, logs.LastPoint()).select("path", "volume", "energy", (0.1 * F.col("pressure")).alias("pressure_gpa"), "max_force")
    return out.where("volume IS NOT NULL AND energy IS NOT NULL")


def tvp(source: DataFrame) -> DataFrame:
    """path, series ('temperature', 'volume', 'pressure'), place, value: three series of an OUTCAR, each with its own length; lines with settings are no temperatures."""
    patterns = {"temperature": rf"temperature\s*=?\s*({NUMBER})", "volume": rf"volume of cell\s*:\s*({NUMBER})", "pressure": rf"external pressure\s*=\s*({NUMBER})"}
    hints = {"temperature": "temperature", "volume": "volume of cell", "pressure": "external pressure"}
    return ranges.scan(source, logs.Counted(patterns, hints, {"temperature": "TEBEG|TEIN|SMASS|TAV|TCHAIN|POTIM"}, every=False))


def temperatures(source: DataFrame) -> DataFrame:
    """path, place, temperature of an OUTCAR: of three ways in which a file can say it the best one present counts for the whole file."""
    ways = {"lattice": rf"EKIN_LAT.*temperature\s+({NUMBER})", "equals": rf"temperature\s*=\s*({NUMBER})", "bracket": rf"\(temperature\s+({NUMBER})"}
    found = ranges.scan(source, logs.BestWay(ways, dict.fromkeys(ways, "temperature")))
    return found.select("path", "place", F.col("value").alias("temperature"))


def oszicar(source: DataFrame) -> DataFrame:
    """schema.SCF without block: every ionic step of an OSZICAR with its electronic iterations, temperature and energy."""
    found = ranges.scan(source, logs.IonicSteps())
    out = found.groupBy("path", "ionic_step").agg(*[F.max(c).alias(c) for c in ("iterations", "has_ionic_line", "temperature", "energy")])
    return out.select("path", "ionic_step", "iterations", "has_ionic_line", "temperature", "energy")


def vasp_thermo(oszicars: DataFrame, outcars: DataFrame, directory: Column) -> DataFrame:
    """run, i, temperature, energy, volume: steps of an OSZICAR and the volumes of the OUTCAR beside it, the first volume left out, paired by place and cut to the shorter; without volumes they are NaN."""
    steps = oszicar(oszicars).where("has_ionic_line").withColumn("run", directory)
    steps = steps.withColumn("i", F.row_number().over(ordered(["run"], ["ionic_step"])) - 1)
    volumes = tvp(outcars).where("series = 'volume' AND place > 0").withColumn("run", directory).select("run", (F.col("place") - 1).alias("i"), F.col("value").alias("volume"))
    known = volumes.select("run").distinct().withColumn("_any", F.lit(True))
    out = steps.select("run", "i", "temperature", "energy").join(volumes, ["run", "i"], "left").join(known, "run", "left")
    return out.where("volume IS NOT NULL OR _any IS NULL").withColumn("volume", F.coalesce("volume", F.lit(float("nan")))).drop("_any")


def lammps_thermo(source: DataFrame) -> DataFrame:
    """schema.THERMO of log files: blocks open at a line with Step and Temp and close at Loop time, an error, a blank, short or non-numeric line; columns are found by the names of their header."""
    return ranges.scan(source, logs.ThermoBlocks())


def time_steps(incars: DataFrame, outcars: DataFrame, scripts: DataFrame, directory: Column) -> DataFrame:
    """run, dt_fs, source: POTIM of INCAR, then of the OUTCAR, then the timestep of a LAMMPS script (metal: ps); 1.0 by default for runs with any of these files."""
    a = incars.select(directory.alias("run"), setting(incar_map(F.col("text")), "POTIM").alias("dt"), F.lit(0).alias("rank"), F.lit("INCAR").alias("source"))
    b = outcars.select(directory.alias("run"), last_number(F.col("text"), rf"POTIM\s*=\s*({NUMBER})").alias("dt"), F.lit(1).alias("rank"), F.lit("OUTCAR").alias("source"))
    metal = F.col("text").rlike(r"(?m)^\s*units\s+metal")
    stated = last_number(F.col("text"), rf"(?m)^\s*timestep\s+({NUMBER})")
    c = scripts.select(directory.alias("run"), F.when(metal, stated * 1000).otherwise(stated).alias("dt"), F.lit(2).alias("rank"), F.lit("LAMMPS").alias("source"))
    best = F.min_by(F.struct("dt", "source"), F.when(F.col("dt").isNotNull(), F.col("rank")))
    out = a.unionByName(b).unionByName(c).groupBy("run").agg(best.alias("b"))
    return out.select("run", F.coalesce("b.dt", F.lit(1.0)).alias("dt_fs"), F.coalesce("b.source", F.lit("default")).alias("source"))


def element_map(files: DataFrame) -> DataFrame:
    """path, type, symbol: elements that a LAMMPS script names in its pair_coeff * * line."""
    words = F.split(F.trim(F.regexp_extract("text", r"(?m)^\s*pair_coeff\s+\*\s+\*\s+([^\n#]*)", 1)), r"\s+")
    symbols = F.filter(words, lambda x: x.rlike(r"^[A-Z][a-z]?$"))
    return files.select("path", F.posexplode(symbols).alias("_i", "symbol")).select("path", (F.col("_i") + 1).alias("type"), "symbol")


def metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Wide training metrics as a long table: path, epoch, row, metric, value; see frames.learning_curve."""
    from ..operators.frames import wide_to_long

    wide = spark.read.option("header", "true").csv(path).withColumn("path", F.col("_metadata.file_path")).withColumn("row", F.monotonically_increasing_id())
    names = [c for c in wide.columns if c not in ("path", "row", "epoch")]
    rows = wide.select("path", "row", F.col("epoch").try_cast("double").cast("long").alias("epoch"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])
    return wide_to_long(rows, ["path", "row", "epoch"], names)


def provenance(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of provenance tables whose repeated header rows are left out."""
    rows = spark.read.option("header", "true").csv(path)
    first = rows.columns[0]
    return rows.where(F.col(f"`{first}`") != first)


def training_config(files: DataFrame) -> DataFrame:
    """path, seed (12345 by default), dataset, shares: what a flat reading of a training YAML says about its split."""
    value = lambda key: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^\s*{key}\s*:\s*([^\n#]*)", 1)), F.lit(""))
    shares = floats(value("train_val_split"))
    return files.select("path", F.coalesce(value("seed").try_cast("int"), F.lit(12345)).alias("seed"), F.coalesce(value("split_dataset"), value("file_path"), value("train_file_path")).alias("dataset"), F.when(F.size(shares) > 0, shares).alias("shares"))


def scheduler(files: DataFrame) -> DataFrame:
    """id, state, name, reason, runtime, workdir of a |-separated queue listing; a header line is no job."""
    rows = files.select(F.explode(F.split("text", r"\r?\n")).alias("x")).select(F.split("x", r"\|").alias("c")).where("size(c) >= 6")
    names = ["id", "state", "name", "reason", "runtime", "workdir"]
    return rows.select(*[F.trim(F.col("c")[i]).alias(n) for i, n in enumerate(names)]).where("id RLIKE '^[0-9]'")


def two_columns(source: DataFrame, x: str = "t", y: str = "msd") -> DataFrame:
    """path, row, x, y of two-column text; lines that begin with # and lines without two numbers are left out."""
    return ranges.scan(source, logs.NumberedLines()).select("path", "row", F.col("x").alias(x), F.col("y").alias(y))


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, alpha of PNG files, from the first bytes of each."""
    return png_headers(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path))


def png_headers(files: DataFrame) -> DataFrame:
    """path, width, height, alpha from path and content; nulls where the content is no PNG."""
    is_png = F.startswith(F.hex("content"), F.lit("89504E470D0A1A0A"))
    number = lambda at: F.when(is_png, F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int"))
    return files.select("path", number(17).alias("width"), number(21).alias("height"), F.when(is_png, F.conv(F.hex(F.substring("content", 26, 1)), 16, 10).isin("4", "6")).alias("alpha"))


def convergence(outcars: DataFrame, oszicars: DataFrame, incars: DataFrame, directory: Column, failure: str = FAILURE) -> DataFrame:
    """run, converged (null where undecidable) of each run, from its three files: the most electronic iterations of any step count."""
    from ..operators.frames import converged

    a = ranges.ends(outcars, logs.Marked(failure)).select(directory.alias("run"), F.col("found").alias("failed"))
    b = oszicar(oszicars).withColumn("run", directory).groupBy("run").agg(F.max("iterations").alias("iterations"), F.bool_or("has_ionic_line").alias("energy"))
    c = incars.select(directory.alias("run"), electronic_limit(incar_map(F.col("text"))).alias("limit"))
    out = a.join(b, "run", "full").join(c, "run", "left")
    return out.select("run", converged(F.col("failed"), F.col("energy"), F.col("iterations"), F.col("limit")).alias("converged"))
