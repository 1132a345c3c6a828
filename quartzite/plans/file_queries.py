"""Named queries of sources, sinks and discovery: tables are written in a file grammar, scanned again, and compared with the tables.

Texts of small files are built in columns and scanned where they are; trajectories are written to the shared folder and read
back through the data source. Runs are users with their events, frames are orders with their lines, structures are parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import descriptors, eos, errors, frames, match, pairs, select, series
from ..sources import catalog, files, frame_index, ranges, settings, sinks
from .queries import RUNS, SQL, query, rounded, runs, table
from .storage import scratch


def run_files(spark: SparkSession, d: str, name: str, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """path, text: a file of each run, a piece of text for each row of the run in order."""
    rows = runs(spark, d).select("user_id", "i", line.alias("line"))
    per = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))
    return per.select(F.format_string(f"/data/run%d/{name}", "user_id").alias("path"), F.concat(F.lit(head), F.array_join("r.line", "\n"), F.lit(tail)).alias("text"))


def run_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"/run(\d+)/", 1).cast("long").alias("user_id")


def run_ranges(spark: SparkSession, d: str, name: str, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """Byte ranges of a file of each run, in a folder of its own; they are small, so that files have several."""
    path = scratch(spark, name.lower())
    sinks.write_text(run_files(spark, d, name, line, head, tail).select(run_of(), "text"), F.col("text"), path, ["user_id"])
    return ranges.file_ranges(spark, path, range_bytes=4096)


def user_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"user_id=(\d+)/", 1).cast("long").alias("user_id")


def say(pattern: str, *values: Column | str) -> Column:
    return F.format_string(pattern, *values)


# --- logs and settings --------------------------------------------------------------------------------------------


def ionic_steps() -> Column:
    """Three electronic steps at most, then the ionic line."""
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.col("i") % 3 + 1), lambda k: say("DAV:  %d    -0.1", k)), "\n"), F.lit("\n"), say("%4d T= %.4f E= -1.0 F= -2.0 E0= %.4f", F.col("i") + 1, F.col("value") + 300, -F.col("value")))


@query(f"SELECT user_id, i AS ionic_step, i % 3 + 1 AS iterations, round(value + 300, 4) AS temperature, round(-value, 4) AS energy FROM {RUNS}")
def oszicar_scan(spark: SparkSession, d: str) -> DataFrame:
    """Electronic iterations, temperature and energy of each ionic step."""
    out = settings.oszicar(run_ranges(spark, d, "OSZICAR", ionic_steps()))
    return rounded(out.select(user_of(), "ionic_step", F.col("iterations").cast("long").alias("iterations"), "temperature", "energy"))


@query(f"SELECT user_id, i, round(value + 300, 4) AS temperature, round(-value, 4) AS energy, CASE WHEN user_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE round(64 + i + 1.0, 4) END AS volume FROM {RUNS} JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id) WHERE user_id % 5 = 0 OR i < n - 1")
def vasp_thermo_scan(spark: SparkSession, d: str) -> DataFrame:
    """Steps of one file and volumes of the other, the first volume left out, the longer cut; runs without volumes have none."""
    volumes = run_ranges(spark, d, "OUTCAR", F.when(F.col("user_id") % 5 != 0, say("  volume of cell :  %.4f", F.col("i") + 64.0)).otherwise("nothing"))
    out = settings.vasp_thermo(run_ranges(spark, d, "OSZICAR", ionic_steps()), volumes, F.regexp_extract("path", r"user_id=(\d+)/", 1))
    return rounded(out.select(F.col("run").cast("long").alias("user_id"), F.col("i").cast("long").alias("i"), "temperature", "energy", "volume"))


def three_series() -> Column:
    return F.concat_ws("\n", F.when(F.col("i") % 10 == 0, F.lit("  TEBEG = 300.0 ; temperature = 5.0")), say("  temperature %.4f K", F.col("value")), F.when(F.col("i") % 2 == 0, say("  volume of cell :   %.4f", F.col("value") + 64)), say("  external pressure =   %.4f kB  Pullay stress = 0.00 kB", -F.col("value")))


@query(f"""SELECT user_id, 'temperature' AS series, i AS place, round(value, 4) AS value FROM {RUNS} UNION ALL SELECT user_id, 'pressure', i, round(-value, 4) FROM {RUNS}
UNION ALL SELECT user_id, 'volume', i // 2, round(value + 64, 4) FROM {RUNS} WHERE i % 2 = 0""")
def outcar_series_scan(spark: SparkSession, d: str) -> DataFrame:
    """Three series of one log, each of its own length; lines with settings are no temperatures."""
    out = settings.tvp(run_ranges(spark, d, "OUTCAR", three_series()))
    return rounded(out.select(user_of(), "series", F.col("place").cast("long").alias("place"), "value"))


@query(f"SELECT user_id, i AS place, round(value + user_id % 3, 4) AS temperature FROM {RUNS}")
def outcar_temperature_scan(spark: SparkSession, d: str) -> DataFrame:
    """Of three ways to state a temperature the best one present counts for the whole file."""
    k, v = F.col("user_id") % 3, F.col("value")
    ways = [F.when(k == 0, say("  EKIN_LAT= 0.0  (temperature  %.4f K)", v)), F.when(k <= 1, say("  temperature = %.4f K", v + 1)), say("  kinetic (temperature %.4f K)", v + 2)]
    out = settings.temperatures(run_ranges(spark, d, "OUTCAR", F.concat_ws("\n", *ways)))
    return rounded(out.select(user_of(), F.col("place").cast("long").alias("place"), "temperature"))


def eos_block() -> Column:
    return F.concat_ws("\n", say("  volume of cell :   %.4f", F.col("value") + 64), say(" POSITION          TOTAL-FORCE (eV/Angst)\n ------\n 0.0 0.0 0.0  %.4f 0.0 0.0\n 1.0 1.0 1.0  0.0 3.0 4.0", F.col("value")), say("  free  energy   TOTEN  =  %.4f eV", -F.col("value")), say("  external pressure =  %.4f kB", F.col("value") * 2))


@query(f"SELECT user_id, round(max_by(value, i) + 64, 4) AS volume, round(-max_by(value, i), 4) AS energy, round(0.2 * max_by(value, i), 4) AS pressure_gpa, round(greatest(abs(max_by(value, i)), 5), 4) AS max_force FROM {RUNS} GROUP BY 1")
def eos_point_scan(spark: SparkSession, d: str) -> DataFrame:
    """The last volume, energy and pressure, and the largest force of the last block."""
    out = settings.eos_point(run_ranges(spark, d, "OUTCAR", eos_block(), tail="\n"))
    return rounded(out.select(user_of(), "volume", "energy", "pressure_gpa", "max_force"))


@query("SELECT o_orderkey, (o_custkey % 90)::BIGINT AS nelm, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 1000, 3) END AS potim, 'run ' || o_orderkey AS system, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 4 END::BIGINT AS entries, 'int' AS kind FROM orders")
def settings_scan(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values; comments are left out, several entries share a line, of repeated keys the last counts."""
    k = F.col("o_orderkey")
    body = F.concat_ws("\n", say(" System = run %d ! the name = x", k), say("NELM = 7; ISMEAR = -5 # two = three"), F.lit("! POTIM = 9"), F.when(k % 3 == 0, say("potim = %.3f", F.col("o_totalprice") / 1000)), F.lit("MAGMOM = 1*5 2*0"), say("nelm = %d", F.col("o_custkey") % 90))
    p = settings.incar(table(spark, d, "orders").select(say("/data/%d/INCAR", k).alias("path"), body.alias("text")))
    m = F.col("params")
    return p.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("o_orderkey"), settings.electronic_limit(m).cast("long").alias("nelm"), settings.setting(m, "POTIM").alias("potim"), m["SYSTEM"].alias("system"), F.size(m).cast("long").alias("entries"), settings.value_kind(m["NELM"]).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '1x1x1' ELSE p_size || 'x' || (p_size + 1) || 'x' || (p_partkey % 9 + 1) END AS grid, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * (p_size + 1) * (p_partkey % 9 + 1) END::BIGINT AS n FROM part")
def kpoints_scan(spark: SparkSession, d: str) -> DataFrame:
    """Grids that the writer makes, read again; files without one have a point."""
    grid = F.array(F.col("p_size"), F.col("p_size") + 1, (F.col("p_partkey") % 9 + 1).cast("int"))
    body = F.when(F.col("p_size") % 7 == 0, F.lit("comment\nlines only\n")).otherwise(sinks.kpoints_text(grid, F.when(F.col("p_partkey") % 2 == 0, "Gamma").otherwise("Monkhorst-Pack")))
    out = settings.kpoints(table(spark, d, "part").select(say("/d/%d/KPOINTS", F.col("p_partkey")).alias("path"), body.alias("text")))
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("p_partkey"), F.array_join(F.col("grid").cast("array<string>"), "x").alias("grid"), F.col("n").cast("long").alias("n"))


@query("SELECT c_custkey // 50 AS file, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS place, ['Mn', 'O', 'K'][c_custkey % 3 + 1] AS symbol, round(c_custkey % 17 + 0.25, 4) AS zval FROM customer")
def potcar_scan(spark: SparkSession, d: str) -> DataFrame:
    """Name and valence of every potential in a file."""
    symbol = F.element_at(F.array(F.lit("Mn"), F.lit("O"), F.lit("K")), (F.col("c_custkey") % 3 + 1).cast("int"))
    entry = F.concat(F.lit(" TITEL  = PAW_PBE "), symbol, F.when(F.col("c_custkey") % 2 == 0, "_pv").otherwise(""), F.lit(" 02Aug2007\n POMASS =   54.938; "), say("ZVAL   =   %.3f    mass\n", F.col("c_custkey") % 17 + 0.25))
    per = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("file")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))).alias("r"))
    out = settings.potcar(per.select(say("/n/%d/POTCAR", F.col("file")).alias("path"), F.array_join("r.e", "").alias("text")))
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("file"), F.col("place").cast("long").alias("place"), "symbol", F.round("zval", 4).alias("zval"))


@query(f"SELECT user_id, i AS place, round(-value, 4) AS e_pot FROM {RUNS}")
def report_scan(spark: SparkSession, d: str) -> DataFrame:
    """The second number of every energy line."""
    out = settings.report_energies(run_ranges(spark, d, "REPORT", say("step\n   e_b>  1.5E+01  %.4f  2.0", -F.col("value"))))
    return rounded(out.select(user_of(), F.col("place").cast("long").alias("place"), "e_pot"))


@query(f"SELECT user_id, (i // 30 + 1)::BIGINT AS block, i % 30 AS row, i * 10 AS step, round(value, 4) AS temperature, round(value + 64, 4) AS volume, round(-value, 4) AS energy FROM {RUNS} WHERE NOT (i % 30 > 20)")
def lammps_log_scan(spark: SparkSession, d: str) -> DataFrame:
    """Blocks open at a header and close at Loop time or at a broken line; columns are found by name, in either order."""
    i, v = F.col("i"), F.col("value")
    new = F.col("user_id") % 2 == 0
    head = F.when(i % 30 == 0, F.when(new, F.lit("Loop time of 1 on 1 procs\nStep Temp Press Volume TotEng")).otherwise(F.lit("Step TotEng Temp Vol Press")))
    row = F.when(new, say("%d %.4f 1.0 %.4f %.4f", i * 10, v, v + 64, -v)).otherwise(say("   %d %.4f %.4f %.4f 1.0", i * 10, -v, v, v + 64))
    out = settings.lammps_thermo(run_ranges(spark, d, "log.lammps", F.concat_ws("\n", head, F.when(i % 30 == 21, F.lit("ERROR: lost atoms")), row), head="LAMMPS\n"))
    return rounded(out.select(user_of(), F.col("block").cast("long").alias("block"), "row", "step", "temperature", "volume", "energy"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 WHEN 2 THEN 2.5 WHEN 3 THEN 3.0 ELSE 1.0 END::DOUBLE AS dt_fs, ['INCAR', 'OUTCAR', 'LAMMPS', 'LAMMPS', 'default'][c_custkey % 5 + 1] AS source FROM customer")
def time_step_scan(spark: SparkSession, d: str) -> DataFrame:
    """The time step of each run by precedence, with the units of its engine, on the run's rows."""
    c = table(spark, d, "customer").select("c_custkey", say("/c/run%d/x", F.col("c_custkey")).alias("path"), (F.col("c_custkey") % 5).alias("k"))
    k = F.col("k")
    incars = c.where("k IN (0, 4)").select("path", F.when(k == 0, F.lit("POTIM = 1.5\n")).otherwise(F.lit("NSW = 3\n")).alias("text"))
    outcars = c.where("k IN (0, 1)").select("path", F.lit("   POTIM  =  2.0000    time-step").alias("text"))
    scripts = c.where("k IN (1, 2, 3)").select("path", F.when(k == 3, F.lit("units real\ntimestep 3.0\n")).otherwise(F.lit("units metal\ntimestep 0.0025\n")).alias("text"))
    steps = settings.time_steps(incars, outcars, scripts, text.parent_dir(F.col("path")))
    on_rows = match.per_run(c.select("c_custkey", text.parent_dir(F.col("path")).alias("run")), steps, ["run"])
    return on_rows.select("c_custkey", F.round("dt_fs", 6).alias("dt_fs"), "source")


@query(f"SELECT coalesce(['K', 'Mn', 'O'][i % 4 + 1], 'X') AS symbol, count(*) AS n FROM {RUNS} GROUP BY 1")
def element_map_scan(spark: SparkSession, d: str) -> DataFrame:
    """Elements that a script names, put on atoms by their type; a type without one has a fallback."""
    script = spark.range(1).select(F.lit("/s/in.lmp").alias("path"), F.lit("units metal\npair_style mace\npair_coeff * * model.pt K Mn O # all\nrun 5\n").alias("text"))
    kinds = settings.element_map(script).select("type", "symbol")
    atoms = runs(spark, d).select((F.col("i") % 4 + 1).cast("int").alias("type"))
    return match.with_symbols(atoms, kinds, "type", "symbol", fallback="X").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linenumber::BIGINT AS kind, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS symbols FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def type_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Types that rows name by more than one symbol."""
    out = match.conflicts(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("kind"), "l_returnflag"), "kind", "l_returnflag")
    return out.select("kind", F.array_join("symbols", ",").alias("symbols"))


@query("""WITH o AS (SELECT o_custkey // 50 AS run, o_orderkey % 40 AS epoch, o_orderkey, o_totalprice AS loss, CASE WHEN o_orderkey % 4 < 3 THEN o_totalprice / 10 - 12000 END AS mse FROM orders),
t AS (SELECT run, epoch, max_by(loss, o_orderkey) AS loss, max_by(mse, o_orderkey) AS mse FROM o GROUP BY 1, 2)
SELECT run, 'train_loss_epoch' AS metric, epoch, round(loss, 3) AS value FROM t UNION ALL SELECT run, 'val_mse', epoch, round(mse, 3) FROM t WHERE mse IS NOT NULL
UNION ALL SELECT run, 'val_rmse', epoch, round(sqrt(mse), 3) FROM t WHERE mse >= 0""")
def metrics_scan(spark: SparkSession, d: str) -> DataFrame:
    """Wide sparse metrics of each run, written as CSV and read as a long table; the last value of an epoch counts, roots of squares are added."""
    wide = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 50).alias("run"), (F.col("o_orderkey") % 40).alias("epoch"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("train_loss_epoch"), F.when(F.col("o_orderkey") % 4 < 3, F.col("o_totalprice") / 10 - 12000).alias("val_mse"))
    path = scratch(spark, "metrics")
    wide.repartition("run").sortWithinPartitions("run", "step").write.partitionBy("run").option("header", "true").csv(path)
    long = settings.metrics(spark, path).where("metric NOT IN ('step', 'run')").withColumn("run", F.regexp_extract("path", r"/run=(\d+)/", 1).cast("long"))
    curve = frames.learning_curve(long, ["run"], "epoch", ["row"])
    return frames.root_metrics(curve).select("run", "metric", "epoch", F.round("value", 3).alias("value"))


@query("SELECT '/pool/s' || (o_custkey % 20) || '.xyz' AS source_file, count(*) AS frames, count(DISTINCT o_orderpriority) AS directories FROM orders GROUP BY 1")
def provenance_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows of provenance tables whose header lines are repeated."""
    rows = table(spark, d, "orders").select(say("/pool/s%d.xyz", F.col("o_custkey") % 20).alias("source_file"), F.col("o_orderpriority").alias("directory"))
    again = spark.range(7).select(F.lit("source_file").alias("source_file"), F.lit("directory").alias("directory"))
    path = scratch(spark, "provenance")
    sinks.write_report(rows.unionByName(again), path, "csv")
    return frames.provenance_counts(settings.provenance(spark, path), "source_file", "directory")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 12345 ELSE c_custkey % 100 END::BIGINT AS seed, CASE WHEN c_custkey % 2 = 0 THEN '/d/a' ELSE '/d/b' END || c_custkey || '.xyz' AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 0.95 END AS train FROM customer")
def training_config_scan(spark: SparkSession, d: str) -> DataFrame:
    """Seed, data set and split of a training configuration, from either of two keys."""
    k = F.col("c_custkey")
    body = F.concat_ws("\n", F.lit("run:"), F.when(k % 3 != 0, say("  seed: %d  # fixed", k % 100)), F.when(k % 2 == 0, say("  split_dataset: /d/a%d.xyz\n  file_path: /other\n  train_val_split: [0.95, 0.05]", k)).otherwise(say("  file_path: /d/b%d.xyz", k)))
    out = settings.training_config(table(spark, d, "customer").select(say("/y/%d/train.yaml", k).alias("path"), body.alias("text")))
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("c_custkey"), F.col("seed").cast("long").alias("seed"), "dataset", F.get("shares", F.lit(0)).alias("train"))


@query("SELECT o_orderkey AS id, ['RUNNING', 'PENDING', 'COMPLETED'][o_orderkey % 3 + 1] AS state, '/data/c' || (o_custkey % 30) || '/r' || o_orderkey AS workdir FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 > 0 AND o_custkey % 30 IN (1, 2)")
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A queue listing, its short rows and headers left out; jobs in given states below given folders, whole parts compared."""
    k = F.col("o_orderkey")
    state = F.element_at(F.array(F.lit("RUNNING"), F.lit("PENDING"), F.lit("COMPLETED")), (k % 3 + 1).cast("int"))
    line = F.when(k % 10 == 0, say("%d|RUNNING|short", k)).otherwise(F.concat(say("%d|", k), state, say("|job|None|1:00|/data/c%d/r%d", F.col("o_custkey") % 30, k)))
    per = table(spark, d, "orders").groupBy(F.floor(k / 100).alias("part")).agg(F.concat_ws("\n", F.lit("JOBID|STATE|NAME|REASON|TIME|DIR"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    jobs = frames.active_jobs(settings.scheduler(per), "state", "workdir", ["/data/c1", "/data/c2/"])
    return jobs.select(F.col("id").cast("long").alias("id"), "state", "workdir")


@query("SELECT event_id::DOUBLE AS t, round(value, 6) AS msd FROM events")
def numeric_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A numeric log with its header in each part, read again as two columns."""
    path = scratch(spark, "log")
    sinks.write_table(table(spark, d, "events"), path, ["event_id", "value"], "t msd", order=["event_id"])
    return settings.two_columns(ranges.file_ranges(spark, path, "part-*", range_bytes=1 << 16)).select("t", F.round("msd", 6).alias("msd"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_size * 100 ELSE -1 END AS width, CASE WHEN p_partkey % 11 > 0 THEN (p_partkey % 500 + 1)::INT ELSE -1 END AS height, p_partkey % 11 > 0 AND p_partkey % 3 = 0 AS alpha FROM part")
def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """Size and transparency from the first bytes of an image; what is no image has none."""
    eight = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    content = F.concat(F.when(F.col("p_partkey") % 11 == 0, F.lit("00504E470D0A1A0A")).otherwise(F.lit("89504E470D0A1A0A")), F.lit("0000000D49484452"), eight(F.col("p_size") * 100), eight(F.col("p_partkey") % 500 + 1), F.lit("08"), F.when(F.col("p_partkey") % 3 == 0, "06").otherwise("02"))
    out = settings.png_headers(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.unhex(content).alias("content")))
    return out.select(F.col("path").cast("long").alias("p_partkey"), F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("height", F.lit(-1)).alias("height"), F.coalesce("alpha", F.lit(False)).alias("alpha"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'undecidable' WHEN c_custkey % 7 = 1 OR c_custkey % 7 = 2 OR c_custkey % 7 = 3 THEN 'false' ELSE 'true' END AS converged FROM customer")
def convergence_scan(spark: SparkSession, d: str) -> DataFrame:
    """Convergence of a run from its three files: failure texts, a missing energy, and as many iterations as allowed."""
    k = F.col("k")
    c = table(spark, d, "customer").select(say("/c/run%d/x", F.col("c_custkey")).alias("path"), (F.col("c_custkey") % 7).alias("k"))
    outcars = c.select("path", F.when(k == 1, F.lit(" BRMIX: very serious problems")).otherwise(F.lit("fine")).alias("text"))
    many = F.when(k == 2, 40).otherwise(3)
    steps = F.array_join(F.transform(F.sequence(F.lit(1), many), lambda n: say("DAV: %d -0.1", n)), "\n")
    oszicars = c.select("path", F.when(k == 6, F.lit("nothing")).when(k == 3, steps).otherwise(F.concat(steps, F.lit("\n   1 F= -1.0 E0= -1.5"))).alias("text"))
    incars = c.select("path", F.when(k == 5, F.lit("ISMEAR = 0")).otherwise(F.lit("NELM = 40")).alias("text"))
    out = settings.convergence(outcars, oszicars, incars, text.parent_dir(F.col("path")))
    return out.select(F.regexp_extract("run", r"run(\d+)$", 1).cast("long").alias("c_custkey"), F.coalesce(F.col("converged").cast("string"), F.lit("undecidable")).alias("converged"))


# --- structures ---------------------------------------------------------------------------------------------------

def species(flag: Column) -> Column:
    return F.when(flag == "A", "K").when(flag == "N", "Mn").otherwise("O")


def order_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its atoms, grouped by species: key, symbols and counts of species, kinds and coordinates of atoms."""
    atom = F.struct(species(F.col("l_returnflag")).alias("s"), "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_quantity") / 100, 6).alias("x"), F.round(F.col("l_discount"), 6).alias("y"), F.round(F.col("l_tax"), 6).alias("z"))
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(atom)).alias("a"))
    symbols = F.array_distinct("a.s")
    per = per.withColumn("symbols", symbols).withColumn("coords", F.transform("a", lambda r: F.array(r["x"], r["y"], r["z"])))
    per = per.withColumn("kinds", F.transform("a", lambda r: F.array_position("symbols", r["s"]).cast("int"))).withColumn("names", F.col("a.s"))
    return per.withColumn("counts", F.transform("symbols", lambda s: F.size(F.filter("names", lambda n: n == s)))).drop("a")


CELL = [10.0, 0.0, 0.0, 0.0, 11.0, 0.0, 0.0, 0.0, 12.0]
SPECIES = "CASE l_returnflag WHEN 'A' THEN 'K' WHEN 'N' THEN 'Mn' ELSE 'O' END"
PER_SPECIES = f"SELECT l_orderkey AS key, {SPECIES} AS symbol, count(*) AS n, round(sum(round(l_quantity / 100, 6)), 5) AS x, round(sum(round(l_tax, 6)), 5) AS z FROM lineitem GROUP BY 1, 2"


def cell() -> Column:
    return F.array(*map(F.lit, CELL))


def per_species(s: DataFrame, key: Column, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """key, symbol, n and sums of two coordinates of structures."""
    s = s.withColumn("names", F.flatten(F.zip_with("symbols", "counts", lambda a, n: F.array_repeat(a, n))))
    rows = s.select(key.alias("key"), F.explode(F.arrays_zip("names", "coords")).alias("r"))
    return rows.groupBy("key", F.col("r.names").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("r.coords")[0]) / scale[0], 5).alias("x"), F.round(F.sum(F.col("r.coords")[2]) / scale[1], 5).alias("z"))


@query(PER_SPECIES)
def poscar_scan(spark: SparkSession, d: str) -> DataFrame:
    """Structures that the writer makes, read again."""
    a = order_atoms(spark, d)
    s = files.structures_of(a.select(say("/s/%d/POSCAR", F.col("key")).alias("path"), sinks.poscar_text(say("order %d", F.col("key")), cell(), F.col("symbols"), F.col("counts"), F.col("coords")).alias("text")))
    return per_species(s, F.regexp_extract("comment", r"(\d+)", 1).cast("long"))


@query("SELECT p_partkey // 40 AS file, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS part, p_partkey, round(pow(p_size + 1.0, 3), 3) AS volume, 1 AS n_atoms FROM part")
def concatenated_structure_scan(spark: SparkSession, d: str) -> DataFrame:
    """Structures one after the other in a file, with vectors that wrap over lines, volumes for scales and velocities."""
    size, k = F.col("p_size") + 1.0, F.col("p_partkey")
    rows = F.when(k % 3 == 0, say("%.6f 0.0\n0.0 0.0 %.6f 0.0 0.0\n0.0 %.6f", size, size, size)).otherwise(say("%.6f 0.0 0.0\n0.0 %.6f 0.0\n0.0 0.0 %.6f", size, size, size))
    scaled = F.when(k % 3 == 1, F.concat(say("%.6f", -F.pow(size, F.lit(3.0))), F.lit("\n2.0 0.0 0.0\n0.0 2.0 0.0\n0.0 0.0 2.0"))).otherwise(F.concat(F.lit("1.0\n"), rows))
    one = F.concat(say("part %d\n", k), scaled, F.lit("\nMn\n1\nDirect\n0.1 0.2 0.3\n"), F.when(k % 2 == 0, "\n0.0 0.0 0.1\n").otherwise(""))
    per = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 40).cast("string").alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("t")))).alias("r"))
    s = files.structures_of(per.select(F.col("file").alias("path"), F.array_join("r.t", "").alias("text")))
    from ..functions.geometry import volume

    return s.select(F.col("path").cast("long").alias("file"), F.col("part").cast("long").alias("part"), F.regexp_extract("comment", r"(\d+)", 1).cast("long").alias("p_partkey"), F.round(volume(F.col("cell")), 3).alias("volume"), "n_atoms")


@query(PER_SPECIES)
def lammps_data_scan(spark: SparkSession, d: str) -> DataFrame:
    """Data files that the writer makes, read again; types are named by a comment or by their mass."""
    masses = F.transform("symbols", lambda s: F.when(s == "K", 39.0983).when(s == "Mn", 54.938).otherwise(15.999))
    a = order_atoms(spark, d).withColumn("masses", masses)
    body = sinks.lammps_data_text(say("order %d", F.col("key")), cell(), F.col("kinds"), F.col("symbols"), F.col("masses"), F.col("coords"))
    body = F.when(F.col("key") % 2 == 0, F.regexp_replace(body, r"(?m)^(\d+ [\d.]+) # [A-Z][a-z]?$", "$1")).otherwise(body)
    s = files.structures_of(a.select(F.lit("x.data").alias("path"), body.alias("text")), "lammps_data")
    return per_species(s, F.regexp_extract("comment", r"(\d+)", 1).cast("long"))


@query("""WITH s AS (SELECT s_suppkey, round(s_acctbal) / 100 AS z FROM supplier)
SELECT s_suppkey, 'log' AS kind, 2 AS n_atoms, 'OH' AS formula, z FROM s UNION ALL SELECT s_suppkey, 'log', 2, 'OH', z + 1 FROM s WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'archive', 2, 'OH', z FROM s WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 'input', 2, 'OH', z FROM s WHERE s_suppkey % 5 > 0""")
def molecule_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orientation tables and archives of logs, and inputs; charged archives and ghost centres are refused."""
    k, z = F.col("s_suppkey"), F.round("s_acctbal") / 100
    s = table(spark, d, "supplier").withColumn("path", k.cast("string"))
    bar = "-" * 30
    orientation = lambda v: say(f" Standard orientation:\n {bar}\n Center Atomic Type X Y Z\n {bar}\n 1 8 0 0.0 0.0 0.0\n 2 1 0 0.5 0.0 %.4f\n {bar}\n", v)
    log = s.select("path", F.concat(orientation(z), F.when(k % 2 == 0, orientation(z + 1)).otherwise("")).alias("text"))
    archive = s.select("path", F.concat(F.lit(" 1\\1\\GINC\\SP\\RHF\\"), F.when(k % 3 == 0, "\\title\\\\1,1\\").otherwise("\\title\\\\0,1\\"), say("O,0.,0.,0.\\\n H,0.5,0.,%.4f\\\\Ver\n sion=ES64\\@\n", z)).alias("text"))
    inputs = s.select("path", F.concat(F.lit("# hf\n\ntitle\n\n0 1\nO 0.0 0.0 0.0\n"), F.when(k % 5 == 0, "Bq").otherwise("H"), say(" 0.5 0.0 %.4f\n\n", z)).alias("text"))
    out = None
    for name, rows, grammar in (("log", log, "gaussian_log"), ("archive", archive, "gaussian_archive"), ("input", inputs, "gaussian_input")):
        one = files.structures_of(rows, grammar).select(F.col("path").cast("long").alias("s_suppkey"), F.lit(name).alias("kind"), "n_atoms", rules.formula(F.col("symbols"), F.col("counts")).alias("formula"), F.round(F.col("coords")[1][2], 4).alias("z"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT l_orderkey AS key, {SPECIES} AS symbol, count(*) AS n FROM lineitem GROUP BY 1, 2")
def element_count_scan(spark: SparkSession, d: str) -> DataFrame:
    """Elements of structure and xyz files; the grammar is told from the name, the ending or the first line."""
    a = order_atoms(spark, d)
    k = F.col("key") % 4
    name = F.when(k == 0, "POSCAR").when(k == 1, "a.vasp").when(k == 2, "b.xyz").otherwise("c.dat")
    body = F.when(k < 2, sinks.poscar_text(F.lit("x"), cell(), F.col("symbols"), F.col("counts"), F.col("coords"))).otherwise(sinks.extxyz_text(F.col("names"), F.col("coords"), cell()))
    out = files.count_elements(a.select(F.concat(say("/e/%d/", F.col("key")), name).alias("path"), body.alias("text")))
    return out.select(F.regexp_extract("path", r"/e/(\d+)/", 1).cast("long").alias("key"), "symbol", "n")


# --- trajectories -------------------------------------------------------------------------------------------------


def written(spark: SparkSession, rows: DataFrame, body: Column, name: str, by: list[str] | None = None) -> str:
    path = scratch(spark, name)
    sinks.write_text(rows, body, path, by)
    return path


def xyz_path(spark: SparkSession, d: str) -> str:
    """Frames of all orders as extended xyz, with the order, its customer and its energy in the comment."""
    a = order_atoms(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice"), "key")
    info = F.create_map(F.lit("energy"), say("%.4f", F.col("o_totalprice")), F.lit("frame"), F.col("key").cast("string"), F.lit("run_id"), say("c%d", F.col("o_custkey")), F.lit("note"), F.lit("two words"))
    return written(spark, a, sinks.extxyz_text(F.col("names"), F.col("coords"), cell(), info), "xyz")


@query(f"SELECT l_orderkey AS key, {SPECIES} AS symbol, count(*) AS n, round(sum(round(l_quantity / 100, 6)), 5) AS x, round(any_value(o_totalprice), 4) AS energy FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def extxyz_scan(spark: SparkSession, d: str, read: Callable = files.read_trajectories) -> DataFrame:
    """Frames that the writer makes, scanned by the data source: atoms, energies and keys."""
    f = read(spark, xyz_path(spark, d), "extxyz")
    rows = f.select(F.col("info")["frame"].cast("long").alias("key"), "energy", F.explode("atoms").alias("a"))
    return rows.groupBy("key", F.col("a.symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("a.pos")[0]), 5).alias("x"), F.round(F.first("energy"), 4).alias("energy"))


@query("SELECT 'c' || o_custkey AS run_id, count(*) AS frames FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def comment_scan(spark: SparkSession, d: str, read: Callable = files.read_trajectories) -> DataFrame:
    """Frames of each run from the comment lines alone."""
    f = read(spark, xyz_path(spark, d), "extxyz", atoms=False)
    return frames.frames_by_run(f).groupBy("run_id").agg(F.sum("frames").alias("frames"))


@query("SELECT l_orderkey AS key, 'fractional' AS coord_space, count(*) + 2 AS raw_lines, 'two words' AS note, 1 AS pos_column FROM lineitem GROUP BY 1")
def raw_block_scan(spark: SparkSession, d: str, read: Callable = files.read_trajectories) -> DataFrame:
    """Fractional frames with their text as it was, and the place of a property in the header."""
    f = read(spark, xyz_path(spark, d), "extxyz", coords="fractional", raw=True)
    comment = F.get(F.split("raw", "\n"), F.lit(1))
    lines = F.size(F.filter(F.split("raw", "\n"), lambda x: x != "")).cast("long")
    return f.select(text.header_value(comment, "frame").cast("long").alias("key"), "coord_space", lines.alias("raw_lines"), text.header_value(comment, "note").alias("note"), text.property_offset(text.header_value(comment, "Properties"), "pos").alias("pos_column"))


def run_steps(spark: SparkSession, d: str, line: Column, head: str, name: str) -> str:
    """A file of each run, in a folder of its own."""
    rows = run_files(spark, d, name, line, head).select(run_of(), "text")
    return written(spark, rows, F.col("text"), name.lower(), ["user_id"])


XDATCAR_HEAD = "run\n1.0\n 4.0 0.0 0.0\n 0.0 4.0 0.0\n 0.0 0.0 4.0\n K O\n 1 1\n"


@query(f"SELECT user_id, i AS frame_index, 'fractional' AS coord_space, round(value / 1000, 6) AS x, CASE WHEN i >= 20 THEN 5.0 ELSE 4.0 END::DOUBLE AS a, 'K,O' AS symbols FROM {RUNS} WHERE i % 7 <> 3")
def xdatcar_scan(spark: SparkSession, d: str, read: Callable = files.read_trajectories) -> DataFrame:
    """Fractional frames; a new header changes the cell, a frame with a bad coordinate is left out and keeps its place."""
    i = F.col("i")
    head = F.when(i == 20, F.lit(XDATCAR_HEAD.replace("4.0", "5.0")[:-1]))
    line = F.concat_ws("\n", head, say("Direct configuration=%6d", i + 1), F.when(i % 7 == 3, F.lit("0.1 bad 0.1")).otherwise(say("%.6f 0.1\0 0.2", F.col("value") / 1000)), F.lit("0.5 0.5 0.5"))
    f = read(spark, run_steps(spark, d, line, XDATCAR_HEAD, "XDATCAR"), "xdatcar")
    return f.select(user_of(), "frame_index", "coord_space", F.round(F.col("atoms")[0]["pos"][0], 6).alias("x"), F.col("cell")[0].alias("a"), F.array_join("atoms.symbol", ",").alias("symbols"))


@query(f"SELECT user_id, i AS frame_index, round(value / 1000, 6) AS x FROM {RUNS} WHERE i >= 10 AND i < 25 AND i % 7 <> 3 AND i IN (11, 12, 24, 30)")
def random_access_frames(spark: SparkSession, d: str) -> DataFrame:
    """Single frames of a range, each read from its own place in the file by an index of offsets."""
    i = F.col("i")
    line = F.concat_ws("\n", say("Direct configuration=%6d", i + 1), F.when(i % 7 == 3, F.lit("0.1 bad 0.1")).otherwise(say("%.6f 0.1 0.2", F.col("value") / 1000)), F.lit("0.5 0.5 0.5"))
    index = frame_index.frame_index(spark, run_steps(spark, d, line, XDATCAR_HEAD, "XDATCAR"), "xdatcar", range_bytes=2048)
    f = frame_index.indexed_frames(index, "xdatcar", (F.col("frame_index") >= 10) & (F.col("frame_index") < 25) & F.col("frame_index").isin(11, 12, 24, 30), range_bytes=512)
    return f.select(user_of(), "frame_index", F.round(F.col("atoms")[0]["pos"][0], 6).alias("x"))


OUTCAR_HEAD = " TITEL  = PAW_PBE Mn_pv 02Aug2007\n TITEL  = PAW_PBE O 08Apr2002\n   ions per type =               1   1\n      direct lattice vectors                 reciprocal lattice vectors\n     4.0 0.0 0.0     0.25 0.0 0.0\n     0.0 4.0 0.0     0.0 0.25 0.0\n     0.0 0.0 4.0     0.0 0.0 0.25\n"


@query(f"SELECT user_id, i AS frame_index, k AS idx, ['Mn', 'O'][k + 1] AS symbol, round(CASE WHEN k = 0 THEN value / 100 ELSE 2.0 END, 6) AS x, round(CASE WHEN k = 0 THEN abs(value) ELSE 5.0 END, 4) AS force FROM {RUNS}, (SELECT unnest([0, 1]) AS k) WHERE i % 9 <> 8")
def outcar_frame_scan(spark: SparkSession, d: str, read: Callable = files.read_trajectories) -> DataFrame:
    """Positions and forces of every ionic step; a step that breaks off is left out."""
    v = F.col("value")
    line = F.concat(F.lit(" POSITION          TOTAL-FORCE (eV/Angst)\n ------\n"), say(" %.6f 0.0 0.0  %.4f 0.0 0.0\n", v / 100, v), F.when(F.col("i") % 9 == 8, " 2.0 2.0 ***").otherwise(" 2.0 2.0 2.0  0.0 3.0 4.0"), F.lit("\n ------"))
    f = read(spark, run_steps(spark, d, line, OUTCAR_HEAD, "OUTCAR"), "outcar")
    a = files.atoms_of(f)
    return a.select(user_of(), "frame_index", "idx", "symbol", F.round(F.col("pos")[0], 6).alias("x"), F.round(frames.largest_force(F.array("force")), 4).alias("force"))


@query(f"SELECT user_id, i AS frame_index, (i * 100)::VARCHAR AS step, round(value / 100, 6) AS x, 'X1,Mn' AS symbols, 3.0::DOUBLE AS a FROM {RUNS}")
def dump_scan(spark: SparkSession, d: str, read: Callable = files.read_trajectories) -> DataFrame:
    """Frames of a text dump, atoms by their ids, positions from the box's corner; a type without an element is named by its number."""
    i, v = F.col("i"), F.col("value")
    line = F.concat(say("ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n1.0 4.0\n0.0 5.0\n0.0 6.0\n", i * 100), say("ITEM: ATOMS id type element x y z\n2 2 Mn 2.0 1.0 1.0\n1 1 %s %.6f 0.0 0.0", F.lit(""), v / 100 + 1))
    line = F.regexp_replace(line, "ITEM: ATOMS id type element x y z\n2 2 Mn (.*)\n1 1  ", "ITEM: ATOMS id type x y z\n2 2 $1\n1 1 ")
    rows = run_files(spark, d, "dump.lammpstrj", line).select(run_of(), "text")
    path = written(spark, rows, F.col("text"), "dump", ["user_id"])
    f = read(spark, path, "lammpstrj")
    kinds = spark.createDataFrame([("X2", "Mn")], "kind string, symbol string")
    a = match.with_symbols(f.select(user_of(), "frame_index", F.col("info")["step"].alias("step"), F.col("cell")[0].alias("a"), F.explode("atoms").alias("r")).select("user_id", "frame_index", "step", "a", F.col("r.idx").alias("idx"), F.col("r.pos")[0].alias("x"), F.col("r.symbol").alias("kind")), kinds, "kind", "symbol", inferred="kind")
    return a.groupBy("user_id", "frame_index", "step", "a").agg(F.round(F.min_by("x", "idx"), 6).alias("x"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "symbol"))), lambda e: e["symbol"]), ",").alias("symbols"))


def in_ranges(spark: SparkSession, path: str, grammar: str, **options) -> DataFrame:
    """The frames by ranges of bytes; they are small, so that files have several."""
    return frame_index.read_split(spark, path, grammar, range_bytes=8192, **options)


def split_scan(scan: Callable) -> None:
    """The query of a scan once more, with files read in ranges."""

    def split(spark: SparkSession, d: str) -> DataFrame:
        return scan(spark, d, in_ranges)

    split.__name__, split.__doc__ = f"split_{scan.__name__}", f"{scan.__doc__} Each file is read by several tasks."
    query(SQL[scan.__name__])(split)


for _scan in (extxyz_scan, comment_scan, raw_block_scan, xdatcar_scan, outcar_frame_scan, dump_scan):
    split_scan(_scan)


@query("""WITH a AS (SELECT l_orderkey AS key, row_number() OVER () AS i, round(l_quantity / 100, 6) AS x, round(l_discount, 6) AS y, round(l_tax, 6) AS z FROM lineitem),
p AS (SELECT a.key, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM a JOIN a b ON a.key = b.key AND a.i < b.i),
n AS (SELECT key, count(*) AS n FROM a GROUP BY 1)
SELECT key, floor(d / 0.5 * 10)::BIGINT AS bin, round(count(*) / any_value(n), 6) AS share FROM p JOIN n USING (key) WHERE d < 0.5 AND abs(d * 20 - round(d * 20)) > 1e-6 GROUP BY 1, 2""")
def frame_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """2.10, T05: distances in every frame, by the descriptor that is registered under that name; distances on the edge of a bin are left out."""
    a = order_atoms(spark, d)
    atom = F.transform(F.arrays_zip("names", "coords"), lambda r: F.struct(r["names"].alias("symbol"), r["coords"].alias("pos")))
    f = a.select(F.lit("p").alias("path"), F.col("key").alias("frame_index"), cell().alias("cell"), F.lit("cartesian").alias("coord_space"), atom.alias("atoms"))
    rows = descriptors.described(f, "inner_distances", cutoff=0.5, bins=10).select(F.col("frame_index").alias("key"), F.posexplode("vector").alias("bin", "share"))
    return rows.where("share > 0").select("key", F.col("bin").cast("long").alias("bin"), F.round("share", 6).alias("share"))


@descriptors.register("inner_distances")
def inner_distances(cutoff: float, bins: int) -> descriptors.Descriptor:
    """Pairs of atoms by their distance, for each atom, without those whose distance can't be told from the edge of a bin."""
    import numpy as np

    def describe(symbols: list[str], positions: np.ndarray, cell: np.ndarray | None) -> np.ndarray:
        total = np.zeros(bins)
        for i in range(len(positions) - 1):
            place = np.sqrt(((positions[i + 1 :] - positions[i]) ** 2).sum(axis=1)) / cutoff * bins
            place = place[(place < bins) & (np.abs(place - np.round(place)) > 1e-6)]
            total += np.bincount(place.astype(np.int64), minlength=bins)
        return total / max(len(positions), 1)

    return describe


# --- discovery ----------------------------------------------------------------------------------------------------


def listed(spark: SparkSession, d: str) -> DataFrame:
    """A listing: each order's folder below its customer's, with files by kind."""
    k = F.col("o_orderkey")
    folder = say("/home/u/c%d/%dK/r%d", F.col("o_custkey") % 50, F.col("o_custkey") % 7 * 100, k)
    names = F.array(F.lit("OUTCAR"), F.lit("POSCAR"), F.when(k % 2 == 0, "CONTCAR").otherwise("CONTCAR_old"), F.when(k % 3 == 0, "traj.xyz").when(k % 3 == 1, "dump.lammpstrj").otherwise("XDATCAR"), F.lit("run10.extxyz"), F.lit("run9_test.extxyz"))
    rows = table(spark, d, "orders").select("o_orderkey", folder.alias("dir"), F.explode(names).alias("name"))
    extra = spark.range(50).select(F.lit(-1).cast("long").alias("o_orderkey"), say("/home/u/c%d", F.col("id")).alias("dir"), F.lit("OUTCAR").alias("name"))
    rows = rows.unionByName(extra)
    return rows.withColumn("path", F.concat_ws("/", "dir", "name")).withColumn("size", F.when((F.col("name") == "CONTCAR") & (k % 4 == 0), 0).otherwise(10).cast("long"))


@query("SELECT '/home/u/c' || (o_custkey % 50) || '/' || (o_custkey % 7 * 100) || 'K/r' || o_orderkey AS dir FROM orders UNION ALL SELECT '/home/u/c' || c FROM (SELECT unnest(range(50)) AS c) WHERE c NOT IN (SELECT o_custkey % 50 FROM orders)")
def leaf_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run folders below which there is no other."""
    return catalog.leaf_dirs(listed(spark, d), F.col("name") == "OUTCAR").select("dir")


@query("SELECT '~/c' || (o_custkey % 50) || '/' || (o_custkey % 7 * 100) || 'K/r' || o_orderkey AS run_id, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT '~/c' || c, 1 FROM (SELECT unnest(range(50)) AS c)")
def discovered_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run of every log, its home folder shortened; paths listed twice are one."""
    logs = listed(spark, d).where("name = 'OUTCAR'")
    return catalog.run_ids(logs.unionByName(logs), "/home/u/").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'traj.xyz' WHEN 1 THEN 'dump.lammpstrj' ELSE 'run10.extxyz' END AS name FROM orders")
def chosen_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """One trajectory a folder by the precedence of patterns, test files last."""
    out = match.choose_file(listed(spark, d).where("o_orderkey >= 0"), "dir", "name", [r"^traj\.xyz$", r"\.lammpstrj$", r"\.extxyz$"], avoid="test")
    return out.select("o_orderkey", "name")


@query("SELECT o_orderkey, 1 + (o_orderkey % 4 <> 0)::BIGINT AS files FROM orders")
def structure_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Structure files; an empty CONTCAR is none."""
    return catalog.structure_files(listed(spark, d)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_brand AS compound, s AS vol_pct, '/eos/' || p_brand || '/V_' || printf('%+.1f', s) || '%/' || last || '/OUTCAR' AS path FROM (SELECT p_brand, ((p_size - 25) * 0.5)::DOUBLE AS s, max(lpad(p_partkey::VARCHAR, 8, '0')) AS last FROM part GROUP BY 1, 2)")
def eos_directories(spark: SparkSession, d: str) -> DataFrame:
    """Compound and strain of volume folders; of equal ones the last path counts."""
    strain = (F.col("p_size") - 25) * F.lit(0.5)
    path = F.concat(F.lit("/eos/"), F.col("p_brand"), F.lit("/V_"), say("%+.1f", strain), F.lit("%/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("/OUTCAR"))
    return catalog.eos_dirs(table(spark, d, "part").select(path.alias("path"))).select("compound", F.col("vol_pct"), "path")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'MACE' ELSE 'ALLEGRO' END AS model, round(-o_totalprice, 2) AS energy FROM orders WHERE o_orderkey % 5 <> 0")
def evaluation_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Files whose first frame a model has been evaluated on, by precedence; the energy of that frame."""
    k = F.col("o_orderkey")
    good = F.create_map(F.lit("REF_energy"), say("%.2f", -F.col("o_totalprice")), F.when(F.col("o_custkey") % 3 == 0, "MACE_energy").otherwise("UMA_energy"), F.lit("-1.0"), F.lit("ALLEGRO_energy"), F.lit("-2.0"), F.lit("Properties"), F.concat(F.lit("species:S:1:pos:R:3:REF_forces:R:3:ALLEGRO_forces:R:3:"), F.when(F.col("o_custkey") % 3 == 0, "MACE_forces:R:3").otherwise("UMA_stress:R:9")))
    bare = F.create_map(F.lit("energy"), F.lit("1.0"))
    f = table(spark, d, "orders").select(k.cast("string").alias("path"), F.explode(F.array(F.struct(F.lit(0).alias("frame_index"), F.when(k % 5 == 0, bare).otherwise(good).alias("info")), F.struct(F.lit(1).alias("frame_index"), bare.alias("info")))).alias("f")).select("path", "f.*")
    energies = f.where("frame_index = 0").select("path", frames.frame_energy(F.lit(0.0), F.lit(False), F.col("info"), "REF_energy").alias("energy"))
    return frames.evaluation_files(f, ["MACE", "ALLEGRO"]).join(energies, "path").select(F.col("path").cast("long").alias("o_orderkey"), "model", F.round("energy", 2).alias("energy"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'LAMMPS' ELSE 'VASP' END AS engine, (o_custkey % 7 * 100)::DOUBLE AS loose, (o_custkey % 7 * 100)::DOUBLE AS strict FROM orders")
def engine_and_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The engine of a folder from its files, and its temperature from the path."""
    per = listed(spark, d).where("o_orderkey >= 0 AND name <> 'OUTCAR'").groupBy("o_orderkey", "dir").agg(F.collect_list("name").alias("names"))
    return per.select("o_orderkey", F.coalesce(rules.engine(F.col("names")), F.lit("none")).alias("engine"), text.path_temperature(F.col("dir")).alias("loose"), text.strict_path_temperature(F.col("dir")).alias("strict"))


@query("SELECT r_regionkey::BIGINT AS temperature, min(n_nationkey) FILTER (n_nationkey % 2 = 0) AS vasp, min(n_nationkey) FILTER (n_nationkey % 2 = 1) AS lammps FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def engine_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two engines at one temperature side by side."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("temperature"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "VASP").otherwise("LAMMPS").alias("engine"))
    return match.engine_pairs(n, ["temperature"], "engine", ["n_nationkey"]).select("temperature", F.col("vasp.n_nationkey").alias("vasp"), F.col("lammps.n_nationkey").alias("lammps"))


# --- writers, names and rules -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A = 1' || chr(10) || 'NELECT = ' || o_custkey || chr(10) ELSE 'A = 1' || chr(10) || 'nothing' || chr(10) || 'NELECT = ' || o_custkey || chr(10) END AS upserted,
CASE WHEN o_orderkey % 2 = 0 THEN 'A = 1' || chr(10) || 'NELECT = $x' || chr(10) ELSE 'A = 1' || chr(10) || 'nothing' || chr(10) END AS rewritten, CASE WHEN o_orderkey % 2 = 0 THEN 'MAGMOM' ELSE 'NELECT,MAGMOM' END AS missing, 'NPAR: wanted 4, found nothing' AS wrong FROM orders""")
def edited_settings(spark: SparkSession, d: str) -> DataFrame:
    """A key set or appended, rewritten only where it is, keys that are missing, and required values that differ."""
    body = F.when(F.col("o_orderkey") % 2 == 0, F.lit("A = 1\nnelect = 0 ! old\n")).otherwise(F.lit("A = 1\nnothing\n"))
    wrong = rules.violations(settings.incar_map(body), {"A": "1", "NPAR": "4"})
    return table(spark, d, "orders").select("o_orderkey", sinks.upsert(body, "NELECT", F.col("o_custkey").cast("string")).alias("upserted"), sinks.rewrite(body, "NELECT", F.lit("$x")).alias("rewritten"), F.array_join(sinks.missing_keys(body, ["A", "NELECT", "MAGMOM"]), ",").alias("missing"), F.array_join(wrong, ";").alias("wrong"))


@query("SELECT p_partkey, p_name || CASE WHEN r = 0 THEN '' ELSE '_' || r END AS free_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)")
def free_names(spark: SparkSession, d: str) -> DataFrame:
    """Names for copies without collisions."""
    return sinks.free_names(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "free_name")


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A report as JSON lines, read again."""
    path = scratch(spark, "report")
    sinks.write_report(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return spark.read.schema("p_partkey long, p_name string, p_size long, p_retailprice double").json(path)


@query("SELECT o_orderkey, rank, o_totalprice FROM (SELECT o_orderkey, o_totalprice, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders) WHERE rank < 40")
def ranked_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of a selection with their rank in it, in canonical order before they are ranked (a top-k selection)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    picks = errors.worst(select.canonical(o, "o_orderkey", "o_totalprice"), "o_totalprice", 40, ["o_orderkey"])
    ranks = series.with_ordinal(picks.withColumn("all", F.lit(1)), ["all"], [F.col("o_totalprice").desc(), "o_orderkey"], "rank")
    return match.ranked_frames(o, ranks, ["o_orderkey"]).select("o_orderkey", F.col("rank").cast("long").alias("rank"), "o_totalprice")


@query("SELECT l_orderkey, string_agg(n || '*' || CASE WHEN l_returnflag = 'A' THEN '0.0' WHEN l_returnflag = 'N' THEN '5.0' ELSE '0.0' END, ' ' ORDER BY l_returnflag) AS magmom FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def magnetic_moments(spark: SparkSession, d: str) -> DataFrame:
    """moments of the species in order; one without a moment has none."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    m = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 5.0)
    per = c.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "n", m.alias("m")))).alias("s"))
    return per.select("l_orderkey", rules.magmom(F.col("s.n"), F.col("s.m")).alias("magmom"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'bulk' WHEN contains(lower(p_name), 'ring') THEN 'loop' WHEN contains(lower(p_name), 'bolt') THEN 'rod' ELSE 'unknown' END AS kind FROM part")
def structure_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The declared kind, else that of a part of the name."""
    kind = rules.structure_kind(F.when(F.col("p_size") % 3 == 0, "bulk").when(F.col("p_size") % 3 == 1, ""), F.upper("p_name"), [("ring", "loop"), ("bolt", "rod")])
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey % 1000, p_partkey) AS place FROM part")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Names whose runs of digits compare as numbers."""
    name = say("V%d/run_%d", F.col("p_size"), F.col("p_partkey") % 1000)
    rows = table(spark, d, "part").select("p_partkey", text.natural_key(name).alias("k"))
    return series.placed(rows, ["k", "p_partkey"], "i").select("p_partkey", (F.col("i") + 1).alias("place"))


@query("SELECT s_suppkey, ['Mn', 'O', 'Li', 'none'][s_suppkey % 4 + 1] AS symbol FROM supplier")
def normal_symbols(spark: SparkSession, d: str) -> DataFrame:
    """labels of potentials to symbols."""
    label = F.element_at(F.array(F.lit(" mn_pv"), F.lit("O"), F.lit("LI_sv_GW"), F.lit("_x")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(text.normal_symbol(label), F.lit("none")).alias("symbol"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY 1 HAVING count(*) <= 4")
def small_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames with few atoms whose file name has none of the stated parts."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    f = f.withColumn("path", F.when(F.col("l_orderkey") % 4 == 1, "/a/x_test.xyz").otherwise("/a_test/x.xyz"))
    return frames.atom_limit(f, "n", 4, "path", ["_test"]).select("l_orderkey", "n")


@query("SELECT DISTINCT s_name || '-' || n_name AS pair FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 3 UNION SELECT DISTINCT n_name || '-' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (3, 4)")
def pair_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels that hold a species, and channels named in either order."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("-", "s_name", "n_name").alias("pair")).distinct()
    r = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("-", "n_name", "r_name").alias("pair")).distinct()
    names = {row.n_nationkey: row for row in n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey IN (3, 4)").collect()}
    return pairs.select_pairs(s, "pair", names[3].n_name).union(pairs.select_pairs(r, "pair", "", [f"{row.r_name}-{row.n_name}" for row in names.values()])).distinct()


@query(f"SELECT user_id, i, value FROM {RUNS} WHERE user_id % 4 <> 1 AND value <= 40")
def masked_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of converged steps; a run whose steps and frames differ in number is left out."""
    r = runs(spark, d)
    steps = frames.step_mask(r.where("user_id % 4 <> 1 OR i > 0").select("user_id", "i", "value", F.when(F.col("user_id") % 2 == 0, 40.000001).alias("nelm")), ["user_id"], "value", "nelm", 40)
    steps = steps.withColumn("ok", F.col("ok") | (F.col("value") == 40))
    return series.mask_frames(r.select("user_id", "i", "value"), steps, ["user_id"], "i", "ok")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON regexp_extract(p_name, '^(\\w+)', 1) = ['small', 'red', 'blue', 'green', 'large'][s_suppkey % 5 + 1]")
def token_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name is one of the tokens of another row's text, as an equi-join."""
    p = table(spark, d, "part").select("p_partkey", F.upper(F.regexp_extract("p_name", r"^(\w+)", 1)).alias("needle"))
    word = F.element_at(F.array(*map(F.lit, ("small", "red", "blue", "green", "large"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("x-"), word, F.lit("_"), word, F.lit(" Yx")).alias("hay"))
    return match.shared_tokens(p, s, "p_partkey", "s_suppkey", "needle", "[a-z]+", "hay")


@query("""SELECT p_partkey, c_custkey FROM (SELECT p_partkey, lower(p_partkey::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END) AS needle FROM part) JOIN (SELECT c_custkey, c_name || '-x' || (c_custkey * 7919) || 'a' || c_nationkey AS hay FROM customer) ON contains(lower(hay), needle)""")
def substring_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id occurs anywhere in another row's text, inside longer tokens too."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.concat(k.cast("string"), F.when(k % 2 == 0, "A").otherwise("")).alias("needle"))
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("-x"), (F.col("c_custkey") * 7919).cast("string"), F.lit("a"), F.col("c_nationkey").cast("string")).alias("hay"))
    return match.containment(p, c, "p_partkey", "c_custkey", "needle", "hay", block_chars=4096)


@query("SELECT event_id, round(json_extract(props, '$.k')::DOUBLE + value, 4) AS total, 9 AS n FROM events")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """F16: lists of numbers in JSON, flat or of rows, marked or not."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    flat = F.concat(F.lit("["), k, say(", %.4f, 0, 0, 0, 0, 0, 0, 0]", F.col("value")))
    rows = F.concat(F.lit("_JSON [["), k, say(", %.4f, 0], [0, 0, 0], [0, 0, 0]]", F.col("value")))
    found = text.json_numbers(F.when(F.col("event_id") % 2 == 0, flat).otherwise(rows))
    return table(spark, d, "events").select("event_id", F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(found).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt((0.1 * 0.1 + l_tax * l_tax + l_discount * l_discount) / 3), 6) AS rmse FROM lineitem")
def array_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors between two arrays of a row."""
    q = F.col("l_quantity")
    ref, pred = F.array(q, q, q), F.array(q + 0.1, q + F.col("l_tax"), q - F.col("l_discount"))
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", errors.array_rmse(ref, pred).alias("rmse")), 6)


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minor = lambda j: determinant([[x for k, x in enumerate(r) if k != j] for r in m[1:]])
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {minor(j)}" for j in range(len(m))) + ")"


POWERS = [[f"s{i + j}" for j in range(4)] for i in range(4)]
#: What a cubic explains of the squares, by the normal equations.
EXPLAINED = " + ".join(f"t{k} * {determinant([[f't{i}' if j == k else POWERS[i][j] for j in range(4)] for i in range(4)])}" for k in range(4))


@query(
    f"""WITH p AS (SELECT p_brand, v, -500.0 + 50.625 * (pow(x - 1, 3) * 4.3 + pow(x - 1, 2) * (6 - 4 * x)) + noise AS e FROM (SELECT p_brand, p_size + 80.0 AS v, pow(100.0 / (p_size + 80.0), 2.0 / 3.0) AS x, (p_partkey * 7919 % 100 - 50) * 0.001 AS noise FROM part)),
x AS (SELECT p_brand, e - avg(e) OVER w AS y, pow(v / avg(v) OVER w, -2.0 / 3.0) AS x FROM p WINDOW w AS (PARTITION BY p_brand)),
z AS (SELECT p_brand, y, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM x WINDOW w AS (PARTITION BY p_brand)),
s AS (SELECT p_brand, count(*) AS n, sum(y * y) AS yy, {", ".join(f"sum(pow(z, {k})) AS s{k}" for k in range(7))}, {", ".join(f"sum(pow(z, {k}) * y) AS t{k}" for k in range(4))} FROM z GROUP BY 1)
SELECT p_brand, n, round(({EXPLAINED}) / {determinant(POWERS)} / yy, 5) AS r2 FROM s WHERE n >= 6"""
)
def eos_fit_quality(spark: SparkSession, d: str) -> DataFrame:
    """What fits of noisy energies per atom explain, against normal equations."""
    atoms = 1 + F.col("p_partkey") % 3
    x = F.pow(100.0 / (F.col("p_size") + 80.0), F.lit(2.0 / 3.0))
    e = -500.0 + 50.625 * (F.pow(x - 1, F.lit(3.0)) * 4.3 + F.pow(x - 1, F.lit(2.0)) * (6 - 4 * x)) + (F.col("p_partkey") * 7919 % 100 - 50) * 0.001
    p = table(spark, d, "part").select("p_brand", ((F.col("p_size") + 80.0) * atoms).alias("v"), (e * atoms).alias("e"), atoms.alias("atoms"))
    fits = eos.fit(eos.per_atom(p, "v", "e", "atoms"), ["p_brand"], "v", "e").where("n >= 6")
    return fits.select("p_brand", "n", F.round("r2", 5).alias("r2"))


@query("SELECT p_brand, n, round(CASE WHEN n >= 4 THEN 100.0 ELSE v END, 2) AS volume, round(CASE WHEN n >= 4 THEN -500.0 ELSE e END, 3) AS energy FROM (SELECT p_brand, count(*) AS n, min_by(v, e) AS v, min(e) AS e FROM (SELECT DISTINCT p_brand, v, -500.0 + 50.625 * (pow(x - 1, 3) * 4.3 + pow(x - 1, 2) * (6 - 4 * x)) AS e FROM (SELECT p_brand, p_size + 80.0 AS v, pow(100.0 / (p_size + 80.0), 2.0 / 3.0) AS x FROM part WHERE p_brand <> 'Brand#1' OR p_size < 4)) GROUP BY 1)")
def optimal_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The fitted volume and energy of an exact curve, or the least point where there are too few."""
    from .queries import eos_points

    points = eos_points(spark, d).where("p_brand <> 'Brand#1' OR v < 84")
    out = eos.optimal_volume(eos.fit(points, ["p_brand"], "v", "e"))
    return out.select("p_brand", "n", F.round("volume", 2).alias("volume"), F.round("energy", 3).alias("energy"))
