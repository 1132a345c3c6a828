"""Named queries of the engine over the supplied tables, each with the SQL that a reference engine can run.

The tables stand in for simulation data: orders are frames (customer: run, price: energy), lineitem rows are atoms (extended
price: reference, discounted price: prediction, return flag: species), events are time series (user: run), embeddings are
descriptors, parts are structures and texts are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, rules, text
from ..operators import eos, errors, fits, frames, match, motion, pairs, select, series, stats
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with ref and pred."""
    return table(spark, d, "lineitem").withColumn("ref", F.col("l_extendedprice")).withColumn("pred", F.col("l_extendedprice") * (1 - F.col("l_discount")))


ATOMS = "(SELECT *, l_extendedprice AS ref, l_extendedprice * (1 - l_discount) AS pred FROM lineitem)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """events with their place in the run."""
    return series.with_ordinal(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "i")


RUNS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


# --- errors -------------------------------------------------------------------------------------------------------


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(abs(pred - ref)), 4) AS mae, round(sqrt(avg((pred - ref) ** 2)), 4) AS rmse FROM {ATOMS} GROUP BY l_returnflag")
def error_stats_partial_final(spark: SparkSession, d: str) -> DataFrame:
    """States by supplier and species, merged to species."""
    states = errors.partial_errors(atoms(spark, d), ["l_suppkey", "l_returnflag"], "ref", "pred")
    return rounded(errors.merge_errors(states, ["l_returnflag"]))


def run_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames with reference and predicted energies and numbers of atoms: an aggregate of atoms joined to their frames."""
    per = atoms(spark, d).groupBy("l_orderkey").agg(F.sum("ref").alias("ref"), F.sum("pred").alias("pred"), F.count(F.lit(1)).alias("n_atoms"))
    frame = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), "o_custkey", F.col("o_orderpriority").alias("dataset"))
    return frame.join(per.withColumnRenamed("l_orderkey", "frame"), "frame")


FRAMES = f"(SELECT o_orderkey AS frame, o_custkey, o_orderpriority AS dataset, ref, pred, n_atoms FROM orders JOIN (SELECT l_orderkey, sum(ref) AS ref, sum(pred) AS pred, count(*) AS n_atoms FROM {ATOMS} GROUP BY 1) ON o_orderkey = l_orderkey)"


@query(
    f"""WITH f AS {FRAMES},
b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(ref / n_atoms, 6), frame) AS r FROM f),
j AS (SELECT f.*, b.ref AS r0, b.pred AS p0, b.n_atoms AS n0 FROM f JOIN b ON f.dataset = b.dataset AND b.r = 1)
SELECT dataset, count(*) AS n, round(sqrt(avg(((pred - p0) - (ref - r0)) ** 2)), 3) AS rmse_energy,
       round(sqrt(avg(((pred / n_atoms - p0 / n0) - (ref / n_atoms - r0 / n0)) ** 2)), 3) AS rmse_energy_per_atom FROM j GROUP BY dataset"""
)
def rmse_relative_energy(spark: SparkSession, d: str) -> DataFrame:
    """RMSE of energies relative to each dataset's frame of least energy per atom."""
    return rounded(errors.relative_energy_errors(run_frames(spark, d), ["dataset"], "ref", "pred", "n_atoms", ["frame"]), 3)


@query(f"SELECT dataset, round(avg(abs(pred - ref)), 3) AS mae, round(sqrt(avg((pred - ref) ** 2)), 3) AS rmse, round(avg(n_atoms), 4) AS mean_atoms, round(avg(abs(pred - ref)) / avg(n_atoms), 3) AS mae_per_atom, round(sqrt(avg((pred - ref) ** 2)) / avg(n_atoms), 3) AS rmse_per_atom FROM {FRAMES} GROUP BY dataset")
def absolute_energy_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors without a base frame, divided by the mean number of atoms."""
    out = errors.absolute_errors(run_frames(spark, d), ["dataset"], "ref", "pred", "n_atoms")
    return out.select("dataset", *[F.round(c, 4 if c == "mean_atoms" else 3).alias(c) for c in ("mae", "rmse", "mean_atoms", "mae_per_atom", "rmse_per_atom")])


@query(f"SELECT l_orderkey, count(*) AS n, round(sqrt(avg((pred - ref) ** 2)), 4) AS rmse FROM {ATOMS} GROUP BY 1")
def frame_force_rmse(spark: SparkSession, d: str) -> DataFrame:
    """A04."""
    return rounded(errors.frame_rmse(atoms(spark, d), ["l_orderkey"], "ref", "pred"))


@query(f"SELECT l_orderkey, n, round(rmse, 4) AS rmse FROM (SELECT l_orderkey, count(*) AS n, sqrt(avg((pred - ref) ** 2)) AS rmse FROM {ATOMS} GROUP BY 1) ORDER BY round(rmse, 4) DESC, l_orderkey LIMIT 25")
def worst_frames(spark: SparkSession, d: str) -> DataFrame:
    """The 25 frames of largest error."""
    return errors.worst(rounded(errors.frame_rmse(atoms(spark, d), ["l_orderkey"], "ref", "pred")), "rmse", 25, ["l_orderkey"])


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(pred - ref)), 4) AS mae, round(sqrt(avg((pred - ref) ** 2)), 4) AS rmse FROM {ATOMS} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def error_by_species_axis(spark: SparkSession, d: str) -> DataFrame:
    """By species and axis, by species, and pooled."""
    return rounded(errors.error_cube(atoms(spark, d), [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "ref", "pred"))


# --- counts, shares, summaries ------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def count_distinct_by_group(spark: SparkSession, d: str) -> DataFrame:
    """A06."""
    return stats.distinct_by(table(spark, d, "orders"), "o_orderstatus", "o_custkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def count_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """A07."""
    return stats.rows_by(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT key, round(sum(v), 2) AS total FROM (SELECT o_orderpriority AS key, o_totalprice AS v FROM orders UNION ALL SELECT event_type, value FROM events) GROUP BY 1")
def sum_for_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Two sources one after the other, summed."""
    a = table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("v"))
    return rounded(stats.summed_order([a, b], "key", "v"), 2)


PART_RULES = [(r"^STANDARD", "standard", "plain"), (r"BRASS$", "metal", "brass"), (r"(STEEL|COPPER)$", "metal", "other"), (r"PLATED", "coated", "plated")]


@query("SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 4) AS percent FROM (SELECT CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'standard' WHEN regexp_matches(p_type, 'BRASS$') THEN 'metal' WHEN regexp_matches(p_type, '(STEEL|COPPER)$') THEN 'metal' WHEN regexp_matches(p_type, 'PLATED') THEN 'coated' ELSE 'Uncategorised' END AS category FROM part) GROUP BY 1")
def category_share(spark: SparkSession, d: str) -> DataFrame:
    """An ordered cascade of patterns, and the share of each category."""
    return rounded(stats.category_shares(table(spark, d, "part"), text.categorise(F.col("p_type"), PART_RULES)[0]))


@query("SELECT l_orderkey, l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 4) AS percent FROM lineitem GROUP BY 1, 2")
def composition_percent(spark: SparkSession, d: str) -> DataFrame:
    """A10: number and percentage of each species in each frame."""
    return rounded(stats.composition(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS value_mean, round(stddev_pop(value), 4) AS value_std FROM events GROUP BY 1")
def thermo_summary(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return rounded(stats.thermo_summary(table(spark, d, "events"), ["event_type"], ["value"]))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def volume_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation."""
    return rounded(stats.volume_statistic(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "mean"))


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def volume_median(spark: SparkSession, d: str) -> DataFrame:
    """Median."""
    return rounded(stats.volume_statistic(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "median"))


@query(
    """WITH e AS (SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority, low, high, least(floor((o_totalprice - low) * 60 / (high - low)), 59) AS bin, count(*) AS n FROM orders JOIN e USING (o_orderpriority) GROUP BY ALL)
SELECT o_orderpriority, round(low + (max_by(bin, (n, -bin)) + 0.5) * (high - low) / 60, 4) AS mode FROM b GROUP BY o_orderpriority, low, high"""
)
def volume_mode(spark: SparkSession, d: str) -> DataFrame:
    """Centre of the first fullest of 60 bins."""
    return rounded(stats.volume_statistic(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "mode"))


@query(
    """WITH e AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem),
b AS (SELECT l_returnflag, least(floor((l_extendedprice - low) * 40 / (high - low)), 39)::INT AS bin, low, (high - low) / 40 AS w, count(*) AS n FROM lineitem, e GROUP BY ALL)
SELECT l_returnflag, bin, round(low + bin * w, 4) AS left_edge, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * w), 10) AS density FROM b"""
)
def histogram_density_common_edges(spark: SparkSession, d: str) -> DataFrame:
    """Densities of each species over common edges."""
    out = stats.density_histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 40)
    return out.withColumn("left_edge", F.round("left_edge", 4)).withColumn("density", F.round("density", 10))


@query("SELECT p_brand, count(*) FILTER (p_size <= 15) AS small, count(*) FILTER (p_size > 15 AND p_size <= 35) AS medium, count(*) FILTER (p_size > 35) AS large FROM part GROUP BY 1")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    return stats.size_buckets(table(spark, d, "part"), ["p_brand"], "p_size", (15, 35))


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS a, round(avg(l_extendedprice), 4) AS b, round(avg(l_discount), 6) AS c FROM lineitem GROUP BY 1")
def average_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise means of an array; the first row of the matrix."""
    z = F.lit(0.0)
    cells = table(spark, d, "lineitem").withColumn("cell", F.array("l_quantity", "l_extendedprice", "l_discount", z, z, z, z, z, z))
    return stats.average_cell(cells, ["l_returnflag"]).select("l_returnflag", F.round(F.col("cell")[0], 4).alias("a"), F.round(F.col("cell")[1], 4).alias("b"), F.round(F.col("cell")[2], 6).alias("c"))


@query("SELECT user_id, round(100.0 * count(*) / 200, 2) AS progress, max(i) AS top FROM " + RUNS + " GROUP BY 1")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Percentage of planned steps, from the largest counters of each job."""
    steps = runs(spark, d).select("user_id", (F.col("i") + 1).alias("n"), F.col("i").alias("top"), F.lit(0).alias("report"))
    return stats.step_counters(steps, "user_id", "n", "top", "report").select("user_id", stats.progress(F.col("n"), F.lit(200)).alias("progress"), "top")


@query("SELECT o_orderstatus, round(100.0 * (1 - count(*) FILTER (o_totalprice > 150000) / count(*)), 4) AS reduced FROM orders GROUP BY 1")
def reduction_percent(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    out = table(spark, d, "orders").groupBy("o_orderstatus").agg(stats.reduction(F.count_if(F.col("o_totalprice") > 150000), F.count(F.lit(1))).alias("reduced"))
    return rounded(out)


# --- ordered series -----------------------------------------------------------------------------------------------


@query(f"SELECT event_id, i FROM {RUNS} WHERE i >= 5 AND (i - 5) % 3 = 0 AND (i - 5) / 3 < 20")
def skip_stride_limit(spark: SparkSession, d: str) -> DataFrame:
    """Skip, then stride on source ordinals, then at most 20 rows a run."""
    return series.skip_stride(runs(spark, d), "i", 5, 3, 20).select("event_id", "i")


@query(f"SELECT event_id, round(velocity, 4) AS velocity FROM (SELECT event_id, (lead(value) OVER w - lag(value) OVER w) / 4.0 AS velocity FROM {RUNS} WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE velocity IS NOT NULL")
def central_difference_velocity(spark: SparkSession, d: str) -> DataFrame:
    """W04."""
    return rounded(series.central_difference(runs(spark, d), ["user_id"], ["i"], "value", 2.0).select("event_id", "velocity"))


@query(f"SELECT event_id, round(CASE WHEN n < 5 THEN value ELSE m END, 4) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM {RUNS}) WHERE n < 5 OR i >= 4")
def running_mean_valid(spark: SparkSession, d: str) -> DataFrame:
    """W05."""
    return rounded(series.running_mean(runs(spark, d), ["user_id"], ["i"], "value", 5).select("event_id", "mean"))


CENTRED = f"""SELECT event_id, round((s {{}}) / 5, 4) AS smooth FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s,
 first_value(value) OVER w AS f, last_value(value) OVER w AS l, count(*) OVER (PARTITION BY user_id) AS n FROM {RUNS} WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(CENTRED.format("+ greatest(2 - i, 0) * f + greatest(3 + i - n, 0) * l"))
def centred_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Ends repeated."""
    return rounded(series.centred_mean(runs(spark, d), ["user_id"], ["i"], "value", 5).select("event_id", "smooth"))


@query(CENTRED.format(""))
def centred_smooth_zero(spark: SparkSession, d: str) -> DataFrame:
    """Zeros beyond the ends."""
    return rounded(series.centred_mean(runs(spark, d), ["user_id"], ["i"], "value", 5, pad="zero").select("event_id", "smooth"))


@query(f"SELECT event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY i), 3) AS integral FROM (SELECT *, coalesce((value + lag(value) OVER w) / 2, 0) AS s FROM {RUNS} WINDOW w AS (PARTITION BY user_id ORDER BY i))")
def cumulative_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    """W07."""
    return rounded(series.cumulative_trapezoid(runs(spark, d), ["user_id"], ["i"], "i", "value", "integral").select("event_id", "integral"), 3)


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY i), 3) AS total FROM {RUNS}")
def running_total_blocks(spark: SparkSession, d: str) -> DataFrame:
    """W07 for runs of any length: sums of blocks, then offsets."""
    return rounded(series.running_sum(runs(spark, d), ["user_id"], "i", F.col("value"), "total", block=32).select("event_id", "total"), 3)


@query(f"SELECT user_id, min(i) AS i FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY i) AS p, max(value) OVER (PARTITION BY user_id) AS e FROM {RUNS}) WHERE p >= 0.9 * e GROUP BY 1")
def first_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Where the running maximum reaches nine tenths of the last."""
    return series.first_crossing(runs(spark, d), ["user_id"], ["i"], "i", "value", 0.9)


@query(f"SELECT user_id, max(i) AS i FROM {RUNS} WHERE value > 50 GROUP BY 1")
def last_above_floor(spark: SparkSession, d: str) -> DataFrame:
    """Last place above a floor."""
    return series.last_above(runs(spark, d), ["user_id"], ["i"], "i", "value", 50.0)


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS tail_mean FROM {RUNS}")
def reverse_cumulative_mean(spark: SparkSession, d: str) -> DataFrame:
    """W09."""
    return rounded(series.tail_mean(runs(spark, d), ["user_id"], ["i"], "value").select("event_id", "tail_mean"), 9)


@query(
    f"""WITH t AS (SELECT user_id, i, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY user_id) AS n, value FROM {RUNS}),
r AS (SELECT user_id, avg(value) FILTER (i >= greatest(1, least(round_even(n * 0.65, 0), n - 2))) AS ref FROM t GROUP BY 1),
e AS (SELECT user_id, i, n, abs(rest - ref) AS err, greatest(0.02, 0.01 * abs(ref)) AS tol, i <= least(n - 2, floor(n * 0.55)) AS allowed FROM t JOIN r USING (user_id))
SELECT user_id, (CASE WHEN max(n) < 20 THEN 0 ELSE coalesce(min(i) FILTER (allowed AND err <= tol), min_by(i, (err, i)) FILTER (allowed)) END)::BIGINT AS skip FROM e GROUP BY 1"""
)
def tail_reference_skip(spark: SparkSession, d: str) -> DataFrame:
    """The smallest skip whose rest agrees with the tail."""
    return series.equilibration_skip(runs(spark, d), ["user_id"], "i", "value", rtol=0.01)


@query(
    f"""SELECT user_id, block, max(value) AS block_max, count(*) AS n FROM (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM {RUNS})
GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase')"""
)
def block_segment_max(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that an event closes."""
    return series.block_max(runs(spark, d), ["user_id"], ["i"], F.col("event_type") == "purchase", "value").select("user_id", "block", "block_max", "n")


@query(
    f"""WITH t AS (SELECT user_id, i, value > 40 AS ok, count(*) OVER (PARTITION BY user_id) AS n FROM {RUNS}),
a AS (SELECT user_id, n, min(i) FILTER (ok AND i >= n // 3) AS first FROM t GROUP BY 1, 2),
b AS (SELECT t.user_id, first, min(i) FILTER (ok AND i >= (2 * t.n) // 3 AND i > first) AS second FROM t JOIN a USING (user_id) GROUP BY 1, 2)
SELECT * FROM b WHERE first IS NOT NULL AND second IS NOT NULL"""
)
def next_good_after_target(spark: SparkSession, d: str) -> DataFrame:
    """Two good rows, at or after a third and two thirds."""
    return series.two_good(runs(spark, d), ["user_id"], "i", F.col("value") > 40)


@query(f"SELECT user_id, CASE WHEN n // 3 = (2 * n) // 3 THEN (n // 3)::VARCHAR ELSE (n // 3) || ',' || ((2 * n) // 3) END AS picks FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def two_point_pick(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    sizes = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("user_id", F.array_join(F.transform(series.two_points(F.col("n")), lambda i: i.cast("string")), ",").alias("picks"))


@query(f"SELECT user_id, coalesce(min(i) FILTER (value > 60 AND i >= n // 4), -1) AS place FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {RUNS}) GROUP BY 1")
def next_good_place(spark: SparkSession, d: str) -> DataFrame:
    """The first good row at or after a quarter of each run."""
    out = series.next_good(runs(spark, d), ["user_id"], "i", F.col("value") > 60, 0.25, "place")
    return out.select("user_id", F.coalesce("place", F.lit(-1)).cast("long").alias("place"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def hourly_means(spark: SparkSession, d: str) -> DataFrame:
    """2.9: means in tumbling windows, in the form of a table."""
    return rounded(ingest.windowed_means(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour", "1 day"))


@query("SELECT l_orderkey, round(sum(CASE l_returnflag WHEN 'A' THEN 39.0983 WHEN 'N' THEN 54.938 ELSE 15.999 END) / count(*), 6) AS mass FROM lineitem GROUP BY 1")
def mean_masses(spark: SparkSession, d: str) -> DataFrame:
    """the mean mass of a composition, which frictions are relative to."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    m = F.when(F.col("l_returnflag") == "A", 39.0983).when(F.col("l_returnflag") == "N", 54.938).otherwise(15.999)
    per = c.groupBy("l_orderkey").agg(F.collect_list(F.struct("n", m.alias("m"))).alias("s"))
    return per.select("l_orderkey", F.round(rules.mean_mass(F.col("s.m"), F.col("s.n")), 6).alias("mass"))


@query(f"SELECT user_id, max(i) AS last_good FROM {RUNS} WHERE value > 40 GROUP BY 1")
def last_converged_row(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return series.last_good(runs(spark, d), ["user_id"], "i", F.col("value") > 40)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmin_per_group(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    return series.least_row(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"], ["o_orderkey", "o_totalprice"])


@query(
    """WITH b AS (SELECT p_brand, min_by(p_size, (p_retailprice, p_partkey)) AS x FROM part GROUP BY 1)
SELECT p_brand, p_partkey, distance, rank FROM (SELECT p_brand, p_partkey, abs(p_size - x) AS distance, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - x), p_partkey) AS rank FROM part JOIN b USING (p_brand)) WHERE rank <= 5"""
)
def nearest_n_to_min(spark: SparkSession, d: str) -> DataFrame:
    """Five structures nearest to the one of least energy."""
    out = series.nearest_to_least(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size", ["p_partkey"], 5)
    return out.select("p_brand", "p_partkey", "distance", "rank")


@query("SELECT p_type, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size >= 20, p_size, p_partkey) AS r FROM part) WHERE r = 1")
def anchor_per_group(spark: SparkSession, d: str) -> DataFrame:
    """W16."""
    return series.coverage_anchor(table(spark, d, "part"), ["p_type"], "p_size", 20, ["p_partkey"], ["p_partkey", "p_size"])


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """W17."""
    return series.last_write(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT p_partkey, round(a * pow(8.0 * p_retailprice / (a * b * c), 1.0 / 3.0), 4) AS a FROM (SELECT p_partkey, p_retailprice, p_size + 1.0 AS a, p_size + 2.0 AS b, p_size + 3.0 AS c FROM part)")
def rescale_to_volume(spark: SparkSession, d: str) -> DataFrame:
    """An orthogonal cell stretched to a volume; its first length."""
    z = F.lit(0.0)
    cell = F.array(F.col("p_size") + 1.0, z, z, z, F.col("p_size") + 2.0, z, z, z, F.col("p_size") + 3.0)
    out = table(spark, d, "part").select("p_partkey", geometry.rescale_to_volume(cell, 8.0 * F.col("p_retailprice")).alias("cell"))
    return out.select("p_partkey", F.round(F.col("cell")[0], 4).alias("a"))


@query(
    f"""WITH s AS (SELECT *, i // 7 AS segment, i % 7 + 1 AS step FROM {RUNS}),
t AS (SELECT user_id, segment, max(step) AS top FROM s GROUP BY 1, 2),
o AS (SELECT user_id, segment, coalesce(sum(top) OVER (PARTITION BY user_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
SELECT event_id, (step + off)::BIGINT AS total_step FROM s JOIN o USING (user_id, segment)"""
)
def restart_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Steps of seven-row segments counted on."""
    rows = runs(spark, d).withColumn("segment", F.floor(F.col("i") / 7)).withColumn("step", F.col("i") % 7 + 1)
    return series.join_restarts(rows, ["user_id"], "segment", "step").select("event_id", "total_step")


@query(
    f"""WITH a AS (SELECT user_id AS run, i, value FROM {RUNS}),
b AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 2 AS i, o_totalprice FROM orders)
SELECT run, i, value, o_totalprice FROM a JOIN b USING (run, i)"""
)
def positional_zip_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Two series paired by place, the first row of the second left out, the longer cut."""
    a = table(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), "o_orderdate", "o_orderkey", "o_totalprice")
    return series.zip_rows(a, b, ["run"], ["ts", "event_id"], ["o_orderdate", "o_orderkey"], 1).select("run", "i", "value", "o_totalprice")


@query(
    f"""WITH a AS (SELECT user_id, i, value > 30 AS ok FROM {RUNS}), b AS (SELECT user_id, i, value < 80 AS ok FROM {RUNS} WHERE user_id % 2 = 0 OR i > 0),
na AS (SELECT user_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT user_id, count(*) AS n FROM b GROUP BY 1)
SELECT a.user_id, a.i, CASE WHEN na.n IS NOT DISTINCT FROM nb.n THEN a.ok AND b.ok ELSE a.ok END AS ok FROM a JOIN na USING (user_id) LEFT JOIN nb ON nb.user_id = a.user_id LEFT JOIN b ON b.user_id = a.user_id AND b.i = a.i"""
)
def combined_masks(spark: SparkSession, d: str) -> DataFrame:
    """Two masks combined by place where they are equally long."""
    r = runs(spark, d)
    a = r.select("user_id", "i", (F.col("value") > 30).alias("ok"))
    b = r.where("user_id % 2 = 0 OR i > 0").select("user_id", "i", (F.col("value") < 80).alias("ok"))
    return series.and_masks(a, b, ["user_id"], "i", "ok").select("user_id", "i", "ok")


# --- motion -------------------------------------------------------------------------------------------------------


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """events as one wrapped coordinate in a cell of length 100 (frac: its share)."""
    return runs(spark, d).withColumn("w", F.round("value", 2) % 100.0).withColumn("frac", F.col("w") / 100.0).withColumn("len", F.lit(100.0))


WRAPPED = f"(SELECT *, (round(value, 2) % 100.0) AS w, (round(value, 2) % 100.0) / 100.0 AS frac FROM {RUNS})"


@query(f"SELECT event_id, round(w - 100.0 * sum(k) OVER (PARTITION BY user_id ORDER BY i), 4) AS unwrapped FROM (SELECT *, coalesce(floor((w - lag(w) OVER (PARTITION BY user_id ORDER BY i)) / 100.0 + 0.5), 0) AS k FROM {WRAPPED})")
def unwrap_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """A running sum of whole cells."""
    return rounded(motion.unwrap(wrapped(spark, d), ["user_id"], ["i"], "w", "hybrid", length="len").select("event_id", "unwrapped"))


UNWRAP = f"SELECT event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY i){{}}, 4) AS unwrapped FROM (SELECT *, coalesce((dx - round_even(dx, 0)){{}}, frac{{}}) AS s FROM (SELECT *, frac - lag(frac) OVER (PARTITION BY user_id ORDER BY i) AS dx FROM {WRAPPED}))"


@query(UNWRAP.format("", " * 100.0", " * 100.0"))
def unwrap_displacement(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-image steps times the cell of each frame."""
    return rounded(motion.unwrap(wrapped(spark, d), ["user_id"], ["i"], "frac", "displacement", length="len").select("event_id", "unwrapped"))


@query(UNWRAP.format(" * 100.0", "", ""))
def unwrap_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-image fractions summed, times the present cell."""
    return rounded(motion.unwrap(wrapped(spark, d), ["user_id"], ["i"], "frac", "lattice", length="len").select("event_id", "unwrapped"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - sum(l_quantity * l_extendedprice) OVER w / sum(l_quantity) OVER w + 1e-7, 3) + 0.0 AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def com_removed(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates relative to each frame's centre of mass."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("x"))
    return motion.remove_drift(rows, ["l_orderkey"], "l_quantity", ["x"]).select("l_orderkey", "l_linenumber", (F.round(F.col("x") + 1e-7, 3) + 0.0).alias("x"))


@query(f"SELECT user_id % 7 AS species, i, round(avg((value - f) ** 2), 9) AS msd, count(*) AS n FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY i) AS f FROM {RUNS}) GROUP BY ALL")
def single_origin_msd(spark: SparkSession, d: str) -> DataFrame:
    """Each user an atom, seven species."""
    rows = runs(spark, d).withColumn("species", F.col("user_id") % 7)
    return rounded(motion.single_origin_msd(rows, [], ["user_id"], "i", ["value"], ["species"]), 9).select("species", "i", "msd", "n")


LAGS = f"(SELECT a.user_id, b.i - a.i AS lag, avg({{}}) AS v FROM {RUNS} a JOIN {RUNS} b ON a.user_id = b.user_id AND b.i >= a.i GROUP BY ALL)"
SQUARES, PRODUCTS = LAGS.format("(b.value - a.value) ** 2"), LAGS.format("a.value * b.value")


@query(f"SELECT user_id % 4 AS species, lag, round(avg(v) + 1e-6, 3) AS msd, count(*) AS atoms FROM {SQUARES} GROUP BY 1, 2")
def msd_all_origins(spark: SparkSession, d: str) -> DataFrame:
    """Over all origins, for all lags, by species."""
    out = motion.msd_all_origins(runs(spark, d).withColumn("species", F.col("user_id") % 4), [], ["user_id"], ["species"], "i", ["value"])
    return out.select("species", "lag", F.round(F.col("msd") + 1e-6, 3).alias("msd"), "atoms")


@query(f"SELECT lag, round(avg(v) + 1e-6, 3) AS msd, count(*) AS atoms FROM {SQUARES} GROUP BY 1")
def msd_every_lag(spark: SparkSession, d: str) -> DataFrame:
    """Over all origins, for all lags."""
    out = motion.msd_all_origins(runs(spark, d), [], ["user_id"], [], "i", ["value"])
    return out.select("lag", F.round(F.col("msd") + 1e-6, 3).alias("msd"), "atoms")


@query(f"SELECT lag, round(avg(v), 3) AS vacf, count(*) AS atoms FROM {PRODUCTS} GROUP BY 1")
def vacf_every_lag(spark: SparkSession, d: str) -> DataFrame:
    """For all lags of the series."""
    return rounded(motion.per_atom_lags(runs(spark, d), [], ["user_id"], [], "i", ["value"], motion.autocorrelation, "vacf", lambda n: n), 3)


@query(f"SELECT lag, round(avg(v), 3) AS vacf, count(*) AS atoms FROM {PRODUCTS} GROUP BY 1")
def vacf_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same for series that no task could hold, in blocks of sixteen rows."""
    return rounded(motion.blocked_lags(runs(spark, d), [], ["user_id"], [], "i", ["value"], 16, "vacf"), 3)


@query(f"WITH c AS (SELECT l.lag, avg(v) AS c, count(*) AS atoms FROM {PRODUCTS} l JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id) WHERE l.lag < least(n, greatest(256, n // 2)) GROUP BY 1) SELECT lag, round(c, 3) AS vacf, atoms, round(c / (SELECT c FROM c WHERE lag = 0), 6) AS vacf_norm FROM c")
def velocity_correlation(spark: SparkSession, d: str) -> DataFrame:
    """For all lags that the operator keeps, with the values relative to lag 0."""
    out = motion.velocity_correlation(runs(spark, d), [], ["user_id"], [], "i", ["value"])
    return out.select("lag", F.round("vacf", 3).alias("vacf"), "atoms", F.round("vacf_norm", 6).alias("vacf_norm"))


@query(f"SELECT user_id % 5 AS species, round(regr_intercept(value + user_id + 0.5 * i, i), 4) AS a, round(ln(regr_slope(value + user_id + 0.5 * i, i)), 4) AS q, count(*) AS n FROM {RUNS} GROUP BY 1 HAVING regr_slope(value + user_id + 0.5 * i, i) > 0")
def fitted_models(spark: SparkSession, d: str) -> DataFrame:
    """2.10, A22: a model of one's own, a + exp(q) i, fitted to the series of each species; a line in another guise, so SQL knows the least squares."""
    rows = runs(spark, d).select((F.col("user_id") % 5).alias("species"), F.col("i").cast("double").alias("i"), (F.col("value") + F.col("user_id") + 0.5 * F.col("i")).alias("y"))
    out = fits.fit(rows, ["species"], "i", "y", lambda x, a, q: a + F.exp(q) * x, [F.avg("y"), F.lit(0.0)], ["a", "q"]).where("converged")
    return out.select("species", F.round("a", 4).alias("a"), F.round("q", 4).alias("q"), "n")


@query(f"SELECT a.user_id % 5 AS species, b.i - a.i AS lag, round(avg(a.value * b.value), 3) AS product, count(*) AS n FROM {RUNS} a JOIN {RUNS} b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 6 GROUP BY ALL")
def lagged_products(spark: SparkSession, d: str) -> DataFrame:
    """A14 as an equi-join on exploded ordinals."""
    p = motion.lagged_pairs(runs(spark, d), ["user_id"], "i", "value", 6)
    return rounded(p.groupBy((F.col("user_id") % 5).alias("species"), F.col("lag").cast("long").alias("lag")).agg(F.avg(F.col("a") * F.col("b")).alias("product"), F.count(F.lit(1)).alias("n")), 3)


@query(
    f"""WITH c AS (SELECT user_id % 3 AS species, lag, avg(v) AS c FROM {PRODUCTS} GROUP BY 1, 2), n AS (SELECT species, 2 * count(*) - 1 AS m FROM c GROUP BY 1),
f AS (SELECT species, m, unnest(range((m + 1) // 2)) AS k FROM n),
s AS (SELECT species, k, m, CASE WHEN k = 0 THEN 1 ELSE 2 END * 1e-15 * sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * c * cos(2 * pi() * k * lag / m)) AS s FROM f JOIN c USING (species) GROUP BY species, k, m)
SELECT species, k, round(k / (m * 1e-15) / 29979245800.0, 4) AS nu, round(s * 29979245800.0, 4) AS s, round(coalesce(sum((s + before) / 2) OVER (PARTITION BY species ORDER BY k) / (m * 1e-15), 0), 3) AS cumint
FROM (SELECT *, lag(s) OVER (PARTITION BY species ORDER BY k) AS before FROM s)"""
)
def power_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Spectrum and running integral of each species' correlation, against sums of cosines."""
    rows = runs(spark, d).withColumn("species", F.col("user_id") % 3)
    c = motion.velocity_correlation(rows, [], ["user_id"], ["species"], "i", ["value"])
    out = motion.power_spectrum(c, ["species"], "vacf", 1.0)
    return out.select("species", "k", F.round("nu", 4).alias("nu"), F.round("s", 4).alias("s"), F.round("cumint", 3).alias("cumint"))


@query(f"SELECT l_orderkey, CASE WHEN count(*) > 1 THEN round(sum(l_quantity * (l_discount ** 2 + l_tax ** 2)) * 103.642696 / ((3 * count(*) - 3) * 8.617333262e-5), 2) END AS temperature FROM lineitem GROUP BY 1")
def kinetic_temperature(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return rounded(motion.kinetic_temperature(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", ["l_discount", "l_tax"]), 2)


@query(
    f"""WITH r AS {RUNS}, h AS (SELECT user_id, n, hi, least(200, hi) AS many FROM (SELECT user_id, count(*) AS n, greatest(1, least(count(*) // 2, count(*) - 10)) AS hi FROM events GROUP BY 1 HAVING count(*) >= 10)),
t AS (SELECT DISTINCT user_id, n, CASE WHEN many = 1 THEN 0 WHEN k = many - 1 THEN hi ELSE floor(k * (hi::DOUBLE / (many - 1)))::BIGINT END AS start FROM (SELECT *, unnest(range(many)) AS k FROM h)),
d AS (SELECT t.user_id, start, n - start AS m, i, value - avg(value) OVER (PARTITION BY t.user_id, start) AS d FROM t JOIN r ON r.user_id = t.user_id AND i >= start),
a AS (SELECT x.user_id, x.start, x.m, y.i - x.i AS lag, avg(x.d * y.d) AS c FROM d x JOIN d y ON x.user_id = y.user_id AND x.start = y.start AND y.i >= x.i GROUP BY ALL),
c AS (SELECT user_id, start, m, lag, c / nullif(first_value(c) OVER w, 0) AS c FROM a WINDOW w AS (PARTITION BY user_id, start ORDER BY lag)),
z AS (SELECT *, min(lag) FILTER (c <= 0) OVER (PARTITION BY user_id, start) AS stop FROM c),
g AS (SELECT user_id, start, m, greatest(1, 1 + 2 * coalesce(sum(c * (1 - lag / m)) FILTER (lag > 0 AND lag < coalesce(stop, m)), 0)) AS g FROM z GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m / g DESC, start) AS place, max(start) OVER (PARTITION BY user_id) AS last FROM g)
SELECT user_id, start, round(g, 4) AS inefficiency, round(m / g, 4) AS n_effective, start = last AND last > 0 AS capped FROM b WHERE place = 1
UNION ALL SELECT user_id, 0, 1.0, count(*), false FROM events GROUP BY 1 HAVING count(*) < 10"""
)
def equilibration_start(spark: SparkSession, d: str) -> DataFrame:
    """The start of most effective samples, and whether it is the last that was tried."""
    return rounded(motion.equilibration(runs(spark, d), ["user_id"], "i", "value"))


# --- pairs --------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as points in a periodic cube of length 4, in frames of 50."""
    e = table(spark, d, "embeddings")
    frac = F.array(*[(F.col("embedding")[k].cast("double") / 4.0) for k in range(3)])
    z, four = F.lit(0.0), F.lit(4.0)
    return e.select(F.floor(F.col("vec_id") / 50).alias("frame"), F.col("vec_id").alias("idx"), F.concat(F.lit("S"), (F.col("label") % 2).cast("string")).alias("symbol"), frac.alias("frac"), F.array(four, z, z, z, four, z, z, z, four).alias("cell"))


DISTANCE = " + ".join(f"((a.x{k} - b.x{k}) - 4 * round_even((a.x{k} - b.x{k}) / 4, 0)) ** 2" for k in range(3))
POINTS = "(SELECT floor(vec_id / 50)::BIGINT AS frame, vec_id AS idx, 'S' || (label % 2) AS symbol, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2 FROM embeddings)"
PAIRS = f"(SELECT a.frame, a.idx AS i, b.idx AS j, a.symbol AS si, b.symbol AS sj, sqrt({DISTANCE}) AS dist FROM {POINTS} a JOIN {POINTS} b ON a.frame = b.frame AND a.idx < b.idx)"


@query(f"SELECT least(floor(dist / 0.1), 9)::INT AS bin, count(*) AS pairs FROM {PAIRS} WHERE dist < 1.0 GROUP BY 1")
def pair_distance_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-image pairs nearer than 1 in bins of 0.1."""
    return pairs.pair_histogram(pairs.frame_pairs(points(spark, d), ["frame"], 1.0), [], "distance", 0.1, 10)


@query(
    f"""WITH p AS (SELECT * FROM {PAIRS} WHERE dist < 1.0), c AS (SELECT pair, least(floor(dist / 0.1), 9)::INT AS bin, count(*) AS pairs FROM (SELECT dist, unnest(['total', least(si, sj) || '-' || greatest(si, sj)]) AS pair FROM p) GROUP BY 1, 2),
s AS (SELECT symbol, max(m) AS m FROM (SELECT frame, symbol, count(*) AS m FROM {POINTS} GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT max(n) AS n, count(*) AS frames FROM (SELECT frame, count(*) AS n FROM {POINTS} GROUP BY 1)),
k AS (SELECT a.symbol || '-' || b.symbol AS pair, CASE WHEN a.symbol = b.symbol THEN a.m * (a.m - 1) / 2 ELSE a.m * b.m END AS np FROM s a JOIN s b ON a.symbol <= b.symbol UNION ALL SELECT 'total', n * (n - 1) / 2 FROM n),
d AS (SELECT pair, bin, coalesce(pairs, 0) AS pairs FROM (SELECT DISTINCT pair FROM c) CROSS JOIN (SELECT unnest(range(10))::INT AS bin) LEFT JOIN c USING (pair, bin))
SELECT pair, bin, round((bin + 0.5) * 0.1, 4) AS r, round(pairs * 64.0 / (frames * np * 4.0 / 3.0 * pi() * (pow((bin + 1) * 0.1, 3) - pow(bin * 0.1, 3))), 4) AS g FROM d JOIN k USING (pair), n WHERE np > 0"""
)
def radial_distribution(spark: SparkSession, d: str) -> DataFrame:
    """g(r) in all and for each pair of species."""
    out = pairs.radial_distribution(points(spark, d).withColumn("run", F.lit(1)), ["run"], "frame", 1.0, 0.1)
    return rounded(out.drop("run"))


@query(f"SELECT frame, CASE WHEN min(dist) < 0.12 THEN 'too_close' WHEN min(dist) < 0.2 THEN 'close' ELSE 'keep' END AS verdict FROM {PAIRS} GROUP BY 1")
def close_contact_filter(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each frame by its nearest pair."""
    return pairs.close_contacts(points(spark, d), ["frame"], 0.2, 0.12)


@query(f"SELECT a.idx AS i, b.idx AS j, round(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2), 5) AS distance FROM {POINTS} a JOIN {POINTS} b ON a.idx < b.idx AND abs(a.x0 - b.x0) < 0.05 AND (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 < 0.0025")
def binned_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """J06 for large frames: all pairs nearer than 0.05 by cells."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(3)])
    return rounded(pairs.binned_pairs(e, [], 0.05, ["x0", "x1", "x2"]), 5)


# --- equations of state -------------------------------------------------------------------------------------------


def eos_points(spark: SparkSession, d: str) -> DataFrame:
    """Brands as compounds, sizes as volumes, energies on an exact curve."""
    p = table(spark, d, "part").select("p_brand", "p_size").distinct()
    v = F.col("p_size") + 80.0
    x = F.pow(100.0 / v, F.lit(2.0 / 3.0))
    e = -500.0 + 9 * 100.0 * 0.9 / 16 * (F.pow(x - 1, F.lit(3.0)) * 4.3 + F.pow(x - 1, F.lit(2.0)) * (6 - 4 * x))
    return p.select("p_brand", v.alias("v"), e.alias("e"))


@query("SELECT p_brand, count(*) AS n, -500.0 AS e0, 100.0 AS v0, round(0.9 * 160.21766208, 2) AS b0_gpa, 4.3 AS b0p FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1 HAVING count(*) >= 4")
def eos_fit(spark: SparkSession, d: str) -> DataFrame:
    """Points of a known curve give its parameters back."""
    out = eos.fit(eos_points(spark, d), ["p_brand"], "v", "e").where("n >= 4")
    return out.select("p_brand", "n", F.round("e0", 3).alias("e0"), F.round("v0", 2).alias("v0"), F.round("b0_gpa", 2).alias("b0_gpa"), F.round("b0p", 1).alias("b0p"))


@query("WITH x AS (SELECT p_brand, p_size + 80.0 AS v, pow(100.0 / (p_size + 80.0), 2.0 / 3.0) AS x FROM part), e AS (SELECT p_brand, v, -500.0 + 50.625 * (pow(x - 1, 3) * 4.3 + pow(x - 1, 2) * (6 - 4 * x)) AS e FROM x) SELECT p_brand, min_by(v, (e, v)) AS v_least, round(min(e), 4) AS e_least FROM e GROUP BY 1")
def eos_least_point(spark: SparkSession, d: str) -> DataFrame:
    """The point of least energy that stands in where there is no fit."""
    return rounded(eos.fit(eos_points(spark, d), ["p_brand"], "v", "e").select("p_brand", "v_least", "e_least"))


@query("SELECT p_partkey, round(1.5 * 0.9 * (pow(100.0 / (p_size + 80.0), 7.0 / 3.0) - pow(100.0 / (p_size + 80.0), 5.0 / 3.0)) * (1 + 0.75 * 0.3 * (pow(100.0 / (p_size + 80.0), 2.0 / 3.0) - 1)), 6) AS pressure FROM part")
def eos_pressure(spark: SparkSession, d: str) -> DataFrame:
    """A24, in its textbook form."""
    p = eos.pressure(F.col("p_size") + 80.0, F.lit(100.0), F.lit(0.9), F.lit(4.3))
    return table(spark, d, "part").select("p_partkey", F.round(p, 6).alias("pressure"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), p_size - 25, p_partkey) AS r FROM part) WHERE r = 1")
def reference_volume(spark: SparkSession, d: str) -> DataFrame:
    """Each compound's least strained directory."""
    p = table(spark, d, "part").withColumn("strain", F.col("p_size") - 25)
    return eos.reference_volume(p, ["p_brand"], "strain", ["p_partkey"], ["p_partkey"])


# --- sets, matches, selection -------------------------------------------------------------------------------------


@query("SELECT min(p_partkey) AS p_partkey, count(*) AS copies FROM part GROUP BY p_brand, p_size")
def fingerprint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first frame of each fingerprint; noise far below the fifth digit and the order of atoms make no difference."""
    noise = F.col("p_partkey") % 7 * 1e-7
    x = F.array(F.col("p_size") + noise, F.lit(0.25), F.lit(0.5))
    y = F.array(F.lit(0.125), F.lit(0.75), F.lit(1.0) - noise)
    even = F.col("p_partkey") % 2 == 0
    positions = F.when(even, F.array(x, y)).otherwise(F.array(y, x))
    symbols = F.when(even, F.array(F.col("p_brand"), F.lit("O"))).otherwise(F.array(F.lit("O"), F.col("p_brand")))
    z, ten = F.lit(0.0), F.lit(10.0)
    p = table(spark, d, "part").withColumn("print", frames.fingerprint(F.lit(2), symbols, positions, F.array(ten, z, z, z, ten, z, z, z, ten)))
    sizes = p.groupBy("print").agg(F.count(F.lit(1)).alias("copies"))
    return frames.drop_repeats(p, ["print"], ["p_partkey"]).join(sizes, "print").select("p_partkey", "copies")


@query("SELECT rtrim(regexp_extract(url, '^[^?#]*'), '/') AS name, min(page_id) AS page_id FROM pages GROUP BY 1")
def repeated_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that differ in dots and double slashes only are one."""
    plain = F.regexp_extract("url", r"^[^?#]*", 0)
    host = F.regexp_extract("url", r"^https?://[^/]*", 0)
    rest = F.substring(plain, F.length(host) + 1, F.length(plain))
    tail = F.regexp_extract(rest, r"/[^/]*$", 0)
    head = F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))
    odd = F.concat(head, F.when(F.col("page_id") % 3 == 1, "/.").when(F.col("page_id") % 3 == 2, "//other/..").otherwise(""), tail)
    p = table(spark, d, "pages").select("page_id", host.alias("host"), odd.alias("path"))
    out = frames.drop_repeats(frames.drop_repeated_paths(p.withColumn("path", F.concat(F.regexp_replace("host", "//", "_"), "path")), "path", ["page_id"]), ["resolved"], ["page_id"])
    return out.select(F.regexp_replace("resolved", "_", "//").alias("name"), "page_id")


@query("SELECT l_orderkey, count(*) AS n_atoms, count(DISTINCT l_returnflag) AS species FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 HAVING count(*) < 6")
def pool_minus_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Frames that were not taken and are small enough."""
    pool = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("l_returnflag").alias("species"))
    taken = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return frames.remainder(pool, taken, ["l_orderkey"], "n_atoms", 6)


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def first_appearance(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values with their first appearance."""
    return match.first_appearance(table(spark, d, "events"), "event_type", "event_id")


@query(
    """WITH h AS (SELECT p_partkey, s_suppkey, 0 AS pr, 'both' AS strategy FROM part JOIN supplier ON p_size = s_nationkey AND p_partkey % 10 = s_suppkey % 10
 UNION ALL SELECT p_partkey, s_suppkey, 1, 'size' FROM part JOIN supplier ON p_size = s_nationkey),
b AS (SELECT p_partkey, min(pr) AS pr FROM h GROUP BY 1),
l AS (SELECT p_partkey, strategy, list_sort(list_distinct(list(s_suppkey))) AS s FROM h JOIN b USING (p_partkey, pr) GROUP BY 1, 2)
SELECT p.p_partkey, coalesce(s[p.p_partkey % 3 + 1], s[1], -1) AS s_suppkey, coalesce(strategy, 'none') AS strategy FROM part p LEFT JOIN l USING (p_partkey)"""
)
def prioritised_match(spark: SparkSession, d: str) -> DataFrame:
    """The better of two strategies, the variant's place among equal hits, unmatched rows kept."""
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 10).alias("tail"), (F.col("p_partkey") % 3).alias("variant"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 10).alias("s_tail"))
    out = match.prioritised(p, s, "p_partkey", "s_suppkey", [("both", [("p_size", "s_nationkey"), ("tail", "s_tail")]), ("size", [("p_size", "s_nationkey")])], "variant")
    return out.select("p_partkey", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"), F.coalesce("strategy", F.lit("none")).alias("strategy"))


@query("SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = p_size)")
def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    """What no strategy matches."""
    p, s = table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return match.unmatched(p, match.prioritised(p, s, "p_partkey", "s_suppkey", [("size", [("p_size", "s_nationkey")])]), "p_partkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def same_directory_join(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of a run on its frames; frames without them stay."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return match.beside(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 2")
def has_both_files(spark: SparkSession, d: str) -> DataFrame:
    """Runs that have both kinds."""
    return match.has_both(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase"])


@query("SELECT o_orderkey FROM orders WHERE abs(o_totalprice / 1000 - 100) <= 5 OR abs(o_custkey - 100) <= 5")
def temperature_match(spark: SparkSession, d: str) -> DataFrame:
    """Either of two estimates within a tolerance."""
    o = table(spark, d, "orders")
    return o.where(match.temperature_matches(F.lit(None).cast("double"), F.col("o_totalprice") / 1000, F.col("o_custkey"), 100.0, 5.0)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def held_out_split(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a stated split."""
    split = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return match.held_out(table(spark, d, "orders"), split, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, round(sum(coalesce(CASE l_returnflag WHEN 'A' THEN 6.94 WHEN 'N' THEN 14.007 END, 1.0) * l_quantity), 2) AS mass FROM lineitem GROUP BY 1")
def species_mass_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Masses from a dimension, a stated mass for what it lacks."""
    dim = spark.createDataFrame([("A", 6.94), ("N", 14.007)], "symbol string, mass double")
    rows = match.with_mass(table(spark, d, "lineitem"), dim, "l_returnflag")
    return rounded(rows.groupBy("l_returnflag").agg(F.sum(F.col("mass") * F.col("l_quantity")).alias("mass")), 2)


@query("SELECT page_id, coalesce(max(root), 'none') AS root FROM (SELECT page_id, root FROM pages LEFT JOIN (SELECT unnest(['com/en', 'com', 'net/es', 'org']) AS root) ON p_path(url) = root OR starts_with(p_path(url), root || '/')) GROUP BY 1".replace("p_path(url)", "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*\\.([a-z]+/[^?#]*)', 1), '/+$', '')"))
def jobs_under_roots(spark: SparkSession, d: str) -> DataFrame:
    """Each path's longest root at or above it."""
    p = table(spark, d, "pages").select("page_id", F.rtrim(F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+/[^?#]*)", 1), F.lit("/")).alias("path"))
    roots = spark.createDataFrame([("com/en",), ("com",), ("net/es",), ("org",)], "root string")
    owned = match.owner(p.select("path").distinct(), "path", roots, "root")
    return p.join(owned, "path", "left").select("page_id", F.coalesce("root", F.lit("none")).alias("root"))


@query("SELECT l_orderkey, max(l_discount) <= 0.07 AS calm FROM lineitem GROUP BY 1")
def force_split(spark: SparkSession, d: str) -> DataFrame:
    """Frames by their largest force."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("force"))
    calm, rest = frames.split_by_force(f, "force", 0.07)
    return calm.select("l_orderkey", F.lit(True).alias("calm")).unionByName(rest.select("l_orderkey", F.lit(False).alias("calm")))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE NOT (o_orderpriority = '1-URGENT' OR o_orderstatus <> 'F' OR o_custkey % 80 >= 60) END::VARCHAR, 'undecidable') AS converged FROM orders")
def convergence_three_valued(spark: SparkSession, d: str) -> DataFrame:
    """True, false or undecidable."""
    iterations = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 80)
    c = frames.converged(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", iterations, F.lit(None).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(c.cast("string"), F.lit("undecidable")).alias("converged"))


def farthest_sql(n: int) -> str:
    """Farthest points step by step, a table for each."""
    steps = [
        "e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
        "m AS (SELECT list(x ORDER BY k) AS m FROM (SELECT k, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS k FROM e) GROUP BY 1))",
        "p0 AS MATERIALIZED (SELECT vec_id, 0 AS rank, NULL::DOUBLE AS distance, v FROM e, m ORDER BY list_distance(v, m) DESC, vec_id LIMIT 1)",
    ]
    for k in range(1, n):
        near = f"SELECT e.vec_id, any_value(e.v) AS v, min(list_distance(e.v, p.v)) AS d FROM e, p{k - 1} p WHERE e.vec_id NOT IN (SELECT vec_id FROM p{k - 1}) GROUP BY 1"
        steps.append(f"p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL (SELECT vec_id, {k}, d, v FROM ({near}) ORDER BY d DESC, vec_id LIMIT 1))")
    return f"WITH {', '.join(steps)} SELECT vec_id, rank::BIGINT AS rank, round(coalesce(distance, 0), 5) AS distance FROM p{n - 1}"


@query(farthest_sql(10))
def farthest_point_selection(spark: SparkSession, d: str) -> DataFrame:
    """Ten descriptors, farthest first."""
    out = select.farthest_points(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return rounded(out.withColumn("distance", F.coalesce("distance", F.lit(0.0))), 5)


@query()
def hierarchical_culling(spark: SparkSession, d: str) -> DataFrame:
    """Chunks first, then farthest points over what is left."""
    return select.hierarchical_selection(table(spark, d, "embeddings"), "vec_id", "embedding", 20)


ALLOCATION = """(WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1), n AS (SELECT count(*) AS n FROM part),
f AS (SELECT p_type, size, least(greatest(round_even(300.0 * size / n, 0)::BIGINT, 1), size) AS t FROM s, n),
g AS (SELECT *, 300 - sum(t) OVER () AS gap FROM f),
r AS (SELECT *, sum((t < size)::INT) OVER (ORDER BY size DESC, p_type) AS up, sum((t > 1)::INT) OVER (ORDER BY size, p_type) AS down FROM g)
SELECT p_type, size, (t + (t < size AND up <= gap)::INT - (t > 1 AND down <= -gap)::INT)::BIGINT AS take FROM r)"""


@query(f"SELECT * FROM {ALLOCATION}")
def stratified_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Shares of 300, with one pass of single steps."""
    return select.allocation(table(spark, d, "part"), "p_type", 300)


@query(f"SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) JOIN {ALLOCATION} USING (p_type) WHERE r <= take")
def stratified_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows themselves."""
    return select.stratified(table(spark, d, "part"), "p_type", 300, ["p_partkey"]).select("p_type", "p_partkey")


@query()
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample that does not depend on partitions (a sampling operator)."""
    return select.uniform_sample(table(spark, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey")


@query(f"SELECT event_id FROM {RUNS} JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id) WHERE n <= 20 OR list_contains(list_transform(range(0, 20), lambda x: x * n // 20), i)")
def thinned_series(spark: SparkSession, d: str) -> DataFrame:
    """20 places of each run (a sampling operator)."""
    return select.thinned(runs(spark, d), ["user_id"], "i", 20).select("event_id")


@query("SELECT o_orderkey, c.metric, c.value FROM (SELECT o_orderkey, unnest([{'metric': 'a_mse', 'value': o_totalprice - 100000}, {'metric': 'b', 'value': o_custkey::DOUBLE}]) AS c FROM orders)")
def learning_curve_long(spark: SparkSession, d: str) -> DataFrame:
    """Wide metrics to a long table."""
    wide = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("a_mse"), F.col("o_custkey").alias("b"))
    return frames.wide_to_long(wide, ["o_orderkey"], ["a_mse", "b"])


@query("SELECT o_orderkey, round(sqrt(o_totalprice - 100000), 4) AS value FROM orders WHERE o_totalprice >= 100000")
def root_of_squares(spark: SparkSession, d: str) -> DataFrame:
    """Roots of squared metrics; negative ones have none."""
    long = frames.wide_to_long(table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("a_mse")), ["o_orderkey"], ["a_mse"])
    return rounded(frames.root_metrics(long).where("metric = 'a_rmse'").select("o_orderkey", "value"))


# --- texts and rules ----------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(x) AS n, round(coalesce(list_sum(list_filter(x, lambda v: abs(v) < 1e6)), 0), 4) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?'), lambda v: try_cast(v AS DOUBLE)) AS x FROM documents)".replace("\\\\", "\\"))
def float_extraction(spark: SparkSession, d: str) -> DataFrame:
    """all numbers of a text, with signs, decimals and exponents; the sum leaves out what is as large as a million."""
    found = text.floats(F.col("text"))
    small = F.filter(found, lambda x: F.abs(x) < 1e6)
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.round(F.aggregate(small, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT page_id, nullif(regexp_extract(url, '([^/]+)/[^/]*$', 1), '') AS parent, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def path_parse(spark: SparkSession, d: str) -> DataFrame:
    """Parts of paths."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("url", r"([^/]+)/[^/]*$", 1), F.lit("")).alias("parent"), text.base_name(F.col("url")).alias("name"))


@query("SELECT page_id, ltrim(regexp_extract(url, '://(.*)$', 1), 'w.') AS name FROM pages")
def strip_characters(spark: SparkSession, d: str) -> DataFrame:
    """Leading characters of a set."""
    return table(spark, d, "pages").select("page_id", text.strip_leading(F.regexp_extract("url", r"://(.*)$", 1), "w.").alias("name"))


@query("SELECT s_suppkey, least(s_name, n_name) || '-' || greatest(s_name, n_name) AS pair FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def unordered_pair_key(spark: SparkSession, d: str) -> DataFrame:
    """A key of two names in either order."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(n, "s_nationkey").select("s_suppkey", text.pair_key(F.col("s_name"), F.col("n_name")).alias("pair"))


@query("SELECT doc_id, k AS key, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) l, (SELECT unnest(['the', 'de']) AS k) WHERE contains(lower(line), k) GROUP BY 1, 2")
def text_lines_matching(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a file that hold a word, as an explode and a filter."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    keys = F.array_compact(F.array(*[F.when(text.matches_any(F.col("line"), [k.upper()]), F.lit(k)) for k in ("the", "de")]))
    return rows.select("doc_id", F.explode(keys).alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))


GRID = "[" + ", ".join(f"greatest(1, floor(25.0 / (p_size + {k}) + 0.5))::INT" for k in ("1.0", "4.0", "9.0")) + "]"


@query(f"SELECT p_partkey, array_to_string(g, 'x') AS grid, g[1] * g[2] * g[3] AS n, CASE WHEN p_size + 1.0 > 15 THEN 'Gamma' ELSE 'Monkhorst-Pack' END AS mesh FROM (SELECT p_partkey, p_size, {GRID} AS g FROM part)")
def kpoint_rule(spark: SparkSession, d: str) -> DataFrame:
    """F04."""
    lengths = F.array(F.col("p_size") + 1.0, F.col("p_size") + 4.0, F.col("p_size") + 9.0)
    out = table(spark, d, "part").select("p_partkey", rules.kpoint_grid(lengths).alias("g"), rules.mesh_type(lengths).alias("mesh"))
    return out.select("p_partkey", F.array_join(F.transform("g", lambda n: n.cast("string")), "x").alias("grid"), rules.kpoint_count(F.col("g")).alias("n"), "mesh")


@query(
    """SELECT p_partkey, round(greatest(0.5, least(15.0, 2.0 * pow(50.0 / p_size, 0.6) * pow(p_retailprice / 300.0, 0.5))), 6) AS gamma, round(greatest(0.2, least(2.0, sqrt(300.0 / p_retailprice) * sqrt(p_size / 16.0))), 6) AS dt,
 round(greatest(800.0, least(5000.0, 1000.0 * greatest(0.5, least(3.0, p_size / 50.0)) * greatest(0.5, least(2.0, p_retailprice / 300.0)))), 6) AS pmass, round(greatest(1.0, least(10.0, 3.0 * greatest(0.5, least(3.0, p_size / 50.0)))), 6) AS gamma_l FROM part"""
)
def friction_rule(spark: SparkSession, d: str) -> DataFrame:
    """frictions, time step and piston mass."""
    mass, t = F.col("p_size").cast("double"), F.col("p_retailprice")
    out = table(spark, d, "part").select("p_partkey", rules.friction(mass, F.lit(50.0), t).alias("gamma"), rules.time_step(mass, t).alias("dt"), rules.piston_mass(mass, t).alias("pmass"), rules.lattice_friction(mass).alias("gamma_l"))
    return rounded(out, 6)


@query("SELECT p_partkey, 3 * p_size - 3 AS dof, round(pow(33356.4095198152 / 400 * 1e-15 / 6.283185307179586, 2) * 2.0 * (3 * p_size - 3) * 1.380649e-23 * p_retailprice / (1.66053906660e-27 * pow(5e-10, 2)), 6) AS smass FROM part")
def nose_mass_rule(spark: SparkSession, d: str) -> DataFrame:
    """F06."""
    dof = rules.degrees_of_freedom(F.col("p_size"))
    return rounded(table(spark, d, "part").select("p_partkey", dof.alias("dof"), rules.nose_mass(dof, F.col("p_retailprice"), rules.period_fs(F.lit(400.0)), F.lit(5.0)).alias("smass")), 6)


@query(
    """SELECT p_partkey, greatest(1, least(CASE WHEN n <= 100 THEN CASE WHEN k >= 64 THEN 8 ELSE 4 END ELSE CASE WHEN k >= 64 THEN 4 ELSE 2 END END,
 k // CASE WHEN n <= 100 THEN CASE WHEN k >= 64 THEN 8 ELSE 4 END ELSE CASE WHEN k >= 64 THEN 16 ELSE 9 END END, k))::INT AS kpar,
 CASE WHEN n <= 50 AND k >= 64 THEN 8 WHEN n <= 100 THEN 4 ELSE 2 END AS ncore, CASE WHEN n <= 50 AND k >= 64 THEN 4 WHEN n <= 100 THEN 8 ELSE 16 END AS npar
FROM (SELECT p_partkey, p_size * 4 AS n, p_partkey % 150 AS k FROM part)"""
)
def layout_rule(spark: SparkSession, d: str) -> DataFrame:
    """F07."""
    return table(spark, d, "part").select("p_partkey", rules.layout(F.col("p_size") * 4, F.col("p_partkey") % 150, 32).alias("l")).select("p_partkey", "l.kpar", "l.ncore", "l.npar")


@query("SELECT l_orderkey, string_agg(l_returnflag || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END, '' ORDER BY l_returnflag) AS formula, round(sum(n * CASE l_returnflag WHEN 'A' THEN 7 WHEN 'N' THEN 6 ELSE 9 END)::DOUBLE - 1, 4) AS nelect FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def formula_and_electrons(spark: SparkSession, d: str) -> DataFrame:
    """F08."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    z = F.when(F.col("l_returnflag") == "A", 7.0).when(F.col("l_returnflag") == "N", 6.0).otherwise(9.0)
    per = c.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "n", z.alias("z")))).alias("s"))
    return per.select("l_orderkey", rules.formula(F.col("s.l_returnflag"), F.col("s.n")).alias("formula"), rules.electrons(F.col("s.n"), F.col("s.z"), F.lit(1.0)).alias("nelect"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cli' WHEN o_orderkey % 2 = 0 THEN 'script' ELSE 'disk' END AS source FROM orders")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """the command line before the script before the disk."""
    k = F.col("o_orderkey")
    none = F.create_map().cast("map<string,string>")
    one = lambda v: F.create_map(F.lit("K"), F.lit(v))
    m = rules.merged_settings(one("disk"), F.when(k % 2 == 0, one("script")).otherwise(none), F.when(k % 3 == 0, one("cli")).otherwise(none))
    return table(spark, d, "orders").select("o_orderkey", m["K"].alias("source"))


@query("SELECT p_partkey, -10.0 + 2.5 * i AS strain, round(pow(1 + (-10.0 + 2.5 * i) / 100, 1.0 / 3.0), 6) AS scale, printf('V_%+05.1f%%', -10.0 + 2.5 * i) AS tag, round((p_size + 80.0) * (1 + (-10.0 + 2.5 * i) / 100), 6) AS volume FROM part, range(9) t(i)")
def volume_strain_grid(spark: SparkSession, d: str) -> DataFrame:
    """nine strained volumes of every structure."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 80.0).alias("volume"))
    return rounded(eos.strain_grid(p, "volume", -10.0, 10.0, 9), 6)


def cells(p: DataFrame) -> Column:
    z = F.lit(0.0)
    return F.array(F.col("p_size") + 1.0, z, z, F.lit(1.0), F.col("p_size") + 2.0, z, z, F.lit(0.5), F.col("p_size") + 3.0)


@query("SELECT p_partkey, round(0.25 * (p_size + 1.0) + 0.5, 6) AS x, round(0.5 * (p_size + 2.0) + 0.375, 6) AS y, round(0.75 * (p_size + 3.0), 6) AS z, round((p_size + 1.0) * (p_size + 2.0) * (p_size + 3.0), 4) AS volume FROM part")
def fractional_to_cartesian(spark: SparkSession, d: str) -> DataFrame:
    """rows times the lattice, and the volume."""
    p = table(spark, d, "part")
    p = p.select("p_partkey", cells(p).alias("cell"))
    c = p.withColumn("r", geometry.to_cartesian(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("cell")))
    return c.select("p_partkey", *[F.round(F.col("r")[k], 6).alias(n) for k, n in enumerate("xyz")], F.round(geometry.volume(F.col("cell")), 4).alias("volume"))


@query("SELECT p_partkey, 0.25 AS x, 0.5 AS y, 0.75 AS z FROM part")
def cartesian_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """there and back."""
    p = table(spark, d, "part")
    p = p.select("p_partkey", cells(p).alias("cell"))
    there = geometry.to_cartesian(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("cell"))
    back = p.withColumn("s", there).withColumn("s", geometry.to_fractional(F.col("s"), F.col("cell")))
    return back.select("p_partkey", *[F.round(F.col("s")[k], 6).alias(n) for k, n in enumerate("xyz")])


@query("SELECT l_orderkey, l_linenumber + 100 * c AS idx, round((0.1 * l_linenumber + c) / 2, 6) AS x FROM lineitem, (SELECT unnest([0, 1]) AS c)".replace("100 * c", "n * c").replace("FROM lineitem,", "FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),"))
def supercell_repeat(spark: SparkSession, d: str) -> DataFrame:
    """two copies along the first axis, copy by copy."""
    z, one = F.lit(0.0), F.lit(1.0)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("idx"), F.array(0.1 * F.col("l_linenumber"), z, z).alias("frac"), F.array(one, z, z, z, one, z, z, z, one).alias("cell"))
    out = frames.repeat_atoms(rows, ["l_orderkey"], (2, 1, 1), "idx", "frac", "cell")
    return out.select("l_orderkey", "idx", F.round(F.col("frac")[0], 6).alias("x"))


@query("SELECT l_orderkey, round(max(l_quantity) - min(l_quantity) + 2.0, 6) AS a FROM lineitem GROUP BY 1")
def tight_cell(spark: SparkSession, d: str) -> DataFrame:
    """a padded cell around the atoms."""
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array(F.min("l_quantity"), F.lit(0.0), F.lit(0.0)).alias("low"), F.array(F.max("l_quantity"), F.lit(0.0), F.lit(0.0)).alias("high"))
    return e.select("l_orderkey", F.round(geometry.bounding_cell(F.col("low"), F.col("high"), 1.0)[0], 6).alias("a"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax * 100 + l_discount * 100) / 3, 6) AS mean, round(sqrt(0.5 * ((l_quantity - l_tax * 100) ** 2 + (l_tax * 100 - l_discount * 100) ** 2 + (l_discount * 100 - l_quantity) ** 2) + 3.0 * (l_discount ** 2 + l_tax ** 2 + 1)), 6) AS mises FROM lineitem")
def stress_projection(spark: SparkSession, d: str) -> DataFrame:
    """Six components of a flat tensor, their mean and equivalent stress."""
    q, t, s, o = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.lit(1.0)
    nine = F.array(q, o, t, o, t * 100, s, t, s, s * 100)
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.voigt(nine).alias("v"))
    return rounded(v.select("l_orderkey", "l_linenumber", geometry.hydrostatic(F.col("v")).alias("mean"), geometry.von_mises(F.col("v")).alias("mises")), 6)


@query("SELECT user_id, start, \"end\", n FROM (SELECT user_id, g, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, (coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true))::INT AS new FROM events)) GROUP BY 1, 2)")
def session_activity(spark: SparkSession, d: str) -> DataFrame:
    """2.9: sessions that a gap of half an hour ends."""
    return ingest.sessions(table(spark, d, "events"), "ts", ["user_id"], "30 minutes")




from . import file_queries  # noqa: E402, F401  (adds its queries to the same tables)
