"""Matching: prioritised strategies, tolerances, prefixes, dimensions and owners."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.storage import scratch
from ..sources.ranges import located
from .series import ordered, placed

#: Characters of the needles that an automaton holds at once, and blocks of them before they grow to that.
BLOCK_CHARS = 1 << 20
BLOCKS = 16
#: Characters of the texts that a task reads.
TEXT_CHARS = 32 << 20
#: Pairs of one token that a task makes, and most tasks for the pairs of all: for each core, and in all.
PAIRS = 1 << 24
TASKS_A_CORE, TASKS = 32, 4096


def prioritised(left: DataFrame, right: DataFrame, left_id: str, right_id: str, strategies: list[tuple[str, list[tuple[str, str]]]], variant: str | None = None) -> DataFrame:
    """At most one match for each left row: left_id, right_id, strategy; both null where no strategy matches.

    strategies, best first: a name and pairs of columns that are equal. Each is an equi-join; of several hits the best
    strategy wins and then, by right_id, the one at the 0-based place `variant` of the left row, or the first where that is out of range.
    """
    hits = None
    for priority, (name, columns) in enumerate(strategies):
        keys = [f"_k{i}" for i in range(len(columns))]
        known = [F.col(k).isNotNull() for k in keys]
        a = left.select(F.col(left_id).alias("_l"), *[F.col(x).alias(k) for k, (x, _) in zip(keys, columns, strict=True)], (F.col(variant).cast("int") if variant else F.lit(0)).alias("_v")).where("_v IS NOT NULL").where(reduce(and_, known))
        b = right.select(F.col(right_id).alias("_r"), *[F.col(y).alias(k) for k, (_, y) in zip(keys, columns, strict=True)]).where(reduce(and_, known)).distinct()
        found = _hits(a, b, keys).withColumns({"_p": F.lit(priority), "strategy": F.lit(name)})
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("_l", "_v", "_p", "strategy").agg(F.max("_r").alias("_one"), F.array_sort(F.collect_set("_r")).alias("_all"), F.max("_m").alias("_m"))
    chosen = F.when(F.col("_m") == 1, F.col("_one")).otherwise(F.coalesce(F.get("_all", F.col("_v")), F.get("_all", F.lit(0))))
    out = best.groupBy("_l", "_v").agg(F.min_by(F.struct(chosen.alias("_c"), "strategy"), "_p").alias("_b"))
    return left.select(left_id).join(out.select(F.col("_l").alias(left_id), F.col("_b._c").alias(right_id), "_b.strategy"), left_id, "left")


def _hits(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """_l, _v, _m, _r: of each left row's hits the first and that at its place, never all: right rows are numbered within their keys, and
    places are joined. _m counts the keys of an id; where an id has several, these are the hits up to the place."""
    ranked = placed(b.withColumn("_n", F.col("_r").isNull()), [*keys, "_n", "_r"], "_at")
    first = ranked.groupBy(*keys).agg(F.min("_at").alias("_first"))
    ranked = ranked.join(first, keys).select(*keys, "_r", (F.col("_at") - F.col("_first")).alias("_place"))
    most = ranked.agg(F.max("_place")).first()[0] or 0
    zero, at = F.lit(0).cast("long"), F.greatest(F.col("_v"), F.lit(0)).cast("long")
    places = F.when(F.col("_m") == 1, F.array_distinct(F.array(zero, at))).otherwise(F.sequence(zero, F.least(at, F.lit(most).cast("long"))))
    own = a.groupBy("_l", "_v").agg(F.collect_set(F.struct(*keys)).alias("_ks"))
    wanted = own.select("_l", "_v", F.size("_ks").alias("_m"), F.explode("_ks").alias("_k")).select("_l", "_v", "_m", "_k.*").withColumn("_place", F.explode(places))
    asked = wanted.select(*keys, "_place").distinct()
    return wanted.join(ranked.join(asked, [*keys, "_place"], "left_semi"), [*keys, "_place"]).select("_l", "_v", "_m", "_r")


def shared_tokens(left: DataFrame, right: DataFrame, left_id: str, right_id: str, needle: str, token_pattern: str, haystack: str) -> DataFrame:
    """Left rows whose needle is one of the tokens of a right row's text (either case), as an equi-join on exploded tokens.

    A frequent token's pairs are made by many tasks, a grid: left rows are dealt to its rows and right ones to its columns, and each is
    repeated along the other side. How many places there are depends on the cores and not on the tables, so what is shuffled grows with the tables.
    """
    a = left.select(F.col(left_id), F.lower(needle).alias("_t")).where("_t IS NOT NULL")
    b = right.select(F.col(right_id), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(haystack), F.lit(f"({token_pattern})"), F.lit(1)))).alias("_t"))
    counts = a.groupBy("_t").agg(F.count(F.lit(1)).alias("_a")).join(b.groupBy("_t").agg(F.count(F.lit(1)).alias("_b")), "_t")
    pairs = F.col("_a").cast("double") * F.col("_b")
    total, most = counts.agg(F.sum(pairs), F.max(pairs)).first()
    limit = min(TASKS, TASKS_A_CORE * left.sparkSession.sparkContext.defaultParallelism)
    share = max(PAIRS, (total or 0) / limit)
    if (most or 0) <= share:
        return a.join(b, "_t").select(left_id, right_id)
    # Fewer tokens than there are tasks have more than a share.
    size = F.ceil(pairs / share)
    down = F.least(size, F.greatest(F.lit(1), F.round(F.sqrt(size * F.col("_a") / F.col("_b"))))).cast("int")
    grid = F.broadcast(counts.where(pairs > share).select("_t", down.alias("_down"), F.ceil(size / down).cast("int").alias("_across")))
    tasks = min(TASKS, math.ceil(total / share) + left.sparkSession.sparkContext.defaultParallelism)

    def dealt(side: DataFrame, id: str, own: str, other: str) -> DataFrame:
        one = F.pmod(F.xxhash64(F.col(id).cast("string")), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return side.join(grid, "_t", "left").select(id, "_t", one.alias(f"{own}_at"), every.alias(f"{other}_at")).repartition(tasks, "_t", "_down_at", "_across_at")

    return dealt(a, left_id, "_down", "_across").join(dealt(b, right_id, "_across", "_down"), ["_t", "_down_at", "_across_at"]).select(left_id, right_id)


def containment(left: DataFrame, right: DataFrame, left_id: str, right_id: str, needle: str, haystack: str, block_chars: int = BLOCK_CHARS, rows_a_batch: int = 1 << 14) -> DataFrame:
    """left_id, right_id: left rows whose needle occurs anywhere in a right row's text, in either case (A-Z and whatever else Spark lower-cases).

    The distinct needles are written in blocks of block_chars characters, or of more (BLOCK_CHARS at most) where these would be over
    BLOCKS; tasks read a block, and the texts are streamed through its Aho-Corasick automaton, one pass of the texts a block, so work
    follows texts and hits, never pairs, and the driver has no needles. Rows that share a needle meet it afterwards, in a join. Null and
    empty needles occur in nothing; equal ids count as rows of their own.
    """
    import ahocorasick

    spark = left.sparkSession
    words = left.select(F.lower(F.col(f"`{needle}`").cast("string")).alias("_t")).where("length(_t) > 0").distinct()
    texts = right.select(F.col(f"`{right_id}`").alias("_r"), F.lower(F.col(f"`{haystack}`").cast("string")).alias("_h"))
    kind = texts.schema["_r"].dataType.simpleString()
    id_type = to_arrow_type(texts.schema["_r"].dataType)
    chars = words.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = max(1, -(-chars // max(block_chars, min(BLOCK_CHARS, -(-chars // BLOCKS)))))
    folder = scratch(spark, "needles")
    words.withColumn("_b", F.pmod(F.xxhash64("_t"), F.lit(blocks)).cast("int")).repartition("_b").write.partitionBy("_b").parquet(folder)
    found = sorted(r._b for r in spark.read.schema("_t string, _b int").parquet(folder).select("_b").distinct().collect())
    size = texts.agg(F.sum(F.length("_h"))).first()[0] or 0
    texts = texts.repartition(max(spark.sparkContext.defaultParallelism, size // TEXT_CHARS))

    def passed(number: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = located(f"{folder}/_b={number}")
            block = dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=["_t"]).column("_t").to_pylist()
            automaton = ahocorasick.Automaton()
            for k, word in enumerate(block):
                automaton.add_word(word, k)
            automaton.make_automaton()
            for batch in batches:
                place, found = [], []
                for row, text in enumerate(batch.column("_h").to_pylist()):
                    hits = {k for _, k in automaton.iter(text)} if text else ()
                    place += [row] * len(hits)
                    found += [block[k] for k in hits]
                    if len(found) >= rows_a_batch:
                        yield pa.RecordBatch.from_arrays([batch.column("_r").take(pa.array(place, pa.int64())).cast(id_type), pa.array(found, pa.string())], names=["_r", "_t"])
                        place, found = [], []
                yield pa.RecordBatch.from_arrays([batch.column("_r").take(pa.array(place, pa.int64())).cast(id_type), pa.array(found, pa.string())], names=["_r", "_t"])

        return texts.mapInArrow(run, f"_r {kind}, _t string")

    hits = reduce(DataFrame.unionByName, map(passed, found)) if found else None
    if hits is None:
        hits = texts.select("_r", F.lit(None).cast("string").alias("_t")).where("false")
    asked = left.select(F.col(f"`{left_id}`").alias("_l"), F.lower(F.col(f"`{needle}`").cast("string")).alias("_t"))
    return asked.join(hits, "_t").select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


def unmatched(left: DataFrame, matches: DataFrame, left_id: str) -> DataFrame:
    return left.join(matches.where(F.col("strategy").isNotNull()).select(left_id), left_id, "left_anti")


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def temperature_matches(begin: Column, end: Column, folder: Column, target: float, tolerance: float) -> Column:
    """Whether a run is at a temperature: its end temperature if both are set, else the one there is, or the folder's."""
    return within(F.coalesce(end, begin), F.lit(target), tolerance) | within(folder, F.lit(target), tolerance)


def beside(left: DataFrame, right: DataFrame, directory: str, how: str = "left") -> DataFrame:
    """Rows of files in the same directory; a left row without a partner keeps nulls."""
    return left.join(right, directory, how)


def has_both(files: DataFrame, directory: str, name: str, wanted: list[str]) -> DataFrame:
    """Directories that hold all of the wanted files."""
    found = files.where(F.col(name).isin(wanted)).groupBy(directory).agg(F.count_distinct(name).alias("_n"))
    return found.where(F.col("_n") == len(wanted)).select(directory)


def under_roots(df: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows paired with every root at or above their path: an equi-join on the prefixes of the path."""
    parts = F.split(F.rtrim(F.col(path), F.lit("/")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return df.withColumn("_p", F.explode(prefixes)).join(roots.select(F.col(root), F.rtrim(F.col(root), F.lit("/")).alias("_p")), "_p").drop("_p")


def owner(df: DataFrame, path: str, roots: DataFrame, root: str, rule: str = "longest", listed: str | None = None) -> DataFrame:
    """One root for each row: the 'first' one listed, or the 'longest' (which leaves the shortest relative path)."""
    pairs = under_roots(df, path, roots if listed is None else roots.select(root), root)
    if rule == "first":
        pairs = pairs.join(roots.select(root, F.col(listed).alias("_place")), root)
        best = F.min_by(root, F.struct("_place", root))
    else:
        best = F.max_by(root, F.struct(F.length(root), root))
    return pairs.groupBy(path).agg(best.alias(root))


def with_symbols(df: DataFrame, kinds: DataFrame, kind: str, symbol: str, inferred: str | None = None, fallback: str | None = None) -> DataFrame:
    """Symbols of atom types from a dimension, else from a column of the row, else a fallback (null without one).

    Callers that are strict look for nulls, see unmapped.
    """
    out = df.join(kinds.select(kind, F.col(symbol).alias("_dim")), kind, "left")
    sources = [F.col("_dim"), *([F.col(inferred)] if inferred else []), *([F.lit(fallback)] if fallback else [])]
    return out.withColumn(symbol, F.coalesce(*sources)).drop("_dim")


def conflicts(df: DataFrame, kind: str, symbol: str) -> DataFrame:
    """Types that rows name by more than one symbol."""
    return df.groupBy(kind).agg(F.array_sort(F.collect_set(symbol)).alias("symbols")).where(F.size("symbols") > 1)


def with_mass(df: DataFrame, elements: DataFrame, symbol: str, missing: float = 1.0) -> DataFrame:
    """Masses from an element table; elements that it lacks get a stated mass."""
    return df.join(elements.select(F.col("symbol").alias(symbol), "mass"), symbol, "left").withColumn("mass", F.coalesce("mass", F.lit(missing)))


def per_run(df: DataFrame, settings: DataFrame, run: list[str]) -> DataFrame:
    """Attributes of a run (time step, electronic limit, temperature) on each of its rows."""
    return df.join(settings, run, "left")


def held_out(df: DataFrame, indices: DataFrame, key: str) -> DataFrame:
    """The rows of a stated split."""
    return df.join(indices.select(key), key, "left_semi")


def engine_pairs(runs: DataFrame, bucket: list[str], engine: str, order: list[str], first: str = "VASP", second: str = "LAMMPS") -> DataFrame:
    """Runs of one bucket (temperature, else directory) side by side, one engine first."""
    keep = F.struct(*[c for c in runs.columns if c not in bucket])
    a = runs.where(F.col(engine) == first).groupBy(*bucket).agg(F.min_by(keep, F.struct(*order)).alias(first.lower()))
    b = runs.where(F.col(engine) == second).groupBy(*bucket).agg(F.min_by(keep, F.struct(*order)).alias(second.lower()))
    return a.join(b, bucket, "full")


def ranked_frames(frames: DataFrame, picks: DataFrame, key: list[str], rank: str = "rank") -> DataFrame:
    """Frames of a selection with their rank in it."""
    return frames.join(picks.select(*key, rank), key)


def choose_file(files: DataFrame, directory: str, name: str, patterns: list[str], avoid: str | None = None) -> DataFrame:
    """One file for each directory: of the first pattern that any name matches, without `avoid` if possible, the last in order."""
    place = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        place = F.when(F.col(name).rlike(p), i).otherwise(place)
    shunned = F.col(name).contains(avoid) if avoid else F.lit(False)
    ranked = files.withColumn("_p", place).where("_p IS NOT NULL").withColumn("_s", shunned)
    best = F.row_number().over(ordered([directory], ["_p", "_s", F.col(name).desc()]))
    return ranked.withColumn("_r", best).where("_r = 1").drop("_p", "_s", "_r")


def first_appearance(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first appear."""
    return df.groupBy(value).agg(F.min(order).alias("first")).orderBy("first", value)
