"""Pairs of atoms of one frame under periodic boundaries.

A frame's cell is cut into bins as wide as the cut-off at least. Each atom is sent to its own bin and to one of each two opposite
neighbours, across the cell's faces too, and the join is on (frame, bin): work grows with the number of near pairs, and a large frame is many keys.
In a cell that is less than three bins wide opposite neighbours may be the same, so an atom is sent to all bins around, to each once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import exact_image_distance, heights, image_distance, volume

#: Bins along an axis: their numbers stay within 63 bits.
MOST_BINS = 1 << 20


def frame_pairs(atoms: DataFrame, frame: list[str], cutoff: float, exact: bool = False, idx: str = "idx", symbol: str = "symbol", frac: str = "frac", cell: str = "cell") -> DataFrame:
    """All pairs i < j of each frame nearer than the cut-off: frame, i, j, symbol_i, symbol_j, distance.

    A frame without a cell, and an atom without a position, have no pairs.
    """
    bins = F.transform(heights(F.col(cell)), lambda h: F.greatest(F.lit(1), F.least(F.lit(MOST_BINS), F.floor(h / cutoff * (1 - 1e-9)))).cast("long"))
    placed = atoms.where(F.col(cell).isNotNull() & F.col(frac).isNotNull()).withColumn("_n", bins)
    placed = placed.withColumn("_at", F.zip_with(F.col(frac), "_n", lambda x, n: F.pmod(F.floor(x * n).cast("long"), n)))
    number = lambda at, n: (at[0] * n[1] + at[1]) * n[2] + at[2]
    steps = lambda moves: F.array(*[F.array(*[F.lit(d).cast("long") for d in move]) for move in moves])
    near = lambda moves: F.transform(steps(moves), lambda m: number([F.pmod(F.col("_at")[k] + m[k], F.col("_n")[k]) for k in range(3)], F.col("_n")))
    wide = F.array_min("_n") >= 3
    placed = placed.withColumn("_home", number(F.col("_at"), F.col("_n"))).withColumn("_wide", wide)
    # Bins around a bin come in opposite pairs, so in a cell that is three bins wide one of each pair finds all; in a narrower one the two may be the same.
    one_way = [m for m in _moves(3) if m >= (0, 0, 0)]
    around = F.when(F.aggregate("_n", F.lit(1).cast("long"), lambda x, n: x * n) == 1, F.array(F.lit(0).cast("long"))).when(F.col("_wide"), near(one_way)).otherwise(F.array_distinct(near(_moves(3))))
    a = placed.select(*frame, F.col(idx).alias("i"), F.col(symbol).alias("symbol_i"), F.col(frac).alias("_a"), F.col(cell).alias("_cell"), "_home", "_wide", F.explode(around).alias("_bin"))
    b = placed.select(*frame, F.col(idx).alias("j"), F.col(symbol).alias("symbol_j"), F.col(frac).alias("_b"), F.col("_home").alias("_bin"))
    measure = exact_image_distance if exact else image_distance
    met = a.join(b, [*frame, "_bin"]).where((F.col("i") < F.col("j")) | (F.col("_wide") & (F.col("_bin") != F.col("_home"))))
    met = met.withColumn("distance", measure(F.col("_a"), F.col("_b"), F.col("_cell"))).where(F.col("distance") < cutoff)
    turned = F.col("i") > F.col("j")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    return met.select(*frame, pick("i", "j", "i"), pick("symbol_i", "symbol_j", "symbol_i"), pick("j", "i", "j"), pick("symbol_j", "symbol_i", "symbol_j"), "distance")


def binned_pairs(points: DataFrame, frame: list[str], cutoff: float, axes: list[str], idx: str = "idx") -> DataFrame:
    """Pairs i < j nearer than the cut-off in open space, by bins as wide as the cut-off: frame, i, j, distance.

    Each point meets the points of its own and neighbouring bins only, so work grows with the number of near pairs.
    """
    cells = [F.floor(F.col(a) / cutoff).cast("long") for a in axes]
    home = points.select(*frame, F.col(idx).alias("j"), *[F.col(a).alias(f"_b{k}") for k, a in enumerate(axes)], F.array(*cells).alias("bin"))
    steps = F.array(*[F.array(*[F.lit(d) for d in move]) for move in _moves(len(axes))])
    around = points.select(*frame, F.col(idx).alias("i"), *[F.col(a).alias(f"_a{k}") for k, a in enumerate(axes)], F.array(*cells).alias("_home"), F.explode(steps).alias("_move"))
    around = around.withColumn("bin", F.zip_with("_home", "_move", lambda x, d: x + d)).drop("_home", "_move")
    distance = F.sqrt(sum((F.pow(F.col(f"_a{k}") - F.col(f"_b{k}"), 2) for k in range(1, len(axes))), F.pow(F.col("_a0") - F.col("_b0"), 2)))
    return around.join(home, [*frame, "bin"]).where("i < j").withColumn("distance", distance).where(F.col("distance") < cutoff).select(*frame, "i", "j", "distance")


def _moves(n: int) -> list[tuple[int, ...]]:
    return [(d, *rest) for d in (-1, 0, 1) for rest in (_moves(n - 1) if n > 1 else [()])]


def pair_histogram(pairs: DataFrame, by: list[str | Column], distance: str, width: float, bins: int) -> DataFrame:
    """Number of pairs in each bin of distance; the last bin takes what rounds beyond it."""
    return pairs.groupBy(*by, F.least(F.floor(F.col(distance) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))


def radial_distribution(atoms: DataFrame, run: list[str], frame: str, r_max: float, width: float, idx: str = "idx", symbol: str = "symbol", frac: str = "frac", cell: str = "cell") -> DataFrame:
    """g(r) of each run, for all pairs and for each pair of species: run, pair ('total' or 'A-B'), bin, r, g.

    The volume is the mean over the frames given; r_max is to be less than half the cell. Channels without pairs have no row, empty bins of others have g = 0.
    """
    bins = int(math.ceil(r_max / width))
    pairs = frame_pairs(atoms, [*run, frame], r_max, idx=idx, symbol=symbol, frac=frac, cell=cell)
    name = F.concat_ws("-", F.least("symbol_i", "symbol_j"), F.greatest("symbol_i", "symbol_j"))
    named = pairs.withColumn("pair", F.explode(F.array(F.lit("total"), name)))
    counts = pair_histogram(named, [*run, "pair"], "distance", width, bins)
    per_frame = atoms.groupBy(*run, frame).agg(F.first(volume(F.col(cell))).alias("_v"), F.count(F.lit(1)).alias("_n"))
    whole = per_frame.groupBy(*run).agg(F.avg("_v").alias("_volume"), F.count(F.lit(1)).alias("_frames"))
    species = atoms.groupBy(*run, frame, symbol).agg(F.count(F.lit(1)).alias("_m")).groupBy(*run, symbol).agg(F.max("_m").alias("_m"))
    left, right = species.toDF(*run, "_s", "_ms"), species.toDF(*run, "_t", "_mt")
    channels = left.join(right, run).where("_s <= _t").select(*run, F.concat_ws("-", "_s", "_t").alias("pair"), F.when(F.col("_s") == F.col("_t"), F.col("_ms") * (F.col("_ms") - 1) / 2).otherwise(F.col("_ms") * F.col("_mt")).alias("_pairs"))
    total = per_frame.groupBy(*run).agg(F.max("_n").alias("_n")).select(*run, F.lit("total").alias("pair"), (F.col("_n") * (F.col("_n") - 1) / 2).alias("_pairs"))
    channels = channels.unionByName(total)
    shell = 4.0 / 3.0 * math.pi * (F.pow((F.col("bin") + 1) * width, F.lit(3.0)) - F.pow(F.col("bin") * width, F.lit(3.0)))
    seen = counts.select(*run, "pair").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = seen.join(counts, [*run, "pair", "bin"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    out = counts.join(whole, run).join(channels, [*run, "pair"]).where("_pairs > 0")
    return out.select(*run, "pair", "bin", ((F.col("bin") + 0.5) * width).alias("r"), (F.col("pairs") * F.col("_volume") / (F.col("_frames") * F.col("_pairs") * shell)).alias("g"))


def close_contacts(atoms: DataFrame, frame: list[str], limit: float, tighter: float, idx: str = "idx", frac: str = "frac", cell: str = "cell") -> DataFrame:
    """Each frame with its verdict: 'keep' without a pair nearer than the limit, else 'close' or, nearer than the tighter limit, 'too_close'.

    An atom's own images count: a lattice vector shorter than a limit is a contact.
    """
    from ..functions.geometry import lattice_lengths

    near = frame_pairs(atoms, frame, limit, exact=True, idx=idx, symbol=idx, frac=frac, cell=cell).groupBy(*frame).agg(F.min("distance").alias("_pair"))
    frames = atoms.groupBy(*frame).agg(F.first(F.array_min(lattice_lengths(F.col(cell)))).alias("_own"))
    least = F.least("_own", "_pair")
    return frames.join(near, frame, "left").select(*frame, F.when(least < tighter, "too_close").when(least < limit, "close").otherwise("keep").alias("verdict"))


def select_pairs(df: DataFrame, pair: str, species: str, explicit: list[str] | None = None) -> DataFrame:
    """Channels named explicitly (in either order), else those that hold a species."""
    ends = F.split(pair, "-")
    if explicit:
        wanted = ["-".join(sorted(p.split("-"))) for p in explicit]
        return df.where(F.array_join(F.array_sort(ends), "-").isin(wanted))
    return df.where(F.array_contains(ends, species))
