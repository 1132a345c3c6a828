"""Selection: farthest-point sampling, culling, allocation and sampling."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ordered


#: Vectors that a task selects from at once.
CHUNK_ROWS = 1000
#: Vectors that a round of farthest-point selection looks at on the driver.
AHEAD = 64


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def apart(a: list[float], b: list[float]) -> float:
    """What distance gives, added up in the same order."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def centroid(df: DataFrame, vector: str) -> list[float]:
    """Mean of all vectors, component by component (one row to the driver)."""
    places = df.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("k")
    return [r.m for r in places.collect()]


def farthest_points(df: DataFrame, ordinal: str, vector: str, n: int, checkpoint_every: int = 20, ahead: int = AHEAD) -> DataFrame:
    """Greedy k-centre selection: ordinal, rank, distance to what was picked before.

    The first pick is the farthest from the centroid; of equal distances the smallest ordinal is taken. A round brings the
    `ahead` farthest vectors to the driver and picks among them as long as the best of them is farther than any vector that was
    left behind can be, for distances only shrink; then the tasks get all these picks at once. The distances stay distributed.
    The lineage is cut every few rounds. With n at or above the number of rows, all are kept in order.
    """
    from ..plans.storage import cut_lineage

    spark = df.sparkSession
    if df.count() <= n:
        rank = (F.row_number().over(ordered([], [ordinal])) - 1).cast("long")
        return df.select(ordinal, rank.alias("rank"), F.lit(None).cast("double").alias("distance"))
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
    state = df.select(F.col(ordinal).alias("_o"), F.col(vector).alias("_v"), F.lit(math.inf).alias("_d"))
    centre = literal(centroid(df, vector))
    pick = state.select("_o", "_v", distance(F.col("_v"), centre).alias("_far")).groupBy().agg(F.max_by(F.struct("_o", "_v", "_far"), F.struct("_far", -F.col("_o"))).alias("p")).first().p
    picked, new, turn = [(pick._o, 0, None)], [pick], 0
    while len(picked) < n:
        gap = F.array_min(F.transform(F.array(*[literal(p._v) for p in new]), lambda v: distance(F.col("_v"), v)))
        state = state.withColumn("_d", F.when(F.col("_o").isin([p._o for p in new]), F.lit(-math.inf)).otherwise(F.least("_d", gap)))
        turn += 1
        if turn % checkpoint_every == 0:
            state = cut_lineage(state, "farthest")
        front = state.orderBy(F.col("_d").desc(), "_o").limit(ahead + 1).collect()
        behind = front[ahead]._d if len(front) > ahead else -math.inf
        left, new = {r._o: (r._d, r._v) for r in front[:ahead]}, []
        while len(picked) < n and left:
            best = max(left, key=lambda o: (left[o][0], -o))
            far, v = left[best]
            if new and far <= behind:
                break
            new.append(next(r for r in front if r._o == best))
            picked.append((best, len(picked), float(far)))
            del left[best]
            left = {o: (min(d, apart(w, v)), w) for o, (d, w) in left.items()}
    return spark.createDataFrame(picked, f"`{ordinal}` {df.schema[ordinal].dataType.simpleString()}, rank long, distance double")


def target_size(size: float, n: int) -> int:
    """A share in (0, 1), rounded half to even, or an absolute number; between 1 and n."""
    wanted = round(size * n) if 0 < size < 1 else int(size)
    return max(1, min(n, wanted))


def hierarchical_selection(df: DataFrame, ordinal: str, vector: str, size: float, over: float = 2.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Selection in chunks first (in parallel, over-sized), then farthest points over what the chunks kept.

    Vectors are dealt by a hash of the ordinal to chunks of about `chunk_rows`, whatever their number. A chunk keeps its part of
    `over` times the wanted vectors, but as many as are wanted (a tenth of it at most), so that none is too poor to hold what
    is far from all else. What is kept is dealt and culled again while it is more than a chunk and twice that total.
    """
    import numpy as np
    import pandas as pd

    from ..plans.storage import cut_lineage

    n = df.count()
    wanted = target_size(size, n)
    schema = df.select(F.col(ordinal).alias("o"), F.col(vector).alias("v")).schema

    def cull(share: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run_one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("o")
            x = np.stack(group["v"].to_numpy()).astype(float)
            far = np.linalg.norm(x - x.mean(axis=0), axis=1)
            near, picks = np.full(len(x), np.inf), []
            for _ in range(min(share, len(x))):
                i = int(far.argmax())
                picks.append(i)
                near = np.minimum(near, np.linalg.norm(x - x[i], axis=1))
                near[i] = -np.inf
                far = near
            return group[["o", "v"]].iloc[picks]

        return run_one

    left, turn = df.select(F.col(ordinal).alias("o"), F.col(vector).alias("v")), 0
    while n and (not turn or n > max(chunk_rows, 2 * over * wanted)):
        chunks = math.ceil(n / chunk_rows)
        share = max(math.ceil(over * wanted / chunks), min(wanted, chunk_rows // 10))
        dealt = left.withColumn("chunk", F.pmod(F.xxhash64(F.lit(turn), "o"), F.lit(chunks)))
        left = cut_lineage(dealt.groupBy("chunk").applyInPandas(cull(share), schema), "culled")
        n, turn = left.count(), turn + 1
    return farthest_points(left.toDF(ordinal, vector), ordinal, vector, wanted)


def allocation(df: DataFrame, group: str, target: int, strict: bool = False) -> DataFrame:
    """How many rows to take of each group: its share of the target, rounded half to even, one at least, its size at most.

    What is missing or too much is then settled by one pass of single steps over the groups, largest first for additions and
    smallest first for removals (the removals leave one at least); the total may stay off target. strict: largest remainders instead.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    total = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    share = F.try_divide(F.lit(float(target)) * F.col("size"), total)
    if strict:
        base = sizes.withColumn("_floor", F.floor(share)).withColumn("_rest", share - F.floor(share))
        ranked = base.withColumn("_rank", F.row_number().over(ordered([], [F.col("_rest").desc(), F.col("size").desc(), group])))
        left = F.lit(float(target)) - F.sum("_floor").over(ordered([], [F.lit(1)]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return ranked.withColumn("_left", left).select(group, "size", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("take"))
    first = sizes.withColumn("_take", F.least(F.greatest(F.rint(share).cast("long"), F.lit(1)), F.col("size")))
    gap = F.lit(target) - F.sum("_take").over(ordered([], [F.lit(1)]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    can_add, can_drop = F.col("_take") < F.col("size"), F.col("_take") > 1
    ranked = first.withColumn("_gap", gap)
    ranked = ranked.withColumn("_up", F.sum(can_add.cast("int")).over(ordered([], [F.col("size").desc(), group])))
    ranked = ranked.withColumn("_down", F.sum(can_drop.cast("int")).over(ordered([], ["size", group])))
    add = can_add & (F.col("_up") <= F.col("_gap"))
    drop = can_drop & (F.col("_down") <= -F.col("_gap"))
    return ranked.select(group, "size", (F.col("_take") + add.cast("long") - drop.cast("long")).alias("take"))


def stratified(df: DataFrame, group: str, target: int, order: list[str]) -> DataFrame:
    """The first rows of each group by order, as many as its allocation."""
    ranked = df.withColumn("_rank", F.row_number().over(ordered([group], order)))
    return ranked.join(allocation(df, group, target).select(group, "take"), group).where(F.col("_rank") <= F.col("take")).drop("_rank", "take")


def uniform_sample(df: DataFrame, n: int, key: list[str], seed: int = 12345) -> DataFrame:
    """A sample of n rows, the same for the same seed and keys whatever the partitioning: those with the smallest seeded hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def thinned(df: DataFrame, run: list[str], ordinal: str, width: int) -> DataFrame:
    """Of each run of n rows those at int(k * n / width) for k below width; all rows of a run that has no more than width."""
    sizes = df.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    k = F.ceil(F.col(ordinal) * width / F.col("_n"))
    picked = (k < width) & (F.floor(k * F.col("_n") / width) == F.col(ordinal))
    return df.join(sizes, run).where((F.col("_n") <= width) | picked).drop("_n")


def canonical(df: DataFrame, path: str = "path", frame: str = "frame_index") -> DataFrame:
    """Order of selection that doesn't depend on the order of completion."""
    return df.orderBy(path, frame)
