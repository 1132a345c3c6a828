"""Non-linear least squares of a given model, for all groups of a table at once.

A model is a column expression of x and the parameters. In each round every group has a point in parameter space that is to be tried: one
aggregate over the data gives the sums J'J and J'r there and what the step has changed (partial sums before the shuffle, some k(k+5)/2+5
numbers a group, however many rows it has). A small step for each group then accepts or refuses the point and proposes the next one
(Levenberg-Marquardt, steps kept within bounds). Groups that are done leave the rounds, so later ones read only the others' rows.

Rows may lie far from their model and offsets may be large. So gains are sums of differences, not differences of sums; the differences that
give derivatives are widened until they stand clear of the values' rounding, as long as the model is nearly straight over them; and a group
has converged where the residuals have no part left along the model's derivatives. A parameter that can't be seen in the values any more,
because the least squares lie at infinity, has not converged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.storage import scratch

Model = Callable[..., Column]
#: Rounding of values.
EPS = 2.0**-52
#: Rounding of a derivative below which differences aren't widened, and above which it tells nothing.
CLEAR, UNSEEN = 1e-11, 1e-2
#: How much two differences, one twice as wide, may differ before they are widened, and at all; rounds in which widths change.
STRAIGHT, BENT, WIDTHS = 1e-6, 1e-4, 20
STATE = "point array<double>, best array<double>, width array<double>, sse double, jtj array<double>, jtr array<double>, damping double, rounds int, done boolean, settled boolean, n long"
SUMS = ("sse", "squares", "gain", "moved", "jtj", "jtr", "bend", "n")


def birch_murnaghan(v: Column, e0: Column, v0: Column, b0: Column, b0p: Column) -> Column:
    x = F.pow(v0 / v, F.lit(2 / 3))
    return e0 + 9 * v0 * b0 / 16 * (F.pow(x - 1, F.lit(3.0)) * b0p + F.pow(x - 1, F.lit(2.0)) * (6 - 4 * x))


def vinet(v: Column, e0: Column, v0: Column, b0: Column, b0p: Column) -> Column:
    x = F.pow(v / v0, F.lit(1 / 3))
    eta = 1.5 * (b0p - 1)
    return e0 + 9 * b0 * v0 / (eta * eta) * (1 + (eta * (1 - x) - 1) * F.exp(eta * (1 - x)))


MODELS: dict[str, Model] = {"birch_murnaghan": birch_murnaghan, "vinet": vinet}


def register(name: str, model: Model) -> None:
    """Models may be named in fit."""
    MODELS[name] = model


def _solved(jtj: np.ndarray, jtr: np.ndarray, damping: float) -> np.ndarray | None:
    scaled = jtj + damping * np.diag(np.maximum(np.diag(jtj), 1e-300))
    try:
        step = np.linalg.solve(scaled, -jtr)
    except np.linalg.LinAlgError:
        return None
    return step if np.isfinite(step).all() else None


def _remaining(jtj: np.ndarray, jtr: np.ndarray) -> tuple[float, bool]:
    """The squares of what a full step would change in the values, and whether all parameters are determined."""
    scale = np.sqrt(np.maximum(np.diag(jtj), 1e-300))
    size, along = np.linalg.eigh(jtj / np.outer(scale, scale))
    seen = size > 1e-15 * len(size)
    return float(np.sum((along.T @ (jtr / scale))[seen] ** 2 / size[seen])), bool(seen.all())


def _widths(width: np.ndarray, best: np.ndarray, column: np.ndarray, bend: np.ndarray, squares: float) -> tuple[np.ndarray, np.ndarray]:
    """The widths of the next differences, and the rounding of these derivatives. column, bend: lengths of each derivative and of its error."""
    with np.errstate(divide="ignore", invalid="ignore"):
        noise = np.where(column > 0, EPS * squares**0.5 / column / width, np.inf)
        bent = np.where(column > 0, bend / column, 0.0)
    most = np.maximum(width, 1e-2 * np.maximum(np.abs(best), 1.0))
    wider = np.minimum(np.where(noise > 2 * CLEAR, width * np.clip(noise / CLEAR, 1.0, 1000.0), width), most)
    narrow, straight = bent > np.maximum(BENT, 10 * noise), bent <= np.maximum(STRAIGHT, 10 * noise)
    return np.where(narrow, width / 10, np.where(straight, np.where(bent > 10 * noise, np.minimum(wider, 10 * width), wider), width)), noise


def advance(state: dict, seen: dict, lower: np.ndarray, upper: np.ndarray, tolerance: float, most: int) -> dict:
    """A group's next state, from the sums at the point that it tried."""
    k = len(lower)
    point, best, width, damping, rounds = np.array(state["point"]), state["best"], np.array(state["width"]), state["damping"], state["rounds"] + 1
    finite = lambda c: seen[c] is not None and bool(np.isfinite(np.array(seen[c], float)).all())
    state = dict(state) | {"rounds": rounds, "n": seen["n"]}
    last = rounds >= most or seen["n"] < k
    if finite("sse") and not (finite("jtj") and finite("jtr")) and (width > 1e-9 * np.abs(point) + 1e-12).all():
        return state | {"width": (width / 10).tolist(), "done": last}
    able = all(map(finite, ("sse", "squares", "jtj", "jtr", "bend")))
    moved = seen["moved"] if best is not None and able else np.inf
    whole = (seen["sse"] + seen["squares"] if able else 0.0) + (state["sse"] or 0.0)
    # Where the rounding of a gain hides its sign the step is taken; the gradient, which gives the step, can tell.
    accepted = able and (best is None or seen["gain"] <= (tolerance * moved**0.5 + EPS * seen["squares"] ** 0.5) * state["sse"] ** 0.5)
    visible, changed = np.ones(k, bool), False
    if accepted:
        best, jtj = point, np.array(seen["jtj"])
        wanted, noise = _widths(width, best, np.sqrt(jtj[np.cumsum([0, *range(k, 1, -1)])]), np.sqrt(np.array(seen["bend"])), seen["squares"])
        if rounds <= WIDTHS:
            changed, width = bool((wanted != width).any()), wanted
        visible = noise <= UNSEEN
        state |= {"best": best.tolist(), "width": width.tolist(), "sse": float(seen["sse"]), "jtj": jtj.tolist(), "jtr": list(seen["jtr"])}
        damping = max(damping / 10, 1e-12)
    else:
        damping *= 10
    state["damping"] = damping
    if best is None or damping > 1e16 or last:
        return state | {"done": True}
    if not visible.all():  # The same point with wider differences, if there are any.
        return state | {"point": np.array(best).tolist(), "done": not changed}
    best, jtr, full = np.array(best), np.array(state["jtr"]), np.zeros((k, k))
    full[np.triu_indices(k)] = state["jtj"]
    full += np.triu(full, 1).T
    free = ~((best <= lower) & (jtr > 0) | (best >= upper) & (jtr < 0))
    if not free.any():
        return state | {"done": True, "settled": True}
    full, jtr = full[np.ix_(free, free)], jtr[free]
    left, determined = _remaining(full, jtr)
    settled = not changed and (state["sse"] == 0 or max(moved, left) <= tolerance**2 * whole)
    step = _solved(full, jtr, 0.0 if settled else damping)
    following = best.copy()
    following[free] = np.clip(best[free] + (0.0 if step is None else step), lower[free], upper[free])
    if settled:
        return state | {"best": following.tolist() if determined else best.tolist(), "done": True, "settled": determined}
    return state | {"point": following.tolist(), "done": step is None}


def fit(df: DataFrame, by: list[str], x: str, y: str, model: Model | str, start: list[Column], names: list[str], bounds: list[tuple[float, float]] | None = None, weight: str | None = None, tolerance: float = 1e-12, most: int = 60) -> DataFrame:
    """by, the parameters by their names, n, sse, rounds, converged. start: an aggregate over a group's rows for each parameter; rows with a null or NaN x or y don't count.

    Groups with fewer rows than parameters have null parameters. Derivatives are central differences of two widths. converged: a step that changed
    the values by less than the tolerance was taken, a full step would change no more, and the rows determine all parameters.
    """
    spark, k = df.sparkSession, len(start)
    model = MODELS[model] if isinstance(model, str) else model
    lower, upper = (np.array([b[i] for b in bounds]) if bounds else np.full(k, (-np.inf, np.inf)[i]) for i in (0, 1))
    numbers = [F.col(c).cast("double") for c in (x, y)]
    for c in numbers:
        df = df.where(c.isNotNull() & ~F.isnan(c))
    rows = df.select(*by, numbers[0].alias("_x"), numbers[1].alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    folder = scratch(spark, "points")
    rows.write.parquet(folder)
    rows = spark.read.parquet(folder)
    keys = StructType([rows.schema[c] for c in by])
    first = df.groupBy(*by).agg(F.array(*[c.cast("double") for c in start]).alias("point"))
    empty = {"best": "array<double>", "sse": "double", "jtj": "array<double>", "jtr": "array<double>", "damping": "double", "rounds": "int", "done": "boolean", "settled": "boolean", "n": "long"}
    width = F.transform("point", lambda c: F.abs(c) * 1e-5 + 1e-8).alias("width")
    state = first.select(*by, "point", width, *[F.lit({"damping": 1e-3, "rounds": 0, "done": False, "settled": False}.get(c)).cast(t).alias(c) for c, t in empty.items()])
    kind = StructType([*keys.fields, *StructType.fromDDL(STATE).fields])

    p, was, h = ([F.col(name)[i] for i in range(k)] for name in ("point", "best", "width"))
    at = lambda i, times: model(F.col("_x"), *[c + times * h[i] if j == i else c for j, c in enumerate(p)])

    def sums(active: DataFrame) -> DataFrame:
        both = rows.join(active.select(*by, "point", "best", "width"), by)
        near, far = ([(at(i, t) - at(i, -t)) / (2 * t * h[i]) for i in range(k)] for t in (1, 2))
        both = both.select(*by, "_w", "_y", model(F.col("_x"), *p).alias("_m"), model(F.col("_x"), *was).alias("_b"), *[c.alias(f"_{name}{i}") for name, cs in (("near", near), ("far", far)) for i, c in enumerate(cs)])
        slope, bend = [(4 * F.col(f"_near{i}") - F.col(f"_far{i}")) / 3 for i in range(k)], [F.col(f"_near{i}") - F.col(f"_far{i}") for i in range(k)]
        r, d = F.col("_m") - F.col("_y"), F.col("_m") - F.col("_b")
        both = both.select(*by, "_w", "_m", r.alias("_r"), d.alias("_d"), (d * (r + (F.col("_b") - F.col("_y")))).alias("_g"), *[c.alias(f"_j{i}") for i, c in enumerate(slope)], *[c.alias(f"_e{i}") for i, c in enumerate(bend)])
        total = lambda *names: F.sum(math.prod(map(F.col, names), start=F.col("_w")))
        found = {
            "sse": total("_r", "_r"),
            "squares": total("_m", "_m"),
            "gain": total("_g"),
            "moved": total("_d", "_d"),
            "jtj": F.array(*[total(f"_j{i}", f"_j{j}") for i in range(k) for j in range(i, k)]),
            "jtr": F.array(*[total("_r", f"_j{i}") for i in range(k)]),
            "bend": F.array(*[total(f"_e{i}", f"_e{i}") for i in range(k)]),
            "n": F.count(F.lit(1)),
        }
        return both.groupBy(*by).agg(*[found[c].alias(f"s_{c}") for c in SUMS])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [advance(r, {c: r[f"s_{c}"] for c in SUMS}, lower, upper, tolerance, most) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow, finished = to_arrow_schema(kind), None
    while True:
        folder = scratch(spark, "fit")
        state.join(sums(state), by).mapInArrow(step, kind).write.parquet(folder)
        written = spark.read.schema(kind).parquet(folder)
        ended = written.where("done")
        finished = ended if finished is None else finished.unionByName(ended)
        state = written.where("NOT done")
        if not state.limit(1).count():
            break
    enough = F.col("n") >= k
    return finished.select(*by, *[F.when(enough, F.col("best")[i]).alias(name) for i, name in enumerate(names)], "n", F.when(enough, F.col("sse")).alias("sse"), "rounds", (enough & F.col("settled")).alias("converged"))
