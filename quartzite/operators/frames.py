"""Frames: duplicates, convergence, contacts with thresholds, repetition and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(n: Column, symbols: Column, positions: Column, cell: Column, places: int = 4) -> Column:
    """A digest of number, sorted symbols, rounded positions (in the order of the unrounded ones) and rounded cell."""
    text = lambda x: F.format_number(F.rint(x * 10.0**places) / 10.0**places + 0.0, places)
    rows = F.transform(F.array_sort(positions), lambda p: F.array_join(F.transform(p, text), " "))
    return F.sha2(F.concat_ws("|", n.cast("string"), F.array_join(F.array_sort(symbols), ","), F.array_join(rows, ";"), F.array_join(F.transform(cell, text), " ")), 256)


def drop_repeats(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, all columns kept; aggregated before the shuffle, so a frequent key does no harm."""
    keep = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in keep])


def drop_repeated_paths(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Rows with one path (dots and double slashes resolved) are one."""
    clean = F.regexp_replace(F.regexp_replace(F.col(path), r"/(\./)+", "/"), r"/{2,}", "/")
    clean = F.rtrim(F.regexp_replace(clean, r"/[^/]+/\.\.(?=/|$)", ""), F.lit("/"))
    return drop_repeats(df.withColumn("resolved", clean), ["resolved"], order)


def remainder(pool: DataFrame, taken: DataFrame, key: list[str], size: str | None = None, limit: int | None = None) -> DataFrame:
    """The pool without what was taken and without rows over a size."""
    rest = pool.join(taken.select(*key), key, "left_anti")
    return rest if limit is None else rest.where(F.col(size) < limit)


def split_by_force(frames: DataFrame, force: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """Frames whose largest force is within the limit, and the others; a frame without forces is among the others."""
    calm = F.coalesce(F.col(force) <= limit, F.lit(False))
    return frames.where(calm), frames.where(~calm)


def largest_force(forces: Column) -> Column:
    """Largest length among force vectors; null without any."""
    return F.array_max(F.transform(forces, lambda f: F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2])))


def converged(failed: Column, has_energy: Column, iterations: Column, limit: Column, default_limit: int = 60) -> Column:
    """Convergence of a run: null without electronic steps; false with a failure text, without an energy line, or with as many iterations as the limit; else true."""
    limit = F.coalesce(limit, F.lit(default_limit))
    return F.when(iterations.isNull(), None).otherwise(~(F.coalesce(failed, F.lit(False)) | ~F.coalesce(has_energy, F.lit(False)) | (iterations >= limit)))


def step_mask(steps: DataFrame, run: list[str], iterations: str, limit: str, default_limit: int = 60) -> DataFrame:
    """Each ionic step with ok: fewer electronic iterations than the limit."""
    return steps.withColumn("ok", F.col(iterations) < F.coalesce(F.col(limit), F.lit(default_limit)))


def atom_limit(frames: DataFrame, atoms: str, limit: int, path: str | None = None, without: list[str] | None = None) -> DataFrame:
    """Frames with at most so many atoms whose file name has none of the stated parts."""
    kept = frames.where(F.col(atoms) <= limit)
    for part in without or []:
        kept = kept.where(~F.regexp_extract(F.col(path), r"([^/]*)$", 1).contains(part))
    return kept


def repeat_atoms(atoms: DataFrame, frame: list[str], copies: tuple[int, int, int], idx: str, frac: str, cell: str) -> DataFrame:
    """The supercell's atoms, copy by copy, with fractions of the new cell and the cell multiplied like the atoms."""
    from ..functions.geometry import scale_cell

    nx, ny, nz = copies
    n = F.count(F.lit(1))
    sizes = atoms.groupBy(*frame).agg(n.alias("_n"))
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.array(F.lit(float(x)), F.lit(float(y)), F.lit(float(z))).alias("o")) for k, (x, y, z) in enumerate((x, y, z) for x in range(nx) for y in range(ny) for z in range(nz))])
    out = atoms.join(sizes, frame).withColumn("_c", F.explode(offsets))
    moved = F.array(*[(F.col(frac)[i] + F.col("_c.o")[i]) / float(copies[i]) for i in range(3)])
    return out.withColumn(frac, moved).withColumn(idx, F.col("_c.k") * F.col("_n") + F.col(idx)).withColumn(cell, scale_cell(F.col(cell), list(copies))).drop("_c", "_n")


def wide_to_long(df: DataFrame, keys: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each metric that has a value."""
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], name, value).where(F.col(value).isNotNull())


def root_metrics(long: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """The metrics, and for each *_mse a *_rmse; negative squares have none."""
    roots = long.where(F.col(name).endswith("_mse") & (F.col(value) >= 0)).withColumn(name, F.regexp_replace(F.col(name), "_mse$", "_rmse")).withColumn(value, F.sqrt(value))
    return long.unionByName(roots)


def learning_curve(long: DataFrame, run: list[str], epoch: str, order: list[str], name: str = "metric", value: str = "value", trained: str = "train_loss_epoch") -> DataFrame:
    """One value for each metric and epoch, the last one written; validation metrics only at epochs that were trained."""
    last = long.groupBy(*run, name, epoch).agg(F.max_by(value, F.struct(*order)).alias(value))
    epochs = last.where(F.col(name).startswith(trained)).select(*run, epoch).distinct()
    return last.where(~F.col(name).startswith("val")).unionByName(last.where(F.col(name).startswith("val")).join(epochs, [*run, epoch], "left_semi"))


def provenance_counts(rows: DataFrame, structure: str, directory: str) -> DataFrame:
    """Rows and distinct directories of each structure; repeated header rows are no rows."""
    data = rows.where(F.col(structure) != structure)
    return data.groupBy(structure).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct(directory).alias("directories")).orderBy(F.col("frames").desc(), structure)


def active_jobs(jobs: DataFrame, state: str, directory: str, roots: list[str], states: tuple[str, ...] = ("RUNNING", "COMPLETING", "PENDING")) -> DataFrame:
    from ..functions.text import under_any

    return jobs.where(F.col(state).isin(*states) & under_any(F.col(directory), roots))


def property_names(info: Column) -> Column:
    """Names of the per-atom properties that a frame's header lists."""
    fields = F.split(F.coalesce(info["Properties"], F.lit("")), ":")
    return F.filter(fields, lambda x, i: i % 3 == 0)


def evaluation_model(info: Column, models: list[str], reference: str = "REF") -> Column:
    """The first model, in the stated precedence, whose energy and forces a frame has beside those of the reference; null where there is none."""
    names = property_names(info)
    has = lambda m: info[f"{m}_energy"].isNotNull() & F.array_contains(names, f"{m}_forces")
    model = F.lit(None).cast("string")
    for m in reversed(models):
        model = F.when(has(m), m).otherwise(model)
    return F.when(has(reference), model)


def evaluation_files(frames: DataFrame, models: list[str], reference: str = "REF") -> DataFrame:
    """path, model of the files whose first frame can be evaluated."""
    first = frames.groupBy("path").agg(F.min_by("info", "frame_index").alias("info"))
    return first.select("path", evaluation_model(F.col("info"), models, reference).alias("model")).where("model IS NOT NULL")


def frames_by_run(frames: DataFrame, unknown: str = "__unknown__") -> DataFrame:
    """Number of frames for each run_id of the headers; frames without one are counted under a stated name. Reads no atoms if the source is asked for none."""
    return frames.groupBy("path", F.coalesce(F.col("info")["run_id"], F.lit(unknown)).alias("run_id")).agg(F.count(F.lit(1)).alias("frames"))


def frame_energy(header: Column, listed: Column, info: Column, key: str = "energy") -> Column:
    """A frame's energy: the header's value if headers and frames agree in number (listed is then true), else a key, else any key with 'energy' that is no stress and not per atom."""
    names = F.filter(F.array_sort(F.map_keys(info)), lambda k: F.lower(k).contains("energy") & ~F.lower(k).contains("stress") & ~F.lower(k).contains("per_atom"))
    return F.coalesce(F.when(listed, header), info[key].try_cast("double"), info[F.get(names, F.lit(0))].try_cast("double"))
