"""Reading files of a grammar into tables.

Small files (structures, settings, logs) are read whole, one row each, by Spark's text source, so any store that Spark
reads will do, and parsed where they are. Trajectories are streamed a line at a time by a Python data source, a
file by one task, which may have many: `spark.read.format("trajectory").option("grammar", "xdatcar").load(path)`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema
from . import structures, trajectories
from .frame_batches import frame_batches
from .ranges import below, located

#: Bytes of files that a task of the trajectory source reads (a larger file is a task of its own), and what opening one counts for.
TASK_BYTES = 64 << 20
OPEN_BYTES = 64 << 10
#: Characters of whole files whose rows make a batch.
BATCH_CHARS = 1 << 20


def whole_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, text: one row for each file, folders read to any depth; pattern is a glob on names."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(files: DataFrame, grammar: Callable[[str, str], Iterator[dict]], ddl: str, error: str | None = None) -> DataFrame:
    """Rows that a grammar (path, text) -> dicts finds in each file. A file that it can't read gives none; with `error`, the name of one more column, it gives a row of its path and what is wrong."""
    kind = StructType.fromDDL(ddl + (f", `{error}` string" if error else ""))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                wrong = "nothing found"
                try:
                    rows = [{"path": path} | r for r in grammar(path, text)]
                except (ValueError, IndexError, KeyError) as e:
                    rows, wrong = [], f"{type(e).__name__}: {e}"
                if error and not rows:
                    rows = [{"path": path, error: wrong}]
                held += rows
                size += len(text or "")
                if len(held) >= 256 or size >= BATCH_CHARS:  # a table for each file costs more than small files do
                    yield from pa.Table.from_pylist(held, schema=arrow).to_batches(max_chunksize=256)
                    held, size = [], 0
        yield from pa.Table.from_pylist(held, schema=arrow).to_batches(max_chunksize=256)

    return files.mapInArrow(run, kind)


def unreadable(files: DataFrame, grammar: Callable[[str, str], Iterator[dict]]) -> DataFrame:
    """path, error of the files in which a grammar finds nothing: what it says is wrong, or that there is nothing."""
    return parsed(files, lambda path, text: ({} for _ in grammar(path, text)), "path string", "error").where("error IS NOT NULL")


def structure_grammars() -> dict[str, Callable[[str, str], Iterator[dict]]]:
    from ..functions.elements import MASS

    masses = dict(MASS)
    return {
        "poscar": lambda _, text: structures.poscar(text),
        "lammps_data": lambda _, text: structures.lammps_data(text, masses),
        "gaussian_log": lambda _, text: structures.gaussian_log(text),
        "gaussian_archive": lambda _, text: structures.gaussian_archive(text),
        "gaussian_input": lambda _, text: structures.gaussian_input(text),
    }


def structures_of(files: DataFrame, grammar: str = "poscar", error: str | None = None) -> DataFrame:
    """schema.STRUCTURE of path and text; with `error`, files that can't be read have a row that tells why."""
    return parsed(files, structure_grammars()[grammar], schema.STRUCTURE, error)


def read_structures(spark: SparkSession, path: str | list[str], pattern: str | None = None, grammar: str | None = None) -> DataFrame:
    """Structures of POSCAR-like, LAMMPS data, or quantum-chemistry files: schema.STRUCTURE. Without a grammar it is POSCAR's."""
    return structures_of(whole_files(spark, path, pattern), grammar or "poscar")


def element_counts(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, frame_index, symbol, n of structure or xyz files, see count_elements."""
    return count_elements(whole_files(spark, path, pattern))


def count_elements(files: DataFrame) -> DataFrame:
    """path, frame_index, symbol, n of path and text: structures or xyz, the grammar guessed; where that fails the other one is tried."""

    def count(path: str, text: str) -> Iterator[dict]:
        first = structures.guess(path, text)
        for kind in (first, "poscar" if first == "extxyz" else "extxyz"):
            if kind == "poscar":
                found = [(s["part"], [x for x, n in zip(s["symbols"], s["counts"], strict=True) for _ in range(n)]) for s in structures.poscar(text)]
            else:
                found = [(f["frame_index"], [a["symbol"] for a in f["atoms"]]) for f in trajectories.extxyz(text.splitlines(keepends=True))]
            if found:
                break
        for index, symbols in found:
            for s in sorted(set(symbols)):
                yield {"frame_index": index, "symbol": s, "n": symbols.count(s)}

    return parsed(files, count, "path string, frame_index long, symbol string, n long")


class Trajectory(DataSource):
    """Frames of trajectory files. Options: path, grammar (outcar, xdatcar, extxyz, lammpstrj), skip, limit, coords, raw, atoms."""

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return schema.FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return TrajectoryReader(dict(self.options), schema)


class PushedTrajectory(Trajectory):
    """The same source for sessions that push filters into Python sources: ranges of frame_index become skip and limit."""

    def reader(self, schema: StructType) -> DataSourceReader:
        return PushedReader(dict(self.options), schema)


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: StructType):
        self.options, self.kind = options, kind

    def partitions(self) -> list[InputPartition]:
        """Lists of files, hidden ones left out: small files share a task, as each costs little more than its bytes."""
        store, path = located(self.options["path"])
        info = store.get_file_info(path)
        files = [info] if info.is_file else list(below(store, path))
        most = min(TASK_BYTES, max(OPEN_BYTES, sum(f.size + OPEN_BYTES for f in files) // int(self.options.get("tasks", 32))))
        groups, size = [], 0
        for f in files:
            if not groups or size + f.size + OPEN_BYTES > most:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size + OPEN_BYTES
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from frame_batches(self.sources(partition.value), self.options.get("grammar", "extxyz"), to_arrow_schema(self.kind))

    def sources(self, paths: list[str]) -> Iterator[tuple]:
        import io

        o = self.options
        more = {"skip": int(o.get("skip", 0)), "limit": int(o["limit"]) if "limit" in o else None}
        if o.get("grammar", "extxyz") == "extxyz":
            more |= {"space": o.get("coords", "cartesian"), "raw": o.get("raw") == "true", "atoms": o.get("atoms") != "false"}
        store, _ = located(o["path"])
        for path in paths:
            with store.open_input_stream(path) as stream:
                yield path, io.TextIOWrapper(stream, encoding="utf-8", errors="replace"), more


class PushedReader(TrajectoryReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Bounds of frame_index end up in skip and limit, so a scan stops at the last frame that is asked for; Spark still applies every filter."""
        low = int(self.options.get("skip", 0))
        high = low + int(self.options["limit"]) if "limit" in self.options else None
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_index",):
                kind, value = type(f).__name__, getattr(f, "value", None)
                if kind == "In" and value:
                    first, last = min(value), max(value)
                else:
                    first = {"EqualTo": value, "GreaterThan": value + 1 if kind == "GreaterThan" else None, "GreaterThanOrEqual": value}.get(kind) if value is not None else None
                    last = {"EqualTo": value, "LessThan": value - 1 if kind == "LessThan" else None, "LessThanOrEqual": value}.get(kind) if value is not None else None
                low = low if first is None else max(low, first)
                high = high if last is None else min(last + 1, high) if high is not None else last + 1
            yield f
        self.options["skip"] = str(low)
        if high is not None:
            self.options["limit"] = str(max(0, high - low))


def read_trajectories(spark: SparkSession, path: str, grammar: str, **options) -> DataFrame:
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(PushedTrajectory if pushes else Trajectory)
    reader = spark.read.format("trajectory").option("path", path).option("grammar", grammar).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load()


def atoms_of(frames: DataFrame) -> DataFrame:
    """One row for each atom of each frame."""
    return frames.select("path", "frame_index", "cell", "coord_space", F.explode("atoms").alias("a")).select("path", "frame_index", "cell", "coord_space", "a.*")
