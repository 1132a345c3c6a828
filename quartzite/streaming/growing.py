"""Runs that are still growing: frames as they are appended, once each, and a sink that a repeated batch leaves as it was.

The source knows of files and their sizes alone: an offset is the size of each file, the driver lists, and tasks read the bytes that were
appended, in chunks. A stateful operator by file puts chunks in order, keeps the bytes behind the last whole frame, the ordinal and what
holds for the next frame, and gives out the frames that became whole. All of that is in the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from .. import schema
from ..sources import trajectories

CHUNK_BYTES = 4 << 20
#: What a grammar carries from frame to frame.
CARRIED = {"outcar": trajectories.Outcar, "xdatcar": trajectories.Xdatcar, "lammpstrj": trajectories.Dump, "extxyz": dict}


class GrowingFiles(DataSource):
    """path, start, bytes of what is appended to the files below `path`. Options: path, suffix, max_bytes (of a file in a batch)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, start long, bytes binary"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


class Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("max_bytes", 1 << 30))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        import pyarrow.fs as fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        sizes = {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))}
        # A file that shrank stays where it was: what is written there anew isn't read.
        self.known |= {p: max(self.known.get(p, 0), min(size, self.known.get(p, 0) + self.most)) for p, size in sizes.items()}
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = dict(end)
        pieces = [Piece(p, start.get(p, 0), stop) for p, stop in end.items() if stop > start.get(p, 0)]
        return pieces or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        from ..sources.ranges import opened

        if partition.stop > partition.start:
            with opened(partition.path) as file:
                for a in range(partition.start, partition.stop, CHUNK_BYTES):
                    yield partition.path, a, file.read_at(min(CHUNK_BYTES, partition.stop - a), a)


class Lines:
    """Whole lines of a text, one after the other; tells how many characters were given out and whether more were wanted."""

    def __init__(self, text: str):
        self.text, self.at, self.ended = text, 0, False

    def __iter__(self) -> Lines:
        return self

    def __next__(self) -> str:
        end = self.text.find("\n", self.at) + 1
        if not end:
            self.ended = True
            raise StopIteration
        line, self.at = self.text[self.at : end], end
        return line


def whole_frames(grammar: str, text: str, index: int, carried: dict) -> tuple[list[dict], str, int, dict]:
    """The frames that are whole in a text; and what is left of it, the next ordinal and what holds then."""
    lines, state, out = Lines(text), CARRIED[grammar](**carried), []
    used, following, held = 0, index, carried
    for frame in trajectories.GRAMMARS[grammar](lines, begin=(index, state)):
        if lines.ended:
            break  # the text ended inside it
        out.append(frame)
        used, following = lines.at, frame["frame_index"] + 1
        held = json.loads(json.dumps({} if grammar == "extxyz" else vars(state)))
    if grammar == "xdatcar" and out:
        held["index"] = following
    return out, text[used:], following, held


def growing_frames(spark: SparkSession, path: str, grammar: str, suffix: str = "", max_bytes: int | None = None) -> DataFrame:
    """A stream of schema.FRAME: every frame of the files below path, once it is whole. max_bytes bounds what a batch reads of a file."""
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("path", path).option("suffix", suffix)
    chunks = (reader.option("max_bytes", max_bytes) if max_bytes else reader).load()

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, index, carried = state.get if state.exists else (b"", 0, "{}")
        parts = sorted((int(a), bytes(b)) for batch in batches for a, b in zip(batch["start"], batch["bytes"], strict=True))
        data = bytes(tail) + b"".join(b for _, b in parts)
        end = data.rfind(b"\n") + 1  # characters may be cut anywhere, lines end at whole ones
        frames, left, index, held = whole_frames(grammar, data[:end].decode("utf-8", "replace"), index, json.loads(carried))
        state.update((left.encode() + data[end:], index, json.dumps(held)))
        if frames:
            yield pd.DataFrame({"frame": [json.dumps({"path": key[0]} | f) for f in frames]})

    rows = chunks.groupBy("path").applyInPandasWithState(advance, "frame string", "tail binary, next long, carried string", "append", GroupStateTimeout.NoTimeout)
    return rows.select(F.from_json("frame", schema.FRAME).alias("f")).select("f.*")


def ledger_sink(path: str, columns: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch goes to a folder of its own, and then into the ledger.

    A batch that is in the ledger is left as it is; one that failed half-way is not, and is written over when it is given again. Readers
    take what the ledger names, see ledger_table, so they never see half a batch. One query writes to a path.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_ledger/{number:012d}")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(place):
            return
        (batch.select(*columns) if columns else batch).write.mode("overwrite").parquet(f"{path}/batches/{number:012d}")
        store.create(place, False).close()

    return write


def ledger_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The rows of the batches in a ledger, with the batch number."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_ledger")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in store.listStatus(place)) if store.exists(place) else []
    kind = StructType.fromDDL(ddl)
    if not names:
        return spark.createDataFrame([], kind).withColumn("batch", F.lit(0).cast("long"))
    rows = spark.read.schema(kind).parquet(*[f"{path}/batches/{n}" for n in names])
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1).cast("long"))
