"""Frames to extended xyz files, one for each key, in the order of their frames, and texts to a folder for each key: whole files or none.

Each task writes the files of its keys under temporary names; they are renamed once all tasks are done (frames by the driver, texts in
folders by tasks), and deleted if the job fails. What a task that was lost or tried again has left is deleted with the temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans.storage import scratch
from .ranges import batched, located, tasks_of

#: Files that a task moves to their folders.
TASK_FILES = 1 << 16


class Written(WriterCommitMessage):
    def __init__(self, names: list[str], folder: str):
        self.names, self.folder = names, folder


class KeyedTexts(DataSource):
    """Texts of keys: columns key and text, the rows of a key together and in order. Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "keyed_texts"

    def schema(self) -> str:
        return "key string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return KeyedWriter(dict(self.options))


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".xyz")
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def place(self):
        return located(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = self.place()
        folder, names, seen, stream, current = f"{path}/{self.job}/{uuid.uuid4().hex}", [], set(), None, None
        store.create_dir(folder, recursive=True)
        try:
            for batch in batches:
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if key != current or stream is None:
                        if stream is not None:
                            stream.close()
                        name = quote(key, safe=" =+,.-") + self.suffix
                        if name in seen:
                            raise ValueError(f"the rows of {key} are not together")
                        names.append(name)
                        seen.add(name)
                        stream, current = store.open_output_stream(f"{folder}/{name}"), key
                    stream.write((text if text.endswith("\n") else f"{text}\n").encode())
        finally:
            if stream is not None:
                stream.close()
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self.place()
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a key was written by several tasks")
        for m in messages:
            for n in m.names if m else []:
                store.move(f"{m.folder}/{n}", f"{path}/{n}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs as fs

        store, path = self.place()
        if store.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


def folder_name(column: str, value: Column) -> Column:
    """column=value, as Spark names the folders of a partitioned table."""
    text = value.cast("string")
    escaped = text
    for c in "%\"#'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32))):
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))
    special = text.rlike(r"[%\"#'*/:=?\\{\[\]^\x00-\x1f\x7f]")
    return F.concat(F.lit(f"{column}="), F.when(text.isNull() | (text == ""), "__HIVE_DEFAULT_PARTITION__").when(special, escaped).otherwise(text))


def write_folders(rows: DataFrame, path: str, by: list[str], text: str) -> None:
    """Texts, each ended by a newline, in a folder for each key below path, which is replaced. Files are written by pyarrow, as Hadoop's local file system starts processes for each, and moved to their folders by tasks once all are written."""
    spark, (store, at) = rows.sparkSession, located(path)
    if store.get_file_info(at).type.name == "Directory":
        store.delete_dir(at)
    job, names = f"{at.rstrip('/')}/_temporary-{uuid.uuid4().hex}", scratch(spark, "names")
    arrow = pa.schema([("key", pa.string()), ("file", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(written(batches), arrow)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, _ = located(path)
        task, files, current, stream = uuid.uuid4().hex, 0, None, None
        store.create_dir(f"{job}/{task}", recursive=True)
        try:
            for batch in batches:
                for key, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if stream is None or key != current:
                        if stream is not None:
                            stream.close()
                        stream, current = store.open_output_stream(f"{job}/{task}/{files}"), key
                        yield {"key": key, "file": f"{task}/{files}"}
                        files += 1
                    stream.write(((value or "") + "\n").encode())
        finally:
            if stream is not None:
                stream.close()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(path)
        for batch in batches:
            for key, file in zip(batch.column("key").to_pylist(), batch.column("file").to_pylist(), strict=True):
                place = f"{base.rstrip('/')}/{key}/part-{file.replace('/', '-')}.txt"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                try:
                    store.move(f"{job}/{file}", place)
                except OSError:  # a task that was tried again: moved before
                    if not store.get_file_info(place).is_file:
                        raise
        yield from ()

    keyed = rows.select(F.concat_ws("/", *[folder_name(c, F.col(c)) for c in by]).alias("key"), F.col(text).alias("text"))
    store.create_dir(job, recursive=True)
    try:
        keyed.sortWithinPartitions("key").mapInArrow(write, "key string, file string").write.parquet(names)
        moved = spark.read.parquet(names)
        moved.repartition(tasks_of(moved, F.lit(1), TASK_FILES)).mapInArrow(move, "key string").count()
    finally:
        store.delete_dir(job)


def write_frames(frames: DataFrame, path: str, key: str, order: list[str], text: str, suffix: str = ".xyz") -> None:
    """A file for each key below path: the texts of its frames (see sinks.extxyz_text) one after the other, by order. Files of the same names are replaced. A row with a null key is refused."""
    spark = frames.sparkSession
    spark.dataSource.register(KeyedTexts)
    name = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit("a frame without a key")).cast("string"))
    rows = frames.select(name.alias("key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(text).alias("text"))
    dealt = rows.repartition("key").sortWithinPartitions("key", *[f"_o{i}" for i in range(len(order))])
    dealt.select("key", "text").write.format("keyed_texts").option("path", path).option("suffix", suffix).mode("append").save()
