"""Large text files in byte ranges, each read by a task of its own.

What a range means depends on what stands before it. A parser therefore says what lines do to its state as a small summary that doesn't
need to know the state: one pass summarises all ranges, a second step composes the summaries of each file in order (a row for each range),
and the last pass reads each range from the state that it begins with. Files are listed by Spark and opened by pyarrow in tasks.
Lines end at \\n, with or without \\r before it; a range has the lines that begin in it; NUL bytes count as blanks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import groupby
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.storage import scratch

RANGE_BYTES = 16 << 20
CHUNK = 1 << 16
ROWS = 1024


def file_ranges(spark: SparkSession, path: str | list[str], pattern: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, part (from 0), start, stop of files below path; pattern is a glob on names. An empty file has one empty range. The listing is made once and written, as the ranges are read more than once."""
    folder = scratch(spark, "listing")
    listed(spark, [path] if isinstance(path, str) else path, pattern).write.parquet(folder)
    files = spark.read.parquet(folder)
    rows = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("part", "start"))
    return rows.select("path", "part", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("stop"))


def located(path: str):
    """The store of a path and the path in it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:/+", "/", path))


def known(path: str) -> bool:
    """Whether pyarrow knows the store of a path."""
    try:
        located(path)
    except (ValueError, OSError):
        return False
    return True


def hidden(name: str) -> bool:
    """Names that Spark's listings leave out: checksums, markers and files that are being written."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def below(store, path: str) -> Iterator:
    """The files below a path that aren't hidden, nor in hidden folders, by path. The store lists all folders in one call."""
    import pyarrow.fs as fs

    top = len(path.rstrip("/")) + 1
    found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
    for f in sorted(found, key=lambda f: f.path):
        if not any(map(hidden, f.path[top:].split("/"))):
            yield f


def listed(spark: SparkSession, paths: list[str], pattern: str | None) -> DataFrame:
    """path, length of the files below paths. Local folders are listed by tasks, one level by the driver; other stores, patterns in paths and single files by Spark, which starts many small tasks where folders are many."""
    import pyarrow.fs as fs

    local = [re.sub("^file:/+", "/", p) for p in paths]
    if any("://" in p or re.search(r"[*?\[{\\]", p) or not os.path.isdir(p) for p in local) or re.search(r"[\[{\\]", pattern or ""):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", pattern) if pattern else reader
        return reader.load(paths).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length")  # the content isn't read
    store = fs.LocalFileSystem()
    tops = sorted({os.path.abspath(f.path) for p in local for f in store.get_file_info(fs.FileSelector(p)) if not hidden(f.base_name)})
    arrow = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.LocalFileSystem()
        for batch in batches:
            found = ((f,) if f.is_file else below(store, f.path) for f in store.get_file_info(batch.column("top").to_pylist()))
            yield from batched(({"path": f.path, "length": f.size} for some in found for f in some if not pattern or fnmatchcase(f.base_name, pattern)), arrow)

    tasks = min(len(tops), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(pa.table({"top": pa.array(tops, pa.string())})).repartition(max(1, tasks)).mapInArrow(run, "path string, length long")


def tasks_of(rows: DataFrame, size: Column, task_size: int) -> int:
    """How many tasks rows of so much work are for: one for every task_size, and some for each core at least."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    wanted = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // task_size))
    return max(1, min(count, wanted))


def dealt(rows: DataFrame, size: Column, task_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows that stand for so many bytes to read, evenly in tasks."""
    return rows.repartition(tasks_of(rows, size, task_bytes))


def opened(path: str) -> pa.NativeFile:
    store, at = located(path)
    return store.open_input_file(at)


def block(file: pa.NativeFile, start: int, stop: int, after: int = 0) -> tuple[bytes, int, int]:
    """The lines that begin in [start, stop), followed by `after` more: bytes, where they begin in the file, and how many of the bytes are the range's own."""
    size = file.size()
    body = file.read_at(stop - start, start)
    skip = 0
    if start and file.read_at(1, start - 1) != b"\n":
        skip = body.find(b"\n") + 1
        if not skip:
            return b"", stop, 0
    body, begin = body[skip:], start + skip
    if not body:
        return b"", begin, 0
    pieces, at = [body], stop
    own = len(body) if body.endswith(b"\n") else None
    missing, count = after + (own is None), len(body)
    while missing and at < size:
        piece = file.read_at(CHUNK, at)
        place = -1
        while missing and (place := piece.find(b"\n", place + 1)) >= 0:
            missing -= 1
            own = count + place + 1 if own is None else own
        pieces.append(piece if missing else piece[: place + 1])
        count, at = count + len(pieces[-1]), at + len(piece)
    data = b"".join(pieces).replace(b"\0", b" ")
    return data, begin, len(data) if own is None else own


def lines_before(file: pa.NativeFile, at: int, count: int) -> list[str]:
    """Up to `count` whole lines that end at a line's beginning."""
    back = 1 << 12
    while True:
        low = max(0, at - back)
        rows = file.read_at(at - low, low).replace(b"\0", b" ").split(b"\n")[:-1]
        if low == 0 or len(rows) > count:
            rows = rows if low == 0 else rows[1:]
            return [x.decode("utf-8", "replace").rstrip("\r") for x in rows[-count:]]
        back *= 2


class Parser(Protocol):
    """Lines to rows. States and summaries are made of lists, dicts, numbers, strings and None."""

    ddl: str
    #: Lines after a range that its summary and rows need to see.
    after: int

    def start(self) -> Any: ...

    def summarise(self, lines: list[str], more: list[str]) -> Any:
        """What a range's lines do to any state; more: the lines after them."""

    def step(self, state: Any, summary: Any) -> Any: ...

    def rows(self, state: Any, lines: list[str], more: list[str], last: Any) -> Iterator[dict]:
        """The rows of a range that begins with `state`, in a file that ends with `last`."""


def split_lines(text: str) -> list[str]:
    rows = text.replace("\r\n", "\n").split("\n")
    return rows[:-1] if rows[-1] == "" else rows


def _range_lines(path: str, start: int, stop: int, after: int) -> tuple[list[str], list[str]]:
    with opened(path) as file:
        data, _, own = block(file, start, stop, after)
    return split_lines(data[:own].decode("utf-8", "replace")), split_lines(data[own:].decode("utf-8", "replace"))[:after]


def batched(rows: Iterator[dict], arrow: pa.Schema, weight: str | None = None, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of rows; where `weight` names a number of each row (its atoms), they end at a sum of `most` too."""
    held: list[dict] = []
    total = 0
    for row in rows:
        held.append(row)
        total += row[weight] if weight else 0
        if len(held) == ROWS or total >= most:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def by_file(summaries: DataFrame) -> DataFrame:
    """Summaries with those of a file together, in order."""
    return summaries.repartition("path").sortWithinPartitions("path", "part")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    """Each path with its rows, of rows that are sorted by path."""
    return groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["path"])


def composed(summaries: DataFrame, parser: Parser) -> DataFrame:
    """Summaries (path, part, start, stop, summary) with the state before each range and that at the end of its file. A task holds the summaries of one file at a time."""
    ddl = "path string, part int, start long, stop long, state string, last string"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, rows in grouped(batches):
            state, held = parser.start(), []
            for r in rows:
                held.append({k: r[k] for k in ("path", "part", "start", "stop")} | {"state": json.dumps(state)})
                state = parser.step(state, json.loads(r["summary"]))
            last = json.dumps(state)
            yield from (r | {"last": last} for r in held)

    return by_file(summaries).mapInArrow(lambda batches: batched(states(batches), arrow), ddl)


def summarised(source: DataFrame, parser: Parser) -> DataFrame:
    """Ranges with the summary of each."""
    ddl = "path string, part int, start long, stop long, summary string"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                yield r | {"summary": json.dumps(parser.summarise(*_range_lines(r["path"], r["start"], r["stop"], parser.after)))}

    return dealt(source.select("path", "part", "start", "stop"), F.col("stop") - F.col("start")).mapInArrow(lambda batches: batched(summaries(batches), arrow), ddl)


def scan(source: DataFrame, parser: Parser) -> DataFrame:
    """path and the parser's rows. source: ranges of files (see file_ranges), or path and text, one row a file."""
    kind = StructType.fromDDL(f"path string, {parser.ddl}")
    arrow = to_arrow_schema(kind)

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = split_lines((text or "").replace("\0", " "))
                last = parser.step(parser.start(), parser.summarise(lines, []))
                yield from batched(({"path": path} | r for r in parser.rows(parser.start(), lines, [], last)), arrow)

    if "text" in source.columns:
        return source.select("path", "text").mapInArrow(of_text, kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                lines, more = _range_lines(r["path"], r["start"], r["stop"], parser.after)
                yield from ({"path": r["path"]} | x for x in parser.rows(json.loads(r["state"]), lines, more, json.loads(r["last"])))

    folder = scratch(source.sparkSession, "ranges")
    composed(summarised(source, parser), parser).write.parquet(folder)
    return dealt(source.sparkSession.read.parquet(folder), F.col("stop") - F.col("start")).mapInArrow(lambda batches: batched(read(batches), arrow), kind)


def ends(source: DataFrame, parser: Parser) -> DataFrame:
    """path and the parser's columns from its state at the end of each file, a dict: files are read once."""
    kind = StructType.fromDDL(f"path string, {parser.ddl}")
    arrow = to_arrow_schema(kind)

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path} | parser.step(parser.start(), parser.summarise(split_lines((text or "").replace("\0", " ")), []))], schema=arrow)

    if "text" in source.columns:
        return source.select("path", "text").mapInArrow(of_text, kind)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for path, rows in grouped(batches):
            state = parser.start()
            for r in rows:
                state = parser.step(state, json.loads(r["summary"]))
            yield {"path": path} | state

    return by_file(summarised(source, parser)).mapInArrow(lambda batches: batched(last(batches), arrow), kind)
