"""Where the frames of trajectories begin: files are scanned in byte ranges, and a frame is read without what stands before it.

One pass over the ranges finds the lines that can begin a frame or change what holds for later ones (headers, cells, numbers of atoms) and
counts lines. These marks, a few for each frame and many to a row, are put in the order of their lines, and one walk over a file's marks leaves
out those inside frames and gives every frame its ordinal, its byte offset and the state in force before it. The index is a table: keep it beside
the files, and any frames can be read by as many tasks as there are ranges of bytes. Where all frames are read once, the walk gives the first
frame of each range alone, no index is written, and files of one range aren't marked. Frames are those that the streaming scan finds.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema
from ..plans.storage import scratch
from . import trajectories
from .frame_batches import frame_batches
from .ranges import batched, block, dealt, file_ranges, lines_before, opened, tasks_of

RANGE_BYTES = 64 << 20
#: Bytes of small ranges that a task reads.
TASK_BYTES = 16 << 20
#: Marks that a task walks over, if files are that small.
TASK_MARKS = 1 << 20
#: Marks of a range that share a row.
ROW_MARKS = 1 << 12
INDEX = "path string, frame_index long, offset long, state string"
#: Marks of a range in order: `block` numbers its rows; `lines`, its number of lines, stands in the last one.
MARK = "path string, part int, block int, marks int, line array<long>, offset array<long>, text array<string>, lines long"
#: The frames of a file that begin in one range: ordinals of the first and the last (null: to the end), offset of the first and what holds before it, bytes between the two.
PIECE = "path string, first long, last long, offset long, state string, size long"
#: Lines that a walk needs to see: what they hold, how many lines after and before them belong to a mark, which of them need those after them.
MARKS = {
    "extxyz": (rb"(?m)^[^\S\n]*\d+[^\S\n]*$", 0, 0, rb""),
    "xdatcar": (rb"(?mi)^[^\S\n]*direct configuration", 0, 7, rb""),
    "outcar": (rb"TITEL|ions per type|direct lattice vectors|POSITION", 3, 0, rb"direct lattice vectors"),
    "lammpstrj": (rb"(?m)^ITEM: ", 3, 0, rb"TIMESTEP|NUMBER OF ATOMS|BOX BOUNDS"),
}


def header_before(file: pa.NativeFile, data: bytes, begin: int, first: int, count: int) -> list[str]:
    """Up to `count` lines before a place in a block, if the last one holds whole numbers alone; else none."""
    rows, at = [], first
    while at and len(rows) < count:
        start = data.rfind(b"\n", 0, at - 1) + 1
        rows.insert(0, data[start : at - 1].decode("utf-8", "replace").rstrip("\r"))
        at = start
        if not re.fullmatch(r"[\d\s]+", rows[-1]):
            return []
    if len(rows) < count and begin:
        rows = lines_before(file, begin + first, count)
    return rows if rows and re.fullmatch(r"[\d\s]+", rows[-1]) else []


def marks_of(path: str, part: int, start: int, stop: int, grammar: str) -> Iterator[dict]:
    """The marks of a range, by line (from the range's first), and at last its number of lines, without an offset."""
    pattern, after, before, needs = MARKS[grammar]
    with opened(path) as file:
        data, begin, own = block(file, start, stop, after)
        line, at = 0, 0
        for m in re.finditer(pattern, data):
            place = m.start()
            if place >= own:
                break
            first = data.rfind(b"\n", 0, place) + 1
            if first < at:
                continue  # a line with two of the words
            line += data.count(b"\n", at, first)
            at = end = data.find(b"\n", place) + 1 or len(data)
            if before:
                text = "\n".join(header_before(file, data, begin, first, before))
            else:
                if after and re.search(needs, data[first:at]):
                    for _ in range(after):
                        end = data.find(b"\n", end) + 1 or len(data)
                text = data[first:end].decode("utf-8", "replace").replace("\r\n", "\n")
            yield {"path": path, "part": part, "line": line, "offset": begin + first, "text": text}
            line += 1
        yield {"path": path, "part": part, "line": line + data.count(b"\n", at, own) + (own > at and data[own - 1 : own] != b"\n"), "offset": None, "text": None}


def rows_of(path: str, part: int, marks: Iterator[dict]) -> Iterator[dict]:
    """MARK of the marks of a range, up to ROW_MARKS to a row."""
    for i, held in enumerate(iter(lambda: list(islice(marks, ROW_MARKS)), [])):
        lines = held.pop()["line"] if held[-1]["offset"] is None else None
        yield {"path": path, "part": part, "block": i, "marks": len(held), "lines": lines} | {c: [m[c] for m in held] for c in ("line", "offset", "text")}


def plain(values: pa.Array) -> list:
    """The values of a column without nulls. Equal texts are made once."""
    if not pa.types.is_string(values.type):
        return values.to_numpy(zero_copy_only=False).tolist()
    coded = values.dictionary_encode()
    texts = coded.dictionary.to_pylist()
    return [texts[i] for i in coded.indices.to_numpy(zero_copy_only=False).tolist()]


def rows_of_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """path, lines of the range (in its last row), and line, offset and text of the marks, for each row."""
    for batch in batches:
        line, offset, text = (plain(batch.column(c).flatten()) for c in ("line", "offset", "text"))
        at = 0
        for path, n, lines in zip(*(batch.column(c).to_pylist() for c in ("path", "marks", "lines")), strict=True):
            yield path, lines, line[at : at + n], offset[at : at + n], text[at : at + n]
            at += n


def numbered(rows: Iterator[tuple]) -> Iterator[tuple[int, int, str]]:
    """The marks of a file by the lines of the file: the last row of a range has its number of lines."""
    before = 0
    for _, lines, *marks in rows:
        for line, offset, text in zip(*marks, strict=True):
            yield before + line, offset, text
        before += lines or 0


def held(state: object, last: dict | None) -> dict:
    """What holds before a frame but for its ordinal, which the index has: the dict that was given, as long as nothing has changed."""
    now = {k: v for k, v in vars(state).items() if k != "index"}
    return last if now == last else now


def walk_extxyz(marks: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, dict]]:
    end, nothing = 0, {}
    for line, offset, text in marks:
        if line >= end:
            yield offset, nothing
            end = line + 2 + int(text)


def walk_xdatcar(marks: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, dict]]:
    end, state, last = 0, trajectories.Xdatcar(), None
    for line, offset, text in marks:
        if line < end:
            continue
        between = min(7, line - end)
        state.header(text.split("\n")[-between:] if text and between else [""] * between)
        state.check()
        last = held(state, last)
        yield offset, last
        state.index += 1
        end = line + 1 + len(state.symbols)


def walk_outcar(marks: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, dict]]:
    end, state, last, seen, atoms = 0, trajectories.Outcar(), None, True, 0
    for line, offset, text in marks:
        if line < end:
            continue
        first, *rows = text.split("\n")
        found = state.see(first, iter(rows))
        if found != "frame":
            seen = True
            end = line + 4 if found == "cell" else end
            continue
        if seen:  # frames alone change nothing
            last, seen, atoms = held(state, last), False, sum(state.counts)
        yield offset, last
        end = line + 2 + atoms


def walk_lammpstrj(marks: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, dict]]:
    end, state, last = 0, trajectories.Dump(), None
    for line, offset, text in marks:
        if line < end:
            continue
        first, *rows = text.split("\n")
        taken = state.see(first, iter(rows))
        end = line + 1 + (taken or 0)
        if taken is None and first.startswith("ITEM: ATOMS"):
            last = held(state, last)
            yield offset, last
            end = line + 1 + state.n


WALKS: dict[str, Callable] = {"extxyz": walk_extxyz, "xdatcar": walk_xdatcar, "outcar": walk_outcar, "lammpstrj": walk_lammpstrj}


def walked(batches: Iterator[pa.RecordBatch], grammar: str) -> Iterator[tuple[str, int, int, str]]:
    """path, ordinal, offset and state (JSON, the same object as long as nothing has changed) of every frame."""
    for path, rows in groupby(rows_of_marks(batches), key=lambda r: r[0]):
        last = text = None
        for i, (offset, state) in enumerate(WALKS[grammar](numbered(rows))):
            if state is not last:
                last, text = state, json.dumps(state)
            yield path, i, offset, text


def marked(files: DataFrame, grammar: str, range_bytes: int) -> DataFrame:
    """The marks of the ranges of files, those of a file together and in order."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (r for batch in batches for r in batch.to_pylist())
        yield from batched((m for r in pieces for m in rows_of(r["path"], r["part"], marks_of(r["path"], r["part"], r["start"], r["stop"], grammar))), arrow, "marks")

    spark, arrow = files.sparkSession, to_arrow_schema(StructType.fromDDL(MARK))
    folder = scratch(spark, "marks")
    dealt(files, F.col("stop") - F.col("start"), max(range_bytes, TASK_BYTES)).mapInArrow(find, MARK).write.parquet(folder)
    marks = spark.read.parquet(folder)
    tasks = tasks_of(marks, F.col("marks"), TASK_MARKS)  # a number that is given isn't brought down by the few bytes of marks
    return marks.repartition(tasks, "path").sortWithinPartitions("path", "part", "block")


def frame_index(spark: SparkSession, path: str | list[str], grammar: str, pattern: str | None = None, range_bytes: int = RANGE_BYTES, into: str | None = None) -> DataFrame:
    """path, frame_index, offset, state (JSON) of every frame of the files below path, written to `into`, or to the shared folder. The marks of a file, not its frames, pass through one task."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(({"path": p, "frame_index": i, "offset": offset, "state": state} for p, i, offset, state in walked(batches, grammar)), arrow)

    arrow = to_arrow_schema(StructType.fromDDL(INDEX))
    into = into or scratch(spark, "frames")
    marked(file_ranges(spark, path, pattern, range_bytes), grammar, range_bytes).mapInArrow(entries, INDEX).write.parquet(into)
    return spark.read.parquet(into)


def pieces_of(frames: Iterator[tuple[str, int, int, str]], range_bytes: int) -> Iterator[dict]:
    """PIECE of all frames of files, which come in order."""
    for (path, _), found in groupby(frames, key=lambda f: (f[0], f[2] // range_bytes)):
        _, first, offset, state = next(found)
        last, end = first, offset
        for _, last, end, _ in found:
            pass
        yield {"path": path, "first": first, "last": last, "offset": offset, "state": state, "size": end - offset}


def frames_of(pieces: DataFrame, grammar: str, range_bytes: int, **options) -> DataFrame:
    """schema.FRAME of pieces of files, each read from its first frame to its last. The pieces are written first."""
    spark, kind = pieces.sparkSession, StructType.fromDDL(schema.FRAME)
    arrow = to_arrow_schema(kind)
    if "coords" in options:  # as the data source calls it
        options["space"] = options.pop("coords")
    folder = scratch(spark, "pieces")
    pieces.write.parquet(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    file.seek(r["offset"])
                    lines = io.TextIOWrapper(file, encoding="utf-8", errors="replace")
                    limit = None if r["last"] is None else r["last"] - r["first"] + 1
                    yield r["path"], lines, options | {"skip": r["first"], "limit": limit, "begin": (r["first"], json.loads(r["state"]))}

    return dealt(spark.read.parquet(folder), F.col("size"), max(range_bytes, TASK_BYTES)).mapInArrow(lambda batches: frame_batches(read(batches), grammar, arrow), kind)


def indexed_frames(index: DataFrame, grammar: str, where: Column | None = None, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """schema.FRAME of the frames of an index that meet a condition on path and frame_index. Each task reads one range of bytes of a file, from the first frame wanted in it to the last."""
    chosen = index if where is None else index.where(where)
    at = F.min_by(F.struct("offset", "state"), "frame_index")
    pieces = chosen.groupBy("path", F.floor(F.col("offset") / range_bytes)).agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), at.alias("at"), (F.max("offset") - F.min("offset")).alias("size"))
    out = frames_of(pieces.select("path", "first", "last", "at.offset", "at.state", "size"), grammar, range_bytes, **options)
    return out if where is None else out.where(where)


def read_split(spark: SparkSession, path: str | list[str], grammar: str, pattern: str | None = None, range_bytes: int = RANGE_BYTES, where: Column | None = None, **options) -> DataFrame:
    """The frames of trajectories, each file read by as many tasks as it has ranges. To read files more than once keep their frame_index."""
    if where is not None:
        return indexed_frames(frame_index(spark, path, grammar, pattern, range_bytes), grammar, where, range_bytes, **options)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(pieces_of(walked(batches, grammar), range_bytes), arrow)

    arrow, ranges = to_arrow_schema(StructType.fromDDL(PIECE)), file_ranges(spark, path, pattern, range_bytes)
    one = (F.col("start") == 0) & (F.col("stop") < range_bytes)  # the whole file, read from its beginning to its end
    nothing = {"first": F.lit(0), "last": F.lit(None), "offset": F.lit(0), "state": F.lit("{}"), "size": F.col("stop")}
    whole = ranges.where(one).select("path", *[c.cast("string" if k == "state" else "long").alias(k) for k, c in nothing.items()])
    return frames_of(whole.unionByName(marked(ranges.where(~one), grammar, range_bytes).mapInArrow(pieces, PIECE)), grammar, range_bytes, **options)
