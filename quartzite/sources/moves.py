"""Copying and moving listed files, many tasks at once; nothing is written over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import dealt

STATUS = "source string, target string, status string"


def transferred(source: str, target: str, move: bool) -> str:
    """'done', 'exists' (another file stands at the target) or 'missing'. A copy becomes visible under its name when it is whole; what a lost task has done is found done."""
    import pyarrow.fs as fs

    split = lambda p: fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
    (a, at), (b, to) = split(source), split(target)
    here, there = a.get_file_info(at), b.get_file_info(to)
    same = here.is_file and there.is_file and here.size == there.size and _equal(a, at, b, to)
    if there.type != fs.FileType.NotFound and not same:
        return "done" if move and not here.is_file and there.is_file else "exists"
    if not here.is_file:
        return "missing"
    if not same:
        b.create_dir(to.rpartition("/")[0], recursive=True)
        with a.open_input_stream(at) as read, b.open_output_stream(f"{to}.part") as write:
            while piece := read.read(1 << 20):
                write.write(piece)
        b.move(f"{to}.part", to)
    if move:
        a.delete_file(at)
    return "done"


def _equal(a, at: str, b, to: str) -> bool:
    with a.open_input_stream(at) as x, b.open_input_stream(to) as y:
        while True:
            one, two = x.read(1 << 20), y.read(1 << 20)
            if one != two:
                return False
            if not one:
                return True


def transfer(plan: DataFrame, move: bool = False) -> DataFrame:
    """source, target, status of a plan of files (source, target). It runs when the result is written or collected: write it, and read the outcome from there.

    A file that is moved has one target; where it is gone and the target is there, it was moved before. Targets are to differ; of rows with the same target one is done (the first source by name), the others' status is 'exists'. Null sources or targets are 'missing'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["source", "target", "first"]).to_pylist()
            status = ["missing" if r["source"] is None or r["target"] is None else transferred(r["source"], r["target"], move) if r["source"] == r["first"] else "exists" for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("target"), pa.array(status, pa.string())], names=["source", "target", "status"])

    rows = plan.select("source", "target").distinct()
    first = rows.groupBy("target").agg(F.min("source").alias("first"))
    return dealt(rows.join(first, "target", "left"), F.lit(1 << 20)).mapInArrow(run, STATUS)
