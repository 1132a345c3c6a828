"""A Merkle manifest of a dataset: every row's proof up to one root, built by distributed block traversals.

A row is a leaf, the SHA-256 of its columns, each with its length before it. Leaves of a group (a source) are numbered in the order of
their ids by one range sort of digests; the texts never move. Blocks of 3^HEIGHT aligned leaves are dealt to tasks, each of which walks a
block in postorder: a subtree returns its digest, and while the recursion unwinds, each node's siblings are appended to the proofs of the
leaves below it. The roots of the blocks are the leaves of the next traversal, until a group has one node; the groups' roots, in the order
of their names, go the same way to the root. Proofs of the upper traversals are joined down, a row for each block.

A proof is a list of steps: the place of the own node in its run, and the digests of the others, left to right.

Defined results: a null is written as '-', so that it differs from an empty text; null ids come before all others; rows of equal ids stand
in the order of their digests, and rows that repeat take places beside each other; null groups come first; an empty table gives no rows.
Columns that are not named are not read. Ids may be of any type that has an order and a text form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialise, shuffle_partitions

ARITY = 3
#: Levels of a block: 729 leaves.
HEIGHT = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place:int,others:array<binary>>>"


def written(column: Column) -> Column:
    """A value as its length in bytes, a colon and its text; '-' for null."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row as lowercase hex."""
    return F.sha2(F.concat(*map(written, columns)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos (from 0 within the group) and n (rows of the group): one range sort, numbers within its partitions, and the counts of the partitions before."""
    spark = rows.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            new = np.concatenate([[keys[0].as_py() != last], np.asarray(pc.not_equal(keys[1:], keys[:-1]), dtype=bool)])
            place = np.arange(len(keys))
            at = place - np.maximum.accumulate(np.where(new, place, -count))  # the first run may go on from the batch before
            last, count = keys[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(at)], names=[*names, "__part", "__at"])

    names = rows.columns
    dealt = rows.repartitionByRange(shuffle_partitions(spark), group, *order).sortWithinPartitions(group, *order)
    out = materialise(dealt.mapInArrow(number, StructType([*rows.schema.fields, *_parse_datatype_string("__part int, __at long").fields])), "numbered")
    counts = out.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group)  # a row for each partition that holds the group
    counts = counts.select(group, "__part", F.sum("c").over(w).alias("n"), F.coalesce(F.sum("c").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return out.join(broadcast_if_small(materialise(counts, "counts")), [group, "__part"]).select(*names, (F.col("__at") + F.col("__before")).alias("pos"), "n")


def levels(n: int, most: int) -> int:
    """How often n nodes are gathered until one is left, or until `most` times."""
    count = 0
    while n > 1 and count < most:
        n, count = -(-n // ARITY), count + 1
    return count


def walk(leaves: list[str], height: int) -> tuple[str, list[list[tuple[int, list[bytes]]]]]:
    """The digest of one block and its leaves' proofs within it, by a postorder recursion."""
    proofs: list[list] = [[] for _ in leaves]

    def visit(a: int, b: int, level: int) -> str:
        if level == 0:
            return leaves[a]
        width = ARITY ** (level - 1)
        starts = range(a, b, width)
        found = [visit(s, min(s + width, b), level - 1) for s in starts]
        raw = [bytes.fromhex(x) for x in found]
        for place, s in enumerate(starts):
            step = (place, raw[:place] + raw[place + 1 :])
            for leaf in range(s, min(s + width, b)):
                proofs[leaf].append(step)
        return hashlib.sha256("".join(found).encode()).hexdigest()

    return visit(0, len(leaves), height), proofs


def traversed(nodes: DataFrame, group: str, height: int = HEIGHT) -> DataFrame:
    """nodes (group, pos, n, digest, ..) with block, the root of its block, and the path to it. A block is one task's work, and a task holds one at a time."""
    size = ARITY**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            rows = table.to_batches()[0]
            keys = np.asarray(rows.column("pos")) // size
            names = rows.column(group)
            ends = np.flatnonzero((keys[1:] != keys[:-1]) | np.asarray(pc.not_equal(names[1:], names[:-1]), dtype=bool)) + 1
            bounds = [0, *ends.tolist()]
            held = rows.slice(bounds[-1])
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield finished(rows.slice(a, b - a))
        if held is not None:
            yield finished(held)

    def finished(block: pa.RecordBatch) -> pa.RecordBatch:
        root, proofs = walk([x.hex() for x in block.column("digest").to_pylist()], levels(block.column("n")[0].as_py(), height))
        paths = [[{"place": p, "others": o} for p, o in proof] for proof in proofs]
        more = [pa.array([bytes.fromhex(root)] * len(paths), pa.binary()), pa.array(paths, kind)]
        return pa.RecordBatch.from_arrays([*block.columns, *more], names=[*block.schema.names, "root", "path"])

    kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))
    block = F.floor(F.col("pos") / size).cast("long")
    dealt = nodes.withColumn("block", block).repartition(shuffle_partitions(nodes.sparkSession), group, "block").sortWithinPartitions(group, "block", "pos")
    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, *_parse_datatype_string(f"root binary, path {PATH}").fields]))


def tree(rows: DataFrame, group: str, order: list[str], height: int = HEIGHT) -> DataFrame:
    """rows (group, digest, ..) with root, that of their group, and path, the steps to it."""
    size = ARITY**height
    nodes, floors = numbered(rows, group, order), []
    while True:
        floors.append(materialise(traversed(nodes, group, height), "blocks"))
        if (floors[-1].agg(F.max("n")).first()[0] or 0) <= size:
            break
        nodes = floors[-1].where(F.col("pos") % size == 0).select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("digest"))
    above = None
    for floor in reversed(floors[1:]):
        level = floor.select(group, F.col("pos").alias("below"), "block", "root", "path")
        if above is not None:
            level = level.drop("root").join(broadcast_if_small(above), [group, "block"]).select(group, "below", "root", F.concat("path", "more").alias("path"))
        above = materialise(level.select(group, F.col("below").alias("block"), "root", F.col("path").alias("more")), "above")
    out = floors[0]
    if above is not None:
        out = out.drop("root").join(broadcast_if_small(above), [group, "block"]).withColumn("path", F.concat("path", "more")).drop("more")
    return out.select(*rows.columns, "root", "path")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row for each row of docs: doc_id, source, leaf, subroot, root (binary digests), path, and what `carry` names, computed where the leaf is."""
    source = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)).alias("g"),  # in the order of the sources, null first
        F.col(f"`{id_col}`").alias("doc_id"),
        F.unhex(leaf_digest([F.col(f"`{c}`") for c in columns])).alias("digest"),
        F.monotonically_increasing_id().alias("row"),  # parts rows that repeat, so that no partition needs all of them
        *[c.alias(name) for name, c in (carry or {}).items()],
    )
    rows = tree(materialise(leaves, "leaves"), "g", ["doc_id", "digest", "row"], height)
    groups = materialise(rows.groupBy("g").agg(F.first("root").alias("digest")).withColumn("all", F.lit("")), "groups")
    upper = tree(groups, "all", ["g"], height).select("g", F.col("root").alias("top"), F.col("path").alias("last"))
    out = rows.join(broadcast_if_small(materialise(upper, "upper")), "g")
    source = F.when(F.col("g") != "0", F.substring("g", F.lit(2), F.length("g")))
    return out.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "last").alias("path"), *(carry or {}))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["others"])), text_of), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to, as lowercase hex."""

    def up(own: Column, step: Column) -> Column:
        others = F.transform(step["others"], text_of)
        return F.sha2(F.array_join(F.concat(F.slice(others, F.lit(1), step["place"]), F.array(own), F.slice(others, step["place"] + 1, F.lit(ARITY))), ""), 256)

    return F.aggregate(path, text_of(digest), up)


def verify(docs: DataFrame, stored: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id") -> DataFrame:
    """doc_id and verified for each row of a manifest: whether docs holds a row of this id whose leaf leads to the manifest's root. Ids are distinct here."""
    now = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(leaf_digest([F.col(f"`{c}`") for c in columns])).alias("now"))
    both = stored.alias("s").join(now.alias("d"), F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")), "left")
    return both.select("s.doc_id", F.coalesce(folded(F.col("now"), F.col("path")) == text_of(F.col("root")), F.lit(False)).alias("verified"))

