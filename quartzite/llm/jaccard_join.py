"""Similarity join of word n-gram sets through count-vector R-trees.

Tokens of a set are hashed into groups and the group counts make a point. An R-tree over such points bounds the overlap of
a set with all sets below a node by the summed minima of its counts and the node's largest counts; surviving pairs are
verified on the sets themselves. Bounds in many dimensions prune well between few points and hardly at all at the top of
one tree over everything, so each tree covers one block of documents, and exact filters make the blocks:

1. Ordered by hash, two linked sets share a known number of tokens at their beginnings (about 15 % of the set at 0.85).
   The beginnings alone, about twice that share of all tokens, are shuffled. Tokens that repeat within a batch are counted
   there and leave one row, so that a token that every document has is still only a row for each batch.
2. Documents with fewer repeated tokens there than any link needs have no link. Of the others, one for each distinct set
   has its set rebuilt, and its tokens ordered from rare to frequent; only the first of them, by the prefix filter, make candidates.
3. Candidate components are the blocks. A block of over BLOCK sets is cut into parts, and each part is linked in itself and with
   the first one. What is then not connected in a component meets again either along the posting lists of its beginnings'
   tokens (lists with members of several groups, equal lists once), or, where that is less work, as everything outside the
   largest group with everything: a family of near copies, however large, is mostly one group by then, and a component that chance
   tokens chain together has short lists. In a block, pairs that are already connected are not looked at again, and what
   leaves is a forest. Blocks are dealt by range, so that tasks get like numbers of rows.

Every filter keeps every link, so the result is exact for 64-bit hashes of tokens.

Defined results: a null text, or one without words, has no tokens, links with nothing and is its own component; a text
shorter than an n-gram is one token; equal sets are one class; a null id is never the smallest of a component, and a component of null
ids only has a null id; rows that repeat, or share an id, are documents of their own; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BUCKETS_A_PART, bounded_batches, broadcast_if_small, discard, materialise, mix, packed_by, release_memory, shuffle_partitions, signed, text_slices, unpacked, window_hashes, word_hashes, word_lists
from .components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Sets in one R-tree, and their tokens (8 bytes each); larger blocks are cut into parts.
BLOCK = 100
BLOCK_TOKENS = 2_000_000
#: Tokens that a task holds at once while it counts them (16 bytes each).
TOKENS_PER_TASK = 4_000_000
#: Rows whose credits travel together.
GROUP_BITS = 12
LEAF = 16


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle."""
    offsets, flat = word_lists(texts)
    words = word_hashes(flat)
    whole = window_hashes(words, k)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.unique(whole[a : b - k + 1]) if b - a >= k else window_hashes(words[a:b], b - a, seed=k - (b - a) + 1) if b > a else whole[:0]


class Threshold:
    """Sizes of overlaps and of beginnings for a Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def smallest_partner(self, n):
        return -(-self.num * n // self.den)

    def extra(self, n):
        """How many tokens the extended beginnings of a set of n tokens and a partner not smaller share at least."""
        return np.maximum(1, (self.den - self.num) * n // self.den)

    def beginning(self, n):
        return np.minimum(n, n - self.smallest_partner(n) + self.extra(n))

    def shared(self, n):
        return self.extra(self.smallest_partner(n))

    def overlap(self, n, m):
        return -(-self.num * (n + m) // (self.num + self.den))


def _signatures(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """doc_id, n, sig (of the set; null without tokens), tokens (the extended beginning)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            n, sig, tokens = [], [], []
            for s in shingle_sets(part.column("text"), k):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens.append(signed(s[: int(t.beginning(len(s)))]))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))], names=["doc_id", "th", "n", "sig", "tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, sig binary, tokens array<long>")


def _repeats(signatures: DataFrame, total: int) -> DataFrame:
    """row, credit: at least how many tokens of the row's beginning occur in other rows with another set too (or more, never fewer)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(np.asarray(batch.column("sig").dictionary_encode().indices.fill_null(-1)), return_index=True)
            batch = batch.take(pa.array(np.sort(first)))
            lists = batch.column("tokens")
            token, owner = np.asarray(lists.flatten()), np.repeat(np.asarray(batch.column("row")), np.asarray(pc.list_value_length(lists)))
            distinct, where, count = np.unique(token, return_inverse=True, return_counts=True)
            again = count[where] > 1
            rows, credit = np.unique(owner[again], return_counts=True)
            marks = distinct[count > 1]
            key = np.concatenate([token[~again], marks, rows])
            bucket = mix(key.view(np.uint64)) % np.uint64(BUCKETS_A_PART * parts)
            yield packed_by(bucket, key=key, row=np.concatenate([owner[~again], np.full(len(marks), -1), rows]), credit=np.concatenate([np.zeros(len(key) - len(rows), np.int64), credit]).astype(np.int32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = unpacked(batches, "key", "row", "credit")
        if not columns:
            return
        key, row, credit = columns
        local, rows, credits = credit > 0, row, credit.astype(np.int64)
        key, row = key[~local], row[~local]
        order = np.argsort(key)
        key, row = key[order], row[order]
        same = key[1:] == key[:-1]
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(key) else np.zeros(0, bool)
        # A mark stands for repeats within a batch, also where no other batch has the token; its row needs no credit here.
        found, n = np.unique(row[again & (row >= 0)], return_counts=True)
        yield credited(np.concatenate([rows[local], found]), np.concatenate([credits[local], n]))
        release_memory()

    def credited(row: np.ndarray, credit: np.ndarray) -> pa.RecordBatch:
        """One row for each group of neighbouring rows, so that what a task sends does not grow with the number of documents times tasks."""
        order = np.argsort(row, kind="stable")
        row, credit = row[order], credit[order]
        group = row >> GROUP_BITS
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(row) else np.zeros(0, np.int64)
        ends = pa.array(np.concatenate([begin, [len(row)]]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(group[begin]), pa.ListArray.from_arrays(ends, pa.array(row)), pa.ListArray.from_arrays(ends, pa.array(credit))], names=["group", "rows", "credits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, rows, credits in zip(batch.column("group").to_pylist(), batch.column("rows"), batch.column("credits"), strict=True):
                total = sums.setdefault(group, np.zeros(1 << GROUP_BITS, np.int64))
                np.add.at(total, np.asarray(rows.values) & ((1 << GROUP_BITS) - 1), np.asarray(credits.values))
        for group, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((group << GROUP_BITS) + at), pa.array(total[at])], names=["row", "credit"])

    parts = max(shuffle_partitions(signatures.sparkSession), -(-total // TOKENS_PER_TASK))
    rows = signatures.where("n > 0").select("row", "sig", "tokens").mapInArrow(emit, "bucket long, key array<long>, row array<long>, credit array<int>")
    counted = rows.repartition(parts, "bucket").mapInArrow(count, "group long, rows array<long>, credits array<long>")
    return counted.repartition(parts, "group").mapInArrow(add, "row long, credit long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = list(shingle_sets(part.column("text"), k))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(sets))))], names=["sig", "tokens"])

    return docs.mapInArrow(run, "sig binary, tokens array<long>")


class CountVectorTree:
    """A two-level R-tree over the group counts of sets, in the order of their smallest tokens."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        groups = 16
        while groups < min(4096, size.max() / 4):
            groups *= 2
        self.points = np.zeros((len(sets), groups), np.uint16)
        for i, s in enumerate(sets):
            self.points[i] = np.minimum(np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups), 65535)
        self.sizes = size
        starts = np.arange(0, len(sets), LEAF)
        self.leaf_max = np.maximum.reduceat(self.points, starts, axis=0)
        self.leaf_min_size = np.minimum.reduceat(size, starts)
        tops = np.arange(0, len(starts), LEAF)
        self.top_max = np.maximum.reduceat(self.leaf_max, tops, axis=0)
        self.top_min_size = np.minimum.reduceat(self.leaf_min_size, tops)

    @staticmethod
    def bound(points: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.minimum(points, point).sum(axis=1, dtype=np.int64)

    def candidates(self, i: int, t: Threshold, open_: np.ndarray) -> np.ndarray:
        """Members that open_ allows and whose bound reaches the overlap that a link needs, the best bounds first."""
        point, n = self.points[i], self.sizes[i]
        tops = np.flatnonzero(self.bound(self.top_max, point) >= t.overlap(n, self.top_min_size))
        leaves = (tops[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.leaf_max)]
        leaves = leaves[self.bound(self.leaf_max[leaves], point) >= t.overlap(n, self.leaf_min_size[leaves])]
        members = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        members = members[members < len(self.points)]
        members = members[open_[members]]
        bound = self.bound(self.points[members], point)
        good = bound >= t.overlap(n, self.sizes[members])
        return members[good][np.argsort(-bound[good], kind="stable")]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def link_block(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, t: Threshold, within: bool) -> list[tuple[int, int]]:
    """A forest that connects what links connect, of sets whose labels differ (equal labels are connected already). Unless within, only pairs of different sides are looked at."""
    order = sorted(range(len(sets)), key=lambda i: (sets[i][0], len(sets[i])))
    nodes, sets, side, label = nodes[order], [sets[i] for i in order], side[order], label[order]
    tree, edges = CountVectorTree(sets), []
    for i in range(len(sets)):
        open_ = label != label[i]
        open_[: i + 1] = False
        if not within:
            open_ &= side != side[i]
        if not open_.any():
            continue
        found = tree.candidates(i, t, open_)
        while len(found):
            j, found = found[0], found[1:]
            if overlap(sets[i], sets[j]) >= t.overlap(len(sets[i]), len(sets[j])):
                edges.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
                found = found[label[found] != label[i]]
    return edges


def _parts(members: DataFrame, block: int) -> DataFrame:
    """How many parts each component is cut into."""
    return members.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int").alias("parts"))


def _block_edges(placed: DataFrame, t: Threshold) -> DataFrame:
    """placed: comp, i, j, side, node, label, tokens. Edges (a, b) of each block (comp, i, j); where i is j, pairs of one side count too."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("tokens").combine_chunks()
        flat, ends = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        side, label = np.asarray(group.column("side")), np.asarray(group.column("label")).copy()
        edges = link_block(np.asarray(group.column("node")), sets, side, label, t, group.column("i")[0] == group.column("j")[0])
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return placed.groupBy("comp", "i", "j").applyInArrow(run, "a long, b long")


def _dealt(placed: DataFrame) -> DataFrame:
    """Blocks of large components dealt by range, so that tasks get like numbers of rows."""
    return placed.repartitionByRange(shuffle_partitions(placed.sparkSession), "comp", "i", "j")


def _lists(large: DataFrame, begin: DataFrame, block: int) -> DataFrame:
    """large: comp, node, label, tokens; begin: node, token. The posting lists that hold several labels, one of equal lists: comp, token, cuts (parts of at most a block), work (rows that its blocks take)."""
    rows = begin.join(large.select("comp", "node", "label", F.size("tokens").alias("size")), "node")
    mixed = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"h{seed}") for seed in (1, 2)]
    lists = rows.groupBy("comp", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), *mixed).where("low <> high")
    lists = lists.groupBy("comp", "n", "size", "h1", "h2").agg(F.min("token").alias("token"))
    lists = lists.withColumn("cuts", F.ceil(F.greatest(F.col("n") / block, F.col("size") / BLOCK_TOKENS)).cast("int"))
    return lists.select("comp", "token", "cuts", (F.col("n") * F.col("cuts")).alias("work"))


def _list_blocks(large: DataFrame, begin: DataFrame, lists: DataFrame) -> DataFrame:
    """The blocks of posting lists: every pair of a list's parts. A token names its list, for it is of one component only."""
    rows = begin.join(lists.select("token", "cuts"), "token").withColumn("side", F.pmod(F.xxhash64("token", "node"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select(F.col("token").alias("comp"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node")
    return rows.join(large.select("node", "label", "tokens"), "node").select("comp", "i", "j", "side", "node", "label", "tokens")


def _links(members: DataFrame, begin: DataFrame, t: Threshold, block: int) -> DataFrame:
    """members: comp, node, tokens (a written table); begin: node, token. Edges (a, b) of forests that connect what links connect within each component."""
    parts = materialise(_parts(members, block), "parts")
    placed = members.join(parts, "comp")
    zero = F.lit(0)
    whole = placed.where("parts = 1").select("comp", zero.alias("i"), zero.alias("j"), zero.alias("side"), "node", F.col("node").alias("label"), "tokens")
    small = materialise(_block_edges(whole, t), "links")
    if not parts.where("parts > 1").limit(1).count():
        return small
    placed = materialise(placed.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "placed")
    blocks = F.when(F.col("part") == 0, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.lit(0).alias("i"), j.alias("j"))))
    blocks = blocks.otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("part").alias("j")), F.struct(F.col("part").alias("i"), F.col("part").alias("j"))))
    first = placed.withColumn("b", F.explode(blocks)).select("comp", "b.i", "b.j", F.col("part").alias("side"), "node", F.col("node").alias("label"), "tokens")
    edges = materialise(_block_edges(_dealt(first), t), "links")
    labels = components(edges).withColumnRenamed("root", "label")
    large = materialise(placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "large")
    edges = small.unionByName(edges)
    discard(placed)
    main = large.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = materialise(large.join(main, "comp").where("label <> main").select("comp", "node", "label", "tokens", "parts"), "outside")
    lists = materialise(_lists(large, begin, block), "lists")
    # The rows that each way takes: along the lists, or everything outside with everything.
    size = large.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts"))
    loose = _parts(outside, block).withColumnRenamed("parts", "cuts").join(outside.groupBy("comp").agg(F.count(F.lit(1)).alias("m")), "comp")
    work = size.join(loose, "comp").join(lists.groupBy("comp").agg(F.sum("work").alias("work")), "comp", "left")
    along = materialise(work.where(F.coalesce("work", F.lit(0)) <= F.col("n") * F.col("cuts") + F.col("m") * F.col("parts")).select("comp"), "along")
    chosen = materialise(lists.join(along, "comp", "left_semi"), "chosen")
    edges = edges.unionByName(materialise(_block_edges(_dealt(_list_blocks(large, begin, chosen)), t), "links"))
    others = materialise(outside.join(along, "comp", "left_anti"), "others")
    if not others.limit(1).count():
        return edges
    cuts = materialise(_parts(others, block).withColumnRenamed("parts", "cuts"), "cuts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = large.join(cuts, "comp").select("comp", every("cuts").alias("i"), (-1 - F.col("part")).alias("j"), F.lit(0).alias("side"), "node", "label", "tokens")
    columns = others.join(cuts, "comp").withColumn("i", F.pmod(F.xxhash64(F.lit("cut"), "node"), F.col("cuts")).cast("int"))
    columns = columns.select("comp", "i", every("parts").alias("j"), F.lit(1).alias("side"), "node", "label", "tokens").withColumn("j", -1 - F.col("j"))
    return edges.unionByName(materialise(_block_edges(_dealt(rows.unionByName(columns)), t), "links"))


def similar_groups(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, class_id (of equal sets; null without tokens), class_size, component_id (smallest id reachable by links).

    Two sets link when den * intersection >= num * union.
    """
    bounded_batches(docs.sparkSession)
    spark, t = docs.sparkSession, Threshold(num, den)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    rows = materialise(_signatures(docs, words, t).withColumn("row", F.monotonically_increasing_id()), "sets")
    total = rows.agg(F.sum(F.size("tokens"))).first()[0] or 0
    classes = materialise(rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n")), "classes")
    enough = F.greatest(F.lit(1), F.floor((den - num) * F.floor((num * F.col("n") + den - 1) / den) / den))
    kept = rows.where("n > 0").select("row", "n", "sig").join(_repeats(rows, total), "row").where(F.col("credit") >= enough)
    kept = materialise(classes.join(kept.select("sig").distinct(), "sig", "left_semi"), "kept")

    ids = broadcast_if_small(kept.select("rep").distinct())
    sets = _sets(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi"), words).join(kept.select("sig", "node", "n"), "sig").select("node", "n", "tokens")
    sets = materialise(sets, "sets")

    # From rare to frequent: tokens of one set only come first, so the beginning holds few shared tokens, or none.
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    # Written first, so that the joins are of two plain shuffles and a frequent token can be split.
    often = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    shared = tokens.join(often, "token").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    least = F.floor((num * F.col("n") + den - 1) / den)
    take = F.col("n") - least + 1 - (F.col("n") - F.size("shared"))
    begin = shared.withColumn("take", take.cast("int")).where("take > 0").select("node", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("s")).select("node", F.col("s.token").alias("token"))
    begin = materialise(begin, "beginnings")
    lowest = materialise(begin.groupBy("token").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1"), "lowest")
    near = components(begin.join(lowest, "token").select(F.col("low").alias("a"), F.col("node").alias("b")))

    members = materialise(near.select(F.col("root").alias("comp"), "node").join(sets.select("node", "tokens"), "node"), "members")
    linked = components(_links(members, begin, t, block))
    named = classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Roots of several classes only, and written first, so that the join is of plain shuffles and a large component can be split.
    several = materialise(named.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("together")).where("together > 1"), "several")
    least_id = F.when(F.col("together").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")
    named = materialise(named.join(several, "root", "left").select("sig", F.col("node").alias("class_id"), "class_size", least_id), "classes")
    for table in (begin, lowest, often, sets, kept, members, several):
        discard(table)
    slim = rows.select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), "sig")
    out = slim.where("sig IS NOT NULL").join(named, "sig").select("doc_id", "text_hash", "n_shingles", "class_id", "class_size", "component_id")
    alone = slim.where("sig IS NULL").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_size"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def drop_similar(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with the smallest id of their component, all columns as they were; texts without words all stay.

    The dropped rows are broadcast while they have at most so many bytes; beyond, the join shuffles.
    """
    groups = materialise(similar_groups(docs, words, num, den, id_col, text_col), "groups")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"))
    gone = broadcast_if_small(gone, broadcast_bytes)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")
