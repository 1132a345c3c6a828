"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table of one row for each distinct text: its SHA-256, the id that stays and the batch that brought it,
bucketed and sorted by digest. A batch is aggregated to its distinct digests, which meet the index in a sort-merge anti-join:
only they are shuffled, into the index's buckets, and the index is read bucket by bucket where it lies. The digests that the
index lacks are appended. Texts never move. A batch that is given again finds its own digests under its own name, appends
nothing, and gets the same result, so a job that was lost after the append can be repeated.

A whole table goes through an index of its own in two batches, the larger ids first, so that of equal texts the largest id stays.

Defined results: a null text counts as the empty text; equal ids that repeat count as rows of their own; null ids stay only
where a text has no other; an empty table gives no rows; other columns are not read. Of equal texts in one batch the largest
id stays; a text that the index held before the batch has no row that stays in this batch. Ids may be of any type that has an order.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, discard, listing, materialise, read_text, remove, shared_path, shuffle_partitions, write_new

#: A group of more than this share of all rows is joined apart: there are at most as many such groups as its inverse.
HOT_SHARE = 1 / 1000
#: Files that a bucket may have before the index is compacted.
MOST_FILES = 16


class DigestIndex:
    """A table (digest BINARY, keep_id, batch) below `path`, in `buckets` buckets sorted by digest.

    The path is all that tells an index: `_versions` holds a small file for each version, which names the folder of the table, its buckets
    and the type of keep_id; the last one counts. A session whose catalog doesn't know the table registers it from there, so an
    index outlives the application that began it. A path that holds anything else is refused. Appends add a file to each
    bucket; once a bucket has over `most_files`, the table is written again with one sorted file a bucket, as a new version. One job
    writes at a time. An append that was lost half-way is repeated under the same batch name.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_files: int = MOST_FILES):
        self.spark, self.most_files = spark, most_files
        self.path = (path or shared_path(spark, "digest_index")).rstrip("/")
        self.wanted = buckets or shuffle_partitions(spark)

    @property
    def state(self) -> dict:
        """The last version: folder, buckets, kind; {} where there is none."""
        names = sorted((n for n in listing(self.spark, f"{self.path}/_versions") if n.endswith(".json")), reverse=True)
        for name in names:
            try:
                return json.loads(read_text(self.spark, f"{self.path}/_versions/{name}")) | {"version": int(names[0][:-5])}
            except ValueError:
                continue  # its writer was lost while it wrote, and with it what it was about to name
        if not names and listing(self.spark, self.path):
            raise ValueError(f"{self.path} holds files that are no digest index")
        return {}

    def exists(self) -> bool:
        return bool(self.state)

    def _begin(self, kind: str, buckets: int, last: int = -1) -> dict:
        """A version with an empty folder of its own, not yet the last one."""
        return {"folder": f"data-{uuid.uuid4().hex[:12]}", "buckets": buckets, "kind": kind, "version": last + 1}

    def _publish(self, state: dict) -> None:
        write_new(self.spark, f"{self.path}/_versions/{state['version']:09d}.json", json.dumps({k: state[k] for k in ("folder", "buckets", "kind")}))

    def _name(self, state: dict) -> str:
        """The table of a version in this session's catalog, registered if it isn't there, its files listed anew."""
        place = f"{self.path}/{state['folder']}"
        name = f"digest_index_{hashlib.sha256(place.encode()).hexdigest()[:20]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {state['kind']}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {state['buckets']} BUCKETS LOCATION '{place}'")
        self.spark.sql(f"REFRESH TABLE {name}")
        return name

    def table(self) -> DataFrame:
        return self.spark.table(self._name(self.state))

    def lacking(self, digests: DataFrame) -> DataFrame:
        """Of rows (digest, doc_id) the distinct digests that the index lacks, with the largest id of each.

        The distinct ones are written first: the optimizer would have the join before the aggregate, and a hot digest's rows in one task.
        """
        groups, state = materialise(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "distinct"), self.state
        if not state:
            return groups
        known = self.spark.table(self._name(state)).select("digest")
        return groups.repartition(state["buckets"], "digest").hint("merge").join(known, "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        rows, state = self.lacking(digests).withColumn("batch", F.lit(batch)), self.state
        if not state:
            state = self._begin(digests.schema["doc_id"].dataType.simpleString(), self.wanted)
            self._publish(state)
        self._write(rows.repartition(state["buckets"], "digest"), state)
        if len(self._files(state)) > self.most_files * state["buckets"]:
            self.compact()

    def _write(self, rows: DataFrame, state: dict) -> None:
        rows.write.mode("append").format("parquet").bucketBy(state["buckets"], "digest").sortBy("digest").saveAsTable(self._name(state))

    def _files(self, state: dict) -> list[str]:
        return [n for n in listing(self.spark, f"{self.path}/{state['folder']}") if n.startswith("part-")]

    def compact(self) -> None:
        """Write the table again, one sorted file a bucket. The new version counts once it is whole; then the old one's files go."""
        old = self.state
        new = self._begin(old["kind"], old["buckets"], old["version"])
        # By the number of the bucket: rows of a bucketed table are left where they are if they are asked for by digest, several files a bucket.
        self._write(self.table().repartition(old["buckets"], F.pmod(F.hash("digest"), F.lit(old["buckets"]))), new)
        self._publish(new)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(old)}")
        remove(self.spark, f"{self.path}/{old['folder']}")

    def drop(self) -> None:
        state = self.state
        if state:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(state)}")
            remove(self.spark, self.path)


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, digest, keep_id, group_size (rows of docs with this text), kept.

    With an index, docs are one batch, of the given name. Without one, the whole table goes through an index of its own.
    """
    spark = docs.sparkSession
    digests = materialise(with_digest(docs, id_col, text_col), "digests")
    if index is not None:
        batch = batch or f"batch-{uuid.uuid4().hex}"
        index.append(digests, batch)
        return _decisions(digests, index, batch)
    index = DigestIndex(spark)
    pivot = digests.agg(F.min_by("doc_id", F.xxhash64("doc_id"))).first()[0]  # an id as good as drawn at random
    larger = F.coalesce(F.col("doc_id") > F.lit(pivot), F.lit(False))
    index.append(digests.where(larger), "larger ids")
    index.append(digests.where(~larger), "other ids")
    out = _decisions(digests, index)
    index.drop()
    return out


def _decisions(digests: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Each row with its group. A group that holds a large share of the rows is joined by broadcast, for there are few of them; all others by sort-merge."""
    counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialise(counts.hint("merge").join(index.table(), "digest").select("digest", "keep_id", "group_size", "batch"), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") > F.lit(total * HOT_SHARE)
    hot = groups.where(is_hot)
    out = digests.join(F.broadcast(hot), "digest")  # at most 1 / HOT_SHARE rows
    out = out.unionByName(digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").hint("merge").join(groups.where(~is_hot), "digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if batch is not None:
        stays &= F.col("batch") == batch
    return out.select("doc_id", "digest", "keep_id", "group_size", stays.alias("kept"))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns as they were; of rows equal in id and text one stays.

    The dropped rows are broadcast while they have at most so many bytes; beyond, the join shuffles.
    """
    decided = materialise(deduplicate(docs, index, batch, id_col, text_col), "decisions")
    again = decided.where("kept").groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
    again = materialise(again, "again")
    gone = materialise(decided.where(~F.col("kept")).select("doc_id", "digest").union(again).toDF("__id", "__digest_of"), "gone")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.withColumn("__digest", digest)
    fits = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__digest_of"))
    out = rows.join(broadcast_if_small(gone, broadcast_bytes), fits, "left_anti")
    if again.limit(1).count():
        out = out.unionByName(rows.join(broadcast_if_small(again.toDF("__id", "__digest_of"), broadcast_bytes), fits, "left_semi").dropDuplicates([id_col, "__digest"]))
    discard(decided)
    return out.drop("__digest")
