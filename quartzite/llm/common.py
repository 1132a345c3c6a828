"""Helpers shared by the text operators: shared storage, batch slicing, exact word splitting and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the two word definitions, after A-Z are lower-cased where that is asked for.
ALNUM_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 3 << 20
BATCH_BYTES = 8 << 20
#: Beyond this, a size that the optimizer gives is no estimate, but its stand-in for an unknown one.
UNKNOWN_BYTES = 1 << 50
#: Bytes of text for each byte of a compressed columnar file, roughly.
PACKED = 2
#: Bytes that may be broadcast: sides of joins are measured against it.
BROADCAST_BYTES = 64 << 20
#: Buckets of packed rows for each partition that they are dealt to, so that partitions are alike.
BUCKETS_A_PART = 32
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; then it is a new temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quartzite-"))
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, where the session leaves Spark's default: ten thousand long texts are a lot to hold in two processes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _store(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop has them: any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, folder: str) -> None:
    store, path = _store(spark, folder)
    store.delete(path, True)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    store, path = _store(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _store(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an error if there is one already."""
    store, place = _store(spark, path)
    stream = store.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once nothing that was built on them is read any more."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """About how many bytes of text docs holds, from the sizes of its files; only where these are unknown it is counted. Sizes of filters follow it, results don't."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < UNKNOWN_BYTES:
        return PACKED * known
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a written table in the shared folder: it survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[0].endswith(f"/{spark.sparkContext.applicationId}"):
            remove(spark, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of df have at most `limit` bytes."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its values have at most `limit` bytes; else joins shuffle it."""
    return F.broadcast(df) if is_small(df, limit) else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]
    release_memory()


def release_memory() -> None:
    """Hand freed memory back: Spark keeps Python workers for later tasks, and theirs would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_lists(texts: pa.Array, kind: str = "space", lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words and the flat words. kind: 'space' takes [^\\x20\\x09-\\x0D]+, 'alnum' what ALNUM_SPLIT leaves."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts) if kind == "space" else pc.split_pattern_regex(texts, pattern=ALNUM_SPLIT)
    offsets, flat = np.asarray(lists.offsets, dtype=np.int64), lists.values
    offsets_in = offsets - offsets[0]
    flat = flat.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        offsets_in = np.concatenate([[0], np.cumsum(full)])[offsets_in]
        flat = flat.filter(pa.array(full))
    return offsets_in, flat


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, hashing each distinct word once."""
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return table[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)


def word_digests(flat: pa.Array) -> np.ndarray:
    """A 128-bit hash of each word as a row of two numbers, the first of them that of word_hashes' kind."""
    coded = flat.dictionary_encode()
    raw = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)[np.asarray(coded.indices)] if raw else np.zeros((0, 2), np.uint64)


def in_order(id_col: Column) -> Column:
    """A sortable, joinable form of ids of any type: by id, null ids last and equal to each other."""
    return F.struct(id_col.isNull().alias("last"), id_col.alias("id"))


def sample_share(wanted: Column | float, *keys: Column) -> Column:
    """Whether a row is in a sample of the given share of all rows, chosen by a 63-bit hash of its keys: shares of 1e-12 still choose rows."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1) < F.lit(2.0**63) * wanted


def sampled(rows: DataFrame, wanted: Column | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About the given share of rows, by a hash of id and text, so that rows with equal (or null) ids don't go together; of equal rows one."""
    return rows.where(sample_share(wanted, F.col(id_col), F.col(text_col))).dropDuplicates([id_col, text_col])


def packed_by(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its number and a list of each column's values. A shuffle by bucket then moves few wide rows instead of one for each value."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = pa.array(np.append(begin, len(bucket)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int64)), *(pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in columns.values())], names=["bucket", *columns])


def unpacked(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """All values of the list columns of a task's rows; nothing where it has no rows."""
    parts = [[batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names] for batch in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        out += words[j : j + n]
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(seed))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
