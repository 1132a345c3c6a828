"""Very many small files: written by key, listed by tasks, several read by a task; what Spark's listings hide is no input."""

import pytest
from pyspark.sql import functions as F

from quartzite.sources import files, frame_index, ranges, sinks

FRAME = "1\nLattice=\"1 0 0 0 1 0 0 0 1\"\nH 0 0 0\n"


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "a.xyz").write_text(FRAME * 2)
    df = files.read_trajectories(spark, str(tmp_path), "extxyz")
    assert df.rdd.getNumPartitions() <= 32
    assert df.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("frame_index").alias("i")).where("n = 2 AND i = 1").count() == 300


def test_folders_are_those_of_a_partitioned_table(spark, tmp_path):
    """Files of keys as Spark's own writer leaves them: names of folders, blanks, signs, nulls, rows of several tasks, lines."""
    keys = ["a", "b c", "x=1", "50%", "[q]{r", "ü", "", None, "s/t", "c:d*e", "#'\"", "^\\"]
    rows = [(k, i, None if i == 5 else f"{k} {i}\nmore") for i in range(9) for k in keys]
    df = spark.createDataFrame(rows, "k string, i int, text string").repartition(3, "i")
    own, other = str(tmp_path / "own"), str(tmp_path / "other")
    for _ in range(2):  # a folder is replaced
        sinks.write_text(df, F.col("text"), own, ["k", "i"])
    df.select("k", "i", F.col("text").alias("value")).write.partitionBy("k", "i").text(other)
    read = lambda p: sorted(map(str, spark.read.text(p).collect()))
    assert read(own) == read(other) and len(read(own)) == len(keys) * (9 * 2 - 1)
    folders = lambda p: {str(f.parent.relative_to(p)) for f in p.rglob("*") if f.is_file() and f.suffix in (".txt",)}
    assert folders(tmp_path / "own") == folders(tmp_path / "other")


def test_listing_is_that_of_spark(spark, tmp_path):
    for name in ("a/b/x.log", "a/y.txt", "z.log", ".hidden.log", "_SUCCESS", "_k=1/v.log", "_temporary/0/w.log", "a/.x.log.crc", "u v/w.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("0123456789")
    for pattern in (None, "*.log", "x.*"):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        expected = {r.path.replace("file:", "") for r in (reader.option("pathGlobFilter", pattern) if pattern else reader).load(str(tmp_path)).collect()}
        for path in (str(tmp_path), f"file:{tmp_path}"):
            got = [(r.path, r.start, r.stop) for r in ranges.file_ranges(spark, path, pattern, range_bytes=6).collect()]
            assert sorted(got) == sorted((p, a, b) for p in expected for a, b in ((0, 6), (6, 10)))
    (tmp_path / "none").mkdir()
    assert ranges.file_ranges(spark, str(tmp_path / "none")).count() == 0


def test_checksums_are_no_frames(spark, tmp_path):
    """Bytes of a hidden file that look like a frame aren't counted; a count behind a NUL is one, and a huge one takes what there is."""
    (tmp_path / "a.xyz").write_text(FRAME)
    (tmp_path / ".a.xyz.crc").write_bytes(b"crc\n2\nrun_id=x\n\xff\n")
    (tmp_path / "b.xyz").write_bytes(b"\0" + FRAME.encode() + b"99999999999999\ncut\nH 0 0 0\n")
    for read in (files.read_trajectories, frame_index.read_split):
        got = sorted((r.path[-5:], r.frame_index, r.n_atoms) for r in read(spark, str(tmp_path), "extxyz").collect())
        assert got == [("a.xyz", 0, 1), ("b.xyz", 0, 1)]


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(FRAME * 3000)
    index = frame_index.frame_index(spark, str(tmp_path), "extxyz", range_bytes=512)
    found = frame_index.indexed_frames(index, "extxyz", range_bytes=512)
    assert found.rdd.getNumPartitions() <= 16 and found.count() == 3000


def test_small_structures_share_batches(spark, monkeypatch):
    """Readable and broken files in one partition, in batches that several files fill: the rows and errors of each stay."""
    text = "x\n1.0\n4 0 0\n0 4 0\n0 0 4\nMn\n1\nDirect\n0 0 0\n"
    rows = spark.createDataFrame([(str(i), text if i % 10 else "broken") for i in range(1000)], "path string, text string").coalesce(1)
    got = files.structures_of(rows, error="wrong").select("path", "n_atoms", "wrong").collect()
    assert {r.path: (r.n_atoms, r.wrong is None) for r in got} == {str(i): (1, True) if i % 10 else (None, False) for i in range(1000)} and len(got) == 1000


def test_index_is_made_by_many_tasks_from_few_states(spark, tmp_path):
    """The marks of small files are walked by several tasks, and frames under one header share one state, without their ordinals."""
    head = "x\n1.0\n4 0 0\n0 4 0\n0 0 4\nA\n1\n"
    for k in range(40):
        (tmp_path / f"{k}.xdat").write_text(head + "Direct configuration= 1\n0 0 0\n" * 30 + head.replace("4", "5") + "Direct configuration= 1\n0 0 0\n" * 5)
    index = frame_index.frame_index(spark, str(tmp_path), "xdatcar")
    assert index.count() == 40 * 35 and index.select("state").distinct().count() == 2
    assert len(index.inputFiles()) > 4
    got = frame_index.indexed_frames(index, "xdatcar", F.col("frame_index").isin(29, 30)).select("frame_index", F.col("cell")[0].alias("a")).distinct().collect()
    assert sorted(map(tuple, got)) == [(29, 4.0), (30, 5.0)]


def test_names_of_folders_stay_with_the_tasks(spark, tmp_path, monkeypatch):
    """The driver moves no file of a key; files that a move left behind when it was tried again are as they were, and a job that fails leaves none."""
    import pyarrow.fs as fs

    from quartzite.sources import frame_writer

    class Store:
        def __init__(self):
            self.calls = []

        def __reduce__(self):  # tasks have a plain one
            return fs.LocalFileSystem, ()

        def __getattr__(self, name):
            self.calls.append(name)
            return getattr(fs.LocalFileSystem(), name)

    store, path = Store(), str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(frame_writer, "located", lambda p: (store, p))
        df = spark.range(200).select("id", F.format_string("text %d", "id").alias("value"))
        frame_writer.write_folders(df, path, ["id"], "value")
    assert "move" not in store.calls and len(store.calls) < 10
    assert {(r.id, r.value) for r in spark.read.text(path).collect()} == {(i, f"text {i}") for i in range(200)}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_temporary")]
    with pytest.raises(Exception, match="broken"):
        frame_writer.write_folders(df.withColumn("value", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("value"))), path, ["id"], "value")
    assert not list((tmp_path / "out").iterdir())


def test_files_are_listed_once(spark, tmp_path):
    """Ranges that are counted and then read are those of one listing, whatever comes into the folders in between."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("0123456789")
    found = ranges.file_ranges(spark, str(tmp_path))
    (tmp_path / "a" / "y.log").write_text("0123456789")
    assert [r.path for r in found.collect()] == [str(tmp_path / "a" / "x.log")]


def test_outcar_index_is_made_by_many_tasks(spark, tmp_path):
    head = " TITEL  = PAW O x\n   ions per type =   1\n"
    for k in range(40):
        (tmp_path / f"{k}.OUTCAR").write_text(head + " POSITION    TOTAL-FORCE (eV/Angst)\n ----\n 0 0 0 1 1 1\n" * 5)
    index = frame_index.frame_index(spark, str(tmp_path), "outcar")
    assert index.count() == 200 and len(index.inputFiles()) > 4
    assert frame_index.indexed_frames(index, "outcar").count() == 200


def test_a_split_scan_moves_ranges_not_frames(spark, tmp_path, monkeypatch):
    """What is shuffled for 4,000 frames that are all read are rows of ranges: of marks, and of where to begin."""
    step = " POSITION    TOTAL-FORCE (eV/Angst)\n ----\n 0 0 0 1 1 1\n"
    for k in range(2):
        (tmp_path / f"{k}.OUTCAR").write_text(" TITEL  = PAW O x\n   ions per type =   1\n" + step * 2000)
    made, scratch = [], frame_index.scratch
    monkeypatch.setattr(frame_index, "scratch", lambda spark, name: made.append(scratch(spark, name)) or made[-1])
    split = frame_index.read_split(spark, str(tmp_path), "outcar", range_bytes=1 << 15)
    whole = frame_index.indexed_frames(frame_index.frame_index(spark, str(tmp_path), "outcar"), "outcar")
    assert made and all(spark.read.parquet(p).count() <= 10 for p in made[:2])
    assert split.count() == 4000 and sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_columns_of_steps_are_the_frames_of_the_grammar(spark):
    """Numbers that Arrow may read in another way than Python, lines that are short or long, steps that break off, changed species."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from quartzite import schema
    from quartzite.sources import frame_batches, trajectories

    arrow = to_arrow_schema(StructType.fromDDL(schema.FRAME))
    head = " TITEL  = PAW Mn_pv x\n TITEL  = PAW O x\n   ions per type =   1   1\n"
    step = " POSITION    TOTAL-FORCE (eV/Angst)\n ----\n{}\n{}\n"
    good = "\t1.5 -2e3 .5  1. 0 -0.0  more"
    odd = ["1 2 3 4 5", "1 2 3 4 5 ***", "", "1_0 2 3 4 5 6", "+1 2 3 4 5 6", "nan inf -inf 4 5 6", "nan(1) 2 3 4 5 6", "1 2 3 4 5 6", "1\x1f2 3 4 5 6", "0x1 2 3 4 5 6", "1\0 2 3 4 5 6", "1 2 3 4 5 6\r"]
    for text in [*odd, good]:
        steps = [head, step.format(good, text), step.format(text, good), "   ions per type =   0   1\n", step.format(good, text), "direct lattice vectors\n1 0 0\n0 1 0\n0 0 1\n", step.format(good, good), " POSITION TOTAL-FORCE\n --\n"]
        lines = "".join(steps).splitlines(keepends=True)
        expected = [{"path": p} | f for p in "ab" for f in trajectories.outcar(lines)]
        got = pa.Table.from_batches(list(frame_batches.frame_batches(((p, lines, {}) for p in "ab"), "outcar", arrow)), schema=arrow)
        assert expected and str(got.to_pylist()) == str(pa.Table.from_pylist(expected, schema=arrow).to_pylist())


def test_files_of_one_range_are_read_once(spark, tmp_path, monkeypatch):
    """Small files beside a long one: the long one alone is marked, and the frames are those of the stream; empty files have none."""
    step = " POSITION    TOTAL-FORCE (eV/Angst)\n ----\n 0 0 0 1 1 1\n"
    for k, n in enumerate((0, 1, 5, 300)):
        (tmp_path / f"{k}.OUTCAR").write_text(" TITEL  = PAW O x\n   ions per type =   1\n" + step * n)
    (tmp_path / "empty.OUTCAR").write_text("")
    made, scratch = [], frame_index.scratch
    monkeypatch.setattr(frame_index, "scratch", lambda spark, name: made.append(scratch(spark, name)) or made[-1])
    split = frame_index.read_split(spark, str(tmp_path), "outcar", range_bytes=1 << 12)
    assert [r.path[-8:] for r in spark.read.parquet(made[0]).select("path").distinct().collect()] == ["3.OUTCAR"]
    assert sorted(map(str, split.collect())) == sorted(map(str, files.read_trajectories(spark, str(tmp_path), "outcar").collect()))
    made.clear()
    few = frame_index.read_split(spark, str(tmp_path), "outcar", "[012].OUTCAR")
    assert few.count() == 6 and spark.read.parquet(made[0]).count() == 0
