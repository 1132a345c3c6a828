"""Files in byte ranges: the same rows as in one piece, wherever the ranges end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quartzite.sources import files, frame_index, logs, ranges, settings, trajectories


def log_lines(rng, n):
    """Lines of several kinds of logs in any order, with headers, blanks and broken rows."""
    kinds = [
        lambda: "Step Temp TotEng Press Volume", lambda: "   step  Volume Temp", lambda: f"{rng.randint(0, 99)} 300.0 -1.5 0.5 {rng.randint(1, 9)}.0", lambda: f" {rng.randint(0, 99)} 64.0 310.5 1", lambda: "Loop time of 1", lambda: "",
        lambda: "12 nonsense", lambda: f"{rng.randint(1, 9)} 2.5", lambda: f"DAV: {rng.randint(1, 40)} -0.1", lambda: f"  {rng.randint(1, 9)} T= {rng.randint(1, 500)}. E= -1.5 F= -2.0" + rng.choice(["", " E0= -.3E+01"]),
        lambda: f"  volume of cell : {rng.randint(10, 90)}.5", lambda: f"  free  energy   TOTEN  = -{rng.randint(1, 9)}.25 eV", lambda: f"  external pressure = {rng.randint(-9, 9)}.0 kB", lambda: " POSITION   TOTAL-FORCE (eV/Angst)\n -----\n 0 0 0 3.0 4.0 0.0\n 1 1 1 0.0 0.0 " + f"{rng.randint(1, 9)}.0",
        lambda: " POSITION   TOTAL-FORCE (eV/Angst)", lambda: " ------", lambda: f"0 0 0 1.0 2.0 {rng.randint(1, 9)}.0", lambda: f"  temperature = {rng.randint(1, 500)}.5 K", lambda: f" kinetic (temperature {rng.randint(1, 500)}.0 K)", lambda: "TEBEG = 3; temperature = 5.0",
        lambda: f"  EKIN_LAT= 0.0  (temperature  {rng.randint(1, 500)}.0 K)", lambda: f" e_b> 1.0 -{rng.randint(1, 9)}.5 3", lambda: "# comment 1 2", lambda: "1.5, 2.5", lambda: "ZBRENT: fatal error",
    ]
    chosen = rng.sample(kinds, rng.randint(3, len(kinds)))
    return "\n".join(rng.choice(chosen)() for _ in range(n)).split("\n")


PARSERS = {
    "tvp": logs.Counted({"t": r"temperature\s*=?\s*([\d.]+)", "v": r"volume of cell\s*:\s*([\d.]+)"}, {"t": "temperature", "v": "volume"}, {"t": "TEBEG"}, every=False),
    "best": logs.BestWay({"a": r"EKIN_LAT.*temperature\s+([\d.]+)", "b": r"temperature\s*=\s*([\d.]+)", "c": r"\(temperature\s+([\d.]+)"}, dict.fromkeys("abc", "temperature")),
    "failed": logs.Marked("ZBRENT"), "point": logs.LastPoint(), "steps": logs.IonicSteps(), "thermo": logs.ThermoBlocks(), "columns": logs.NumberedLines(),
}


@pytest.mark.parametrize("name", PARSERS)
def test_parsers_compose(name):
    """A file cut at any lines gives the rows and the end that it gives in one piece."""
    parser, rng = PARSERS[name], random.Random(name)
    for _ in range(300):
        lines = log_lines(rng, rng.randint(0, 40))
        whole = parser.step(parser.start(), parser.summarise(lines, []))
        expected = list(parser.rows(parser.start(), lines, [], whole)) if hasattr(parser, "rows") else []
        cuts = sorted(rng.choices(range(len(lines) + 1), k=rng.randint(1, 6)))
        state, pieces = parser.start(), []
        for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
            pieces.append((state, lines[a:b], lines[b : b + parser.after]))
            state = json.loads(json.dumps(parser.step(state, parser.summarise(lines[a:b], lines[b : b + parser.after]))))
        assert state == json.loads(json.dumps(whole))
        if expected:
            assert sorted(map(str, (r for s, x, more in pieces for r in parser.rows(s, x, more, whole)))) == sorted(map(str, expected))


def test_blocks_have_the_lines_that_begin_in_them(tmp_path):
    rng = random.Random(1)
    for k in range(60):
        text = "".join(rng.choice(["\n", "a\n", "bcd\r\n", "x" * rng.randint(0, 30) + "\n"]) for _ in range(rng.randint(0, 20))) + rng.choice(["", "end", "\n"])
        path = tmp_path / str(k)
        path.write_bytes(text.encode())
        lines = ranges.split_lines(text)
        for size in (1, 3, 7, 20, 1000):
            found = []
            for start in range(0, max(1, len(text)), size):
                own, more = ranges._range_lines(str(path), start, min(start + size, len(text)), 2)
                found += own
                assert more == lines[len(found) : len(found) + 2] or not own
            assert found == lines


@pytest.fixture(scope="module")
def logged(tmp_path_factory):
    """Logs of many ranges: runs of one kind each, as files and as texts."""
    base, rng, texts = tmp_path_factory.mktemp("logs"), random.Random(9), {}
    for k in range(6):
        texts[str(base / f"{k}.log")] = "\n".join(log_lines(rng, 120)) + ("\n" if k % 2 else "")
    texts[str(base / "empty.log")] = ""
    for path, text in texts.items():
        open(path, "w").write(text)
    return str(base), texts


@pytest.mark.parametrize("scan", [settings.tvp, settings.temperatures, settings.oszicar, settings.lammps_thermo, settings.report_energies, settings.two_columns, settings.eos_point])
def test_logs_in_ranges(spark, logged, scan):
    base, texts = logged
    whole = scan(spark.createDataFrame(list(texts.items()), "path string, text string"))
    cut = scan(ranges.file_ranges(spark, base, "*.log", range_bytes=500))
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(whole) == rows(cut) and len(rows(cut)) > 0
    assert ranges.file_ranges(spark, base, "*.log", range_bytes=500).groupBy("path").count().agg(F.max("count")).first()[0] >= 4


def trajectory(grammar, rng, n):
    """A file with frames that are good, broken, of another cell, and lines that look like beginnings of frames."""
    row = lambda k: " ".join(f"{rng.random():.4f}" for _ in range(k))
    out = []
    for i in range(n):
        bad = rng.random() < 0.1
        if grammar == "extxyz":
            size = rng.randint(0, 4)
            out += [str(size), rng.choice(["5", 'Lattice="4 0 0 0 4 0 0 0 4" energy=-1.5', "plain"]), *[f"H {row(3)}" if not bad else "H x y" for _ in range(size)], *rng.choice([[], [], ["stray"]])]
        elif grammar == "xdatcar":
            if i == 0 or rng.random() < 0.3:
                out += ["run", "1.0", f"{4 + i} 0 0", "0 4 0", "0 0 4", "A B", "1 2"][rng.choice([0, 0, i > 0]) :]
            out += [f"Direct configuration= {i + 1}", row(3), "bad" if bad else row(3), row(3)]
        elif grammar == "outcar":
            if i == 0:
                out += [" TITEL  = PAW Mn_pv x", " TITEL  = PAW O x", "   ions per type =   1   2"]
            if rng.random() < 0.5:
                out += ["  direct lattice vectors    reciprocal", f" {4 + i} 0 0", " 0 4 0", " 0 0 4" if not bad else " POSITION TOTAL-FORCE"]
            out += [" POSITION    TOTAL-FORCE (eV/Angst)", " ----", row(6), "POSITION TOTAL-FORCE" if bad else row(6), row(6), " POSITION elsewhere"]
        else:
            out += ["ITEM: TIMESTEP", str(i * 10), "ITEM: NUMBER OF ATOMS", "2", "ITEM: BOX BOUNDS pp pp pp", "0 4", "0 5", f"0 {i + 3}", "ITEM: ATOMS id type x y z", f"2 1 {row(3)}", "1 2" if bad else f"1 2 {row(3)}"]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("grammar", sorted(trajectories.GRAMMARS))
def test_marks_give_the_frames_of_the_stream(grammar, tmp_path):
    """Ranges of any size; each frame is then read from its offset and state alone, and is the one that the stream has."""
    rng = random.Random(grammar)
    for k in range(12):
        text, path = trajectory(grammar, rng, rng.randint(1, 12)), tmp_path / f"{k}"
        path.write_text(text)
        expected = {f["frame_index"]: f for f in trajectories.GRAMMARS[grammar](text.splitlines(keepends=True))}
        for size in (1 if k < 3 else 11, 64, 501, 10**6):
            marks, line = [], 0
            for part, start in enumerate(range(0, len(text), size)):
                *rows, last = frame_index.marks_of(str(path), part, start, min(start + size, len(text)), grammar)
                marks += [(line + r["line"], r["offset"], r["text"]) for r in rows]
                line += last["line"]
            assert line == text.count("\n")
            found = {}
            for i, (offset, state) in enumerate(frame_index.WALKS[grammar](iter(marks))):
                rest = text.encode()[offset:].decode().splitlines(keepends=True)
                found.update((f["frame_index"], f) for f in trajectories.GRAMMARS[grammar](rest, skip=i, limit=1, begin=(i, json.loads(json.dumps(state)))))
            assert found == expected


@pytest.mark.parametrize("grammar", sorted(trajectories.GRAMMARS))
def test_split_scan_and_direct_access(spark, grammar, tmp_path):
    rng = random.Random(5)
    for name in ("a", "b"):
        (tmp_path / f"{name}.traj").write_text(trajectory(grammar, rng, 40))
    streamed = {(r.path, r.frame_index): r for r in files.read_trajectories(spark, str(tmp_path), grammar).collect()}
    split = frame_index.read_split(spark, str(tmp_path), grammar, "*.traj", range_bytes=300)
    assert {(r.path, r.frame_index): r for r in split.collect()} == streamed and split.rdd.getNumPartitions() > 10
    index = frame_index.frame_index(spark, str(tmp_path), grammar, "*.traj", range_bytes=300)
    some = frame_index.indexed_frames(index, grammar, F.col("frame_index").isin(3, 30), range_bytes=300)
    assert {(r.path, r.frame_index): r for r in some.collect()} == {k: r for k, r in streamed.items() if k[1] in (3, 30)}
    assert some.rdd.getNumPartitions() <= 4
    with pytest.raises(Exception, match="has 3 atoms, not 2"):
        (tmp_path / "c.xdat").write_text("x\n1.0\n4 0 0\n0 4 0\n0 0 4\nA\n2\nDirect configuration= 1\n0 0 0\n0 0 0\nx\n1.0\n4 0 0\n0 4 0\n0 0 4\nA\n3\nDirect configuration= 2\n0 0 0\n0 0 0\n0 0 0\n")
        frame_index.frame_index(spark, str(tmp_path), "xdatcar", "*.xdat").count()
