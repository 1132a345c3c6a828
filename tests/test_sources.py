"""Sources and sinks on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quartzite.functions.text import parent_dir
from quartzite.operators import frames
from quartzite.sources import catalog, files, settings, sinks, structures, trajectories
from quartzite.streaming import ingest

POSCAR = """K Mn O
1.0
4.0 0.0 0.0
0.0 5.0 0.0
0.0 0.0 6.0
K Mn_pv O
1 1 2
Direct
0.0 0.0 0.0
0.5 0.5 0.5
0.25 0.25 0.25
0.75 0.75 0.75
"""

XDATCAR = """run
1.0
4 0 0
0 4 0
0 0 4
A B
1 1
Direct configuration=     1
0.1 0.1 0.1
0.2 0.2 0.2
Direct configuration=     2
0.1 bad 0.1
0.2 0.2 0.2
run
1.0
5 0 0
0 5 0
0 0 5
A B
1 1
Direct configuration=     3
0.3 0.3 0.3
0.4 0.4 0.4
"""

OUTCAR = """ TITEL  = PAW_PBE Mn_pv 02Aug2007
 TITEL  = PAW_PBE O 08Apr2002
   ions per type =               1   1
 POTIM  =  2.0000
  volume of cell :       64.00
      direct lattice vectors                 reciprocal lattice vectors
     4.0 0.0 0.0     0.25 0.0 0.0
     0.0 4.0 0.0     0.0 0.25 0.0
     0.0 0.0 4.0     0.0 0.0 0.25
 POSITION                                       TOTAL-FORCE (eV/Angst)
 -----------------------------------------------------------------------------------
      0.0 0.0 0.0     3.0 4.0 0.0
      2.0 2.0 2.0     0.0 0.0 1.0
 -----------------------------------------------------------------------------------
  free  energy   TOTEN  =       -10.50000000 eV
  external pressure =      -12.00 kB  Pullay stress =        0.00 kB
  (temperature  310.0 K)
  volume of cell :       65.00
  free  energy   TOTEN  =       -11.50000000 eV
 General timing and accounting informations for this job:
"""

EXTXYZ = """2
Lattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:forces:R:3 energy=-1.5 free_energy=-9 run_id=r1 pbc="T T F"
H 0.0 0.0 0.0 0.1 0.2 0.3
O 1.0 1.0 1.0 0.0 0.0 0.0
stray
2
Lattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:forces:R:3 energy=-2.5
H x 0.0 0.0 0.1 0.2 0.3
O 1.0 1.0 1.0 0.0 0.0 0.0
1
comment only
He 1 2 3
"""

DUMP = """ITEM: TIMESTEP
100
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
1.0 5.0
0.0 4.0
0.0 4.0
ITEM: ATOMS id type x y z
2 2 3.0 1.0 1.0
1 1 1.0 0.0 0.0
"""

LOG = """LAMMPS
Step Temp TotEng Press Volume
0 300.0 -1.0 0.5 64.0
10 310.0 -1.1 0.6 64.5
Loop time of 1 on 1
Step Temp TotEng Press Volume
20 320.0 -1.2 0.7 65.0
30 nonsense
40 340.0 -1.4 0.9 66.0
"""

OSZICAR = """       N       E
DAV:   1    -0.1
DAV:   2    -0.2
   1 T=   300. E= -.10E+02 F= -.11E+02 E0= -.115E+02
DAV:   1    -0.1
   2 T=   305. E= -.12E+02 F= -.13E+02 E0= -.125E+02
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in {
        "run/POSCAR": POSCAR, "run/XDATCAR": XDATCAR, "run/OUTCAR": OUTCAR, "run/OSZICAR": OSZICAR, "run/INCAR": "NELM = 40 ! limit\nPOTIM = 1.5; TEBEG = 300\nNELM = 50\nMAGMOM = 1*5 2*0\n", "run/KPOINTS": "auto\n0\nMonkhorst-pack\n 2 3 4\n0 0 0\n",
        "run/POTCAR": " TITEL  = PAW_PBE Mn_pv 02Aug2007\n ZVAL   =   13.000    mass\n TITEL  = PAW_PBE O 08Apr2002\n ZVAL   =    6.000\n", "run/REPORT": " e_b>  -1.0 -2.5 -3.0\n e_b> -1.1 -2.6 -3.1\n", "x/t.extxyz": EXTXYZ, "x/d.lammpstrj": DUMP, "x/log.lammps": LOG,
        "x/in.lmp": "units metal\ntimestep 0.002\npair_coeff * * model.pth K Mn O\n", "eos/MnO2/V_+2.0%/OUTCAR": OUTCAR, "eos/MnO2/V_-2.0%/OUTCAR": OUTCAR, "m/metrics.csv": "epoch,train_loss_epoch,val_mse\n0,1.0,\n0,,4.0\n1,0.5,-1.0\n",
        "j/queue.txt": "JOBID|STATE|NAME|REASON|TIME|DIR\n12|RUNNING|a|None|1:00|/data/a\n", "y/train.yaml": "run_name: x\nseed: 7\nsplit_dataset: /d/all.xyz\n",
    }.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(base)


def whole(spark, tree, name):
    return files.whole_files(spark, f"{tree}/{name}")


def test_structures(spark, tree):
    row = files.read_structures(spark, f"{tree}/run", "POSCAR").first()
    assert (row.symbols, row.counts, row.n_atoms, row.cell[4]) == (["K", "Mn", "O"], [1, 1, 2], 4, 5.0)
    wrapped = POSCAR.replace("4.0 0.0 0.0\n0.0 5.0 0.0", "4.0 0.0\n0.0 0.0 5.0 0.0").replace("1.0\n", "-240.0\n", 1)
    two = list(structures.poscar(POSCAR + wrapped))
    assert len(two) == 2 and two[1]["cell"] == pytest.approx([8.0 ** (1 / 3) * x for x in two[0]["cell"]], rel=1e-6) or two[1]["cell"][0] > 4
    assert list(structures.poscar("broken\n1.0\n1 2\n")) == []
    counts = {r.symbol: r.n for r in files.element_counts(spark, f"{tree}/run", "POSCAR").collect()}
    assert counts == {"K": 1, "Mn": 1, "O": 2}


def test_lammps_data_and_logs_of_molecules():
    data = "title\n\n2 atoms\n2 atom types\n0.0 4.0 xlo xhi\n0.0 4.0 ylo yhi\n0.0 4.0 zlo zhi\n\nMasses\n\n1 39.0983 # K\n2 16.0\n\nAtoms # charge\n\n2 2 0.0 1.0 1.0 1.0\n1 1 0.0 2.0 2.0 2.0\n"
    row = next(structures.lammps_data(data, {"O": 15.999, "K": 39.0983}))
    assert (row["symbols"], row["counts"], row["coords"]) == (["K", "O"], [1, 1], [[2.0, 2.0, 2.0], [1.0, 1.0, 1.0]])
    com = "# p\n\ntitle\n\n0 1\nO 0.0 0.0 0.0\nH 0.0 0.0 1.0\n\n"
    assert next(structures.gaussian_input(com))["n_atoms"] == 2
    assert list(structures.gaussian_input(com.replace("H 0", "Bq 0"))) == []


def test_trajectories(spark, tree):
    x = files.read_trajectories(spark, f"{tree}/run/XDATCAR", "xdatcar").orderBy("frame_index").collect()
    assert [(r.frame_index, r.cell[0]) for r in x] == [(0, 4.0), (2, 5.0)]
    assert files.read_trajectories(spark, f"{tree}/run/XDATCAR", "xdatcar", skip=1, limit=2).count() == 1
    assert [r.frame_index for r in files.read_trajectories(spark, f"{tree}/run/XDATCAR", "xdatcar").where("frame_index >= 1 AND frame_index < 3").collect()] == [2]
    bad = files.unreadable(whole(spark, tree, "run").where("path LIKE '%POSCAR' OR path LIKE '%INCAR'"), files.structure_grammars()["poscar"]).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.error) for r in bad] == [("INCAR", "nothing found")]
    o = files.read_trajectories(spark, f"{tree}/run/OUTCAR", "outcar").first()
    assert [a.symbol for a in o.atoms] == ["Mn", "O"] and o.atoms[0].force == [3.0, 4.0, 0.0]
    e = files.read_trajectories(spark, f"{tree}/x/t.extxyz", "extxyz", raw=True).orderBy("frame_index").collect()
    assert [r.frame_index for r in e] == [0, 2] and e[0].energy == -1.5 and e[0].pbc == [True, True, False] and e[0].raw.startswith("2\n")
    assert files.read_trajectories(spark, f"{tree}/x/t.extxyz", "extxyz", atoms=False).count() == 3
    d = files.read_trajectories(spark, f"{tree}/x/d.lammpstrj", "lammpstrj").first()
    assert [a.pos for a in d.atoms] == [[0.0, 0.0, 0.0], [2.0, 1.0, 1.0]] and d.info["step"] == "100"
    with pytest.raises(ValueError):
        list(trajectories.xdatcar((XDATCAR + XDATCAR.replace("\n1 1\n", "\n2 1\n")).splitlines()))


def test_settings(spark, tree):
    incar = settings.incar(whole(spark, tree, "run/INCAR")).first().params
    assert incar == {"NELM": "50", "POTIM": "1.5", "TEBEG": "300", "MAGMOM": "1*5 2*0"}
    k = settings.kpoints(whole(spark, tree, "run/KPOINTS")).first()
    assert (k.grid, k.n) == ([2, 3, 4], 24)
    assert settings.kpoints(whole(spark, tree, "x/log.lammps").withColumn("text", F.lit("none"))).first().n == 0
    assert [(r.symbol, r.zval) for r in settings.potcar(whole(spark, tree, "run/POTCAR")).orderBy("place").collect()] == [("Mn", 13.0), ("O", 6.0)]
    assert [r.e_pot for r in settings.report_energies(whole(spark, tree, "run/REPORT")).orderBy("place").collect()] == [-2.5, -2.6]
    point = settings.eos_point(whole(spark, tree, "run/OUTCAR")).first()
    assert (point.volume, point.energy, round(point.pressure_gpa, 6), point.max_force) == (65.0, -11.5, -1.2, 5.0)
    assert [r.symbol for r in settings.element_map(whole(spark, tree, "x/in.lmp")).orderBy("type").collect()] == ["K", "Mn", "O"]
    assert settings.scheduler(whole(spark, tree, "j/queue.txt")).collect()[0].workdir == "/data/a"
    y = settings.training_config(whole(spark, tree, "y/train.yaml")).first()
    assert (y.seed, y.dataset) == (7, "/d/all.xyz")
    assert settings.temperatures(whole(spark, tree, "run/OUTCAR")).first().temperature == 310.0


def test_thermo(spark, tree):
    rows = settings.lammps_thermo(whole(spark, tree, "x/log.lammps")).orderBy("block", "row").collect()
    assert [(r.block, r.step, r.temperature, r.volume, r.energy) for r in rows] == [(1, 0, 300.0, 64.0, -1.0), (1, 10, 310.0, 64.5, -1.1), (2, 20, 320.0, 65.0, -1.2)]
    s = settings.oszicar(whole(spark, tree, "run/OSZICAR")).orderBy("ionic_step").collect()
    assert [(r.iterations, r.temperature, r.energy) for r in s] == [(2, 300.0, -11.5), (1, 305.0, -12.5)]
    t = settings.vasp_thermo(whole(spark, tree, "run/OSZICAR"), whole(spark, tree, "run/OUTCAR"), parent_dir(F.col("path"))).collect()
    assert [(r.i, r.volume) for r in t] == [(0, 65.0)]
    c = settings.convergence(whole(spark, tree, "run/OUTCAR"), whole(spark, tree, "run/OSZICAR"), whole(spark, tree, "run/INCAR"), parent_dir(F.col("path"))).first()
    assert c.converged is True
    steps = settings.time_steps(whole(spark, tree, "run/INCAR"), whole(spark, tree, "run/OUTCAR"), whole(spark, tree, "x/in.lmp"), parent_dir(F.col("path")))
    assert sorted((r.dt_fs, r.source) for r in steps.collect()) == [(1.5, "INCAR"), (2.0, "LAMMPS")]


def test_metrics(spark, tree):
    got = {(r.metric, r.epoch): r.value for r in settings.metrics(spark, f"{tree}/m").collect()}
    assert got == {("train_loss_epoch", 0): 1.0, ("val_mse", 0): 4.0, ("train_loss_epoch", 1): 0.5, ("val_mse", 1): -1.0}


def test_catalog(spark, tree):
    listed = catalog.listing(spark, tree)
    assert listed.count() == 17
    assert [(r.compound, r.vol_pct) for r in catalog.eos_dirs(listed.where("name = 'OUTCAR'")).orderBy("vol_pct").collect()] == [("MnO2", -2.0), ("MnO2", 2.0)]
    assert catalog.leaf_dirs(listed, F.col("name") == "OUTCAR").count() == 3
    assert catalog.structure_files(listed).count() == 1
    with pytest.raises(ValueError):
        catalog.only_one(listed, "dataset")


def test_sinks_round_trip(spark, tree, tmp_path):
    rows = files.read_structures(spark, f"{tree}/run", "POSCAR")
    out = rows.select(sinks.poscar_text(F.col("comment"), F.col("cell"), F.col("symbols"), F.col("counts"), F.col("coords")).alias("value"))
    back = next(structures.poscar(out.first().value))
    assert back["counts"] == [1, 1, 2] and back["coords"][1] == [0.5, 0.5, 0.5]
    text = spark.range(1).select(sinks.upsert(F.lit("A = 1\nmagmom = 2\nMAGMOM = 3\n"), "MAGMOM", F.lit("9")).alias("a"), sinks.upsert(F.lit("A = 1\n"), "NELECT", F.lit("4")).alias("b"), sinks.rewrite(F.lit("System = x\nsystem=y\n"), "System", F.lit("z")).alias("c")).first()
    assert text.a == "A = 1\nMAGMOM = 9\nMAGMOM = 3\n" and text.b == "A = 1\nNELECT = 4\n" and text.c == "System = z\nSystem = z\n"
    assert spark.range(1).select(sinks.missing_keys(F.lit("System = x\n istart=1\n"), ["System", "ISTART", "MAGMOM"]).alias("m")).first().m == ["MAGMOM"]
    sinks.write_table(spark.range(30).repartition(3).toDF("x"), str(tmp_path / "t"), ["x"], "x", order=["x"])
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "t").glob("part-*"))]
    assert all(p[0] == "# x" for p in parts if p) and [float(x) for p in parts for x in p[1:]] == list(range(30))


def test_streaming(spark, tmp_path):
    rows = [("a", s) for s in (1, 2, 3, 1, 2, 5)]
    spark.createDataFrame(rows, "run string, step long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.continued_steps(ingest.landed(spark, str(tmp_path / "in"), "run string, step long"), "run", "step")
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.total_step for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5, 8]
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("u", t, 1.0), ("u", t + dt.timedelta(minutes=5), 3.0), ("u", t + dt.timedelta(hours=2), 5.0)], "user string, ts timestamp, v double")
    assert ingest.sessions(events, "ts", ["user"], "30 minutes").count() == 2
    assert ingest.windowed_means(events, "ts", ["user"], "v", "1 hour", "10 minutes").count() == 2


def test_evaluation_files(spark, tmp_path):
    header = 'Lattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:REF_forces:R:3:{m}_forces:R:3 REF_energy=-1 {m}_energy=-2 run_id=a'
    (tmp_path / "a.xyz").write_text(f"1\n{header.format(m='MACE')}\nH 0 0 0 0 0 0 0 0 0\n1\nnothing\nH 0 0 0\n")
    (tmp_path / "b.xyz").write_text("1\nenergy=-1\nH 0 0 0\n")
    df = files.read_trajectories(spark, str(tmp_path), "extxyz")
    got = frames.evaluation_files(df, ["MACE", "ALLEGRO"]).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.model) for r in got] == [("a.xyz", "MACE")]
    counts = {(r.path[-5:], r.run_id): r.frames for r in frames.frames_by_run(files.read_trajectories(spark, str(tmp_path), "extxyz", atoms=False)).collect()}
    assert counts == {("a.xyz", "a"): 1, ("a.xyz", "__unknown__"): 1, ("b.xyz", "__unknown__"): 1}
    e = df.select(frames.frame_energy(F.lit(None).cast("double"), F.lit(False), F.col("info")).alias("e")).where("e IS NOT NULL").collect()
    assert sorted(r.e for r in e) == [-2.0, -1.0]


def test_bounds_of_frames_reach_the_scan():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    def pushed(*filters, **options):
        reader = files.PushedReader(options, None)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return int(reader.options["skip"]), reader.options.get("limit")

    at = ("frame_index",)
    assert pushed(GreaterThan(at, 4), LessThanOrEqual(at, 9)) == (5, "5")
    assert pushed(EqualTo(at, 7), EqualTo(("n_atoms",), 3)) == (7, "1")
    assert pushed(In(at, (3, 8))) == (3, "6")
    assert pushed(LessThanOrEqual(at, 2), skip="5", limit="9") == (5, "0")
    assert pushed(EqualTo(("path",), "x")) == (0, None)


def test_sizes_of_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x06")
    (tmp_path / "b.png").write_bytes(b"no image")
    out = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, r.alpha) for r in settings.png_sizes(spark, str(tmp_path)).collect()}
    assert out == {"a.png": (640, 480, True), "b.png": (None, None, None)}


def test_errors_come_with_the_rows(spark, tree):
    texts = spark.createDataFrame([("good", POSCAR), ("bad", POSCAR.replace("1 1 2", "1 x 2")), ("none", "")], "path string, text string")
    out = {r.path: (r.n_atoms, r.why is None) for r in files.structures_of(texts, error="why").collect()}
    assert out["good"] == (4, True) and out["bad"] == (None, False) and out["none"] == (None, False)
    assert files.structures_of(texts).count() == 1


def test_frame_writer(spark, tmp_path):
    """A file for each key in frame order; a job that fails leaves no file, and one that is given again replaces them."""
    from quartzite.sources import frame_writer

    rows = [(f"run/{k % 5}", i, 1.0 + i, ["H", "O"]) for k in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "run string, frame long, x double, names array<string>").repartition(7)
    coords = F.array(F.array("x", F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), "x", F.lit(2.0)))
    text = df.withColumn("text", sinks.extxyz_text(F.col("names"), coords, F.array(*[F.lit(float(x)) for x in (9, 0, 0, 0, 9, 0, 0, 0, 9)])))
    path = str(tmp_path / "out")
    for _ in range(2):
        frame_writer.write_frames(text, path, "run", ["frame"], "text")
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"run%2F{k}.xyz" for k in range(5)]
    back = files.read_trajectories(spark, path, "extxyz").collect()
    assert sorted((r.path[-9:-4], r.frame_index, r.atoms[0].pos[0]) for r in back) == sorted((f"n%2F{k}", i, 1.0 + i) for k in range(5) for i in range(20))
    broken = text.withColumn("text", F.when((F.col("run") == "run/3") & (F.col("frame") == 15), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    for bad, why in ((broken, "lost"), (text.withColumn("run", F.nullif(F.col("run"), F.lit("run/1"))), "without a key")):
        with pytest.raises(Exception, match=why):
            frame_writer.write_frames(bad, str(tmp_path / why[:4]), "run", ["frame"], "text")
        assert not (tmp_path / why[:4]).exists() or not list((tmp_path / why[:4]).iterdir())


def test_files_are_copied_and_moved(spark, tmp_path):
    """Nothing is written over; a plan that is run again finds its work done."""
    from quartzite.sources import moves

    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name * 5)
    (tmp_path / "taken").write_text("other")
    p = lambda *names: tuple(str(tmp_path / n) if n else None for n in names)
    plan = spark.createDataFrame([p("a", "x/a"), p("b", "taken"), p("gone", "x/gone"), p("c", "x/both"), p("b", "x/both"), p("c", None), p("a", "x/a")], "source string, target string")
    run = lambda plan, move=False: {(r.source.rsplit("/", 1)[-1], (r.target or "").rsplit("/", 1)[-1]): r.status for r in moves.transfer(plan, move).collect()}
    expected = {("a", "a"): "done", ("b", "taken"): "exists", ("gone", "gone"): "missing", ("b", "both"): "done", ("c", "both"): "exists", ("c", ""): "missing"}
    assert run(plan) == expected and run(plan) == expected and (tmp_path / "a").exists()
    moved = spark.createDataFrame([p("a", "x/a"), p("c", "y/c"), p("b", "taken")], "source string, target string")
    for _ in range(2):
        assert run(moved, True) == {("a", "a"): "done", ("c", "c"): "done", ("b", "taken"): "exists"}
    assert [(tmp_path / n).exists() for n in "abc"] == [False, True, False]
    assert [(tmp_path / n).read_text() for n in ("x/a", "y/c", "x/both", "taken")] == ["aaaaa", "ccccc", "bbbbb", "other"] and not list(tmp_path.glob("*/*.part"))
