"""Text sinks: a column expression builds each file's text, and Spark writes it.

Files of a run are written by a key (see frame_writer), so each key's rows end in their own folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frame_writer, ranges


def number(x: Column, places: int = 10) -> Column:
    return F.format_string(f"%.{places}f", x)


def vector(v: Column, places: int = 10) -> Column:
    return F.array_join(F.transform(v, lambda x: number(x, places)), "  ")


def extxyz_text(symbols: Column, positions: Column, cell: Column, info: Column | None = None) -> Column:
    """One frame of extended xyz."""
    fields = F.concat(F.lit('Lattice="'), F.array_join(F.transform(cell, lambda x: number(x, 8)), " "), F.lit('" Properties=species:S:1:pos:R:3 pbc="T T T"'))
    if info is not None:
        pairs = F.transform(F.array_sort(F.map_entries(info)), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), F.when(F.contains(e["value"], F.lit(" ")), F.concat(F.lit('"'), e["value"], F.lit('"'))).otherwise(e["value"])))
        fields = F.concat(fields, F.array_join(pairs, ""))
    rows = F.zip_with(symbols, positions, lambda s, p: F.concat_ws(" ", s, vector(p, 8)))
    return F.concat_ws("\n", F.size(symbols).cast("string"), fields, F.array_join(rows, "\n"))


def poscar_text(comment: Column, cell: Column, symbols: Column, counts: Column, coords: Column, mode: str = "Direct") -> Column:
    lattice = F.array_join(F.transform(F.array(F.lit(0), F.lit(3), F.lit(6)), lambda i: vector(F.slice(cell, i + 1, F.lit(3)))), "\n")
    rows = F.array_join(F.transform(coords, lambda p: vector(p)), "\n")
    return F.concat_ws("\n", comment, F.lit("1.0"), lattice, F.array_join(symbols, " "), F.array_join(F.transform(counts, lambda n: n.cast("string")), " "), F.lit(mode), rows)


def lammps_data_text(title: Column, cell: Column, kinds: Column, symbols: Column, masses: Column, positions: Column) -> Column:
    """A data file in atomic style for a lower-triangular cell; kinds are 1-based types of the atoms."""
    bounds = F.concat_ws("\n", *[F.concat_ws(" ", F.lit("0.0"), number(cell[i]), F.lit(f"{a}lo {a}hi")) for i, a in ((0, "x"), (4, "y"), (8, "z"))], F.concat_ws(" ", number(cell[3]), number(cell[6]), number(cell[7]), F.lit("xy xz yz")))
    mass = F.array_join(F.transform(F.arrays_zip(symbols.alias("s"), masses.alias("m")), lambda e, i: F.concat_ws(" ", (i + 1).cast("string"), number(e["m"], 6), F.lit("#"), e["s"])), "\n")
    atoms = F.array_join(F.transform(F.arrays_zip(kinds.alias("k"), positions.alias("p")), lambda e, i: F.concat_ws(" ", (i + 1).cast("string"), e["k"].cast("string"), vector(e["p"]))), "\n")
    head = F.concat_ws("\n", title, F.lit(""), F.concat(F.size(kinds).cast("string"), F.lit(" atoms")), F.concat(F.size(symbols).cast("string"), F.lit(" atom types")), bounds)
    return F.concat_ws("\n", head, F.lit("\nMasses\n"), mass, F.lit("\nAtoms # atomic\n"), atoms)


def upsert(text: Column, key: str, value: Column) -> Column:
    """A settings text whose first line of a key (in either case) has a new value; without one the line is appended."""
    pattern = rf"(?im)^([ \t]*){key}[ \t]*=[^\n]*"
    line = F.concat(F.lit(f"{key} = "), value)
    place = F.regexp_instr(text, F.lit(pattern))
    old = F.regexp_extract(text, pattern, 0)
    first = F.concat(F.substring(text, F.lit(1), place - 1), line, F.substring(text, place + F.length(old), F.length(text)))
    return F.when(text.rlike(pattern), first).otherwise(F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n"), line, F.lit("\n")))


def rewrite(text: Column, key: str, value: Column) -> Column:
    """Every line of a key has a new value; none is appended."""
    return F.regexp_replace(text, F.lit(rf"(?im)^[ \t]*{key}[ \t]*=[^\n]*"), F.concat(F.lit(f"{key} = "), F.regexp_replace(value, r"([\\$])", r"\\$1")))


def missing_keys(text: Column, keys: list[str]) -> Column:
    """Keys that a settings text has no line for; a writer that may not append raises where there are any."""
    return F.array_compact(F.array(*[F.when(~text.rlike(rf"(?im)^[ \t]*{k}[ \t]*="), F.lit(k)) for k in keys]))


def kpoints_text(grid: Column, mesh: Column) -> Column:
    return F.concat_ws("\n", F.lit("Automatic mesh"), F.lit("0"), mesh, F.array_join(F.transform(grid, lambda n: n.cast("string")), " "), F.lit("0 0 0"))


def write_text(df: DataFrame, text: Column, path: str, by: list[str] | None = None) -> None:
    """One text for each row; with `by`, in a folder for each key: files are then written by pyarrow where it knows the store, as there may be very many."""
    out = df.select(*(by or []), text.alias("value"))
    if by and ranges.known(path):
        frame_writer.write_folders(out, path, by, "value")
        return
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_table(df: DataFrame, path: str, columns: list[str], header: str, order: list[str] | None = None, by: list[str] | None = None) -> None:
    """Numeric columns as %.10e text, each part with its header line first; by: a folder for each key; order: of the rows, within and across parts."""
    text = F.concat_ws(" ", *[F.format_string("%.10e", F.col(c).cast("double")) for c in columns])
    rows = df.orderBy(*(by or []), *order) if order else df
    # A tab never stands in a line, so that lines are written as they are.
    writer = rows.select(*(by or []), text.alias(f"# {header}")).write.mode("overwrite").option("header", "true").option("sep", "\t").option("comment", "\u0001")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", "true").csv(path)


def free_names(names: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names without collisions: the first keeps its own, others get _1, _2 and on."""
    from ..operators.series import ordered

    place = F.row_number().over(ordered([name], order)) - 1
    return names.withColumn("free_name", F.when(place == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), place.cast("string"))))
