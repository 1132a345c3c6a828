"""Schemas of the tables that sources produce. Lattices are nine numbers, row by row; a Cartesian row is a fractional row times the lattice."""

ATOM = "struct<idx:int,symbol:string,pos:array<double>,vel:array<double>,force:array<double>>"
FRAME = (
    "path string, frame_index long, n_atoms int, cell array<double>, pbc array<boolean>, energy double, stress array<double>, "
    f"info map<string,string>, coord_space string, raw string, atoms array<{ATOM}>"
)
STRUCTURE = "path string, part int, comment string, scale double, cell array<double>, symbols array<string>, counts array<int>, mode string, coords array<array<double>>, selective array<array<boolean>>, n_atoms int"
THERMO = "path string, block int, row long, step long, temperature double, volume double, energy double, pressure double"
SCF = "path string, ionic_step long, iterations int, has_ionic_line boolean, temperature double, energy double"
