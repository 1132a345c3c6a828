"""Rules that derive simulation input parameters, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed values of the rules.
KPOINT_DENSITY, GAMMA_LENGTH = 25.0, 15.0
FRICTION = {"base": 2.0, "mass_power": 0.6, "temperature_power": 0.5, "low": 0.5, "high": 15.0}
TIME_STEP = {"base": 1.0, "low": 0.2, "high": 2.0}
BOLTZMANN_J, AMU_KG = 1.380649e-23, 1.66053906660e-27
#: For at most so many atoms (null: any number) and for 64 k-points or more, or fewer: caps and divisors of k-point groups and of cores for each band.
LAYOUTS = [
    {"atoms": 50, "many_points": True, "group_cap": 8, "points_a_group": 8, "core_cap": 8, "core_divisor": 2},
    {"atoms": 50, "many_points": False, "group_cap": 4, "points_a_group": 4, "core_cap": 4, "core_divisor": 4},
    {"atoms": 100, "many_points": True, "group_cap": 8, "points_a_group": 8, "core_cap": 4, "core_divisor": 4},
    {"atoms": 100, "many_points": False, "group_cap": 4, "points_a_group": 4, "core_cap": 4, "core_divisor": 4},
    {"atoms": None, "many_points": True, "group_cap": 4, "points_a_group": 16, "core_cap": 2, "core_divisor": 8},
    {"atoms": None, "many_points": False, "group_cap": 2, "points_a_group": 9, "core_cap": 2, "core_divisor": 8},
]


def kpoint_grid(lengths: Column, constant: float = KPOINT_DENSITY) -> Column:
    """Points along each lattice vector: constant / length to the nearest whole number (halves up), one at least."""
    return F.transform(lengths, lambda x: F.greatest(F.lit(1), F.floor(constant / F.nullif(x, F.lit(0.0)) + 0.5).cast("int")))


def kpoint_count(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(1), lambda a, x: a * x)


def mesh_type(lengths: Column, threshold: float = GAMMA_LENGTH) -> Column:
    """Gamma-centred where every lattice vector is longer than a threshold, else Monkhorst-Pack."""
    return F.when(F.array_min(lengths) > threshold, "Gamma").otherwise("Monkhorst-Pack")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean_mass(masses: Column, counts: Column) -> Column:
    """Mean mass of the atoms of a composition."""
    total = F.aggregate(F.zip_with(masses, counts, lambda m, n: m * n), F.lit(0.0), lambda a, x: a + x)
    return total / F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)


def friction(mass: Column, reference: Column, temperature: Column) -> Column:
    """Langevin friction (1/ps) of a species: a power of its mass relative to the composition's mean, and of the temperature relative to 300 K, within limits."""
    f = FRICTION
    return clamp(f["base"] * F.pow(reference / mass, F.lit(f["mass_power"])) * F.pow(temperature / 300.0, F.lit(f["temperature_power"])), f["low"], f["high"])


def never_rising(masses: Column, values: Column) -> Column:
    """In order, a value above the one before it is held down to that where the mass rises."""
    pairs = F.zip_with(masses, values, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    held = lambda done, x: F.when((F.size(done) > 0) & (x["m"] > F.element_at(done, -1)["m"]), F.least(x["v"], F.element_at(done, -1)["v"])).otherwise(x["v"])
    step = lambda done, x: F.concat(done, F.array(F.struct(x["m"].alias("m"), held(done, x).alias("v"))))
    return F.transform(F.aggregate(pairs, F.array().cast("array<struct<m:double,v:double>>"), step), lambda x: x["v"])


def size_factor(atoms: Column) -> Column:
    return clamp(atoms / 50.0, 0.5, 3.0)


def time_step(lightest: Column, temperature: Column) -> Column:
    """Time step (fs): grows with the root of the lightest mass (16 amu: one) and falls with the root of the temperature, within limits."""
    return clamp(TIME_STEP["base"] * F.sqrt(300.0 / temperature) * F.sqrt(lightest / 16.0), TIME_STEP["low"], TIME_STEP["high"])


def piston_mass(atoms: Column, temperature: Column) -> Column:
    return clamp(1000.0 * size_factor(atoms) * clamp(temperature / 300.0, 0.5, 2.0), 800.0, 5000.0)


def lattice_friction(atoms: Column) -> Column:
    return clamp(3.0 * size_factor(atoms), 1.0, 10.0)


def steps(atoms: Column) -> Column:
    return clamp(10000.0 * size_factor(atoms), 5000.0, 50000.0).cast("int")


def degrees_of_freedom(atoms: Column, free: Column | None = None) -> Column:
    """The free Cartesian components if they are stated, else 3 N less the drift."""
    return F.coalesce(free if free is not None else F.lit(None), 3 * atoms - 3)


def period_fs(wavenumber: Column) -> Column:
    """Period (fs) of a wave number (1/cm)."""
    return 33356.4095198152 / wavenumber


def nose_mass(freedom: Column, temperature: Column, period: Column, first_length: Column) -> Column:
    """Thermostat mass in units of amu times the first lattice vector squared: (period / 2 pi)^2 x 2 x degrees of freedom x kT."""
    joule = F.pow(period * 1e-15 / 6.283185307179586, F.lit(2.0)) * 2.0 * freedom * BOLTZMANN_J * temperature
    return joule / (AMU_KG * F.pow(first_length * 1e-10, F.lit(2.0)))


def layout(atoms: Column, kpoints: Column, cores: int, most: int = 64) -> Column:
    """Parallel layout by number of atoms and k-points: groups over k-points, cores for each band, bands at once, blocking."""
    chosen = None
    for rule in reversed(LAYOUTS):
        kpar = F.greatest(F.lit(1), F.least(F.lit(rule["group_cap"]), F.floor(kpoints / rule["points_a_group"]), kpoints)).cast("int")
        fitting = min(rule["core_cap"], cores // rule["core_divisor"])
        ncore = max(1, min(fitting, most))
        row = F.struct(kpar.alias("kpar"), F.lit(ncore).alias("ncore"), F.lit(max(1, cores // max(1, fitting))).alias("npar"), F.lit(4).alias("nsim"))
        fits = (kpoints >= 64 if rule["many_points"] else kpoints < 64) & (atoms <= rule["atoms"] if rule["atoms"] else F.lit(True))
        chosen = row if chosen is None else F.when(fits, row).otherwise(chosen)
    return chosen


def formula(symbols: Column, counts: Column) -> Column:
    """Symbols and counts in the order of the species; a count of one is left out."""
    return F.array_join(F.zip_with(symbols, counts, lambda s, n: F.concat(s, F.when(n == 1, "").otherwise(n.cast("string")))), "")


def magmom(counts: Column, moments: Column) -> Column:
    """'n*m' tokens in the order of the species; a species without a moment has 0."""
    return F.array_join(F.zip_with(counts, moments, lambda n, m: F.concat(n.cast("string"), F.lit("*"), F.coalesce(m, F.lit(0.0)).cast("string"))), " ")


def electrons(counts: Column, valences: Column, removed: Column) -> Column:
    """Valence electrons of all atoms less those removed."""
    return F.aggregate(F.zip_with(counts, valences, lambda n, z: n * z), F.lit(0.0), lambda a, x: a + x) - removed


def merged_settings(disk: Column, script: Column, command: Column) -> Column:
    """Settings of three sources (maps); the command line wins over the script, the script over what is on disk."""
    own = lambda a, b: F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    lower = F.map_concat(own(disk, script), script)
    return F.map_concat(own(lower, command), command)


def violations(settings: Column, required: dict[str, str]) -> Column:
    """Every required setting that is missing or differs, as 'KEY: wanted x, found y', in the order of the keys."""
    checks = [F.when(~settings[k].eqNullSafe(F.lit(v)), F.concat(F.lit(f"{k}: wanted {v}, found "), F.coalesce(settings[k], F.lit("nothing")))) for k, v in sorted(required.items())]
    return F.array_compact(F.array(*checks))


def structure_kind(declared: Column, file_name: Column, rules: list[tuple[str, str]]) -> Column:
    """The declared kind, else that of the first part found in the file name, else 'unknown'."""
    kind = F.lit("unknown")
    for part, name in reversed(rules):
        kind = F.when(F.lower(file_name).contains(part), name).otherwise(kind)
    return F.coalesce(F.nullif(declared, F.lit("")), kind)


def engine(names: Column) -> Column:
    """The engine of a directory from its file names: LAMMPS wins where both have left files; null for neither."""
    has = lambda pattern: F.exists(names, lambda n: n.rlike(pattern))
    return F.when(has(r"^log\.lammps$|\.lammpstrj$"), "LAMMPS").when(has(r"^(OUTCAR|OSZICAR|XDATCAR)$"), "VASP")
