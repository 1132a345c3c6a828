"""Structure grammars: from the text of a file to rows of schema.STRUCTURE without path."""

from __future__ import annotations

import re
from collections.abc import Iterator


def _numbers(line: str, n: int) -> list[float]:
    found = [float(x) for x in line.split()[:n]]
    if len(found) < n:
        raise ValueError(f"fewer than {n} numbers: {line!r}")
    return found


def _is_counts(line: str) -> bool:
    return bool(re.fullmatch(r"\s*\d+(\s+\d+)*\s*", line))


def poscar(text: str) -> Iterator[dict]:
    """All structures of a file, one after the other; vectors that wrap over lines are joined. Malformed rest is left out.

    A negative scale is the cell's volume. Without a line of symbols (the old form) they are taken from the comment if it has as
    many words as there are counts, else named Species_1 and on.
    """
    lines, part = text.replace("\r", "").replace("\0", " ").split("\n"), 0
    while lines:
        while lines and not lines[0].strip() and not (len(lines) > 1 and lines[1].strip()):
            lines.pop(0)
        if len(lines) < 7:
            return
        try:
            row, used = _one(lines)
        except (ValueError, IndexError):
            return
        yield row | {"part": part}
        part += 1
        lines = lines[used:]
        # Velocities may follow: a blank line and as many rows of three numbers.
        n = row["n_atoms"]
        if len(lines) > n and not lines[0].strip() and all(re.fullmatch(r"\s*(\S+\s+){2}\S+\s*", x) and not re.search("[A-DF-Za-df-z]", x) for x in lines[1 : n + 1]):
            lines = lines[n + 1 :]


def _one(lines: list[str]) -> tuple[dict, int]:
    comment, at = lines[0].strip(), 2
    scale = _numbers(lines[1], 1)[0]
    values: list[float] = []
    while len(values) < 9:
        values += [float(x) for x in lines[at].split()]
        at += 1
    cell = values[:9]
    if _is_counts(lines[at]):
        counts = [int(x) for x in lines[at].split()]
        words = comment.split()
        symbols = words if len(words) == len(counts) and all(re.fullmatch("[A-Z][a-z]?", w) for w in words) else [f"Species_{i + 1}" for i in range(len(counts))]
        at += 1
    else:
        symbols = [re.match(r"[A-Za-z]*", s)[0] for s in lines[at].split()]
        counts = [int(x) for x in lines[at + 1].split()]
        at += 2
    if len(symbols) != len(counts):
        raise ValueError("symbols and counts differ in number")
    a, b, c = cell[:3], cell[3:6], cell[6:]
    if scale < 0:
        volume = abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
        factor = (-scale / volume) ** (1 / 3)
    else:
        factor = scale
    selective = lines[at].strip()[:1] in ("s", "S")
    at += selective
    mode = "cartesian" if lines[at].strip()[:1] in tuple("cCkK") else "direct"
    at += 1
    n, coords, flags = sum(counts), [], []
    for line in lines[at : at + n]:
        coords.append(_numbers(line, 3))
        flags.append([x.upper().startswith("T") for x in line.split()[3:6]] if selective else None)
    if len(coords) < n:
        raise ValueError("too few coordinates")
    if mode == "cartesian":
        coords = [[x * factor for x in p] for p in coords]
    row = {"comment": comment, "scale": scale, "cell": [x * factor for x in cell], "symbols": symbols, "counts": counts, "mode": mode, "coords": coords, "selective": flags if selective else None, "n_atoms": n}
    return row, at + n


def nearest_symbol(mass: float, masses: dict[str, float], tolerance: float = 0.5) -> str | None:
    symbol = min(masses, key=lambda s: (abs(masses[s] - mass), s))
    return symbol if abs(masses[symbol] - mass) <= tolerance else None


def lammps_data(text: str, masses: dict[str, float], tolerance: float = 0.5) -> Iterator[dict]:
    """The structure of a data file: symbols from comments in Masses, else by the nearest mass; atoms counted by type. Charges and topology are not read."""
    body = text.replace("\r", "")
    sides = {k: (float(lo), float(hi)) for lo, hi, k in re.findall(r"^\s*(\S+)\s+(\S+)\s+(\w)lo\s+\w+hi", body, re.M)}
    tilt = re.search(r"^\s*(\S+)\s+(\S+)\s+(\S+)\s+xy\s+xz\s+yz", body, re.M)
    xy, xz, yz = (float(x) for x in tilt.groups()) if tilt else (0.0, 0.0, 0.0)

    def section(name: str) -> list[str]:
        m = re.search(rf"^\s*{name}\b[^\n]*\n\s*\n((?:[^\n]*\S[^\n]*\n?)*)", body, re.M)
        return m[1].splitlines() if m else []

    kinds: dict[int, str] = {}
    for line in section("Masses"):
        number, mass = line.split()[:2]
        named = re.search(r"#\s*([A-Z][a-z]?)", line)
        kinds[int(number)] = named[1] if named else nearest_symbol(float(mass), masses, tolerance) or f"Type_{number}"
    atoms = [line.split("#")[0].split() for line in section("Atoms")]
    if not sides or not atoms:
        return
    # Atomic style has id type x y z; one more column is a charge, two more a molecule and a charge (a molecule first).
    width = len(atoms[0]) - (3 if len(atoms[0]) >= 8 else 0)
    kind_at = 2 if width == 7 else 1
    symbols: list[str] = []
    coords: dict[str, list[list[float]]] = {}
    for r in sorted(atoms, key=lambda r: int(r[0])):
        s = kinds.get(int(r[kind_at]), f"Type_{r[kind_at]}")
        coords.setdefault(s, []).append([float(x) - sides[k][0] for x, k in zip(r[width - 3 : width], "xyz", strict=True)])
    symbols = [s for s in dict.fromkeys(kinds.values()) if s in coords] + [s for s in coords if s not in kinds.values()]
    lx, ly, lz = (sides[k][1] - sides[k][0] for k in "xyz")
    yield {"part": 0, "comment": body.split("\n", 1)[0].strip(), "scale": 1.0, "cell": [lx, 0.0, 0.0, xy, ly, 0.0, xz, yz, lz], "symbols": symbols, "counts": [len(coords[s]) for s in symbols], "mode": "cartesian", "coords": [p for s in symbols for p in coords[s]], "selective": None, "n_atoms": len(atoms)}


def gaussian_log(text: str) -> Iterator[dict]:
    """Every orientation table of a quantum-chemistry log, by atomic numbers, as structures without a cell."""
    from ..functions.elements import SYMBOLS

    tables = re.findall(r"(?:Standard|Input) orientation:.*?\n\s*-+\n.*?\n\s*-+\n(.*?)\n\s*-{20}", text, re.S)
    for part, table in enumerate(tables):
        rows = [line.split() for line in table.splitlines()]
        rows = [r for r in rows if len(r) == 6 and r[1].isdigit() and 0 < int(r[1]) <= len(SYMBOLS)]
        yield _molecule(part, "orientation", [(SYMBOLS[int(r[1]) - 1], [float(x) for x in r[3:]]) for r in rows])


def gaussian_archive(text: str) -> Iterator[dict]:
    """The geometry of the last archive entry of a log, if it is neutral and a singlet."""
    joined = re.sub(r"\s+", "", text)
    chunk = joined.rpartition("Version=")[0]
    start = chunk.rfind("\\\\0,1\\")
    if start >= 0:
        atoms = re.findall(r"\\([A-Z][a-z]?)(?:,0)?,(-?[\d.]+),(-?[\d.]+),(-?[\d.]+)", "\\" + chunk[start + 6 :].split("\\\\")[0])
        yield _molecule(0, "archive", [(s, [float(x), float(y), float(z)]) for s, x, y, z in atoms])


def gaussian_input(text: str) -> Iterator[dict]:
    """The geometry of an input: its last block of symbols and coordinates. Ghost and translation centres are refused."""
    blocks, block = [], []
    for line in [*text.splitlines(), ""]:
        m = re.fullmatch(r"\s*([A-Za-z]{1,2}(?:-\w+)?)(?:\([^)]*\))?((?:\s+-?\d*\.?\d+(?:[eE][-+]?\d+)?){3})\s*", line)
        if m:
            block.append((m[1], [float(x) for x in m[2].split()]))
        elif block:
            blocks.append(block)
            block = []
    if blocks and not any(s.lower() in ("bq", "tv", "x") or "-bq" in s.lower() for s, _ in blocks[-1]):
        yield _molecule(0, "input", [(s.capitalize(), p) for s, p in blocks[-1]])


def _molecule(part: int, comment: str, atoms: list) -> dict:
    order = list(dict.fromkeys(s for s, _ in atoms))
    return {"part": part, "comment": comment, "scale": 1.0, "cell": None, "symbols": order, "counts": [sum(s == o for s, _ in atoms) for o in order], "mode": "cartesian", "coords": [p for o in order for s, p in atoms if s == o], "selective": None, "n_atoms": len(atoms)}


def guess(name: str, text: str) -> str:
    """Grammar of a structure file: by name, then by ending, then by its first line that isn't empty."""
    base = name.rsplit("/", 1)[-1].lower()
    if re.match(r"(poscar|contcar)", base) or base.endswith((".vasp", ".poscar")):
        return "poscar"
    if base.endswith((".xyz", ".extxyz")):
        return "extxyz"
    first = next((line for line in text.splitlines() if line.strip()), "")
    return "extxyz" if re.fullmatch(r"\s*\d+\s*", first) else "poscar"
