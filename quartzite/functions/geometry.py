"""Column builders for cells and coordinates. cell: array of nine doubles (rows a, b, c); position: array of three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matmul_row(v: Column, m: Column) -> Column:
    """Row vector times a 3x3 matrix."""
    return F.array(*[sum((v[i] * m[3 * i + j] for i in range(1, 3)), v[0] * m[j]) for j in range(3)])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def rows(cell: Column) -> list[list[Column]]:
    return [[cell[3 * i + j] for j in range(3)] for i in range(3)]


def determinant(cell: Column) -> Column:
    a, b, c = rows(cell)
    return dot(a, cross(b, c))


def volume(cell: Column) -> Column:
    return F.abs(determinant(cell))


def inverse(cell: Column) -> Column:
    a, b, c = rows(cell)
    det = F.nullif(determinant(cell), F.lit(0.0))
    columns = [cross(b, c), cross(c, a), cross(a, b)]
    return F.array(*[columns[j][i] / det for i in range(3) for j in range(3)])


def to_cartesian(frac: Column, cell: Column) -> Column:
    return matmul_row(frac, cell)


def to_fractional(cart: Column, cell: Column) -> Column:
    """Null where the cell has no volume."""
    return matmul_row(cart, inverse(cell))


def length(v: Column) -> Column:
    return F.sqrt(dot([v[i] for i in range(3)], [v[i] for i in range(3)]))


def lattice_lengths(cell: Column) -> Column:
    return F.array(*[F.sqrt(dot(r, r)) for r in rows(cell)])


def heights(cell: Column) -> Column:
    """Distances between opposite faces of the cell."""
    a, b, c = rows(cell)
    return F.array(*[volume(cell) / F.nullif(length(cross(x, y)), F.lit(0.0)) for x, y in ((b, c), (c, a), (a, b))])


def nearest_image(delta: Column) -> Column:
    """A fractional difference moved by whole cells into [-0.5, 0.5]; halves go to the even integer."""
    return F.array(*[delta[i] - F.rint(delta[i]) for i in range(3)])


def image_distance(frac_a: Column, frac_b: Column, cell: Column) -> Column:
    """Distance between the nearest images by rounding; exact in cells that are not strongly skewed."""
    delta = F.array(*[frac_a[i] - frac_b[i] for i in range(3)])
    return length(to_cartesian(nearest_image(delta), cell))


def exact_image_distance(frac_a: Column, frac_b: Column, cell: Column) -> Column:
    """Distance between the nearest of the 27 images around the rounded one, for skewed cells."""
    base = nearest_image(F.array(*[frac_a[i] - frac_b[i] for i in range(3)]))
    around = F.array(*[F.array(*[F.lit(float(d)) for d in (x, y, z)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    lengths = F.transform(F.array(base), lambda b: F.array_min(F.transform(around, lambda s: length(to_cartesian(F.zip_with(b, s, lambda p, q: p + q), cell)))))
    return lengths[0]


def scale_cell(cell: Column, factors: list[int]) -> Column:
    """The cell of a repeated structure: each lattice row times its number of copies."""
    return F.array(*[cell[3 * i + j] * float(factors[i]) for i in range(3) for j in range(3)])


def rescale_to_volume(cell: Column, target: Column) -> Column:
    """The cell stretched alike in all directions to a target volume; null without volume."""
    factor = F.pow(target / F.nullif(volume(cell), F.lit(0.0)), F.lit(1.0 / 3.0))
    return F.transform(cell, lambda x: x * factor)


def bounding_cell(lows: Column, highs: Column, pad: float) -> Column:
    """An orthogonal cell around the atoms with `pad` on each side."""
    zero = F.lit(0.0)
    side = [highs[i] - lows[i] + 2 * pad for i in range(3)]
    return F.array(side[0], zero, zero, zero, side[1], zero, zero, zero, side[2])


def voigt(stress: Column) -> Column:
    """Six components xx, yy, zz, yz, xz, xy of a stress given as six or nine numbers; null for other lengths."""
    order = [0, 4, 8, 5, 2, 1]
    return F.when(F.size(stress) == 6, stress).when(F.size(stress) == 9, F.array(*[F.get(stress, F.lit(i)) for i in order]))


def hydrostatic(stress6: Column) -> Column:
    return (stress6[0] + stress6[1] + stress6[2]) / 3.0


def von_mises(stress6: Column) -> Column:
    x, y, z, yz, xz, xy = (stress6[i] for i in range(6))
    square = lambda c: c * c
    return F.sqrt(0.5 * (square(x - y) + square(y - z) + square(z - x)) + 3.0 * (square(yz) + square(xz) + square(xy)))
