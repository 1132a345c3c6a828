"""Descriptors of frames: a registry of functions from a frame to a vector, and the table of vectors that selection works on.

A descriptor is registered as a factory: it takes the parameters and gives a function of (symbols, positions, cell) to a vector of fixed
length. A worker process makes each function once for its parameters and keeps it for later tasks. The vectors feed
select.farthest_points and select.hierarchical_selection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Descriptor = Callable[[list[str], np.ndarray, np.ndarray | None], np.ndarray]
FACTORIES: dict[str, Callable[..., Descriptor]] = {}
_MADE: dict[tuple, Descriptor] = {}


def register(name: str) -> Callable[[Callable[..., Descriptor]], Callable[..., Descriptor]]:
    """Decorator of a factory."""

    def add(factory: Callable[..., Descriptor]) -> Callable[..., Descriptor]:
        FACTORIES[name] = factory
        return factory

    return add


@register("distance_histogram")
def distance_histogram(cutoff: float = 5.0, bins: int = 20) -> Descriptor:
    """Pairs of atoms of a frame by their distance (that of the nearest image where there is a cell), for each atom; positions are Cartesian."""

    def describe(symbols: list[str], positions: np.ndarray, cell: np.ndarray | None) -> np.ndarray:
        total = np.zeros(bins)
        inverse = None if cell is None else np.linalg.inv(cell)
        for i in range(len(positions) - 1):  # a row of pairs at a time: memory follows atoms, not pairs
            gap = positions[i + 1 :] - positions[i]
            if inverse is not None:
                part = gap @ inverse
                gap = (part - np.round(part)) @ cell
            d = np.sqrt((gap * gap).sum(axis=1))
            total += np.bincount(np.minimum((d / cutoff * bins).astype(np.int64), bins), minlength=bins + 1)[:bins]
        return total / max(len(positions), 1)

    return describe


@register("composition")
def composition(elements: tuple[str, ...] = ()) -> Descriptor:
    """The share of each of the given elements."""

    def describe(symbols: list[str], positions: np.ndarray, cell: np.ndarray | None) -> np.ndarray:
        return np.array([symbols.count(e) for e in elements]) / max(len(symbols), 1)

    return describe


def made(name: str, factory: Callable[..., Descriptor], settings: str) -> Descriptor:
    """The function for these parameters, made once a process."""
    key = (name, settings)
    if key not in _MADE:
        _MADE[key] = factory(**json.loads(settings))
    return _MADE[key]


def described(frames: DataFrame, name: str, **settings) -> DataFrame:
    """path, frame_index, vector of frames (schema.FRAME): fractional positions are made Cartesian; a frame without atoms has the vector of none."""
    factory, text = FACTORIES[name], json.dumps(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = made(name, factory, text)
        for batch in batches:
            vectors = []
            for cell, space, symbols, positions in zip(*(batch.column(c).to_pylist() for c in ("cell", "coord_space", "symbols", "positions")), strict=True):
                lattice = None if cell is None else np.array(cell).reshape(3, 3)
                x = np.array(positions or [], float).reshape(-1, 3)
                if space == "fractional" and lattice is not None:
                    x = x @ lattice
                vectors.append(np.asarray(describe(symbols or [], x, lattice), float))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("frame_index"), pa.array(vectors, pa.list_(pa.float64()))], names=["path", "frame_index", "vector"])

    rows = frames.select("path", "frame_index", "cell", "coord_space", F.col("atoms.symbol").alias("symbols"), F.col("atoms.pos").alias("positions"))
    return rows.mapInArrow(run, "path string, frame_index long, vector array<double>")
