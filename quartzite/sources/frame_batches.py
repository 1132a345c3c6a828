"""Frames of a grammar to Arrow batches of schema.FRAME. Steps of OUTCAR files, which may be very many and small, are made in columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import trajectories
from .ranges import ROWS, batched

#: Atoms that end a batch.
ATOMS = 1 << 16


def frame_batches(sources: Iterator[tuple[str, Iterable[str], dict]], grammar: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The frames of sources: path, lines, options of the grammar."""
    if grammar != "outcar":
        yield from batched(({"path": path} | f for path, lines, options in sources for f in trajectories.GRAMMARS[grammar](lines, **options)), arrow, "n_atoms", ATOMS)
        return
    held, total = [], 0
    for path, lines, options in sources:
        for step in trajectories.outcar_steps(lines, **options):
            held.append((path, *step))
            total += len(step[3])
            if len(held) == ROWS or total >= ATOMS:
                yield steps(held, arrow)
                held, total = [], 0
    if held:
        yield steps(held, arrow)


def numbers(lines: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Which steps have six numbers in each line, and these numbers; none where Arrow may not read them as Python does."""
    text = pa.array(lines, pa.string())
    if pc.any(pc.match_substring_regex(text, r"[^\t\n\r\x20-\x7e]|\(")).as_py():
        return None
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    enough = pc.list_value_length(words).to_numpy() >= 6
    whole = np.logical_and.reduceat(enough, np.cumsum(counts) - counts)
    six = pc.list_slice(words.filter(pa.array(np.repeat(whole, counts))), 0, 6)
    try:
        return whole, pc.cast(six.flatten(), pa.float64()).to_numpy().reshape(-1, 6)
    except pa.ArrowInvalid:
        return None


def steps(held: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    """path and what outcar_steps gives. Steps with a bad line are left out."""
    counts = np.array([len(h[4]) for h in held])
    found = numbers([line for h in held for line in h[4]], counts) if all(len(h[3]) == len(h[4]) for h in held) else None
    if found is None:
        return pa.RecordBatch.from_pylist([{"path": path} | f for path, *step in held for f in trajectories.outcar_frame(*step)], schema=arrow)
    whole, values = found
    held, counts = [h for h, ok in zip(held, whole, strict=True) if ok], counts[whole]
    n, ends = len(held), np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    atoms = arrow.field("atoms").type
    of = {f.name: f.type for f in atoms.value_type}
    triples = np.arange(0, 3 * len(values) + 1, 3, dtype=np.int32)
    vectors = lambda v, kind: pa.ListArray.from_arrays(triples, pa.array(v.ravel()), type=kind)
    columns = {
        "idx": pa.array(np.arange(len(values)) - np.repeat(ends[:-1], counts), of["idx"]),
        "symbol": pa.array([s for h in held for s in h[3]], of["symbol"]),
        "pos": vectors(values[:, :3], of["pos"]),
        "vel": pa.nulls(len(values), of["vel"]),
        "force": vectors(values[:, 3:], of["force"]),
    }
    rows = pa.StructArray.from_arrays([columns[f.name] for f in atoms.value_type], fields=list(atoms.value_type))
    given = {
        "path": [h[0] for h in held],
        "frame_index": [h[1] for h in held],
        "n_atoms": counts,
        "cell": [h[2] for h in held],
        "pbc": [[True] * 3] * n,
        "info": [[]] * n,
        "coord_space": ["cartesian"] * n,
        "atoms": pa.ListArray.from_arrays(ends, rows, type=atoms),
    }
    return pa.RecordBatch.from_arrays([v if isinstance(v := given.get(f.name), pa.Array) else pa.array(v, f.type) if v is not None else pa.nulls(n, f.type) for f in arrow], schema=arrow)
