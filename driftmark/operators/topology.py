"""The molecule's graph: bonds, angles, dihedrals, ring and fragments. Small, so on the driver."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Covalent radii in angstrom (Cordero and others, 2008).
RADII = {
    "H": 0.31, "He": 0.28, "Li": 1.28, "Be": 0.96, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "Ne": 0.58,
    "Na": 1.66, "Mg": 1.41, "Al": 1.21, "Si": 1.11, "P": 1.07, "S": 1.05, "Cl": 1.02, "Ar": 1.06, "K": 2.03, "Ca": 1.76,
    "Sc": 1.70, "Ti": 1.60, "V": 1.53, "Cr": 1.39, "Mn": 1.39, "Fe": 1.32, "Co": 1.26, "Ni": 1.24, "Cu": 1.32, "Zn": 1.22,
    "Ga": 1.22, "Ge": 1.20, "As": 1.19, "Se": 1.20, "Br": 1.20, "Kr": 1.16, "I": 1.39, "Xe": 1.40,
}
#: What neighbour lists add to a pair's cut-off by default.
SKIN = 0.6
#: Rows of graphs that a worker holds before it hands them on.
HELD_ROWS = 10_000


@dataclass
class Topology:
    atom_types: list[str]
    bonds: list[tuple[int, int]]
    angles: list[tuple[int, int, int]] = field(default_factory=list)
    dihedrals: list[tuple[int, int, int, int]] = field(default_factory=list)
    ring: list[int] = field(default_factory=list)

    @property
    def n_atoms(self) -> int:
        return len(self.atom_types)

    @property
    def n_features(self) -> int:
        return len(self.bonds) + len(self.angles) + 2 * len(self.dihedrals) + bool(self.ring)

    @property
    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.atom_types]
        for i, j in self.bonds:
            out[i].append(j)
            out[j].append(i)
        return out

    @property
    def feature_names(self) -> list[str]:
        """Bonds, angles, all sines, all cosines, planarity: the order of the descriptor."""
        label = lambda atoms: "-".join(f"{self.atom_types[a]}{a}" for a in atoms)
        torsions = [label(d) for d in self.dihedrals]
        return [
            *(f"bond_{label(b)}_Å" for b in self.bonds), *(f"angle_{label(a)}_rad" for a in self.angles),
            *(f"sin_dih_{t}" for t in torsions), *(f"cos_dih_{t}" for t in torsions), *(["ring_planarity_rmsd_Å"] if self.ring else []),
        ]

    def fragments(self) -> int:
        """Connected parts of the bond graph."""
        up = list(range(self.n_atoms))

        def root(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        for i, j in self.bonds:
            up[root(i)] = root(j)
        return len({root(i) for i in range(self.n_atoms)})

    def beyond(self, i: int, j: int) -> set[int]:
        """Atoms on j's side of the bond i-j."""
        found, edge, near = {i, j}, {j}, self.neighbours
        while edge:
            edge = {b for a in edge for b in near[a]} - found
            found |= edge
        return found - {i}

    def rotatable(self, least: int = 0) -> list[tuple[tuple[int, int, int, int], int]]:
        """Dihedrals about bonds outside the ring, with the size of the smaller side."""
        ring, out = set(self.ring), []
        for d in self.dihedrals:
            if not (d[1] in ring and d[2] in ring):
                n = len(self.beyond(d[1], d[2]))
                if min(n, self.n_atoms - n) >= least:
                    out.append((d, min(n, self.n_atoms - n)))
        return out

    def balanced_dihedral(self) -> tuple[int, int, int, int]:
        """The first rotatable dihedral that splits the molecule most evenly."""
        found = self.rotatable()
        if not found:
            raise ValueError("no rotatable dihedral outside the ring")
        return max(found, key=lambda x: x[1])[0]


def carbon_ring(near: list[list[int]], types: list[str], size: int = 6) -> list[int]:
    """Sorted atoms of the all-carbon cycle found from the lowest atom; none: empty."""
    carbon = [t == "C" for t in types]
    for start in range(len(types)):
        paths = [[start]] if carbon[start] else []
        while paths:
            path = paths.pop()
            if len(path) == size:
                if start in near[path[-1]]:
                    return sorted(path)
                continue
            # reversed, so that the lowest neighbour is walked first
            paths += [[*path, b] for b in reversed(near[path[-1]]) if carbon[b] and b not in path]
    return []


def checked_ring(atoms: list[int], near: list[list[int]]) -> list[int]:
    ring = [int(a) for a in atoms]
    if not ring:
        return []
    if len(ring) < 3 or len(set(ring)) < len(ring):
        raise ValueError(f"a ring has at least 3 distinct atoms: {ring}")
    if min(ring) < 0 or max(ring) >= len(near):
        raise ValueError(f"ring atoms out of range: {ring}")
    for a in ring:
        if len(set(near[a]) & set(ring)) != 2:
            raise ValueError(f"atom {a} does not have two neighbours in the ring {ring}")
    return sorted(ring)


def build(symbols: list[str], positions, nl_mult: float = 1.1, ring_atoms: list[int] | None = None, ring_size: int = 6, skin: float = SKIN) -> Topology:
    """The graph of one geometry. ``ring_atoms``: None finds a ring, an empty list wants none."""
    p, n = np.asarray(positions, float), len(symbols)
    bonds = [(i, j) for i in range(n) for j in range(i + 1, n) if math.dist(p[i], p[j]) < nl_mult * (RADII[symbols[i]] + RADII[symbols[j]]) + skin]
    if not bonds:
        raise ValueError(f"no bonds with nl_mult={nl_mult}")
    topo = from_bonds(symbols, bonds, ring_atoms, ring_size)
    if topo.fragments() > 1:
        warnings.warn("the bond graph falls into fragments; coordinates have no periodic images", stacklevel=2)
    return topo


def from_bonds(symbols: list[str], bonds: list[tuple[int, int]], ring_atoms: list[int] | None = None, ring_size: int = 6) -> Topology:
    """The graph of known bonds (i < j, in order)."""
    n, topo = len(symbols), Topology(list(symbols), list(bonds))
    near = topo.neighbours
    topo.angles = list(dict.fromkeys((min(i, k), j, max(i, k)) for j in range(n) for a, i in enumerate(near[j]) for k in near[j][a + 1 :]))
    quads = ((i, j, k, m) for j, k in bonds for i in near[j] if i != k for m in near[k] if m not in (j, i))
    topo.dihedrals = list(dict.fromkeys(min(q, q[::-1]) for q in quads))
    topo.ring = carbon_ring(near, topo.atom_types, ring_size) if ring_atoms is None else checked_ring(ring_atoms, near)
    return topo


def graphs(frames: DataFrame, symbols: list[str], nl_mult: float = 1.1, ring_size: int = 6, skin: float = SKIN) -> DataFrame:
    """(frame, kind, place, atoms) of each frame's own graph: its bonds, angles and dihedrals in order, the
    ``side`` of each bond (its atoms and how many lie beyond), ``fragments``, the ``balance`` of its most
    balanced dihedral (null without one) and its ``ring`` (null without one). Frames without bonds have no rows.
    """
    held = HELD_ROWS

    def terms(topo: Topology):
        for kind, items in (("bond", topo.bonds), ("angle", topo.angles), ("dihedral", topo.dihedrals)):
            yield from ((kind, k, list(x)) for k, x in enumerate(items))
        yield from (("side", k, [i, j, len(topo.beyond(i, j))]) for k, (i, j) in enumerate(topo.bonds))
        yield "fragments", 0, [topo.fragments()]
        # the ring holds no turnable bond; without one, every dihedral counts
        free = Topology(topo.atom_types, topo.bonds, topo.angles, topo.dihedrals)
        yield "balance", 0, [max(n for _, n in free.rotatable())] if free.dihedrals else None
        yield "ring", 0, topo.ring or None

    def pack(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["frame", "kind", "place", "atoms"])

    # a batch of frames is many times as large in graphs: frames are read one by one, and their rows leave in batches of their own
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for at in range(batch.num_rows):
                frame, p = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    try:
                        topo = build(symbols, p, nl_mult, None, ring_size, skin)
                    except ValueError:
                        continue
                for t in terms(topo):
                    rows.append((frame, *t))
                    if len(rows) >= held:
                        yield pack(rows)
                        rows = []
        yield pack(rows)

    return frames.select(F.col("frame").cast("long").alias("frame"), "positions").mapInArrow(run, "frame long, kind string, place int, atoms array<int>")
