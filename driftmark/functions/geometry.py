"""Internal coordinates: SQL column builders for single terms, arrays for whole descriptors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.operators.topology import Topology

EPS = 1e-12
HARTREE_BOHR = 51.4221
HARTREE_BOHR_EXACT = 51.42208619083232

# --- columns: a point is an array of three doubles ---------------------------


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def angle(a: Column, vertex: Column, b: Column) -> Column:
    """Radians at the vertex."""
    return _bind(F.struct(sub(a, vertex).alias("u"), sub(b, vertex).alias("v")), lambda s: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(s["u"], s["v"]) / (norm(s["u"]) * norm(s["v"]) + EPS)))))


def dihedral(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """Radians about the bond p1-p2, in (-pi, pi]."""
    across = lambda v, b: F.zip_with(v, b, lambda x, y: x - dot(v, b) * y)

    def of(s: Column) -> Column:
        unit = F.transform(s["b1"], lambda x: x / (norm(s["b1"]) + EPS))
        return _bind(
            F.struct(unit.alias("h"), s["b0"].alias("b0"), s["b2"].alias("b2")),
            lambda q: _bind(F.struct(q["h"].alias("h"), across(q["b0"], q["h"]).alias("v"), across(q["b2"], q["h"]).alias("w")), lambda r: F.atan2(dot(cross(r["h"], r["v"]), r["w"]), dot(r["v"], r["w"]))),
        )

    return _bind(F.struct(sub(p0, p1).alias("b0"), sub(p2, p1).alias("b1"), sub(p3, p2).alias("b2")), of)


def scaled(vectors: Column, factor: float = HARTREE_BOHR) -> Column:
    """Unit conversion of an array of vectors."""
    return F.transform(vectors, lambda v: F.transform(v, lambda x: x * F.lit(factor)))


def cell_of(comment: Column) -> Column:
    """a, b, c and the three angles of a comment's CELL(abcABC), or null."""
    number = r"\s+([-+.\deE]+)"
    found = F.transform(F.array(*[F.regexp_extract(comment, r"CELL\(abcABC\):" + number * 6, i) for i in range(1, 7)]), lambda x: x.try_cast("double"))
    return F.when(comment.rlike(r"CELL\(abcABC\):" + number * 6), found)


def lattice(cell: Column) -> Column:
    """Row-major lattice vectors as text."""
    a, b, c = cell[0], cell[1], cell[2]
    al, be, ga = (F.radians(cell[i]) for i in (3, 4, 5))
    cx, cy = c * F.cos(be), c * (F.cos(al) - F.cos(be) * F.cos(ga)) / F.sin(ga)
    cz = F.sqrt(F.greatest(F.lit(0.0), c * c - cx * cx - cy * cy))
    zero = F.lit(0.0)
    return F.format_string(" ".join(["%.6f"] * 9), a, zero, zero, b * F.cos(ga), b * F.sin(ga), zero, cx, cy, cz)


def eigen_planarity(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Smallest eigenvalue of a symmetric 3x3 matrix, in closed form."""
    q = (xx + yy + zz) / 3.0
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2.0 * p * p * p), F.lit(0.0))))
    return q + 2.0 * p * F.cos(F.acos(r) / 3.0 + F.lit(2.0 * math.pi / 3.0))


# --- arrays: (frames, atoms, 3) ----------------------------------------------


def torsions(p: np.ndarray, quads: list) -> np.ndarray:
    """Radians, (frames, quads)."""
    q = np.asarray(quads, int).reshape(-1, 4)
    a, b, c, d = (p[:, q[:, i]] for i in range(4))
    axis = c - b
    axis = axis / (np.linalg.norm(axis, axis=-1, keepdims=True) + EPS)
    flat = lambda v: v - (v * axis).sum(-1, keepdims=True) * axis
    v, w = flat(a - b), flat(d - c)
    return np.arctan2((np.cross(axis, v) * w).sum(-1), (v * w).sum(-1))


def planarity(p: np.ndarray, ring: list[int]) -> np.ndarray:
    """Root mean square distance of the ring's atoms from their best plane."""
    c = p[:, ring] - p[:, ring].mean(1, keepdims=True)
    return np.linalg.svd(c, compute_uv=False)[:, -1] / math.sqrt(len(ring))


def descriptors(p: np.ndarray, topo: Topology) -> np.ndarray:
    """Bonds, angles, sines, cosines, planarity: (frames, n_features)."""
    p = np.asarray(p, float)
    blocks = []
    bonds = np.asarray(topo.bonds, int).reshape(-1, 2)
    blocks.append(np.linalg.norm(p[:, bonds[:, 1]] - p[:, bonds[:, 0]], axis=-1))
    ang = np.asarray(topo.angles, int).reshape(-1, 3)
    u, v = p[:, ang[:, 0]] - p[:, ang[:, 1]], p[:, ang[:, 2]] - p[:, ang[:, 1]]
    cosine = (u * v).sum(-1) / (np.linalg.norm(u, axis=-1) * np.linalg.norm(v, axis=-1) + EPS)
    blocks.append(np.arccos(np.clip(cosine, -1, 1)))
    t = torsions(p, topo.dihedrals)
    blocks += [np.sin(t), np.cos(t)]
    if topo.ring:
        blocks.append(planarity(p, topo.ring)[:, None])
    return np.hstack(blocks)


def primary_pairs(p: np.ndarray, quads: list) -> np.ndarray:
    """Sine and cosine of each dihedral side by side: (frames, 2 quads)."""
    t = torsions(p, quads)
    return np.stack([np.sin(t), np.cos(t)], -1).reshape(len(p), -1)


def points(column: pa.Array) -> np.ndarray:
    """An Arrow column of arrays of 3-vectors as (rows, atoms, 3)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().flatten(), np.float64)
    return flat.reshape(len(column), -1, 3) if len(column) else np.zeros((0, 0, 3))


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix, or of (rows, atoms, 3), as an Arrow column of lists."""
    flat = pa.array(np.ascontiguousarray(x, np.float64).reshape(-1))
    for width in x.shape[:0:-1]:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(width, 1)) if width else np.zeros(len(x) + 1), pa.int32()), flat)
    return flat


def with_descriptors(frames: DataFrame, topo: Topology, keep: list[str] | None = None) -> DataFrame:
    """``features`` for each frame, a batch at a time; positions are dropped unless kept."""
    keep = keep or [c for c in ("run", "track", "bead", "frame", "step") if c in frames.columns]
    rows = frames.select(*keep, F.col("positions").alias("__p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = descriptors(points(batch.column(batch.num_columns - 1)), topo) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(x)], names=[*batch.schema.names[:-1], "features"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("features", T.ArrayType(T.DoubleType()))]))
