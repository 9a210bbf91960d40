"""Hard-chemistry checks: broken bonds and close contacts, as one projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions import geometry as G
from driftmark.operators.topology import Topology

#: What written tables call planarity.
PLANARITY = "ring_planarity_rmsd_Å"
PAIR = "array<struct<i:int,j:int,d:double>>"


def pair_distances(positions: Column, pairs: list[tuple[int, int]]) -> Column:
    """(i, j, d) for each pair, in SQL; for few pairs."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]) if pairs else F.array().cast("array<struct<i:int,j:int>>")
    return F.transform(table, lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"), G.distance(F.get(positions, s["i"]), F.get(positions, s["j"])).alias("d")))


def broken_bonds(positions: Column, topo: Topology, cutoff: float = 2.0) -> Column:
    return F.filter(pair_distances(positions, topo.bonds), lambda s: s["d"] > cutoff)


def close_contacts(positions: Column, topo: Topology, cutoff: float = 1.2) -> Column:
    bonded = set(topo.bonds)
    return F.filter(pair_distances(positions, [(i, j) for i in range(topo.n_atoms) for j in range(i + 1, topo.n_atoms) if (i, j) not in bonded]), lambda s: s["d"] < cutoff)


def with_flags(frames: DataFrame, topo: Topology, bond_cutoff: float = 2.0, contact_cutoff: float = 1.2) -> DataFrame:
    """Every pair of a batch at a time: broken, close (lists of i, j, d) and planarity (null without a ring)."""
    keep = [c for c in ("run", "track", "bead", "frame", "step") if c in frames.columns]
    rows = frames.select(*keep, F.col("positions").alias("__p"))
    bonded = np.asarray(topo.bonds, int).reshape(-1, 2)
    held = set(topo.bonds)
    free = np.array([(i, j) for i in range(topo.n_atoms) for j in range(i + 1, topo.n_atoms) if (i, j) not in held], int).reshape(-1, 2)
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("d", pa.float64())]))

    def listed(p: np.ndarray, pairs: np.ndarray, hit) -> pa.Array:
        d = np.linalg.norm(p[:, pairs[:, 0]] - p[:, pairs[:, 1]], axis=-1)
        out: list[list[dict]] = [[] for _ in p]
        for f, k in zip(*np.nonzero(hit(d)), strict=True):
            out[f].append({"i": int(pairs[k, 0]), "j": int(pairs[k, 1]), "d": float(d[f, k])})
        return pa.array(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = G.points(batch.column(batch.num_columns - 1))
            if not len(p):
                continue
            flat = pa.array(G.planarity(p, topo.ring)) if topo.ring else pa.nulls(len(p), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed(p, bonded, lambda d: d > bond_cutoff), listed(p, free, lambda d: d < contact_cutoff), flat], names=[*batch.schema.names[:-1], "broken", "close", "planarity"])

    found = T._parse_datatype_string(f"broken {PAIR}, close {PAIR}, planarity double").fields
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *found]))


def flag_rows(flags: DataFrame) -> DataFrame:
    return flags.select(
        *[c for c in flags.columns if c not in ("broken", "close", "planarity")],
        (F.size("broken") > 0).alias("broken_bond"), F.size("broken").alias("n_broken_bonds"),
        (F.size("close") > 0).alias("close_contact"), F.size("close").alias("n_close_contacts"), "planarity",
    )


def flag_rate(flags: DataFrame) -> DataFrame:
    """The part of frames with a broken bond or a close contact."""
    return flags.agg(F.avg(((F.size("broken") > 0) | (F.size("close") > 0)).cast("double")).alias("flag_rate"))
