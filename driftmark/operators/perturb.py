"""Labelled distortions, torsion coverage and synthetic trajectories, a batch of frames at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import geometry as G
from driftmark.operators.topology import Topology


def rattle(p: np.ndarray, sigma: float, seed: int, frames: np.ndarray | None = None) -> np.ndarray:
    """Gaussian displacements drawn from (seed, frame), so partitioning changes nothing."""
    ids = np.arange(len(p)) if frames is None else frames
    return p + np.stack([np.random.default_rng([seed, int(f)]).normal(0, sigma, p.shape[1:]) for f in ids]) if len(p) else p


def stretch(p: np.ndarray, topo: Topology, delta: float, bond: int = 0) -> np.ndarray:
    """Lengthen a bond, moving all atoms beyond it."""
    i, j = topo.bonds[bond]
    d = p[:, j] - p[:, i]
    n = np.linalg.norm(d, axis=1, keepdims=True)
    d = np.where(n > G.EPS, d / np.where(n > G.EPS, n, 1), [1.0, 0.0, 0.0])
    out = p.copy()
    out[:, sorted(topo.beyond(i, j))] += delta * d[:, None]
    return out


def rotate(p: np.ndarray, topo: Topology, degrees, quad: tuple | None = None) -> np.ndarray:
    """Turn the atoms beyond a dihedral's middle bond; bonds and angles stay."""
    _, j, k, _ = quad or topo.balanced_dihedral()
    axis = p[:, k] - p[:, j]
    n = np.linalg.norm(axis, axis=1, keepdims=True)
    if (n < G.EPS).any():
        raise ValueError(f"the axis of {quad} has no length")
    axis = (axis / n)[:, None]
    t = np.broadcast_to(np.radians(degrees), len(p))[:, None, None]
    moving = sorted(topo.beyond(j, k))
    r = p[:, moving] - p[:, j : j + 1]
    out = p.copy()
    out[:, moving] = p[:, j : j + 1] + r * np.cos(t) + np.cross(np.broadcast_to(axis, r.shape), r) * np.sin(t) + axis * (r * axis).sum(-1, keepdims=True) * (1 - np.cos(t))
    return out


def set_torsion(p: np.ndarray, topo: Topology, quad: tuple, degrees: float) -> np.ndarray:
    return rotate(p, topo, degrees - np.degrees(G.torsions(p, [quad])[:, 0]), quad)


def distorted(frames: DataFrame, topo: Topology, settings: list[tuple], seed: int = 42) -> DataFrame:
    """(setting, frame, positions) for each frame under each setting (kind, magnitude[, quad]).

    All settings of a frame are made where the frame is: no join and no shuffle.
    """
    rows = frames.select("frame", "positions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, p = np.asarray(batch.column(0)), G.points(batch.column(1))
            for s, (kind, size, *more) in enumerate(settings):
                if kind == "rattle":
                    q = rattle(p, size, seed + s, ids)
                elif kind == "stretch":
                    q = stretch(p, topo, size)
                elif kind == "rotate":
                    q = rotate(p, topo, size, *more)
                else:
                    q = set_torsion(p, topo, more[0], size)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(q), pa.int32()), batch.column(0), G.lists(q)], names=["setting", "frame", "positions"])

    return rows.mapInArrow(run, "setting int, frame bigint, positions array<array<double>>")


def histogram(df: DataFrame, angle: Column, keys: list[str] = [], n_bins: int = 12) -> DataFrame:  # noqa: B006
    """Counts of degrees in [-180, 180] by bin, closed at 180; empty bins are rows too."""
    width = 360.0 / n_bins
    at = F.least(F.lit(n_bins), F.width_bucket(angle, F.lit(-180.0), F.lit(180.0), F.lit(n_bins))) - 1
    counts = df.groupBy(*keys, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(n_bins).withColumnRenamed("id", "bin")
    every = counts.select(*keys).distinct().join(F.broadcast(bins)) if keys else bins
    low = F.col("bin") * width - 180.0
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", low.alias("angle_low"), (low + width).alias("angle_high"), (low + width / 2).alias("angle_centre"), F.coalesce("n", F.lit(0)).cast("long").alias("train_count"), F.col("n").isNotNull().alias("visited")
    )


def with_torsions(frames: DataFrame, quads: list) -> DataFrame:
    """(quad, degrees) of each frame and dihedral."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = np.degrees(G.torsions(G.points(batch.column(0)), quads))
                yield pa.RecordBatch.from_pydict({"quad": pa.array(np.tile(np.arange(len(quads)), len(t)), pa.int32()), "degrees": t.ravel()})

    return frames.select("positions").mapInArrow(run, "quad int, degrees double")


def torsion_coverage(frames: DataFrame, quad: tuple, n_bins: int = 12) -> DataFrame:
    return histogram(with_torsions(frames, [quad]), F.col("degrees"), n_bins=n_bins)


def gap_rich_dihedral(frames: DataFrame, topo: Topology, n_bins: int = 12, least: int = 3) -> tuple[tuple, DataFrame]:
    """The first rotatable dihedral with the most unvisited bins, and its coverage."""
    quads = [d for d, _ in topo.rotatable(least)]
    if not quads:
        raise ValueError("no rotatable dihedral outside the ring and its ends")
    table = histogram(with_torsions(frames, quads), F.col("degrees"), ["quad"], n_bins)
    gaps = table.groupBy("quad").agg(F.sum((~F.col("visited")).cast("int")).alias("gaps")).orderBy(F.desc("gaps"), "quad").first()
    return quads[gaps.quad], table.where(F.col("quad") == gaps.quad).drop("quad")


def drifting(positions: np.ndarray, topo: Topology, quad: tuple, n_frames: int, drift: float, sigma: float, seed: int) -> np.ndarray:
    """A synthetic walk: one torsion drifts by ``drift`` degrees, all atoms are rattled, and frames tumble."""
    rng = np.random.default_rng(seed)
    base = np.repeat(np.asarray(positions, float)[None], n_frames, 0)
    base = rotate(base, topo, np.linspace(0, drift, n_frames), quad)
    heavy = np.array([0.5 if t != "H" else 1.0 for t in topo.atom_types])[None, :, None]
    base = base + rng.normal(0, sigma, base.shape) * heavy
    q = rng.normal(size=(n_frames, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    centre = base.mean(1, keepdims=True)
    return np.einsum("ijf,faj->fai", turn, base - centre) + centre


def basin(positions: np.ndarray, topo: Topology, n_frames: int, seed: int, sigma: float = 0.03, turn: float = 12.0) -> np.ndarray:
    """Frames about one geometry: the balanced torsion and every atom vary a little."""
    rng = np.random.default_rng(seed)
    base = np.repeat(np.asarray(positions, float)[None], n_frames, 0)
    base = rotate(base, topo, rng.normal(0, turn, n_frames))
    return base + rng.normal(0, sigma, base.shape)


def ipi_text(p: np.ndarray, symbols: list[str], first_step: int = 0, stride: int = 50, bead: int = 0) -> str:
    """A trajectory in the i-PI layout."""
    out = []
    for k, frame in enumerate(p):
        out.append(f"{len(symbols)}\n# CELL(abcABC): 100.0 100.0 100.0 90.0 90.0 90.0  Step: {first_step + k * stride}  Bead: {bead} positions{{angstrom}} cell{{angstrom}}\n")
        out += [f"{s} {x:.8f} {y:.8f} {z:.8f}\n" for s, (x, y, z) in zip(symbols, frame, strict=True)]
    return "".join(out)
