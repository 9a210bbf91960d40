"""Choosing frames: distances to a reference, farthest-point order, stratified and strided samples."""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions import geometry as G
from driftmark.operators.models import ScalerPCA, matrix
from driftmark.operators.topology import Topology

#: Candidates of up to so many numbers are ordered in one task; beyond, in rounds over the cluster.
ONE_TASK_NUMBERS = 5_000_000


def farthest(x: np.ndarray, reference: np.ndarray, k: int) -> np.ndarray:
    """Farthest-point order from the reference; ties go to the lowest row."""
    d, out = np.linalg.norm(x - reference, axis=1), []
    for _ in range(min(k, len(x))):
        at = int(np.argmax(d))
        out.append(at)
        d = np.minimum(d, np.linalg.norm(x - x[at], axis=1))
        d[out] = -1.0
    return np.array(out, int)


def farthest_points(df: DataFrame, reference: list[float], k: int, column: str = "features", limit: int = ONE_TASK_NUMBERS) -> DataFrame:
    """(rank, frame) of ``k`` rows of (frame, column)."""
    n = df.count()
    if n < k:
        warnings.warn(f"only {n} frames to choose from; {k} were asked for", stacklevel=2)
    rows, spark = df.select("frame", F.col(column).cast("array<double>").alias("x")), df.sparkSession
    if n * len(reference) <= limit:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                table = pa.Table.from_batches(held).sort_by("frame")
                at = farthest(matrix(table.column("x")), np.asarray(reference), k)
                yield pa.RecordBatch.from_pydict({"rank": pa.array(range(len(at)), pa.int32()), "frame": np.asarray(table.column("frame"))[at]})

        return rows.repartition(1).mapInArrow(run, "rank int, frame bigint")
    # a round a pick: only the pick itself comes to the driver, and distances to all picks are one projection
    rows, picks, out = rows.persist(), [list(reference)], []
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with("x", F.array(*map(F.lit, p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    state = rows.withColumn("d", gap(picks[0]))
    for _ in range(min(k, n)):
        best = state.where(~F.col("frame").isin(out) if out else F.lit(True)).orderBy(F.desc("d"), "frame").first()
        out.append(best.frame)
        state = state.withColumn("d", F.least("d", gap(list(best.x))))
        if len(out) % 16 == 0:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="driftmark-"))
            state = state.checkpoint()
    rows.unpersist()
    return spark.createDataFrame(list(enumerate(out)), "rank int, frame bigint")


def chosen_columns(topo: Topology, primary: list[tuple]) -> list[int]:
    """Descriptor columns without the sines and cosines of the primary dihedrals."""
    drop, first = set(), len(topo.bonds) + len(topo.angles)
    for q in primary:
        q = min(tuple(q), tuple(q)[::-1])
        if q not in topo.dihedrals:
            raise ValueError(f"dihedral {q} is not in the topology; indices start at 0")
        at = first + topo.dihedrals.index(q)
        drop |= {at, at + len(topo.dihedrals)}
    return [i for i in range(topo.n_features) if i not in drop]


def ellipse_distance(values: Column, reference: list[float], radii: list[float]) -> Column:
    """sqrt of the sum of (chord / radius) squared over (sine, cosine) pairs side by side."""
    total = F.lit(0.0)
    for i, r in enumerate(radii):
        a, b = values[2 * i] - F.lit(reference[2 * i]), values[2 * i + 1] - F.lit(reference[2 * i + 1])
        total = total + (a * a + b * b) / F.lit(float(r) ** 2)
    return F.sqrt(total)


def within_dihedrals(frames: DataFrame, reference, primary: list[tuple], radii: list[float]) -> DataFrame:
    """Every frame inside the ellipse, in one pass: (frame, positions, distance)."""
    ref = np.asarray(reference, float)[None]
    radii = list(radii) * len(primary) if len(radii) == 1 else list(radii)
    rows = frames.select("frame", "positions")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = G.primary_pairs(G.points(batch.column(1)), primary)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v.tolist(), pa.list_(pa.float64()))], names=["frame", "positions", "pairs"])

    schema = T.StructType([*rows.schema.fields, T.StructField("pairs", T.ArrayType(T.DoubleType()))])
    near = rows.mapInArrow(pairs, schema).withColumn("distance", ellipse_distance(F.col("pairs"), G.primary_pairs(ref, primary)[0].tolist(), radii))
    return near.where("distance <= 1").select("frame", "positions", "distance")


def select_by_dihedrals(frames: DataFrame, topo: Topology, reference, primary: list[tuple], radii: list[float], k: int) -> DataFrame:
    """``k`` frames inside the ellipse, spread out over the other coordinates: (rank, frame, distance).

    Each pick passes over all frames inside, so ``k`` of as many as there are is
    quadratic; ``within_dihedrals`` has them all without ranks.
    """
    # the cheap distance filters before any full descriptor is made
    inside = within_dihedrals(frames, reference, primary, radii).persist()
    keep = chosen_columns(topo, primary)
    rest = G.with_descriptors(inside, topo, ["frame", "distance"]).withColumn("features", F.transform(F.array(*map(F.lit, keep)), lambda i: F.get("features", i)))
    order = farthest_points(rest, G.descriptors(np.asarray(reference, float)[None], topo)[0][keep].tolist(), k)
    return order.join(inside.select("frame", "distance"), "frame").select("rank", "frame", "distance")


def within_descriptor(frames: DataFrame, topo: Topology, reference, radius: float, variance: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Every frame within ``radius`` in principal components fitted on the trajectory, (frame, reduced, distance), and the reduced reference."""
    described = G.with_descriptors(frames, topo, ["frame"]).persist()
    pca = ScalerPCA.fit(described, variance)
    ref = pca.apply(G.descriptors(np.asarray(reference, float)[None], topo))[0].tolist()
    gap = F.sqrt(F.aggregate(F.zip_with("reduced", F.array(*map(F.lit, ref)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return pca.transform(described).withColumn("distance", gap).where(F.col("distance") <= radius), ref


def select_by_descriptor(frames: DataFrame, topo: Topology, reference, radius: float, k: int, variance: float = 0.95) -> DataFrame:
    """``k`` frames of ``within_descriptor``, spread out: (rank, frame, distance)."""
    near, ref = within_descriptor(frames, topo, reference, radius, variance)
    near = near.persist()
    order = farthest_points(near, ref, k, "reduced")
    return order.join(near.select("frame", "distance"), "frame").select("rank", "frame", "distance")


def stratified(df: DataFrame, n_per_bin: int, seed: int = 42, lot: Column | None = None) -> DataFrame:
    """The same number of rows from each bin, by ``lot`` (a hash of seed and frame), then frame; fewer where a bin holds fewer.

    Each task keeps its own first rows of a bin before the shuffle, so a bin of
    any size sends at most ``n_per_bin`` rows a task.
    """
    lot = F.xxhash64(F.lit(seed), "frame") if lot is None else lot
    rows = df.withColumn("__lot", F.struct(lot.alias("lot"), F.col("frame").alias("f")))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("frame"), F.lit(64)))
    first = Window.partitionBy("bin", "__salt").orderBy("__lot")
    some = salted.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= n_per_bin)
    final = Window.partitionBy("bin").orderBy("__lot")
    return some.withColumn("__n", F.row_number().over(final)).where(F.col("__n") <= n_per_bin).drop("__n", "__salt", "__lot")


def strided_split(df: DataFrame, part: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(calibration, evaluation) by frame number; at least 8 frames."""
    n = df.count()
    if n < 8:
        raise ValueError(f"at least 8 frames are needed, not {n}")
    stride = max(2, round(1 / max(part, 1e-6)))
    return df.where(F.col("frame") % stride == 0), df.where(F.col("frame") % stride != 0)
