"""Per-atom embeddings: made in batches by any model, kept as Parquet, imported from arrays.

A row is (run, bead, step, atom, features): 32-bit numbers on disk, doubles when read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.geometry import points

ROWS = "run string, bead int, step bigint, atom int, features array<float>"


def _batch(run: list, bead: list, step: list, x: np.ndarray) -> pa.RecordBatch:
    """Arrow rows of (frames, atoms, features)."""
    n, atoms, width = x.shape
    flat = pa.array(np.ascontiguousarray(x, np.float32).reshape(-1))
    features = pa.ListArray.from_arrays(pa.array(np.arange(0, n * atoms * width + 1, max(width, 1))[: n * atoms + 1], pa.int32()), flat)
    again = lambda v, t: pa.array([y for y in v for _ in range(atoms)], t)
    return pa.RecordBatch.from_arrays([again(run, pa.string()), again(bead, pa.int32()), again(step, pa.int64()), pa.array(np.tile(np.arange(atoms), n), pa.int32()), features], names=["run", "bead", "step", "atom", "features"])


def embed(frames: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 256) -> DataFrame:
    """Embeddings of (run, bead, step, positions).

    ``model`` is called once a task and gives a function of (frames, atoms, 3) to
    (frames, atoms, features), which sees at most ``batch`` frames at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = model()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                yield _batch(*(part.column(i).to_pylist() for i in range(3)), np.asarray(apply(points(part.column(3)))))

    return frames.select(F.col("run").cast("string"), F.col("bead").cast("int"), F.col("step").cast("long"), "positions").mapInArrow(run, ROWS)


def write(df: DataFrame, path: str) -> None:
    """Parquet under (run, bead); the centroid's bead is null."""
    df.selectExpr("run", "bead", "cast(step as bigint) step", "cast(atom as int) atom", "cast(features as array<float>) features").write.mode("overwrite").option("compression", "zstd").partitionBy("run", "bead").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("features", df["features"].cast("array<double>"))


def import_arrays(spark: SparkSession, path: str, run: str, bead: int | None, frames_per_task: int = 512) -> DataFrame:
    """Rows of a file of ``inv_features`` (frames, atoms, features) and ``steps``: an .npz, or an HDF5 file where h5py is.

    Each task opens the file and reads its own frames.
    """

    def opened():
        if path.endswith(".npz"):
            return np.load(path)
        try:
            import h5py
        except ImportError as e:
            raise ImportError("HDF5 embeddings need h5py; import them where it is installed") from e
        return h5py.File(path)

    with opened() as f:
        n = len(f["steps"])

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened() as f:
            for rows in batches:
                for first in rows.column(0).to_pylist():
                    to = min(n, first + frames_per_task)
                    yield _batch([run] * (to - first), [bead] * (to - first), np.asarray(f["steps"][first:to]).tolist(), np.asarray(f["inv_features"][first:to]))

    starts = spark.range(0, max(n, 1), frames_per_task, max(1, -(-n // frames_per_task))) if n else spark.range(0)
    return starts.mapInArrow(pull, ROWS)
