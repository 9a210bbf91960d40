"""The molecule contract and the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAMES = (
    "run string, track string, bead int, frame bigint, step bigint, n_atoms int, symbols array<string>, "
    "positions array<array<double>>, forces array<array<double>>, energy double, comment string"
)
SCORES = "run string, track string, bead int, frame bigint, step bigint, score double"
LEGACY_TYPES = ("C",) * 7 + ("O",) * 3 + ("C",) * 2 + ("O",) + ("H",) * 8


@dataclass(frozen=True)
class MoleculeSpec:
    """Atom count and element order that every frame has to match."""

    n_atoms: int
    atom_types: tuple[str, ...] = ()

    def checked(self, frames: DataFrame, elements: bool = True) -> DataFrame:
        """``frames``, failing at run time on the first that differs."""
        wrong = F.when(F.col("n_atoms") != self.n_atoms, F.format_string("frame %d has %d atoms, expected " + str(self.n_atoms), "frame", "n_atoms"))
        if elements and self.atom_types:
            order = F.array(*map(F.lit, self.atom_types))
            wrong = wrong.when(F.col("symbols").isNotNull() & (F.col("symbols") != order), F.format_string("frame %d has another element order", "frame"))
        return frames.withColumn("n_atoms", F.when(wrong.isNull(), F.col("n_atoms")).otherwise(F.raise_error(wrong).cast("int")))


def one_atom_count(frames: DataFrame) -> int:
    """The atom count of all frames; mixed counts are an error."""
    low, high = frames.agg(F.min("n_atoms"), F.max("n_atoms")).first()
    if low != high:
        raise ValueError(f"mixed atom counts: {low} to {high}")
    return low


def flagged(score: Column, threshold: float | Column) -> Column:
    """Strictly above the threshold; a NaN or null score is never flagged."""
    return F.coalesce((F.nanvl(score, F.lit(None).cast("double")) > threshold), F.lit(False))


def time_ps(step: Column, timestep_fs: float, stride: int) -> Column:
    return step * F.lit(float(timestep_fs)) * F.lit(int(stride)) / F.lit(1000.0)
