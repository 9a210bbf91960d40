"""Standardisation, principal components and Mahalanobis scores.

Fits are one pass of partial sums: every task folds its rows into a count, a
shifted sum and a Gram matrix of fixed size, and only those meet. Fitted models
are small and live on the driver, saved as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions.geometry import lists, points


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _partial(shift: list[float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                if shift is not None:
                    x = x - np.asarray(shift)
                total = x.sum(0) if total is None else total + x.sum(0)
                gram = x.T @ x if gram is None else gram + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "gram": [gram.ravel().tolist()]})

    return run


def moments(df: DataFrame, column: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred Gram matrix. The first row is the shift, so large offsets cost no digits."""
    first = df.select(column).first()
    if first is None:
        raise ValueError("no rows to fit")
    shift = np.asarray(first[0], np.float64)
    parts = df.select(column).mapInArrow(_partial(shift.tolist()), "n long, total array<double>, gram array<double>")
    # partials of one fixed size meet in a tree of sums, element by element
    d = len(shift)
    sums = parts.select("n", F.posexplode(F.concat("total", "gram")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = sorted(sums.collect())
    n, v = rows[0].n, np.array([r.v for r in rows])
    mean = v[:d] / n
    return n, shift + mean, v[d:].reshape(d, d) - n * np.outer(mean, mean)


def mapped(df: DataFrame, function, column: str, name: str, kind: T.DataType) -> DataFrame:
    """``df`` with ``name`` = function(matrix of ``column``), batch by batch."""
    kept = [c for c in df.columns if c != name]
    rows = df.select(*kept, F.col(column).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = function(matrix(batch.column(batch.num_columns - 1)))
            if not batch.num_rows:
                value = pa.array([], pa.list_(pa.float64()) if isinstance(kind, T.ArrayType) else pa.float64())
            else:
                value = lists(value) if value.ndim > 1 else pa.array(value, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], value], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, kind)]))


VECTOR = T.ArrayType(T.DoubleType())


def mapped_points(rows: DataFrame, function, name: str) -> DataFrame:
    """``rows``, whose last column is positions, with ``name`` = function(frames, atoms, 3) instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = function(points(batch.column(batch.num_columns - 1))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(x)], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, VECTOR)]))


@dataclass
class ScalerPCA:
    """Population standard deviations (constant columns keep scale 1), then principal components."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray  # (k, d)
    ratio: np.ndarray

    @property
    def n_components(self) -> int:
        return len(self.components)

    @classmethod
    def fit(cls, df: DataFrame, variance: float = 0.95, column: str = "features") -> ScalerPCA:
        """The fewest components whose share of the variance exceeds ``variance``."""
        n, mean, gram = moments(df, column)
        std = np.sqrt(np.maximum(np.diag(gram) / n, 0))
        scale = np.where(std > 10 * np.finfo(float).eps * np.maximum(np.abs(mean), 1), std, 1.0)
        value, vector = np.linalg.eigh(gram / np.outer(scale, scale))
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        most = min(n, len(mean))
        share = value / max(value.sum(), np.finfo(float).tiny)
        k = min(int(np.searchsorted(np.cumsum(share), variance, side="right")) + 1, most)
        sign = np.sign(vector[np.abs(vector).argmax(0), range(len(mean))])
        return cls(mean, scale, (vector * sign).T[:k], share[:k])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.components.T

    def transform(self, df: DataFrame, column: str = "features", name: str = "reduced") -> DataFrame:
        return mapped(df, self.apply, column, name, VECTOR)

    def residual(self, df: DataFrame, column: str = "features", name: str = "residual") -> DataFrame:
        """Squared reconstruction residual of each standardised feature."""

        def of(x: np.ndarray) -> np.ndarray:
            z = (x - self.mean) / self.scale
            return (z - z @ self.components.T @ self.components) ** 2

        return mapped(df, of, column, name, VECTOR)


@dataclass
class Mahalanobis:
    """Distance from the mean under the sample covariance (plus 1e-8 on the diagonal)."""

    mean: np.ndarray
    inverse: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, column: str = "reduced") -> Mahalanobis:
        n, mean, gram = moments(df, column)
        return cls(mean, np.linalg.inv(gram / max(n - 1, 1) + 1e-8 * np.eye(len(mean))))

    def apply(self, x: np.ndarray) -> np.ndarray:
        d = x - self.mean
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, self.inverse, d, optimize=True), 0))

    def score(self, df: DataFrame, column: str = "reduced", name: str = "score") -> DataFrame:
        return mapped(df, self.apply, column, name, T.DoubleType())

    def calibrate(self, scored: DataFrame, percentile: float, track: str = "default", column: str = "score") -> float:
        from driftmark.operators.aggregate import percentile_threshold

        self.thresholds[track] = percentile_threshold(scored, percentile, column)
        return self.thresholds[track]

    def threshold(self, track: str = "default") -> float:
        if track not in self.thresholds:
            raise ValueError(f"track {track!r} has not been calibrated")
        return self.thresholds[track]

    def is_ood(self, scored: DataFrame, track: str = "default") -> DataFrame:
        from driftmark.schema import flagged

        return scored.withColumn("ood", flagged(F.col("score"), self.threshold(track)))


@dataclass
class PerAtom:
    """One Mahalanobis model for each atom index; a frame scores its worst atom."""

    atoms: dict[int, Mahalanobis]
    value: float | None = None

    @classmethod
    def fit(cls, df: DataFrame, column: str = "features") -> PerAtom:
        """All atoms in two passes of partial sums in Arrow batches, never an atom's rows together."""
        x = df.select(F.col("atom").cast("long").alias("atom"), F.col(column).cast("array<double>").alias("x"))

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                m, atoms = matrix(batch.column(1)), np.asarray(batch.column(0))
                for a in np.unique(atoms).tolist():
                    d = m[atoms == a]
                    n, t = held.get(a, (0, 0.0))
                    held[a] = (n + len(d), t + d.sum(0))
            for a, (n, t) in held.items():
                yield pa.RecordBatch.from_pydict({"atom": pa.array([a], pa.int64()), "n": [n], "total": [t.tolist()]})

        # one row a task and atom, of one fixed size
        sums: dict[int, tuple] = {}
        for r in x.mapInArrow(totals, "atom long, n long, total array<double>").select("atom", "n", F.posexplode("total").alias("k", "v")).groupBy("atom", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            sums.setdefault(r.atom, {})[r.k] = r.v / r.n
        centre = {a: [m[k] for k in sorted(m)] for a, m in sums.items()}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                m, atoms = matrix(batch.column(1)), np.asarray(batch.column(0))
                for a in np.unique(atoms).tolist():
                    d = m[atoms == a] - np.asarray(centre[a])
                    n, g = held.get(a, (0, 0.0))
                    held[a] = (n + len(d), g + d.T @ d)
            for a, (n, g) in held.items():
                yield pa.RecordBatch.from_pydict({"atom": pa.array([a], pa.int64()), "n": [n], "gram": [g.ravel().tolist()]})

        parts = x.mapInArrow(partial, "atom long, n long, gram array<double>")
        sums = parts.select("atom", "n", F.posexplode("gram").alias("k", "v")).groupBy("atom", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).groupBy("atom").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "v"))).alias("g"))
        out = {}
        for r in sums.collect():
            d = len(centre[r.atom])
            gram = np.array([e.v for e in r.g]).reshape(d, d)
            out[r.atom] = Mahalanobis(np.array(centre[r.atom]), np.linalg.inv(gram / max(r.n - 1, 1) + 1e-8 * np.eye(d)))
        return cls(out)

    def score_atoms(self, df: DataFrame, column: str = "features") -> DataFrame:
        models = self.atoms
        rows = df.select(*[c for c in df.columns if c != column], F.col("atom").cast("long").alias("__a"), F.col(column).cast("array<double>").alias("__x"))
        keep = [f for f in rows.schema.fields if not f.name.startswith("__")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                atoms, x = np.asarray(batch.column(batch.num_columns - 2)), matrix(batch.column(batch.num_columns - 1))
                s = np.full(len(atoms), np.nan)
                for a in np.unique(atoms).tolist():
                    if a in models:
                        s[atoms == a] = models[a].apply(x[atoms == a])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(s)], names=[*batch.schema.names[:-2], "score"])

        return rows.mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType())]))

    def score(self, df: DataFrame, column: str = "features") -> DataFrame:
        """(run, bead, step, score): the largest over atoms."""
        return self.score_atoms(df, column).groupBy("run", "bead", "step").agg(F.max("score").alias("score"))

    def calibrate(self, df: DataFrame, percentile: float) -> float:
        from driftmark.operators.aggregate import percentile_threshold

        self.value = percentile_threshold(self.score(df), percentile)
        return self.value


def save(path: str | Path, **models) -> None:
    """Models as one JSON file; never pickles."""
    def plain(x):
        if isinstance(x, np.ndarray):
            return {"array": x.tolist()}
        if isinstance(x, (ScalerPCA, Mahalanobis, PerAtom)):
            return {"kind": type(x).__name__, "fields": {k: plain(v) for k, v in vars(x).items()}}
        if isinstance(x, dict):
            return {"map": [[k, plain(v)] for k, v in x.items()]}
        return x

    Path(path).write_text(json.dumps({k: plain(v) for k, v in models.items()}))


def load(path: str | Path) -> dict:
    kinds = {c.__name__: c for c in (ScalerPCA, Mahalanobis, PerAtom)}

    def back(x):
        if isinstance(x, dict):
            if "array" in x:
                return np.array(x["array"])
            if "map" in x:
                return {k: back(v) for k, v in x["map"]}
            return kinds[x["kind"]](**{k: back(v) for k, v in x["fields"].items()})
        return x

    return {k: back(v) for k, v in json.loads(Path(path).read_text()).items()}
