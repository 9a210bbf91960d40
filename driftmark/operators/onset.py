"""Onset: the first full hopping window whose flagged share reaches a fraction.

Windows start at frames 0, s, 2s, ... and count only if all w frames are there.
A run has one row a frame. Window sums are built from sums over blocks of as many
frames as divide both ``w`` and ``s``, one partial aggregation before any sort, so
a window function sees a row a block instead of a row a frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares are compared as sums, with room for the last bit.
EPS = 1e-9
#: Frames of a run that are numbered in one task.
STRETCH = 1 << 16


def window_count(n: Column, window: int, step: int) -> Column:
    """Full windows that a run of ``n`` frames has."""
    return F.when(n < window, F.lit(0).cast("long")).otherwise(F.floor((n - window) / step) + 1)


def window_sums(frames: DataFrame, signals: dict[str, Column], window: int, step: int) -> DataFrame:
    """(run, frame, step, one sum a signal) for each full window, at its first frame."""
    names = list(signals)
    rows = frames.select("run", "frame", "step", *[c.cast("double").alias(n) for n, c in signals.items()])
    per = math.gcd(window, step)
    rows = rows.groupBy("run", F.floor(F.col("frame") / per).alias("block")).agg(F.min("frame").alias("frame"), F.min_by("step", "frame").alias("step"), F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy("run").orderBy("frame").rowsBetween(0, window // per - 1)
    sums = rows.select("run", "frame", "step", F.sum("n").over(w).alias("n"), *[F.sum(n).over(w).alias(n) for n in names])
    return sums.where((F.col("n") == window) & (F.col("frame") % step == 0)).drop("n")


def windowed_onset(frames: DataFrame, signals: dict[str, Column], window: int, step: int, fraction: float) -> DataFrame:
    """Per run: the first window in which every signal's mean reaches ``fraction``; runs without one are absent."""
    fires = F.lit(True)
    for n in signals:
        fires = fires & (F.col(n) >= fraction * window - EPS)
    fired = window_sums(frames, signals, window, step).where(fires)
    return fired.groupBy("run").agg(F.min(F.struct("frame", "step")).alias("f")).select("run", F.col("f.frame").alias("frame"), F.col("f.step").alias("step"))


def sparse_onset(frames: DataFrame, signal: Column, window: int, step: int, fraction: float) -> DataFrame:
    """The same over the rows where ``signal`` is not null, numbered anew; the frame returned is the original."""
    scored = frames.select("run", "frame", "step", signal.cast("double").alias("x"), F.floor(F.col("frame") / STRETCH).alias("stretch")).where("x is not null")
    # numbers within a stretch, and how many rows the stretches before hold
    before = scored.groupBy("run", "stretch").agg(F.count("*").alias("c"))
    before = before.select("run", "stretch", (F.sum("c").over(Window.partitionBy("run").orderBy("stretch")) - F.col("c")).alias("before"))
    place = F.row_number().over(Window.partitionBy("run", "stretch").orderBy("frame")) - 1
    again = scored.withColumn("place", place).join(before, ["run", "stretch"])
    again = again.select("run", (F.col("place") + F.col("before")).cast("long").alias("frame"), F.struct(F.col("frame").alias("at"), "step").alias("step"), "x")
    found = windowed_onset(again, {"x": F.col("x")}, window, step, fraction)
    return found.select("run", F.col("step.at").alias("frame"), F.col("step.step").alias("step"))


def detect(steps: DataFrame, window: int = 500, step: int = 50, fraction: float = 0.2) -> DataFrame:
    """One row a run with the steps and frames of every kind of onset; null where a criterion is never met."""
    bead, centroid = F.col("bead_frac_ood"), F.col("centroid_ood").cast("double")
    named = lambda df, kind: df.select("run", F.col("frame").alias(f"{kind}_frame"), F.col("step").alias(f"{kind}_step"))
    first = steps.where(bead > 0).groupBy("run").agg(F.min(F.struct("frame", "step")).alias("f")).select("run", F.col("f.frame").alias("frame"), F.col("f.step").alias("step"))
    # one pass over the windows serves three kinds
    sums = window_sums(steps, {"b": bead, "c": centroid}, window, step)
    need = fraction * window - EPS
    kinds = {"persistent_bead_anomaly": F.col("b") >= need, "centroid_anomaly": F.col("c") >= need, "collective_anomaly": (F.col("b") >= need) & (F.col("c") >= need)}
    windows = sums.groupBy("run").agg(*[F.min(F.when(c, F.struct("frame", "step"))).alias(k) for k, c in kinds.items()])
    windows = windows.select("run", *[F.col(k)[f].alias(f"{k}_{f}") for k in kinds for f in ("frame", "step")])
    out = steps.select("run").distinct().join(named(first, "first_bead_anomaly"), "run", "left").join(windows, "run", "left")
    tracks = {"embedding_persistent_bead_onset": "emb_bead_frac_ood", "embedding_centroid_onset": "emb_centroid_ood"}
    for kind, column in tracks.items():
        if column in steps.columns:
            out = out.join(named(sparse_onset(steps, F.col(column), window, step, fraction), kind), "run", "left")
        else:
            out = out.withColumns({f"{kind}_frame": F.lit(None).cast("long"), f"{kind}_step": F.lit(None).cast("long")})
    return out
