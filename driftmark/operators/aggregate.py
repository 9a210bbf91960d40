"""Scores over replicas: alignment, per-step aggregates, thresholds and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators import ranks
from driftmark.schema import flagged, time_ps


def percentile_threshold(scores: DataFrame, percentile: float, column: str = "score") -> float:
    """The interpolated percentile of in-distribution scores."""
    (value,) = ranks.percentiles(scores, column, [percentile / 100.0])
    if value is None:
        raise ValueError("no scores to calibrate on")
    return value


def track_percentiles(config: dict) -> tuple[float, float]:
    """(bead, centroid) percentiles; each falls back to the common one."""
    common = config.get("percentile")
    found = tuple(config.get(f"{track}_percentile", common) for track in ("bead", "centroid"))
    if None in found:
        raise KeyError("threshold needs 'percentile', or one for each track")
    return found


def misaligned(scores: DataFrame) -> DataFrame:
    """(run, frame, n_steps, bead) where beads disagree on a frame's step; the bead is that of the earliest."""
    steps = scores.groupBy("run", "frame").agg(F.min("step").alias("low"), F.max("step").alias("high"), F.count_distinct("step").alias("n_steps"), F.min_by("bead", "step").alias("bead"))
    return steps.where("low < high").select("run", "frame", "n_steps", "bead")


def check_alignment(scores: DataFrame) -> None:
    """Beads must agree on the step of each frame they share."""
    bad = misaligned(trim_common(scores)).orderBy("run", "frame").first()
    if bad:
        raise ValueError(f"run {bad.run}: steps differ at frame {bad.frame} (bead {bad.bead})")


def frame_report(scores: DataFrame) -> DataFrame:
    """Per run: frames used, those of each bead in order, frames that the longest bead loses, whether any does."""
    counts = scores.groupBy("run", "bead").agg(F.count("*").alias("n"))
    return counts.groupBy("run").agg(
        F.min("n").alias("n_frames_used"),
        F.max("n").alias("n_frames_most"),
        F.count("*").alias("n_beads"),
        F.transform(F.array_sort(F.collect_list(F.struct("bead", "n"))), lambda x: x["n"]).alias("frame_counts"),
    ).select("run", "n_beads", "n_frames_used", "frame_counts", (F.col("n_frames_used") < F.col("n_frames_most")).alias("truncated_to_common_range"), (F.col("n_frames_most") - F.col("n_frames_used")).alias("n_frames_dropped"))


def trim_common(scores: DataFrame) -> DataFrame:
    """Frames below the smallest frame count of the run's beads. The counts are one row a run."""
    least = scores.groupBy("run", "bead").agg(F.count("*").alias("n")).groupBy("run").agg(F.min("n").alias("n_used"))
    return scores.join(least, "run").where(F.col("frame") < F.col("n_used")).drop("n_used")


def per_step(scores: DataFrame, threshold: float, timestep_fs: float = 1.0, stride: int = 1) -> DataFrame:
    """Over beads: the largest score, the 95th percentile and the part above the threshold; never the mean."""
    flag = flagged(F.col("score"), threshold)
    return (
        scores.groupBy("run", "frame")
        .agg(F.min("step").alias("step"), F.max("score").alias("bead_max"), F.percentile("score", F.lit(0.95)).alias("bead_p95"), F.sum(flag.cast("long")).alias("n_flagged"), F.count("*").alias("n_beads"))
        .withColumn("bead_frac_ood", F.col("n_flagged") / F.col("n_beads"))
        .withColumn("time_ps", time_ps(F.col("step"), timestep_fs, stride))
    )


def with_centroid(steps: DataFrame, centroid: DataFrame, threshold: float) -> DataFrame:
    """Add the centroid's score and flag; frames beyond the shorter of the two tracks go."""
    c = centroid.select("run", "frame", F.col("score").alias("centroid_score"))
    return steps.join(c, ["run", "frame"]).withColumn("centroid_ood", flagged(F.col("centroid_score"), threshold))


def with_embedding(steps: DataFrame, beads: DataFrame, centroid: DataFrame, threshold: float) -> DataFrame:
    """Left join of the embedding track by step; steps it did not score stay null."""
    b = per_step(beads, threshold).select("run", "step", F.col("bead_max").alias("emb_bead_max"), F.col("bead_p95").alias("emb_bead_p95"), F.col("bead_frac_ood").alias("emb_bead_frac_ood"), F.col("n_flagged").alias("emb_n_flagged"), F.col("n_beads").alias("emb_n_beads"))
    c = centroid.select("run", "step", F.col("score").alias("emb_centroid_score"), flagged(F.col("score"), threshold).cast("double").alias("emb_centroid_ood"))
    twice = b.groupBy("run", "step").count().where("count > 1").first()
    if twice:
        raise ValueError(f"run {twice.run}: step {twice.step} has two embedding rows")
    return steps.join(b, ["run", "step"], "left").join(c, ["run", "step"], "left")


def summary(scores: DataFrame, threshold: float) -> DataFrame:
    """One row over all beads and frames."""
    s = F.col("score")
    mean, most, flags = scores.agg(F.avg(s), F.max(s), F.avg(flagged(s, threshold).cast("double"))).first()
    row = (mean, *ranks.percentiles(scores, "score", [0.5, 0.95, 0.99]), most, flags)
    return scores.sparkSession.createDataFrame([row], "mean double, median double, p95 double, p99 double, max double, frac_ood double")


def first_flag(scores: DataFrame, threshold: float) -> DataFrame:
    """Per run the first flagged frame and its bead; ties go to the lowest bead."""
    return scores.where(flagged(F.col("score"), threshold)).groupBy("run").agg(F.min(F.struct("frame", "bead", "step")).alias("f")).select("run", F.col("f.frame").alias("first_frame"), F.col("f.step").alias("first_step"), F.col("f.bead").alias("first_anomaly_bead_idx"))


def stable_segment(steps: DataFrame, fraction: float = 0.1, least: int = 3) -> DataFrame:
    """The first ``max(3, int(n * fraction))`` frames of each run."""
    n0 = steps.groupBy("run").agg(F.greatest(F.lit(least), F.floor(F.count("*") * F.lit(float(fraction)))).alias("n0"))
    return steps.join(n0, "run").where(F.col("frame") < F.col("n0")).drop("n0")


#: Frames of a run that one task walks through.
STRETCH = 1 << 16


def lag1_autocorrelation(steps: DataFrame, column: str = "centroid_score") -> DataFrame:
    """Per run the lag-1 autocorrelation of the finite values, cut to [0, 0.99]; 0 below three values."""
    x = F.col(column)
    fine = steps.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    mean = fine.groupBy("run").agg(F.avg(x).alias("mean"))
    d = fine.select("run", "frame", x.alias("x")).join(mean, "run").select("run", "frame", (F.col("x") - F.col("mean")).alias("d"), F.floor(F.col("frame") / STRETCH).alias("stretch"))
    d = d.withColumn("after", F.lead("d").over(Window.partitionBy("run", "stretch").orderBy("frame")))
    # a long run falls into stretches, whose ends meet in a table of one row each
    ends = d.groupBy("run", "stretch").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("after")).alias("p"), F.sum(F.col("d") * F.col("d")).alias("s"), F.min_by("d", "frame").alias("first"), F.max_by("d", "frame").alias("last"))
    ends = ends.withColumn("next", F.lead("first").over(Window.partitionBy("run").orderBy("stretch")))
    n = F.sum("n")
    products = F.coalesce(F.sum("p"), F.lit(0.0)) + F.coalesce(F.sum(F.col("last") * F.col("next")), F.lit(0.0))
    out = ends.groupBy("run").agg(n.alias("n"), F.when(n > 1, F.try_divide(products / (n - 1), F.sum("s") / n)).alias("raw"))
    return out.select("run", F.when((F.col("n") < 3) | F.col("raw").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("raw")))).alias("rho"))
