"""Studies around the detector: the distortion benchmark, score against error, frame extraction and selection."""

from __future__ import annotations

import json
import warnings
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import geometry as G
from driftmark.operators import aggregate, chemistry, evaluation, onset, perturb, ranks, select
from driftmark.plans import detect
from driftmark.schema import flagged
from driftmark.sources import xyz

RATTLES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
STRETCHES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
TORSION_BINS = 12


def benchmark(spark: SparkSession, config: dict, alpha: float | None = None, split: float = 0.5, seed: int = 42, least_fragment: int = 3) -> tuple[DataFrame, dict]:
    """Detection by kind and size of distortion: all settings are made and scored in one pass."""
    fitted = detect.fit(spark, config)
    alpha = 1 - config["threshold"]["percentile"] / 100 if alpha is None else alpha
    if fitted.n_train < 10 * fitted.pca.n_components:
        warnings.warn(f"{fitted.n_train} train frames for {fitted.pca.n_components} components: the covariance is ill-conditioned", stacklevel=2)
    held = xyz.read_extxyz(spark, config["reference"]["valid"])
    calibration, rest = select.strided_split(held, split)
    normal = fitted.score(calibration).select("score").persist()
    threshold = evaluation.conformal_threshold(normal, alpha)
    train = xyz.read_extxyz(spark, config["reference"]["train"])
    quad, coverage = perturb.gap_rich_dihedral(train, fitted.topo, TORSION_BINS, least_fragment)
    slices = coverage.orderBy("bin").collect()
    settings = [("rattle", s) for s in RATTLES] + [("stretch", d) for d in STRETCHES] + [("torsion_scan", r.angle_centre, quad) for r in slices]
    made = perturb.distorted(rest, fitted.topo, settings, seed).persist()
    scored = fitted.score(made).select("setting", "frame", "score").persist()
    chem = config["chemistry"]
    flags = chemistry.with_flags(made.withColumn("step", F.col("setting")), fitted.topo, chem["bond_break_cutoff"], chem["close_contact_cutoff"])
    rates = flags.groupBy(F.col("step").alias("setting")).agg(F.avg(((F.size("broken") > 0) | (F.size("close") > 0)).cast("double")).alias("chemistry_flag_rate"))
    out = separations(normal, scored, threshold).join(rates, "setting")
    units = {"rattle": "sigma_A", "stretch": "delta_A", "torsion_scan": "target_angle_deg"}
    named = spark.createDataFrame([(i, s[0], float(s[1]), units[s[0]], slices[i - 12].train_count if s[0] == "torsion_scan" else None) for i, s in enumerate(settings)], "setting int, distortion string, magnitude double, magnitude_unit string, train_count_at_target long")
    table = named.join(out, "setting").withColumn("target_visited_in_training", F.col("train_count_at_target") > 0).persist()
    dense = max(1, int(0.01 * fitted.n_train))
    scan = table.where("distortion = 'torsion_scan'")
    ends = slice_rates(scan, dense).first()
    rho = evaluation.correlation(scan.withColumn("n", F.col("train_count_at_target").cast("double")), "n", "detection_rate")["spearman"]
    label = "-".join(f"{fitted.topo.atom_types[a]}{a}" for a in quad)
    summary = {"false_flag_rate": alpha, "threshold": threshold, "n_train": fitted.n_train, "pca_n_components": fitted.pca.n_components, "n_features": fitted.topo.n_features, "seed": seed, "torsion": list(quad), "torsion_label": label, "dense_slice_min_train_count": dense, "detection_rate_unvisited_slices": ends.unvisited, "detection_rate_dense_slices": ends.dense, "spearman_train_count_vs_detection_rate": rho}
    return table, summary


def separations(normal: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Per setting: AUROC, average precision, detection rate and medians against one set of normal scores."""
    # each distinct normal score stands once for every setting; there are as many settings as the caller made
    numbers = sorted(r.setting for r in scored.select("setting").distinct().collect())
    zero = normal.groupBy("score").agg(F.count("*").alias("neg")).withColumn("setting", F.explode(F.array(*map(F.lit, numbers))))
    counts = scored.groupBy("setting", "score").agg(F.count("*").alias("pos"))
    both = counts.select("setting", "score", "pos", F.lit(0).alias("neg")).unionByName(zero.select("setting", "score", F.lit(0).cast("long").alias("pos"), "neg")).groupBy("setting", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    from pyspark.sql import Window

    w = Window.partitionBy("setting").orderBy(F.desc("score"))
    run = both.select("setting", "score", "pos", "neg", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    wins = F.sum(F.col("pos") * (F.lit(0.5) * F.col("neg")) + F.col("neg") * (F.col("tp") - F.col("pos")))
    found = run.groupBy("setting").agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auroc"), (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"), F.sum("neg").alias("n_negatives"), F.sum("pos").alias("n_positives"))
    half = F.lit(0.5)
    rates = scored.groupBy("setting").agg(F.avg(flagged(F.col("score"), threshold).cast("double")).alias("detection_rate"), F.percentile("score", half).alias("median_score_distorted"))
    (middle,) = ranks.percentiles(normal, "score", [0.5])
    return found.join(rates, "setting").withColumn("median_score_normal", F.lit(middle))


def slice_rates(scan: DataFrame, dense: int) -> DataFrame:
    """One row: mean detection rate of the slices that training never visited, and of those with at least ``dense`` frames."""
    n, rate = F.col("train_count_at_target"), F.col("detection_rate")
    return scan.agg(F.avg(F.when(n == 0, rate)).alias("unvisited"), F.avg(F.when(n >= dense, rate)).alias("dense"))


def rate_pivot(table: DataFrame) -> DataFrame:
    """Detection rate by size (rows) and kind (columns)."""
    return table.groupBy("magnitude").pivot("distortion", ["rattle", "stretch", "torsion_scan"]).agg(F.avg("detection_rate"))


def sample_by_score(spark: SparkSession, config: dict, trajectory: str, n_bins: int = 10, n_per_bin: int = 20, scan_stride: int = 10, scheme: str = "quantile", tail_from: float = 0.9, seed: int = 42, initial: str | None = None, reuse: str | None = None, index_dir: str | None = None) -> DataFrame:
    """Frames drawn equally from bins of the score: (frame, step, score, bin), by frame."""
    if reuse and Path(reuse).exists():
        scored = spark.read.parquet(reuse)
    else:
        fitted = detect.fit(spark, config, initial)
        scored = fitted.score(xyz.read_ipi(spark, trajectory, index_dir=index_dir, columns="positions", frame_stride=scan_stride)).persist()
        if reuse:
            scored.write.parquet(reuse)
    edges = evaluation.bin_edges(scored, n_bins, scheme, tail_from)
    drawn = select.stratified(scored.withColumn("bin", evaluation.digitise(F.col("score"), edges)), n_per_bin, seed)
    by_bin = {r.bin: r.n for r in drawn.groupBy("bin").agg(F.count("*").alias("n"), F.min("score"), F.max("score")).collect()}
    for b in range(n_bins):
        if by_bin.get(b, 0) < n_per_bin:
            warnings.warn(f"bin {b} gives {by_bin.get(b, 0)} of {n_per_bin} frames", stacklevel=2)
    return drawn.select("frame", "step", "score", "bin").orderBy("frame")


def write_sample(
    spark: SparkSession, config: dict, trajectory: str, out: Path, n_bins: int = 10, n_per_bin: int = 30, scan_stride: int = 10, scheme: str = "quantile", tail_from: float = 0.99, seed: int = 0,
    initial: str | None = None, predicted: str | None = None, predicted_unit: str = "hartree_bohr", reuse: str | None = None, index_dir: str | None = None,
) -> dict:
    """Sampled geometries with their index and, if there are any, the forces that a model gave them.

    At most ``n_bins * n_per_bin`` frames, so the files are written by the driver.
    """
    drawn = sample_by_score(spark, config, trajectory, n_bins, n_per_bin, scan_stride, scheme, tail_from, seed, initial, reuse, index_dir).persist()
    rows = drawn.collect()
    ids = [r.frame for r in rows]
    symbols = xyz.first_frame(initial or config["runs"][0]["initial_xyz"])[0]
    frames = {r.frame: r for r in xyz.select_frames(xyz.read_ipi(spark, trajectory, index_dir=index_dir, columns="positions"), ids).collect()}
    said = lambda r: {"frame": r.frame, "step": r.step, "ood_score": f"{r.score:.6f}", "score_bin": r.bin}
    (out / "sample_geometries.extxyz").write_text("".join(xyz.format_frame({"symbols": symbols, "positions": frames[r.frame].positions, "info": said(r)}) for r in rows))
    lines = [f"{i},{r.frame},{r.step},{r.score!r},{r.bin}" for i, r in enumerate(rows)]
    (out / "sample_index.csv").write_text("\n".join(["sample_index,frame,step,ood_score,score_bin", *lines]) + "\n")
    report = {"bins": [r.asDict() for r in evaluation.bin_report(drawn).orderBy("bin").collect()]}
    if predicted:
        forces = xyz.select_frames(xyz.read_ipi(spark, predicted, index_dir=index_dir, columns="positions"), ids)
        if predicted_unit == "hartree_bohr":
            forces = forces.withColumn("positions", G.scaled(F.col("positions"), G.HARTREE_BOHR_EXACT))
        found = {r.frame: r for r in forces.collect()}
        wrong = [r.frame for r in rows if r.frame not in found or found[r.frame].step != r.step]
        if wrong:
            raise ValueError(f"step mismatch between {trajectory} and {predicted} at frame {wrong[0]}")
        np.savez(out / "sample_predicted.npz", forces=np.array([found[i].positions for i in ids]), frame=np.array(ids), step=np.array([r.step for r in rows]))
        report["forces"] = evaluation.force_magnitudes(forces, "positions").first().asDict()
    print(json.dumps(report, indent=2))
    return report


def onset_frame(spark: SparkSession, config: dict, run: str, kind: str, threshold: float | None = None) -> int | None:
    """The frame of a run's onset, from its saved table or detected again at another threshold from saved scores."""
    column = {"persistent": "persistent_bead_anomaly_frame", "first": "first_bead_anomaly_frame"}[kind]
    out = Path(config["io"]["output_dir"])
    if threshold is None:
        found = spark.read.option("header", True).csv(str(out / run / "onset_table.csv")).first()
    else:
        manifest = json.loads((out / run / "manifest.json").read_text())
        design = manifest["onset_design"]
        fraction = design.get("fraction_threshold_used", design.get("fraction_threshold"))
        scores = spark.read.parquet(manifest["scores"]).where(F.col("run") == run)
        found = redetect(scores.where("track = 'bead'"), scores.where("track = 'centroid'"), threshold, config["onset"], fraction).first()
    return None if found is None or found[column] is None else int(found[column])


def _figure(draw, path: Path) -> bool:
    """A picture where matplotlib is there; a failure harms nothing."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt

        fig, axes = plt.subplots(1, 3, figsize=(13, 4))
        draw(axes)
        fig.savefig(path)
        plt.close(fig)
    except Exception:  # noqa: BLE001
        return False
    return True


def plot_benchmark(rows, out: Path) -> bool:
    def draw(axes) -> None:
        for ax, (kind, part) in zip(axes, rows.groupby("distortion"), strict=False):
            ax.plot(part.magnitude, part.detection_rate, marker="o")
            ax.set_title(kind)

    return _figure(draw, out / "detection_benchmark.png")


def plot_errors(frames: DataFrame, bins: DataFrame, out: Path) -> bool:
    """Means by bin, and where the frames lie on a grid of score and error."""

    def draw(axes) -> None:
        b = bins.orderBy("bin").toPandas()
        axes[0].plot(b.score_min, b.error_mean, marker="o")
        axes[1].plot(b.bin, b.error_p95, marker="o")
        lo, hi, elo, ehi = frames.agg(F.min("score"), F.max("score"), F.min("error"), F.max("error")).first()
        cell = lambda c, a, z: F.least(F.lit(49), F.floor((F.col(c) - a) / max(z - a, 1e-12) * 50))
        g = frames.groupBy(cell("score", lo, hi).alias("x"), cell("error", elo, ehi).alias("y")).count().toPandas()
        axes[2].scatter(g.x, g.y, s=g["count"])

    return _figure(draw, out / "score_vs_error.png")


def score_against_error(spark: SparkSession, config: dict, reference: DataFrame, predicted: DataFrame, metric: str = "mae", n_bins: int = 10, reference_unit: str = "ev_a", predicted_unit: str = "ev_a", initial: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(frames, bins, summary): reference (frame, positions, forces), predicted (frame, forces)."""
    fitted = detect.fit(spark, config, initial)
    convert = lambda c, unit: G.scaled(c, G.HARTREE_BOHR_EXACT) if unit == "hartree_bohr" else c
    a = reference.select("frame", "positions", convert(F.col("forces"), reference_unit).alias("ref"))
    b = predicted.select("frame", convert(F.col("forces"), predicted_unit).alias("pred"))
    both = a.join(b, "frame").persist()
    if both.count() != a.count() or both.count() != b.count():
        raise ValueError("the two force sets do not hold the same frames")
    errors = both.select("frame", evaluation.force_error(F.col("ref"), F.col("pred"), metric).alias("error"))
    flags = chemistry.flag_rows(chemistry.with_flags(both, fitted.topo, config["chemistry"]["bond_break_cutoff"], config["chemistry"]["close_contact_cutoff"])).select("frame", "broken_bond", "close_contact")
    frames = fitted.score(both.select("frame", "positions")).join(errors, "frame").join(flags, "frame").persist()
    bins = evaluation.error_bins(frames, n_bins).persist()
    summary = evaluation.correlation(frames, "score", "error") | {"metric": metric, "n_frames": frames.count(), "top_over_bottom_decile_error_ratio": evaluation.top_over_bottom(bins), "n_train": fitted.n_train, "pca_n_components": fitted.pca.n_components}
    return frames, bins, summary


def force_path(path: str) -> str:
    """The force file beside a position file: the first pos_ of its name becomes for_."""
    p = Path(path)
    if "pos_" not in p.name:
        raise ValueError(f"{p.name} has no 'pos_'")
    other = p.with_name(p.name.replace("pos_", "for_", 1))
    if not other.exists():
        raise FileNotFoundError(str(other))
    return str(other)


def around(frames: DataFrame, at: int, before: int, after: int) -> DataFrame:
    """Frames at - before to at + after, as far as there are any."""
    return frames.where((F.col("frame") >= max(0, at - before)) & (F.col("frame") <= at + after))


def around_onset(spark: SparkSession, pos: str, forces: str | None, at: int, before: int, after: int, symbols: list[str]) -> DataFrame:
    """Frames at - before to at + after as writer rows, with forces in eV per angstrom."""
    p = xyz.read_ipi(spark, pos)
    near = around(p, at, before, after)
    rows = near.select("frame", F.array(*map(F.lit, symbols)).alias("symbols"), "positions", "step", "bead", G.lattice(G.cell_of(F.col("comment"))).alias("lattice"))
    if forces is None:
        return rows.withColumn("forces", F.lit(None).cast("array<array<double>>")).orderBy("frame")
    f = xyz.read_ipi(spark, forces)
    if f.count() != p.count():
        raise ValueError("positions and forces have different numbers of frames")
    return rows.join(f.select("frame", G.scaled(F.col("positions")).alias("forces")), "frame").orderBy("frame")


def redetect(scores: DataFrame, centroid: DataFrame, threshold: float, rule: dict, fraction: float) -> DataFrame:
    """Onsets of saved scores at another threshold; nothing is scored again."""
    steps = aggregate.with_centroid(aggregate.per_step(scores, threshold), centroid, threshold)
    return onset.detect(steps, rule["window_frames"], rule["step_frames"], fraction)


def write_json(path: str | Path, summary: dict) -> None:
    Path(path).write_text(json.dumps(summary, indent=2, default=str))
