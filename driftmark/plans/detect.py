"""The detection job: fit on train frames, calibrate on valid frames, score all runs in one plan."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark import __version__
from driftmark.functions import geometry as G
from driftmark.operators import aggregate, chemistry, false_alarm, models, onset, topology
from driftmark.schema import MoleculeSpec
from driftmark.sources import embeddings, xyz


log = logging.getLogger(__name__)


@dataclass
class Fitted:
    topo: topology.Topology
    pca: models.ScalerPCA
    scorer: models.Mahalanobis
    bead_percentile: float
    centroid_percentile: float
    n_train: int

    def score(self, frames: DataFrame) -> DataFrame:
        """Scores of frames: one map from positions to a number, with nothing wide in between."""
        keep = [c for c in frames.columns if c in ("run", "track", "bead", "frame", "step", "setting")]
        rows = frames.select(*keep, "positions")

        def run(batches):
            for batch in batches:
                p = G.points(batch.column(batch.num_columns - 1))
                value = pa.array(self.score_array(p)) if len(p) else pa.array([], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], value], names=[*batch.schema.names[:-1], "score"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))

    def score_features(self, described: DataFrame) -> DataFrame:
        """The same from descriptors that are there already."""
        scored = models.mapped(described, lambda x: self.scorer.apply(self.pca.apply(x)), "features", "score", T.DoubleType())
        return scored.drop("features")

    def score_array(self, p: np.ndarray) -> np.ndarray:
        return self.scorer.apply(self.pca.apply(G.descriptors(p, self.topo)))


def read_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def fit(spark: SparkSession, config: dict, initial: str | None = None) -> Fitted:
    """Topology from the first run, models from train, thresholds from valid; test is never read."""
    chem, ref = config["chemistry"], config["reference"]
    first = initial or config["runs"][0]["initial_xyz"]
    topo = topology.build(*xyz.first_frame(first), nl_mult=chem["nl_mult"], ring_atoms=chem.get("ring_atoms"))
    spec = MoleculeSpec(topo.n_atoms, tuple(topo.atom_types))
    for run in config.get("runs", []):
        other = xyz.first_frame(run["initial_xyz"])[0]
        if tuple(other) != spec.atom_types:
            raise ValueError(f"run {run['name']} holds another molecule than the first run")
    read = lambda p: spec.checked(xyz.read_extxyz(spark, p, positions_only="true"))
    train = G.with_descriptors(read(ref["train"]), topo).persist()
    pca = models.ScalerPCA.fit(train, config["descriptor"]["pca_variance"])
    scorer = models.Mahalanobis.fit(pca.transform(train))
    n = train.count()
    train.unpersist()
    fitted = Fitted(topo, pca, scorer, *aggregate.track_percentiles(config["threshold"]), n)
    valid = fitted.score(read(ref["valid"])).persist()
    scorer.calibrate(valid, fitted.bead_percentile, "bead")
    scorer.calibrate(valid, fitted.centroid_percentile, "centroid")
    valid.unpersist()
    return fitted


def frames_of(spark: SparkSession, run: dict) -> tuple[DataFrame, DataFrame]:
    """(beads, centroid) of a run: i-PI files, or Parquet frames under ``frames``."""
    if "frames" in run:
        both = spark.read.parquet(run["frames"]).where(F.col("run") == run["name"])
        return both.where("track = 'bead'"), both.where("track = 'centroid'")
    if "hdf5" in run:
        both = xyz.import_hdf5(spark, run["hdf5"], run["name"])
        return both.where("track = 'bead'"), both.where("track = 'centroid'")
    read = lambda p, track: xyz.read_ipi(spark, p, run=run["name"], track=track, stride=run.get("stride", 50))
    return read(run["bead_glob"], "bead"), read(run["centroid_xyz"], "centroid")


def cache_key(config: dict, fitted: Fitted, runs: list[dict]) -> str:
    """Scores are reused only for the same inputs (name, size, time), topology and model."""
    files = []
    for run in runs:
        for key in ("bead_glob", "centroid_xyz"):
            if key in run:
                files += [(p, Path(p).stat().st_size, Path(p).stat().st_mtime) for p in xyz.matches(run[key])]
    said = json.dumps([files, runs, fitted.topo.bonds, fitted.topo.ring, fitted.pca.components.tolist(), fitted.scorer.mean.tolist()], default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def features_of(spark: SparkSession, config: dict, fitted: Fitted, frames: DataFrame, out: Path, run: str) -> DataFrame:
    """Descriptors kept as Parquet for the same inputs and topology, whatever the models."""
    track = frames.first()
    files = [(str(k), Path(p).stat().st_size, Path(p).stat().st_mtime) for r in config["runs"] if r["name"] == run for k in ("bead_glob", "centroid_xyz") if k in r for p in xyz.matches(r[k])]
    said = json.dumps([files, run, track.track if track else "", fitted.topo.atom_types, fitted.topo.bonds, fitted.topo.ring], default=str)
    path = out / f"descriptors-{hashlib.sha256(said.encode()).hexdigest()[:16]}"
    if config.get("io", {}).get("force_recompute") or not (path / "_SUCCESS").exists():
        G.with_descriptors(frames, fitted.topo).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def scores_path(config: dict, fitted: Fitted, out: Path) -> Path:
    return out / f"scores-{cache_key(config, fitted, config['runs'])}"


def scores_of(spark: SparkSession, config: dict, fitted: Fitted, out: Path) -> DataFrame:
    """Scores of all runs, tracks and beads, kept as Parquet partitioned by run and track."""
    path = scores_path(config, fitted, out)
    if config.get("io", {}).get("force_recompute") or not (path / "_SUCCESS").exists():
        parts = None
        spec = MoleculeSpec(fitted.topo.n_atoms, tuple(fitted.topo.atom_types))
        for run in config["runs"]:
            for track in frames_of(spark, run):
                checked = spec.checked(track, elements=False)
                one = fitted.score_features(features_of(spark, config, fitted, checked, out, run["name"])) if config.get("io", {}).get("cache_descriptors") else fitted.score(checked)
                parts = one if parts is None else parts.unionByName(one)
        parts.write.mode("overwrite").partitionBy("run", "track").parquet(str(path))
    return spark.read.parquet(str(path))


def tables(scores: DataFrame, fitted: Fitted, timestep_fs: float, stride: int) -> tuple[DataFrame, DataFrame]:
    """(trimmed bead scores, aggregate with centroid)."""
    beads = scores.where("track = 'bead'")
    aggregate.check_alignment(beads)
    used = aggregate.trim_common(beads)
    steps = aggregate.per_step(used, fitted.scorer.threshold("bead"), timestep_fs, stride)
    return used, aggregate.with_centroid(steps, scores.where("track = 'centroid'"), fitted.scorer.threshold("centroid"))


def run(spark: SparkSession, config: dict) -> DataFrame:
    """All runs of a config: tables, manifests and models under io.output_dir; returns one onset row a run."""
    out = Path(config["io"]["output_dir"])
    out.mkdir(parents=True, exist_ok=True)
    fitted = fit(spark, config)
    models.save(out / "models.json", pca=fitted.pca, scorer=fitted.scorer)
    scores = scores_of(spark, config, fitted, out)
    rule, rows = config["onset"], None
    for r in config["runs"]:
        folder = out / r["name"]
        folder.mkdir(exist_ok=True)
        used, steps = tables(scores.where(F.col("run") == r["name"]), fitted, r["timestep_fs"], r.get("stride", 50))
        if "embedding" in r:
            steps = with_embedding_track(spark, steps, r, config)
        steps = steps.persist()
        rho = aggregate.lag1_autocorrelation(aggregate.stable_segment(steps, rule.get("stable_fraction", 0.1))).first()
        fraction, design = false_alarm.two_track_rule(rule, fitted.bead_percentile, fitted.centroid_percentile, steps.count(), rho.rho if rho else 0.0)
        found = onset.detect(steps, rule["window_frames"], rule["step_frames"], fraction)
        found = found.join(aggregate.first_flag(used, fitted.scorer.threshold("bead")).select("run", "first_anomaly_bead_idx"), "run", "left")
        found = spark.createDataFrame(found.collect(), found.schema)  # one row
        steps.orderBy("frame").coalesce(1).write.mode("overwrite").option("header", True).csv(str(folder / "frame_aggregate.csv"))
        steps.write.mode("overwrite").parquet(str(folder / "frame_aggregate"))
        found.coalesce(1).write.mode("overwrite").option("header", True).csv(str(folder / "onset_table.csv"))
        beads, _ = frames_of(spark, r)
        chem = config["chemistry"]
        if not chem.get("all_beads"):
            beads = beads.where("bead = 0")
        flags = chemistry.flag_rows(chemistry.with_flags(beads, fitted.topo, chem["bond_break_cutoff"], chem["close_contact_cutoff"])).withColumnRenamed("planarity", chemistry.PLANARITY)
        flags.orderBy("bead", "frame").coalesce(1).write.mode("overwrite").option("header", True).csv(str(folder / "chemistry_flags_bead00.csv"))
        report = alignment(scores.where(F.col("run") == r["name"]))
        manifest = {
            "version": __version__, "config": config, "run": r["name"], "ood_threshold": fitted.scorer.threshold("bead"), "bead_ood_threshold": fitted.scorer.threshold("bead"), "centroid_ood_threshold": fitted.scorer.threshold("centroid"),
            "bead_percentile": fitted.bead_percentile, "centroid_percentile": fitted.centroid_percentile, "pca_n_components": fitted.pca.n_components,
            "scores": str(scores_path(config, fitted, out)), "pca_variance_explained": float(fitted.pca.ratio.sum()), "n_features": fitted.topo.n_features, "n_train": fitted.n_train,
            "molecule": {"n_atoms": fitted.topo.n_atoms, "atom_types": fitted.topo.atom_types, "ring_atoms": fitted.topo.ring, "initial_xyz": str(config["runs"][0]["initial_xyz"])},
            "onset_design": design, "frame_alignment": report, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"),
        }
        (folder / "manifest.json").write_text(json.dumps(manifest, indent=2, default=str))
        row = found.first()
        marks = [row[c] for c in ("persistent_bead_anomaly_frame", "centroid_anomaly_frame") if row and row[c] is not None]
        plot(steps, folder, fitted.scorer.threshold("bead"), fitted.scorer.threshold("centroid"), fraction, marks)
        steps.unpersist()
        rows = found if rows is None else rows.unionByName(found)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(str(out / "onset_summary.csv"))
    return rows


def alignment(scores: DataFrame) -> dict:
    """How many frames a run's results rest on, and how many its files hold."""
    report = aggregate.frame_report(scores.where("track = 'bead'")).drop("run", "n_beads").first().asDict()
    report["centroid_frame_count"] = scores.where("track = 'centroid'").count()
    if report["truncated_to_common_range"]:
        log.warning("bead frame counts differ: %s; the first %d frames are used", report["frame_counts"], report["n_frames_used"])
    if report["centroid_frame_count"] != report["n_frames_used"]:
        n = min(report["centroid_frame_count"], report["n_frames_used"])
        log.warning("beads have %d frames, the centroid %d; the first %d are used", report["n_frames_used"], report["centroid_frame_count"], n)
        report |= {"n_frames_used": n, "truncated_to_common_range": True}
    return report


def with_embedding_track(spark: SparkSession, steps: DataFrame, run: dict, config: dict) -> DataFrame:
    """Per-atom models on the train embeddings, calibrated on valid, joined by step."""
    emb = config["embedding"]
    model = models.PerAtom.fit(embeddings.read(spark, emb["train"]))
    value = model.calibrate(embeddings.read(spark, emb["valid"]), emb.get("percentile", config["threshold"].get("percentile")))
    scored = model.score(embeddings.read(spark, run["embedding"]).withColumn("run", F.lit(run["name"])))
    scored = scored.withColumn("frame", F.col("step"))
    return aggregate.with_embedding(steps, scored.where("bead is not null"), scored.where("bead is null"), value)


PLOT_POINTS = 2000


def thin(steps: DataFrame):
    """(rows for a picture, how many frames each stands for): the largest values of each stretch of frames."""
    last = steps.agg(F.max("frame")).first()[0] or 0
    each = max(1, -(-(last + 1) // PLOT_POINTS))
    names = ("bead_max", "bead_frac_ood", "centroid_score")
    rows = steps.groupBy(F.floor(F.col("frame") / each).alias("part")).agg(F.min("frame").alias("frame"), F.min("time_ps").alias("time_ps"), *[F.max(n).alias(n) for n in names])
    return rows.orderBy("part").toPandas(), each


def plot(steps: DataFrame, folder: Path, threshold: float = 0.0, centroid_threshold: float = 0.0, fraction: float = 0.0, onsets: list[int] = []) -> bool:  # noqa: B006
    """Six panels, where matplotlib is there; a failure harms nothing.

    A long run is thinned to ``PLOT_POINTS`` stretches of time; each shows its largest
    values, and the figure says so.
    """
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt

        rows, thinned = thin(steps)
        fig, axes = plt.subplots(3, 2, sharex="col", figsize=(11, 8))
        for (left, right), (name, level) in zip(axes, (("bead_max", threshold), ("bead_frac_ood", fraction), ("centroid_score", centroid_threshold)), strict=True):
            left.plot(rows.time_ps, rows[name])
            left.set_ylabel(name)
            left.axhline(level, linestyle="--")
            for frame in onsets:
                left.axvline(float(rows.time_ps[(rows.frame - frame).abs().idxmin()]), linestyle=":")
            right.hist(rows[name], bins=50)
            right.axvline(level, linestyle="--")
        fig.suptitle(f"largest of each {thinned} frames" if thinned > 1 else "every frame")
        fig.savefig(folder / "onset.png")
        plt.close(fig)
    except Exception:  # noqa: BLE001
        return False
    return True
