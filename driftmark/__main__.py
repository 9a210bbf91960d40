"""Command line: python -m driftmark run|benchmark|extract|select|score-error|demo."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

UNITS = ("ev_a", "hartree_bohr")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftmark")
    sub = top.add_subparsers(dest="job", required=True)
    jobs = {n: sub.add_parser(n) for n in ("run", "benchmark", "extract", "select", "score-error", "demo")}
    for n in ("run", "benchmark", "extract", "score-error"):
        jobs[n].add_argument("--config", "-c", required=True, help="YAML file")
    for p in jobs.values():
        p.add_argument("--verbose", "-v", action="store_true")
    jobs["run"].add_argument("--force-recompute", action="store_true", help="score again even where kept scores fit")
    b = jobs["benchmark"]
    b.add_argument("--output-dir", help="default: io.output_dir of the config")
    b.add_argument("--false-flag-rate", type=float)
    b.add_argument("--calibration-split", type=float, default=0.5)
    b.add_argument("--seed", type=int, default=42)
    e = jobs["extract"]
    e.add_argument("--run", help="default: the first")
    e.add_argument("--n-before", type=int, default=100)
    e.add_argument("--n-after", type=int, default=100)
    e.add_argument("--onset-type", default="persistent", choices=["persistent", "first"])
    e.add_argument("--threshold", type=float, help="detect again at this score")
    s = jobs["select"]
    for flag, kind in (("--reference", str), ("--trajectory", str), ("--n-configs", int), ("--output", str)):
        s.add_argument(flag, type=kind, required=True)
    s.add_argument("--radius", type=float, nargs="+", required=True, help="one, or one for each primary dihedral")
    s.add_argument("--pimd", action="store_true", help="the trajectory is in the i-PI layout")
    s.add_argument("--primary-dihedrals", type=int, nargs=4, action="append", default=[], metavar=("I", "J", "K", "L"))
    s.add_argument("--pca-variance", type=float, default=0.95)
    x = jobs["score-error"]
    x.add_argument("--mode", default="analyse", choices=["analyse", "sample"])
    for flag in ("--reference-xyz", "--predicted", "--trajectory", "--predicted-trajectory", "--initial-xyz", "--reuse-scan", "--index-cache-dir", "--output-dir"):
        x.add_argument(flag)
    x.add_argument("--predicted-trajectory-unit", default="hartree_bohr", choices=UNITS)
    x.add_argument("--predicted-force-unit", default="ev_a", choices=UNITS)
    x.add_argument("--reference-force-unit", default="ev_a", choices=UNITS)
    x.add_argument("--scan-stride", type=int, default=10)
    x.add_argument("--n-per-bin", type=int, default=30)
    x.add_argument("--n-bins", type=int, default=10)
    x.add_argument("--seed", type=int, default=0)
    x.add_argument("--bin-scheme", default="quantile", choices=["quantile", "tail-enriched"])
    x.add_argument("--tail-start-quantile", type=float, default=0.99)
    x.add_argument("--metric", default="mae", choices=["mae", "rmse", "max"])
    d = jobs["demo"]
    d.add_argument("--initial", required=True, help="extended XYZ of one geometry")
    d.add_argument("--output-dir", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")

    from pyspark.sql import SparkSession

    from driftmark.plans import detect

    spark = SparkSession.builder.appName("driftmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = detect.read_config(args.config) if "config" in args else {}
    globals()[f"_{args.job.replace('-', '_')}"](spark, args, config)


def _folder(args, config: dict) -> Path:
    out = Path(args.output_dir or config["io"]["output_dir"])
    out.mkdir(parents=True, exist_ok=True)
    return out


def _run(spark, args, config: dict) -> None:
    from driftmark.plans import detect

    config.setdefault("io", {})["force_recompute"] = args.force_recompute or config.get("io", {}).get("force_recompute", False)
    detect.run(spark, config).show(truncate=False)


def _benchmark(spark, args, config: dict) -> None:
    from driftmark.plans import studies

    out = _folder(args, config)
    table, summary = studies.benchmark(spark, config, args.false_flag_rate, args.calibration_split, args.seed)
    rows = table.orderBy("setting").toPandas()  # one row a setting
    rows.to_csv(out / "detection_benchmark.csv", index=False)
    studies.write_json(out / "detection_benchmark.json", summary)
    studies.plot_benchmark(rows, out)
    studies.rate_pivot(table).orderBy("magnitude").show(50)


def _extract(spark, args, config: dict) -> None:
    from driftmark.plans import studies
    from driftmark.sources import xyz

    chosen = next((r for r in config["runs"] if args.run in (None, r["name"])), None)
    if chosen is None:
        raise SystemExit(f"no run {args.run!r} in the config")
    at = studies.onset_frame(spark, config, chosen["name"], args.onset_type, args.threshold)
    if at is None:
        raise SystemExit(f"no {args.onset_type} onset in run {chosen['name']}")
    symbols = xyz.first_frame(chosen["initial_xyz"])[0]
    out = Path(config["io"]["output_dir"]) / chosen["name"] / "onset_frames"
    out.mkdir(parents=True, exist_ok=True)
    for path in xyz.matches(chosen["bead_glob"]):
        rows = studies.around_onset(spark, path, studies.force_path(path), at, args.n_before, args.n_after, symbols)
        (out / f"{Path(path).stem}.extxyz").write_text("".join(xyz.format_frame(r.asDict()) for r in rows.collect()))  # n_before + n_after + 1 frames


def _select(spark, args, config: dict) -> None:
    from driftmark.operators import select, topology
    from driftmark.sources import xyz

    symbols, reference = xyz.first_frame(args.reference)
    topo = topology.build(symbols, reference)
    frames = xyz.read_ipi(spark, args.trajectory) if args.pimd else xyz.read_extxyz(spark, args.trajectory, positions_only="true")
    if args.primary_dihedrals:
        if len(args.radius) not in (1, len(args.primary_dihedrals)):
            raise SystemExit("--radius takes one value, or one for each of --primary-dihedrals")
        chosen = select.select_by_dihedrals(frames, topo, reference, [tuple(d) for d in args.primary_dihedrals], args.radius, args.n_configs)
    else:
        chosen = select.select_by_descriptor(frames, topo, reference, args.radius[0], args.n_configs, args.pca_variance)
    picked = {r.frame: r for r in chosen.collect()}  # n_configs rows
    if not picked:
        raise SystemExit("no frame within the radius")
    by = {r.frame: r for r in xyz.select_frames(frames, list(picked)).collect()}
    text = xyz.format_frame({"symbols": symbols, "positions": reference, "info": {"source": "reference", "descriptor_distance": 0.0}})
    for r in sorted(picked.values(), key=lambda r: r.rank):
        text += xyz.format_frame({"symbols": symbols, "positions": by[r.frame].positions, "info": {"source_frame": r.frame, "source_step": by[r.frame].step, "descriptor_distance": r.distance}})
    Path(args.output).parent.mkdir(parents=True, exist_ok=True)
    Path(args.output).write_text(text)


def _score_error(spark, args, config: dict) -> None:
    from driftmark.plans import studies
    from driftmark.sources import xyz

    out = _folder(args, config)
    if args.mode == "sample":
        if not args.trajectory:
            raise SystemExit("--mode sample needs --trajectory")
        studies.write_sample(
            spark, config, args.trajectory, out, args.n_bins, args.n_per_bin, args.scan_stride, args.bin_scheme, args.tail_start_quantile, args.seed,
            args.initial_xyz or args.trajectory, args.predicted_trajectory, args.predicted_trajectory_unit, args.reuse_scan, args.index_cache_dir,
        )
        return
    if not (args.reference_xyz and args.predicted):
        raise SystemExit("--mode analyse needs --reference-xyz and --predicted")
    predicted = xyz.read_forces_npz(spark, args.predicted) if args.predicted.endswith(".npz") else xyz.read_extxyz(spark, args.predicted)
    frames, bins, summary = studies.score_against_error(spark, config, xyz.read_extxyz(spark, args.reference_xyz), predicted, args.metric, args.n_bins, args.reference_force_unit, args.predicted_force_unit, args.initial_xyz)
    for df, name, key in ((frames, "score_vs_error.csv", "frame"), (bins, "error_by_decile.csv", "bin")):
        df.orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(str(out / name))
    studies.write_json(out / "score_vs_error.json", summary)
    studies.plot_errors(frames, bins, out)


def _demo(spark, args, config: dict) -> None:
    from driftmark.operators import perturb, topology
    from driftmark.sources import xyz

    symbols, positions = xyz.first_frame(args.initial)
    topo = topology.build(symbols, positions)
    out = _folder(args, config)
    for name, frames in (("train", perturb.basin(positions, topo, 64, 11)), ("valid", perturb.basin(positions, topo, 32, 12))):
        (out / f"{name}.extxyz").write_text("".join(xyz.format_frame({"symbols": symbols, "positions": p.tolist(), "info": {"frame": k, "comment": "synthetic demo geometry"}}) for k, p in enumerate(frames)))
    centroid = perturb.drifting(positions, topo, topo.balanced_dihedral(), 24, 115.0, 0.04, 13)
    (out / "demo.xc.xyz").write_text(perturb.ipi_text(centroid, symbols, 5000))
    (out / "demo.pos_00.xyz").write_text(perturb.ipi_text(perturb.rattle(centroid, 0.03, 14), symbols, 5000))


if __name__ == "__main__":
    main()
