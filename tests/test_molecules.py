"""Topology, geometry, sources, models and selection on hand-made molecules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.functions import geometry as G
from driftmark.operators import chemistry, models, perturb, select, topology
from driftmark.plans import detect, studies
from driftmark.schema import MoleculeSpec, one_atom_count
from driftmark.sources import xyz

HEX = [[1.39 * np.cos(a), 1.39 * np.sin(a), 0.0] for a in np.arange(6) * np.pi / 3]
RING = ["C"] * 6
CHAIN, SPINE = ["C", "C", "C", "O", "H"], [[0, 0, 0], [1.5, 0, 0], [2.1, 1.35, 0], [3.5, 1.4, 0.3], [3.9, 2.2, 0.9]]


@pytest.fixture(scope="module")
def chain():
    return topology.build(CHAIN, SPINE)


def walk(n, seed, sigma=0.03):
    rng = np.random.default_rng(seed)
    return np.asarray(SPINE)[None] + rng.normal(0, sigma, (n, 5, 3))


def extxyz(path, p, forces=None):
    path.write_text("".join(xyz.format_frame({"symbols": CHAIN, "positions": x.tolist(), "forces": None if forces is None else forces[k].tolist(), "info": {"frame": k, "comment": "two words"}}) for k, x in enumerate(p)))
    return str(path)


def test_graph(chain):
    assert chain.bonds == [(0, 1), (1, 2), (2, 3), (3, 4)] and len(chain.angles) == 3 and chain.dihedrals == [(0, 1, 2, 3), (1, 2, 3, 4)]
    assert chain.n_features == len(chain.feature_names) == 4 + 3 + 4 and not chain.ring
    assert chain.beyond(1, 2) == {2, 3, 4} and chain.balanced_dihedral() == (0, 1, 2, 3)


def test_ring():
    t = topology.build(RING, HEX, skin=0.0)
    assert t.ring == list(range(6)) and topology.build(RING, HEX, ring_atoms=[], skin=0.0).ring == []
    for bad in ([0, 1], [0, 0, 1], [0, 1, 9], [0, 1, 3]):
        with pytest.raises(ValueError):
            topology.build(RING, HEX, ring_atoms=bad, skin=0.0)
    with pytest.raises(ValueError):
        topology.build(["H", "H"], [[0, 0, 0], [9, 0, 0]])
    with pytest.warns(UserWarning):
        topology.build(["H"] * 4, [[0, 0, 0], [0.7, 0, 0], [9, 0, 0], [9.7, 0, 0]])


def test_descriptor_is_rigid_motion_invariant(chain):
    p = walk(6, 1)
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.allclose(G.descriptors(p, chain), G.descriptors(p @ q.T + 4.0, chain), atol=1e-9)


def test_sql_geometry_equals_arrays(spark, chain):
    p = walk(8, 3)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(p)], "frame long, p array<array<double>>")
    at = [F.col("p")[k] for k in range(4)]
    got = np.array(df.orderBy("frame").select(G.distance(at[0], at[1]), G.angle(at[0], at[1], at[2]), F.sin(G.dihedral(*at))).collect())
    want = G.descriptors(p, chain)
    assert np.allclose(got, want[:, [0, 4, 7]], atol=1e-12)


def test_planarity_closed_form(spark):
    p = np.array(HEX)[None] + np.random.default_rng(1).normal(0, 0.05, (5, 6, 3))
    c = p - p.mean(1, keepdims=True)
    m = np.einsum("fai,faj->fij", c, c)
    df = spark.createDataFrame([tuple(float(x[i, j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))) for x in m], ["xx", "yy", "zz", "xy", "xz", "yz"])
    got = [np.sqrt(r[0] / 6) for r in df.select(G.eigen_planarity(*map(F.col, df.columns))).collect()]
    assert np.allclose(got, G.planarity(p, list(range(6))), atol=1e-9)


def test_distortions_keep_what_they_should(chain):
    p = walk(4, 5)
    quad, base = (0, 1, 2, 3), G.descriptors(p, chain)
    turned = perturb.set_torsion(p, chain, quad, 75.0)
    assert np.allclose(np.degrees(G.torsions(turned, [quad])), 75.0) and np.allclose(G.descriptors(turned, chain)[:, :7], base[:, :7], atol=1e-9)
    longer = G.descriptors(perturb.stretch(p, chain, 0.3, 1), chain)
    assert np.allclose(longer[:, 1] - base[:, 1], 0.3) and np.allclose(np.delete(longer[:, :4], 1, 1), np.delete(base[:, :4], 1, 1))
    assert np.array_equal(perturb.rattle(p, 0.1, 1)[2:], perturb.rattle(p[2:], 0.1, 1, np.array([2, 3])))


def test_ipi_source(spark, tmp_path):
    text = perturb.ipi_text(walk(7, 1), CHAIN, 1000)
    (tmp_path / "t.pos_00.xyz").write_text(text.replace("5\n#", "\n5\n#", 2))
    (tmp_path / "t.pos_01.xyz").write_text(perturb.ipi_text(walk(5, 2), CHAIN, 1000))
    df = xyz.read_ipi(spark, str(tmp_path / "t.pos_*.xyz"), range_bytes=700, index_dir=str(tmp_path / "ix"))
    assert df.count() == 12 and {r.bead for r in df.select("bead").distinct().collect()} == {0, 1}
    rows = xyz.select_frames(df, [2, 6]).orderBy("bead", "frame").collect()
    assert [(r.bead, r.frame, r.step) for r in rows] == [(0, 2, 1100), (0, 6, 1300), (1, 2, 1100)]
    assert np.allclose(rows[0].positions, walk(7, 1)[2], atol=1e-8)
    assert df.where("frame >= 5").count() == 2 and df.where("frame < 1").count() == 2
    assert one_atom_count(df) == 5 and (tmp_path / "ix").exists()
    with pytest.raises(FileNotFoundError):
        xyz.matches(str(tmp_path / "none*"))


def test_byte_ranges_find_every_frame(spark, tmp_path):
    """Whatever the ranges, the frames are those of one pass, also where comments look like counts."""
    rng, text = np.random.default_rng(3), []
    for k in range(40):
        n = 5
        text += [f"{n}\n", str(n) + "\n" if k % 3 else "\n", *(f"C {x:.4f} {y:.4f} {z:.4f}\n" for x, y, z in rng.normal(size=(n, 3))), "\n" * int(rng.integers(3))]
    path = tmp_path / "c.xyz"
    path.write_text("".join(text))
    whole = xyz.scan_index(str(path))
    assert len(whole) == 40
    size = path.stat().st_size
    for step in (1, 7, 50, 333, 1000, size):
        at = [f for a in range(0, size, step) for f in xyz.frames_between(str(path), a, min(a + step, size))]
        assert [f[0] for f in at] == [f.offset for f in whole], step
    df = xyz.read_ipi(spark, str(path), range_bytes=300, columns="positions", frame_start=3, frame_end=30, frame_stride=4)
    assert [r.frame for r in df.orderBy("frame").collect()] == list(range(3, 30, 4)) and df.where("comment is not null").count() == 0
    assert xyz.read_ipi(spark, str(path), range_bytes=300).rdd.getNumPartitions() > 10
    assert spark.read.format("ipi_xyz").load(str(path)).where("frame in (2, 39)").count() == 2


def test_bad_files(tmp_path):
    f = tmp_path / "x.xyz"
    f.write_text("two\nc\nH 0 0 0\n")
    with pytest.raises(ValueError, match="atom count"):
        xyz.scan_index(str(f))
    f.write_text("2\nc\nH 0 0 0\n")
    with pytest.raises(ValueError, match="1 of 2"):
        xyz.scan_index(str(f))


def test_extxyz_round_trip(spark, tmp_path):
    p, forces = walk(6, 1), np.random.default_rng(1).normal(size=(6, 5, 3))
    df = xyz.read_extxyz(spark, extxyz(tmp_path / "a.xyz", p, forces)).orderBy("frame")
    assert np.allclose([r.forces for r in df.collect()], forces) and df.first().symbols == CHAIN
    df.write.format("extxyz").mode("overwrite").save(str(tmp_path / "out"))
    back = xyz.read_extxyz(spark, str(tmp_path / "out")).orderBy("bead", "frame").collect()
    assert len(back) == 6 and xyz.comment_values('a=1 b="two words" c={x}') == {"a": "1", "b": "two words", "c": "x"}
    plain = xyz.read_extxyz(spark, extxyz(tmp_path / "b.xyz", p)).first()
    assert plain.forces == [[0.0] * 3] * 5 and plain.energy == 0.0
    checked = MoleculeSpec(5, ("C", "C", "O", "C", "H")).checked(df)
    with pytest.raises(Exception, match="element order"):
        checked.collect()


def test_models_equal_numpy(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 1e4
    x = np.c_[x, np.full(400, 3.0)]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "frame long, features array<double>")
    pca = models.ScalerPCA.fit(df.repartition(5), 0.9)
    z = (x[:, :5] - x[:, :5].mean(0)) / x[:, :5].std(0)
    share = np.linalg.svd(z, compute_uv=False) ** 2 / (z**2).sum()
    assert pca.n_components == np.searchsorted(np.cumsum(share), 0.9, side="right") + 1 and np.allclose(pca.ratio, share[: pca.n_components], atol=1e-6) and pca.scale[5] == 1
    m = models.Mahalanobis.fit(pca.transform(df))
    y = pca.apply(x)
    d = y - y.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(y.T) + 1e-8 * np.eye(y.shape[1])), d))
    scored = m.score(pca.transform(df)).orderBy("frame")
    assert np.allclose([r.score for r in scored.collect()], want, atol=1e-6)
    assert abs(m.calibrate(scored, 95.0, "bead") - np.percentile(want, 95)) < 1e-6
    with pytest.raises(ValueError):
        m.threshold("centroid")
    models.save(tmp_path / "m.json", pca=pca, scorer=m)
    back = models.load(tmp_path / "m.json")
    assert np.array_equal(back["scorer"].apply(back["pca"].apply(x)), m.apply(y)) and back["scorer"].thresholds == m.thresholds
    total = pca.residual(df).select(F.expr("aggregate(residual, 0D, (a, b) -> a + b)")).first()[0]
    zz = (x[0] - pca.mean) / pca.scale
    assert abs(total - ((zz - zz @ pca.components.T @ pca.components) ** 2).sum()) < 1e-9


def test_per_atom(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3, 4))
    rows = [("r", 0, f, a, x[f, a].tolist()) for f in range(60) for a in range(3)]
    df = spark.createDataFrame(rows, "run string, bead int, step long, atom int, features array<double>")
    model = models.PerAtom.fit(df.repartition(4))
    want = np.max([[np.sqrt((d := x[f, a] - x[:, a].mean(0)) @ np.linalg.inv(np.cov(x[:, a].T) + 1e-8 * np.eye(4)) @ d) for a in range(3)] for f in range(60)], axis=1)
    assert np.allclose([r.score for r in model.score(df).orderBy("step").collect()], want)


def test_chemistry(spark, chain):
    p = walk(3, 1)
    p[1] = perturb.stretch(p[1:2], chain, 1.0, 1)[0]
    p[2, 4] = p[2, 0] + [0.5, 0.5, 0.5]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(p)], "frame long, positions array<array<double>>")
    rows = chemistry.flag_rows(chemistry.with_flags(df, chain)).orderBy("frame").collect()
    assert [(r.broken_bond, r.close_contact, r.planarity) for r in rows] == [(False, False, None), (True, False, None), (True, True, None)]
    sql = df.select("frame", F.size(chemistry.broken_bonds(F.col("positions"), chain)).alias("b"), F.size(chemistry.close_contacts(F.col("positions"), chain)).alias("c")).orderBy("frame").collect()
    assert [(r.b, r.c) for r in sql] == [(r.n_broken_bonds, r.n_close_contacts) for r in rows]


def test_flag_columns(spark, chain):
    """Rows say planarity; only written tables carry the unit in the name."""
    df = spark.createDataFrame([(0, walk(1, 1)[0].tolist())], "frame long, positions array<array<double>>")
    flags = chemistry.flag_rows(chemistry.with_flags(df, chain))
    assert flags.columns == ["frame", "broken_bond", "n_broken_bonds", "close_contact", "n_close_contacts", "planarity"]
    assert flags.withColumnRenamed("planarity", chemistry.PLANARITY).columns[-1] == "ring_planarity_rmsd_Å"


def test_selection(spark, chain):
    x = np.random.default_rng(1).normal(size=(50, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>")
    one = [r.frame for r in select.farthest_points(df, [0.0] * 3, 6).orderBy("rank").collect()]
    assert one == select.farthest(x, np.zeros(3), 6).tolist()
    assert [r.frame for r in select.farthest_points(df, [0.0] * 3, 6, limit=0).orderBy("rank").collect()] == one
    with pytest.warns(UserWarning):
        assert select.farthest_points(df.limit(3), [0.0] * 3, 6).count() == 3
    assert select.chosen_columns(chain, [(3, 2, 1, 0)]) == [0, 1, 2, 3, 4, 5, 6, 8, 10]
    with pytest.raises(ValueError):
        select.chosen_columns(chain, [(0, 1, 2, 4)])
    drawn = select.stratified(df.withColumn("bin", F.col("frame") % 4), 5)
    assert {r.n for r in drawn.groupBy("bin").agg(F.count("*").alias("n")).collect()} == {5}
    with pytest.raises(ValueError):
        select.strided_split(df.limit(5))


def command_lines(spark, tmp_path, config):
    """main() with each job, over the files of the end-to-end test."""
    import yaml

    from driftmark.__main__ import main, parser

    said = tmp_path / "config.yaml"
    said.write_text(yaml.safe_dump(config))
    out = tmp_path / "out"
    main(["run", "-c", str(said), "-v"])
    main(["extract", "--config", str(said), "--onset-type", "first", "--n-before", "2", "--n-after", "1"])
    first = int(spark.read.option("header", True).csv(str(out / "m/onset_table.csv")).first().first_bead_anomaly_frame)
    text = (out / "m/onset_frames/m.pos_00.extxyz").read_text()
    assert text.count("Properties=") == min(first, 2) + 2 and "forces_unit=eV/Ang" in text
    main(["extract", "--config", str(said), "--threshold", "1.0", "--n-before", "0", "--n-after", "0"])
    with pytest.raises(SystemExit):
        main(["extract", "--config", str(said), "--threshold", "1e9"])
    traj = str(tmp_path / "m.xc.xyz")
    main(["select", "--reference", config["runs"][0]["initial_xyz"], "--trajectory", traj, "--pimd", "--radius", "1.0", "--n-configs", "3", "--primary-dihedrals", "0", "1", "2", "3", "--output", str(tmp_path / "s/sel.extxyz")])
    assert (tmp_path / "s/sel.extxyz").read_text().count("Properties=") == 4
    args = ["score-error", "--mode", "sample", "--config", str(said), "--trajectory", traj, "--initial-xyz", config["runs"][0]["initial_xyz"], "--n-bins", "2", "--n-per-bin", "3", "--scan-stride", "2", "--output-dir", str(tmp_path / "sample")]
    forces = tmp_path / "m.force.xyz"
    forces.write_text(perturb.ipi_text(np.ones((24, 5, 3)), CHAIN, 1000))
    main([*args, "--predicted-trajectory", str(forces), "--reuse-scan", str(tmp_path / "scan")])
    geometry, index = xyz.scan_index(str(tmp_path / "sample/sample_geometries.extxyz")), (tmp_path / "sample/sample_index.csv").read_text().splitlines()
    assert len(geometry) == 6 and len(index) == 7 and index[0] == "sample_index,frame,step,ood_score,score_bin"
    kept = np.load(tmp_path / "sample/sample_predicted.npz")
    assert np.allclose(kept["forces"], 51.42208619083232) and kept["frame"].tolist() == [int(x.split(",")[1]) for x in index[1:]]
    assert xyz.comment_values(geometry[0].comment)["ood_score"] == f"{float(index[1].split(',')[3]):.6f}"
    forces.write_text(perturb.ipi_text(np.ones((24, 5, 3)), CHAIN, 1050))
    with pytest.raises(ValueError, match="step mismatch"):
        main([*args, "--predicted-trajectory", str(forces), "--reuse-scan", str(tmp_path / "scan")])
    main(["score-error", "--config", str(said), "--reference-xyz", config["reference"]["valid"], "--predicted", config["reference"]["valid"], "--n-bins", "4", "--output-dir", str(tmp_path / "errors")])
    assert json.loads((tmp_path / "errors/score_vs_error.json").read_text())["n_frames"] == 40
    main(["demo", "--initial", config["runs"][0]["initial_xyz"], "--output-dir", str(tmp_path / "demo")])
    assert [len(xyz.scan_index(str(tmp_path / "demo" / x))) for x in ("train.extxyz", "valid.extxyz", "demo.xc.xyz", "demo.pos_00.xyz")] == [64, 32, 24, 24]
    assert (tmp_path / "demo/demo.xc.xyz").read_text() != (tmp_path / "demo/demo.pos_00.xyz").read_text()
    e = parser().parse_args(["extract", "-c", "x"])
    assert (e.n_before, e.n_after, e.onset_type) == (100, 100, "persistent")
    rows, each = detect.thin(spark.range(5000).selectExpr("id as frame", "id * 0.1 as time_ps", "double(id) as bead_max", "0D as bead_frac_ood", "0D as centroid_score"))
    assert each == 3 and rows.bead_max.max() == 4999


def test_jobs_end_to_end(spark, tmp_path):
    topo = topology.build(CHAIN, SPINE)
    init = extxyz(tmp_path / "initial.xyz", np.asarray([SPINE], float))
    train, valid = extxyz(tmp_path / "train.xyz", walk(120, 1)), extxyz(tmp_path / "valid.xyz", walk(40, 2), np.zeros((40, 5, 3)))
    drift = perturb.rotate(walk(24, 4), topo, np.linspace(0, 130, 24), (0, 1, 2, 3))
    for k in range(2):
        (tmp_path / f"m.pos_{k:02d}.xyz").write_text(perturb.ipi_text(drift[: 24 - 4 * k], CHAIN, 1000))
        (tmp_path / f"m.for_{k:02d}.xyz").write_text(perturb.ipi_text(drift[: 24 - 4 * k] * 0 + 1, CHAIN, 1000))
    (tmp_path / "m.xc.xyz").write_text(perturb.ipi_text(drift, CHAIN, 1000))
    config = {
        "reference": {"train": train, "valid": valid}, "descriptor": {"pca_variance": 0.95}, "threshold": {"percentile": 95.0},
        "runs": [{"name": "m", "initial_xyz": init, "bead_glob": str(tmp_path / "m.pos_*.xyz"), "centroid_xyz": str(tmp_path / "m.xc.xyz"), "timestep_fs": 0.2, "stride": 50}],
        "chemistry": {"bond_break_cutoff": 2.0, "close_contact_cutoff": 0.8, "nl_mult": 1.1}, "io": {"output_dir": str(tmp_path / "out")},
        "onset": {"window_frames": 5, "step_frames": 1, "fraction_threshold": 0.6, "frame_autocorrelation": "auto"},
    }
    r = detect.run(spark, config).first()
    assert r.collective_anomaly_frame is not None and r.collective_anomaly_step == 1000 + 50 * r.collective_anomaly_frame
    manifest = json.loads((tmp_path / "out/m/manifest.json").read_text())
    assert manifest["frame_alignment"]["n_frames_used"] == 20 and manifest["frame_alignment"]["truncated_to_common_range"]
    assert detect.run(spark, config).first() == r  # from the kept scores
    kept = config | {"io": {"output_dir": str(tmp_path / "kept"), "cache_descriptors": True}}
    assert detect.run(spark, kept).first() == r and len(list((tmp_path / "kept").glob("descriptors-*"))) == 2
    assert detect.run(spark, kept | {"io": kept["io"] | {"force_recompute": True}}).first() == r
    table, summary = studies.benchmark(spark, config, least_fragment=2)
    assert table.count() == 24 and 0 <= summary["detection_rate_unvisited_slices"] <= 1
    near = studies.around_onset(spark, str(tmp_path / "m.pos_00.xyz"), studies.force_path(str(tmp_path / "m.pos_00.xyz")), 10, 2, 3, CHAIN).collect()
    assert [x.frame for x in near] == list(range(8, 14)) and abs(near[0].forces[0][0] - 51.4221) < 1e-9 and near[0].lattice.startswith("100.000000 0")
    ref = xyz.read_extxyz(spark, valid)
    pred = ref.select("frame", F.expr("transform(forces, v -> transform(v, x -> x + frame))").alias("forces"))
    assert manifest["frame_alignment"]["frame_counts"] == [24, 20] and manifest["frame_alignment"]["n_frames_dropped"] == 4 and manifest["frame_alignment"]["centroid_frame_count"] == 24
    assert manifest["ood_threshold"] == manifest["bead_ood_threshold"] and manifest["molecule"]["initial_xyz"] == init
    flags = spark.read.option("header", True).csv(str(tmp_path / "out/m/chemistry_flags_bead00.csv"))
    assert flags.count() == 24 and flags.columns[-1] == "ring_planarity_rmsd_Å"
    command_lines(spark, tmp_path, config)
    frames, bins, s = studies.score_against_error(spark, config, ref, pred, n_bins=4)
    assert frames.count() == 40 and bins.count() == 4 and s["n"] == 40 and -1 <= s["spearman"] <= 1
    drawn = studies.sample_by_score(spark, config, str(tmp_path / "m.xc.xyz"), n_bins=3, n_per_bin=4, scan_stride=2)
    assert drawn.count() == 12
    chosen = select.select_by_dihedrals(xyz.read_ipi(spark, str(tmp_path / "m.xc.xyz")), topo, SPINE, [(0, 1, 2, 3)], [1.0], 3).collect()
    assert len(chosen) == 3 and all(x.distance <= 1 for x in chosen)
    assert select.select_by_descriptor(xyz.read_ipi(spark, str(tmp_path / "m.xc.xyz")), topo, SPINE, 50.0, 3).count() == 3


def test_array_imports(spark, tmp_path):
    from driftmark.sources import embeddings

    class Arrays(dict):
        """An open file of arrays, as HDF5 libraries give them."""

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    rng = np.random.default_rng(1)
    held = Arrays(bead_positions=rng.normal(size=(7, 2, 5, 3)), positions=rng.normal(size=(7, 5, 3)), bead_forces=rng.normal(size=(7, 2, 5, 3)), potential=np.arange(7.0))
    df = xyz.import_hdf5(spark, "x", "r", 3, lambda _: held)
    rows = df.orderBy("frame", F.col("bead").asc_nulls_last()).collect()
    assert len(rows) == 21 and [r.bead for r in rows[:3]] == [0, 1, None] and rows[4].energy == 1.0 and rows[2].forces is None
    assert np.allclose(rows[4].positions, held["bead_positions"][1, 1]) and np.allclose(rows[4].forces, held["bead_forces"][1, 1]) and np.allclose(rows[5].positions, held["positions"][1])
    with pytest.raises(ValueError, match="centroid shape"):
        xyz.import_hdf5(spark, "x", opened=lambda _: Arrays(bead_positions=np.zeros((2, 2, 5, 3)), positions=np.zeros((3, 5, 3))))
    with pytest.raises(ImportError, match="h5py"):
        xyz.import_hdf5(spark, "x.h5")
    x = rng.normal(size=(10, 5, 4)).astype(np.float32)
    np.savez(tmp_path / "e.npz", inv_features=x, steps=np.arange(10) * 50)
    embeddings.write(embeddings.import_arrays(spark, str(tmp_path / "e.npz"), "r", 0, 3).unionByName(embeddings.import_arrays(spark, str(tmp_path / "e.npz"), "r", None, 4)), str(tmp_path / "emb"))
    back = embeddings.read(spark, str(tmp_path / "emb"))
    assert back.count() == 100 and back.where("bead is null").count() == 50
    one = back.where("bead = 0 and step = 150 and atom = 2").first()
    assert np.array_equal(np.array(one.features, np.float32), x[3, 2])
    made = embeddings.embed(df.where("track = 'bead'"), lambda: lambda p: np.concatenate([p, p.sum(-1, keepdims=True)], -1), batch=4)
    got = made.where("bead = 1 and step = 6 and atom = 4").first()
    want = held["bead_positions"][6, 1, 4]
    assert made.count() == 70 and np.allclose(got.features, [*want, want.sum()], atol=1e-6)


def test_selections_without_ranks_order_nothing(spark, sf, monkeypatch):
    from driftmark.plans import catalogue

    def never(*_):
        raise AssertionError("every frame within the radius is wanted, in no order")

    monkeypatch.setattr(select, "farthest_points", never)
    for name in ("dihedral_selection", "descriptor_selection"):
        assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_graphs_leave_in_small_batches(spark):
    import itertools

    import pyarrow as pa

    held = {}

    class Frames:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            held["run"] = run

    spots = [[[0.0, 0.0, 1.2 * k] for k in range(5)]] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(spots)], names=["frame", "positions"])
    topology.graphs(Frames(), ["C"] * 5)
    out = list(held["run"](iter([batch])))
    assert max(b.num_rows for b in out) <= 10_000 and len(out) > 1
    whole = list(itertools.chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for b in out))
    one = list(held["run"](iter([batch.slice(7, 1)])))[0].to_pydict()
    assert [r for r in whole if r[0] == 7] == list(zip(*one.values(), strict=True)) and {r[0] for r in whole} == set(range(3000))
