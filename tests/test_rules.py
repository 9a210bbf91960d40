"""Window rules, false-alarm arithmetic and statistics against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import aggregate, evaluation, false_alarm, onset


def frames(spark, bead, centroid, run="a"):
    return spark.createDataFrame([(run, k, 50 * k, float(b), bool(c)) for k, (b, c) in enumerate(zip(bead, centroid, strict=True))], "run string, frame long, step long, bead_frac_ood double, centroid_ood boolean")


def brute(x, w, s, f):
    return next((k for k in range(0, len(x) - w + 1, s) if np.mean(x[k : k + w]) >= f - 1e-12), None)


@pytest.mark.parametrize("w,s,f", [(10, 1, 0.5), (10, 5, 0.5), (7, 3, 0.3), (30, 1, 0.1), (4, 4, 1.0)])
def test_onset_equals_brute_force(spark, w, s, f):
    rng = np.random.default_rng(w * s)
    b, c = rng.random(25) * (np.arange(25) > 8), rng.random(25) > 0.4
    r = onset.detect(frames(spark, b, c), w, s, f).first()
    assert r.persistent_bead_anomaly_frame == brute(b, w, s, f)
    assert r.centroid_anomaly_frame == brute(c, w, s, f)
    both = next((k for k in range(0, 25 - w + 1, s) if b[k : k + w].mean() >= f and c[k : k + w].mean() >= f), None)
    assert r.collective_anomaly_frame == both
    assert r.first_bead_anomaly_frame == (int(np.flatnonzero(b > 0)[0]) if (b > 0).any() else None)


def test_equality_fires_and_short_runs_do_not(spark):
    r = onset.detect(frames(spark, [0.5] * 20, [False] * 20), 10, 1, 0.5).first()
    assert r.persistent_bead_anomaly_frame == 0 and r.centroid_anomaly_frame is None
    assert onset.detect(frames(spark, [1.0] * 5, [True] * 5), 10, 1, 0.5).first().persistent_bead_anomaly_step is None


def test_sparse_track_keeps_original_frames(spark):
    df = frames(spark, [0] * 20, [False] * 20).withColumn("emb_bead_frac_ood", F.expr("case when frame % 2 = 1 then cast(frame > 8 as double) end")).withColumn("emb_centroid_ood", F.lit(None).cast("double"))
    r = onset.detect(df, 3, 1, 1.0).first()
    assert r.embedding_persistent_bead_onset_frame == 9 and r.embedding_persistent_bead_onset_step == 450
    assert r.embedding_centroid_onset_frame is None


def test_partitioning_changes_nothing(spark):
    rng = np.random.default_rng(3)
    df = frames(spark, rng.random(60), rng.random(60) > 0.5)
    assert len({tuple(onset.detect(df.repartition(n), 10, 5, 0.5).first()) for n in (1, 4, 17)}) == 1


def test_published_budget_rows():
    assert false_alarm.window_count(200_000, 500, 50) == 3991
    f, bound = false_alarm.loosest_fraction(0.01, 0.01, 500, 3991)
    assert f == 19 / 500 and abs(bound - 0.0046274190) < 1e-9
    assert false_alarm.effective_trials(500, 0.37) == 230 and false_alarm.effective_trials(500, 0.4) == 214
    assert abs(false_alarm.false_alarm_bound(0.01, 500, 0.2, 3991) / 1.5236e-91 - 1) < 1e-3
    assert abs(false_alarm.false_alarm_bound(0.01, 500, 13 / 230, 3991, 0.37) - 0.003055) < 1e-6


def test_binomial_tail_sums_to_one():
    assert false_alarm.binomial_tail(0, 9, 0.3) == 1.0
    assert abs(false_alarm.binomial_tail(2, 3, 0.5) - 0.5) < 1e-12
    with pytest.raises(ValueError):
        false_alarm.loosest_fraction(1e-9, 0.5, 3)


def test_rules_resolve():
    rule = {"window_frames": 500, "step_frames": 50, "false_alarm_budget": 0.01, "frame_autocorrelation": "auto"}
    f, report = false_alarm.two_track_rule(rule, 99.0, 95.0, 200_000, 0.0)
    assert f == report["fraction_threshold_used"] == max(report["bead"]["fraction_threshold"], report["centroid"]["fraction_threshold"])
    with pytest.raises(ValueError):
        false_alarm.resolve_rule(rule | {"frame_autocorrelation": "maybe"}, 0.01, 1000)


def test_separation_equals_pair_counts(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 60).astype(float), rng.integers(3, 12, 40).astype(float)
    rows = [(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()]
    r = evaluation.separation(spark.createDataFrame(rows, "score double, label int")).first()
    assert abs(r.auroc - np.mean([(y > x) + 0.5 * (y == x) for x in a for y in b])) < 1e-12
    ap, hits = 0.0, 0
    for t in sorted(set(b), reverse=True):
        new = (b == t).sum()
        hits += new
        ap += new / len(b) * hits / ((a >= t).sum() + hits)
    assert abs(r.average_precision - ap) < 1e-12


def test_one_class_gives_none(spark):
    empty, some = spark.createDataFrame([], "score double"), spark.createDataFrame([(1.0,)], "score double")
    assert evaluation.detection_metrics(some, empty)["auroc"] is None


def test_conformal_threshold(spark):
    df = spark.range(1, 101).selectExpr("cast(id as double) as score")
    assert evaluation.conformal_threshold(df, 0.05) == 95.0
    with pytest.raises(ValueError):
        evaluation.conformal_threshold(df, 0.0)


def test_force_errors(spark):
    df = spark.createDataFrame([([[0.0] * 3] * 2, [[3.0, 4.0, 0.0], [0.0] * 3])], "a array<array<double>>, b array<array<double>>")
    got = df.select(*[evaluation.force_error(F.col("a"), F.col("b"), m).alias(m) for m in ("mae", "rmse", "max")]).first()
    assert np.allclose(tuple(got), (7 / 6, math.sqrt(25 / 6), 5))


def test_p_values_against_integration():
    for r, n in ((0.5, 10), (0.2, 30), (-0.7, 6)):
        nu, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        x = np.linspace(t, t + 400, 4_000_001)
        y = (1 + x * x / nu) ** (-(nu + 1) / 2)
        tail = np.trapezoid(y, x) * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        assert abs(evaluation.correlation_p(r, n) - 2 * tail) < 1e-5


def test_autocorrelation(spark):
    rng, x = np.random.default_rng(1), [0.0]
    for e in rng.normal(size=4000):
        x.append(float(0.7 * x[-1] + e))
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)] + [("b", 0, 1.0), ("b", 1, float("nan"))], "run string, frame long, centroid_score double")
    got = {r.run: r.rho for r in aggregate.lag1_autocorrelation(df).collect()}
    d = np.array(x) - np.mean(x)
    assert abs(got["a"] - (d[:-1] * d[1:]).mean() / (d * d).mean()) < 1e-9 and got["b"] == 0.0


def scores(spark, lengths, shift=()):
    rows = [("a", "bead", b, k, 50 * k + (1 if (b, k) in shift else 0), float(b + k)) for b, n in enumerate(lengths) for k in range(n)]
    return spark.createDataFrame(rows, "run string, track string, bead int, frame long, step long, score double")


def test_alignment_and_trimming(spark):
    s = scores(spark, [24, 12, 24])
    aggregate.check_alignment(s)
    r = aggregate.frame_report(s).first()
    assert (r.n_frames_used, r.truncated_to_common_range, r.n_frames_dropped) == (12, True, 12) and list(r.frame_counts) == [24, 12, 24]
    assert aggregate.trim_common(s).count() == 36
    with pytest.raises(ValueError, match="frame 5"):
        aggregate.check_alignment(scores(spark, [24, 24], {(1, 5)}))


def test_nan_scores_are_never_flagged(spark):
    s = spark.createDataFrame([("a", 0, 0, 0, float("nan")), ("a", 1, 0, 0, 9.0)], "run string, bead int, frame long, step long, score double")
    assert aggregate.per_step(s, 5.0).first().bead_frac_ood == 0.5


def test_edges_and_bins(spark):
    df = spark.range(100).selectExpr("cast(id as double) as score", "id as frame", "cast(id as double) as error")
    edges = evaluation.bin_edges(df, 4, "tail-enriched", 0.8)
    assert np.allclose(edges, np.r_[np.quantile(range(100), [0, 0.4]), np.quantile(range(100), [0.8, 0.9, 1.0])])
    assert [r.n for r in evaluation.error_bins(df, 7).orderBy("bin").collect()] == [len(x) for x in np.array_split(range(100), 7)]


def test_streaming_onset_equals_batch(spark, tmp_path):
    from driftmark.streaming.onset import streaming_onset

    rng = np.random.default_rng(7)
    rows = [(r, k, 50 * k, float(rng.random() < 0.4)) for r in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "run string, frame long, step long, flag double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_onset(stream, 10, 5, 0.5).writeStream.format("memory").queryName("onsets").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = onset.windowed_onset(df, {"x": F.col("flag")}, 10, 5, 0.5).collect()
    assert sorted(map(tuple, spark.table("onsets").collect())) == sorted(map(tuple, want))


def test_exact_ranks_in_ranges(spark):
    from driftmark.operators import ranks

    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=3000), np.full(2000, 0.5), rng.normal(size=2000).round(1), -7.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "score double")
    for limit, at in ((10**6, [0.0, 0.01, 0.37, 0.5, 0.95, 0.999, 1.0]), (500, [0.0, 0.37, 0.5]), (40, [0.95])):
        assert np.allclose(ranks.percentiles(df, "score", at, limit), np.percentile(x, [100 * q for q in at]), rtol=0, atol=1e-12)
        assert ranks.largest(df, "score", 3, limit=limit) == np.sort(x)[-3]
    assert ranks.percentiles(df.where("score is null"), "score", [0.5]) == [None]


def test_long_runs_fall_into_stretches(spark, monkeypatch):
    from driftmark.operators import aggregate, onset

    rng = np.random.default_rng(5)
    rows = [("r", f, f * 2, float(v), bool(rng.random() < 0.7)) for f, v in enumerate(np.cumsum(rng.normal(size=200)))] + [("s", 3, 6, 1.0, True), ("t", 0, 0, None, False)]
    df = spark.createDataFrame(rows, "run string, frame long, step long, centroid_score double, seen boolean")
    signal = F.when(F.col("seen"), (F.col("centroid_score") < 0).cast("double"))
    say = lambda: (sorted((r.run, round(r.rho, 9)) for r in aggregate.lag1_autocorrelation(df).collect()), sorted(map(tuple, onset.sparse_onset(df, signal, 12, 8, 0.6).collect())))
    whole = say()
    for module in (aggregate, onset):
        monkeypatch.setattr(module, "STRETCH", 7)
    assert say() == whole and whole[1]


def test_bins_share_the_passes_of_their_percentiles(spark, monkeypatch):
    from driftmark.operators import ranks

    rng = np.random.default_rng(6)
    score, error = rng.normal(size=4000), rng.normal(size=4000).round(2)
    df = spark.createDataFrame([(k, float(s), float(e)) for k, (s, e) in enumerate(zip(score, error, strict=True))], "frame long, score double, error double")
    monkeypatch.setattr(ranks, "ONE_TASK_ROWS", 60)
    jobs = []
    for n_bins in (4, 20):
        spark.sparkContext.setJobGroup(f"bins-{n_bins}", "")
        got = {r.bin: (r.n, r.error_median, r.error_p95) for r in evaluation.error_bins(df, n_bins).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bins-{n_bins}")))
        for b, at in enumerate(np.array_split(np.argsort(score, kind="stable"), n_bins)):
            assert np.allclose(got[b], (len(at), *np.percentile(error[at], [50, 95])), rtol=0, atol=1e-12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 5
