"""Every query by name, and the SQL that gives the same rows; those of molecules are in ``catalogue_geometry``.

The tables stand for the domain: ``events`` is a set of trajectories (run: user,
bead: event type, frame: place in time, score: value), ``embeddings`` holds
per-atom vectors and, in its first components, points in space, ``lineitem`` a
descriptor matrix, ``orders`` score and error pairs, ``labels`` a binary truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators import aggregate, evaluation, false_alarm, models, onset, select
from driftmark.plans import studies
from driftmark.plans.registry import ORACLE_SQL, QUERIES, query, r6, table
from driftmark.schema import flagged, time_ps
from driftmark.sources import xyz

__all__ = ["ORACLE_SQL", "QUERIES"]
W, S, FRACTION, LEVEL = 10, 5, 0.5, 60.0


def trajectory(spark, sf_dir) -> DataFrame:
    """(run, bead, frame, step, score) of events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("bead"), "ts", F.col("event_id").alias("step"), F.col("value").alias("score"))
    return e.withColumn("frame", (F.row_number().over(Window.partitionBy("run").orderBy("ts", "step")) - 1).cast("long"))


TRAJECTORY = "t as (select user_id as run, event_type as bead, event_id as step, value as score, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"


def daily(spark, sf_dir) -> DataFrame:
    """Per run (event type) and day (frame): users are the beads, their first values the scores."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.to_date("ts").alias("day"), "event_id", "user_id", "value")
    days = e.select("run", "day").distinct().withColumn("frame", (F.row_number().over(Window.partitionBy("run").orderBy("day")) - 1).cast("long"))
    first = e.groupBy("run", "day", F.col("user_id").alias("bead")).agg(F.min_by("value", "event_id").alias("score"))
    return first.join(days, ["run", "day"]).select("run", "bead", "frame", F.datediff("day", F.lit("2000-01-01")).cast("long").alias("step"), "score")


DAILY = """
e as (select event_type as run, cast(ts as date) as day, event_id, user_id, value from events),
days as (select run, day, row_number() over (partition by run order by day) - 1 as frame from (select distinct run, day from e)),
d as (select e.run, user_id as bead, frame, date_diff('day', date '2000-01-01', day) as step, arg_min(value, event_id) as score from e join days using (run, day) group by all),
steps as (select run, frame, min(step) as step, max(score) as bead_max, quantile_cont(score, 0.95) as bead_p95, sum(case when score > 60 then 1 else 0 end) / cast(count(*) as double) as bead_frac_ood, avg(score) as centroid_score from d group by run, frame)
"""


def daily_steps(spark, sf_dir) -> DataFrame:
    d = daily(spark, sf_dir)
    centre = d.groupBy("run", "frame").agg(F.avg("score").alias("score"))
    return aggregate.with_centroid(aggregate.per_step(d, LEVEL), centre, 50.0)


def windows_sql(signals: str, fires: str, source: str = "t") -> str:
    return f"""
w as (select run, frame, step, count(*) over o as n, {signals} from {source} window o as (partition by run order by frame rows between current row and {W - 1} following)),
f as (select run, min(frame) as frame from w where n = {W} and frame % {S} = 0 and {fires} group by run)
"""


# --- thresholds and aggregates ------------------------------------------------


@query("select round(quantile_cont(value, 0.95), 6) as threshold from events")
def threshold_percentile(spark, sf):
    value = aggregate.percentile_threshold(table(spark, sf, "events"), 95.0, "value")
    return spark.createDataFrame([(round(value, 6),)], "threshold double")


@query("select round(quantile_cont(value, 0.99), 6) as bead, round(quantile_cont(value, 0.95), 6) as centroid from events")
def threshold_tracks(spark, sf):
    percentiles = aggregate.track_percentiles({"percentile": 95.0, "bead_percentile": 99.0})
    row = tuple(round(aggregate.percentile_threshold(table(spark, sf, "events"), p, "value"), 6) for p in percentiles)
    return spark.createDataFrame([row], "bead double, centroid double")


@query(f"with {DAILY} select run, frame, cast(step as bigint) as step, round(bead_max, 6) as bead_max, round(bead_p95, 6) as bead_p95, round(bead_frac_ood, 6) as bead_frac_ood, round(centroid_score, 6) as centroid_score, centroid_score > 50 as centroid_ood from steps")
def flag_fraction_by_step(spark, sf):
    return daily_steps(spark, sf).select("run", "frame", "step", *[r6(c).alias(c) for c in ("bead_max", "bead_p95", "bead_frac_ood", "centroid_score")], "centroid_ood")


@query("select round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max, round(avg(case when value > 60 then 1.0 else 0.0 end), 6) as frac_ood from events")
def score_summary(spark, sf):
    out = aggregate.summary(table(spark, sf, "events").withColumnRenamed("value", "score"), LEVEL)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"with {TRAJECTORY} select run, cast(min(frame) as bigint) as first_frame, arg_min(step, frame) as first_step, arg_min(bead, frame) as first_anomaly_bead_idx from t where score > 60 group by run")
def first_flag_per_run(spark, sf):
    return aggregate.first_flag(trajectory(spark, sf), LEVEL)


@query(f"with {TRAJECTORY} select run, frame, step, score > 60 as ood, round(step * cast(0.2 as double) * 50 / 1000, 6) as time_ps from t where frame >= 10 and frame < 20")
def scan_range(spark, sf):
    t = trajectory(spark, sf).where("frame >= 10 and frame < 20")
    return t.select("run", "frame", "step", flagged(F.col("score"), LEVEL).alias("ood"), r6(time_ps(F.col("step"), 0.2, 50)).alias("time_ps"))


@query(f"with {TRAJECTORY}, c as (select run, bead, count(*) as n from t group by run, bead) select run, cast(min(n) as bigint) as n_frames_used, cast(count(*) as bigint) as n_beads, min(n) < max(n) as truncated_to_common_range, cast(max(n) - min(n) as bigint) as n_frames_dropped from c group by run")
def frame_report(spark, sf):
    return aggregate.frame_report(trajectory(spark, sf)).drop("frame_counts")


def _bead_frames(spark, sf):
    t = trajectory(spark, sf).drop("frame")
    return t.withColumn("frame", (F.row_number().over(Window.partitionBy("run", "bead").orderBy("ts", "step")) - 1).cast("long"))


BEADS = "b as (select user_id as run, event_type as bead, event_id as step, value as score, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as frame from events)"


@query(f"with {BEADS}, c as (select run, bead, count(*) as n from b group by run, bead), m as (select run, min(n) as n_used from c group by run) select b.run, bead, cast(frame as bigint) as frame, step from b join m on b.run = m.run where frame < n_used")
def trim_common_range(spark, sf):
    return aggregate.trim_common(_bead_frames(spark, sf)).select("run", "bead", "frame", "step")


@query(f"with {BEADS} select run, cast(frame as bigint) as frame, cast(count(distinct step) as bigint) as n_steps, arg_min(bead, step) as bead from b group by run, frame having count(distinct step) > 1")
def step_alignment_check(spark, sf):
    return aggregate.misaligned(_bead_frames(spark, sf)).select("run", "frame", "n_steps", "bead")


@query(f"with {DAILY}, emb as (select run, step, max(score) as emb_bead_max, sum(case when score > 70 then 1 else 0 end) / cast(count(*) as double) as emb_bead_frac_ood from d where step % 2 = 0 group by run, step) select steps.run, steps.frame, cast(steps.step as bigint) as step, round(emb_bead_max, 6) as emb_bead_max, round(emb_bead_frac_ood, 6) as emb_bead_frac_ood from steps left join emb on steps.run = emb.run and steps.step = emb.step")
def embedding_left_join(spark, sf):
    d = daily(spark, sf)
    some = d.where("step % 2 = 0")
    out = aggregate.with_embedding(aggregate.per_step(d, LEVEL), some, some.groupBy("run", "step").agg(F.avg("score").alias("score")), 70.0)
    return out.select("run", "frame", "step", r6("emb_bead_max").alias("emb_bead_max"), r6("emb_bead_frac_ood").alias("emb_bead_frac_ood"))


# --- windows -------------------------------------------------------------------


@query(f"with {TRAJECTORY}, {windows_sql('sum(case when score > 60 then 1.0 else 0.0 end) over o as x', f'x >= {FRACTION * W} - 1e-9')} select f.run, cast(f.frame as bigint) as frame, t.step from f join t on f.run = t.run and f.frame = t.frame")
def onset_persistent(spark, sf):
    return onset.windowed_onset(trajectory(spark, sf), {"x": flagged(F.col("score"), LEVEL)}, W, S, FRACTION)


@query(f"with {DAILY}, {windows_sql('sum(case when centroid_score > 50 then 1.0 else 0.0 end) over o as x', f'x >= {FRACTION * W} - 1e-9', 'steps')} select f.run, cast(f.frame as bigint) as frame, cast(s.step as bigint) as step from f join steps s on f.run = s.run and f.frame = s.frame")
def onset_centroid(spark, sf):
    return onset.windowed_onset(daily_steps(spark, sf), {"x": F.col("centroid_ood")}, W, S, FRACTION)


@query(f"with {TRAJECTORY}, {windows_sql('sum(case when score > 60 then 1.0 else 0.0 end) over o as x, sum(case when score > 30 then 1.0 else 0.0 end) over o as y', f'x >= {FRACTION * W} - 1e-9 and y >= {FRACTION * W} - 1e-9')} select f.run, cast(f.frame as bigint) as frame, t.step from f join t on f.run = t.run and f.frame = t.frame")
def onset_collective(spark, sf):
    return onset.windowed_onset(trajectory(spark, sf), {"x": flagged(F.col("score"), LEVEL), "y": flagged(F.col("score"), 30.0)}, W, S, FRACTION)


@query(f"with {TRAJECTORY}, s as (select run, row_number() over (partition by run order by frame) - 1 as frame, frame as at, step, score from t where step % 3 <> 0), {windows_sql('sum(case when score > 60 then 1.0 else 0.0 end) over o as x', f'x >= {FRACTION * W} - 1e-9', 's')} select f.run, cast(s.at as bigint) as frame, s.step from f join s on f.run = s.run and f.frame = s.frame")
def onset_sparse_subset(spark, sf):
    signal = F.when(F.col("step") % 3 != 0, flagged(F.col("score"), LEVEL).cast("double"))
    return onset.sparse_onset(trajectory(spark, sf), signal, W, S, FRACTION)


@query(f"""with {DAILY}, {windows_sql('sum(bead_frac_ood) over o as x, sum(case when centroid_score > 50 then 1.0 else 0.0 end) over o as y', 'true', 'steps')},
k as (select run, min(case when x >= 2 - 1e-9 then frame end) as p, min(case when y >= 2 - 1e-9 then frame end) as c, min(case when x >= 2 - 1e-9 and y >= 2 - 1e-9 then frame end) as b from w where n = {W} and frame % {S} = 0 group by run),
r as (select run, min(case when bead_frac_ood > 0 then frame end) as a from steps group by run)
select r.run, cast(a as bigint) as first_bead_anomaly_frame, cast(p as bigint) as persistent_bead_anomaly_frame, cast(c as bigint) as centroid_anomaly_frame, cast(b as bigint) as collective_anomaly_frame from r left join k on r.run = k.run""")
def onset_table(spark, sf):
    out = onset.detect(daily_steps(spark, sf), W, S, 0.2)
    return out.select("run", *[f"{k}_frame" for k in ("first_bead_anomaly", "persistent_bead_anomaly", "centroid_anomaly", "collective_anomaly")])


@query(f"with {TRAJECTORY} select run, cast(case when count(*) < {W} then 0 else (count(*) - {W}) // {S} + 1 end as bigint) as n_windows from t group by run")
def window_count(spark, sf):
    return trajectory(spark, sf).groupBy("run").agg(F.count("*").alias("n")).select("run", onset.window_count(F.col("n"), W, S).cast("long").alias("n_windows"))


LAG = "m as (select run, frame, score - avg(score) over (partition by run) as d from {src}), l as (select run, d, lead(d) over (partition by run order by frame) as a from m), rho as (select run, count(*) as n, avg(d * a) / nullif(avg(d * d), 0) as raw from l group by run), cut as (select run, case when n < 3 or raw is null then 0.0 else greatest(0.0, least(0.99, raw)) end as rho from rho)"


@query(f"with {TRAJECTORY}, {LAG.format(src='t')} select run, round(rho, 6) as rho from cut")
def lag1_autocorrelation(spark, sf):
    return aggregate.lag1_autocorrelation(trajectory(spark, sf), "score").select("run", r6("rho").alias("rho"))


STABLE = "st as (select run, frame, score from (select *, greatest(3, floor(count(*) over (partition by run) * cast(0.5 as double))) as n0 from t) where frame < n0)"


@query(f"with {TRAJECTORY}, {STABLE}, {LAG.format(src='st')} select run, round(rho, 6) as rho from cut")
def stable_segment_autocorrelation(spark, sf):
    return aggregate.lag1_autocorrelation(aggregate.stable_segment(trajectory(spark, sf), 0.5), "score").select("run", r6("rho").alias("rho"))


@query(f"with {TRAJECTORY}, {LAG.format(src='t')} select run, cast(greatest(1, round_even(round(500 * (1 - rho) / (1 + rho), 6), 0)) as bigint) as trials from cut")
def effective_trials(spark, sf):
    return aggregate.lag1_autocorrelation(trajectory(spark, sf), "score").select("run", false_alarm.trials(F.col("rho"), 500).alias("trials"))


CASES = ((500, 0.0, 0.2), (500, 0.4, 0.06), (500, 0.37, 0.0565), (100, 0.0, 0.1), (10, 0.0, 0.5))
TAIL = "case when m <= 0 then 1.0 else (select sum(exp(lgamma(trials + 1) - lgamma(k + 1) - lgamma(trials - k + 1) + k * ln(0.05) + (trials - k) * ln(0.95))) from generate_series(1, 500) g(k) where k >= m and k <= trials) end"


@query(f"with c as (select * from (values {', '.join(f'({w}, cast({r} as double), cast({f} as double))' for w, r, f in CASES)}) v(w, rho, f)), n as (select *, greatest(1, cast(round_even(w * (1 - rho) / (1 + rho), 0) as bigint)) as trials from c), p as (select *, least(greatest(cast(ceil(f * trials - 1e-9) as bigint), 1), trials) as m from n) select cast(w as bigint) as w, rho, f as fraction, cast(trials as bigint) as trials, cast(m as bigint) as needed, round(least(1.0, 100 * {TAIL}), 9) as bound from p")
def false_alarm_bound(spark, sf):
    rows = []
    for w, rho, f in CASES:
        n = false_alarm.effective_trials(w, rho)
        rows.append((w, rho, f, n, false_alarm.flags_needed(f, n), round(false_alarm.false_alarm_bound(0.05, w, f, 100, rho), 9)))
    return spark.createDataFrame(rows, "w long, rho double, fraction double, trials long, needed long, bound double")


@query(f"with c as (select * from (values {', '.join(f'({w}, cast({r} as double))' for w, r, _ in CASES[:4])}) v(w, rho)), n as (select *, greatest(1, cast(round_even(w * (1 - rho) / (1 + rho), 0) as bigint)) as trials from c), p as (select n.*, m.m from n, generate_series(1, 500) m(m) where m <= trials), q as (select *, least(1.0, 100 * {TAIL}) as bound from p), b as (select w, rho, trials, min(m) as m from q where bound <= 0.01 group by all) select cast(w as bigint) as w, rho, cast(m as bigint) as needed, round(m / cast(trials as double), 9) as fraction from b")
def budget_fraction(spark, sf):
    rows = []
    for w, rho, _ in CASES[:4]:
        f, _ = false_alarm.loosest_fraction(0.01, 0.05, w, 100, rho)
        rows.append((w, rho, round(f * false_alarm.effective_trials(w, rho)), round(f, 9)))
    return spark.createDataFrame(rows, "w long, rho double, needed long, fraction double")


# --- evaluation ------------------------------------------------------------------


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


LABELLED = "x as (select cast(n_chars as double) as score, quality as label from documents join labels using (doc_id))"


@query("select round(value, 6) as threshold from (select value, row_number() over (order by value desc) as k, count(*) over () as n from events) where k = least(greatest(cast(ceil((n + 1) * cast(0.05 as double)) as bigint), 1), n)")
def conformal_threshold(spark, sf):
    value = evaluation.conformal_threshold(table(spark, sf, "events"), 0.05, "value")
    return spark.createDataFrame([(round(value, 6),)], "threshold double")


@query(f"""with {LABELLED}, g as (select score, sum(label) as pos, sum(1 - label) as neg from x group by score),
c as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from g)
select round(sum(pos * (0.5 * neg) + neg * (tp - pos)) / (sum(pos) * sum(neg)), 6) as auroc, round(sum(pos * tp / cast(tp + fp as double)) / sum(pos), 6) as average_precision from c""")
def auroc_average_precision(spark, sf):
    out = evaluation.separation(labelled(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"with {LABELLED}, n as (select score, row_number() over (order by score desc) as k, count(*) over () as m from x where label = 1), h as (select score as t from n where k = least(greatest(cast(ceil((m + 1) * cast(0.05 as double)) as bigint), 1), m)) select round(avg(case when score > t then 1.0 else 0.0 end), 6) as detection_rate, cast(count(*) as bigint) as n_abnormal from x, h where label = 0")
def detection_rate(spark, sf):
    x = labelled(spark, sf)
    m = evaluation.detection_metrics(x.where("label = 1"), x.where("label = 0"), 0.05)
    return spark.createDataFrame([(round(m["detection_rate"], 6), m["n_abnormal"])], "detection_rate double, n_abnormal long")


ORDERS = "o as (select o_orderkey as frame, o_totalprice as score, cast(o_custkey as double) as error from orders)"


def pairs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("score"), F.col("o_custkey").cast("double").alias("error"))


@query(f"with {ORDERS}, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / cast(2 as double) as rx, rank() over (order by error) + (count(*) over (partition by error) - 1) / cast(2 as double) as ry from o) select cast(count(*) as bigint) as n, round(corr(rx, ry), 6) as spearman, round(corr(score, error), 6) as pearson from r")
def spearman_pearson(spark, sf):
    m = evaluation.correlation(pairs(spark, sf), "score", "error")
    return spark.createDataFrame([(m["n"], round(m["spearman"], 6), round(m["pearson"], 6))], "n long, spearman double, pearson double")


@query(f"with {ORDERS}, b as (select *, ntile(10) over (order by score, frame) - 1 as bin from o) select cast(bin as int) as bin, cast(count(*) as bigint) as n, round(min(score), 6) as score_min, round(max(score), 6) as score_max, round(avg(error), 6) as error_mean, round(median(error), 6) as error_median, round(quantile_cont(error, 0.95), 6) as error_p95 from b group by bin")
def error_deciles(spark, sf):
    out = evaluation.error_bins(pairs(spark, sf), 10)
    return out.select("bin", "n", *[r6(c).alias(c) for c in out.columns[2:]])


@query(f"with {ORDERS}, q as (select quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) as e from o), d as (select case when score >= e[4] then 4 when score >= e[3] then 3 when score >= e[2] then 2 when score >= e[1] then 1 else 0 end as bin, score from o, q) select cast(bin as int) as bin, cast(count(*) as bigint) as n, round(min(score), 6) as score_min, round(max(score), 6) as score_max from d group by bin")
def bin_edges_digitise(spark, sf):
    o = pairs(spark, sf)
    edges = evaluation.bin_edges(o, 5)
    return o.groupBy(evaluation.digitise(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("n"), r6(F.min("score")).alias("score_min"), r6(F.max("score")).alias("score_max"))


@query("with b as (select o_orderkey as frame, cast(o_orderkey % 7 as int) as bin from orders), n as (select bin, frame, row_number() over (partition by bin order by (frame * 2654435761) % 4294967296, frame) as k from b) select bin, frame from n where k <= 5")
def stratified_sample(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 7).cast("int").alias("bin"))
    return select.stratified(o, 5, lot=F.col("frame") * F.lit(2654435761) % F.lit(4294967296)).select("bin", "frame")


@query(f"with {TRAJECTORY} select run, cast(sum(case when frame % 2 = 0 then 1 else 0 end) as bigint) as calibration, cast(sum(case when frame % 2 = 0 then 0 else 1 end) as bigint) as evaluation from t group by run")
def strided_split(spark, sf):
    a, b = select.strided_split(trajectory(spark, sf), 0.5)
    n = a.groupBy("run").agg(F.count("*").alias("calibration")).join(b.groupBy("run").agg(F.count("*").alias("evaluation")), "run", "full")
    return n.select("run", F.coalesce("calibration", F.lit(0)).cast("long").alias("calibration"), F.coalesce("evaluation", F.lit(0)).cast("long").alias("evaluation"))


# --- models ----------------------------------------------------------------------


@query("select cast(i as int) as i, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by i")
def standardise_moments(spark, sf):
    n, mean, gram = models.moments(table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features")))
    rows = [(i, round(float(m), 6), round(float((g / n) ** 0.5), 6)) for i, (m, g) in enumerate(zip(mean, gram.diagonal(), strict=True))]
    return spark.createDataFrame(rows, "i int, mean double, std double")


@query("with e as (select embedding::double[] as v from embeddings), p as (select i.i, j.j, v[i.i + 1] as x, v[j.j + 1] as y from e, generate_series(0, 7) i(i), generate_series(0, 7) j(j)) select cast(i as int) as i, cast(j as int) as j, round(covar_samp(x, y), 6) as cov from p group by i, j")
def covariance_matrix(spark, sf):
    n, _, gram = models.moments(table(spark, sf, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("features")))
    return spark.createDataFrame([(i, j, round(float(gram[i, j]) / (n - 1), 6)) for i in range(8) for j in range(8)], "i int, j int, cov double")


@query()
def covariance_matrix_all(spark, sf):
    """Every pair of components; ``covariance_matrix`` is the block of the first 8, as its SQL has it."""
    n, _, gram = models.moments(table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features")))
    return spark.createDataFrame([(i, j, round(float(v) / (n - 1), 6)) for i, row in enumerate(gram) for j, v in enumerate(row)], "i int, j int, cov double")


@query()
def pca_explained_variance(spark, sf):
    pca = models.ScalerPCA.fit(table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features")), 0.95)
    return spark.createDataFrame([(i, round(float(r), 6)) for i, r in enumerate(pca.ratio)], "component int, ratio double")


LINE = "select l_orderkey, l_partkey, l_linenumber, l_quantity::double as x, l_extendedprice / 1000 as y from lineitem"
MAHA = "sqrt(greatest(0, (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / (sxx * syy - sxy * sxy)))"


@query(f"with l as ({LINE}), f as (select avg(x) as mx, avg(y) as my, var_samp(x) + 1e-8 as sxx, var_samp(y) + 1e-8 as syy, covar_samp(x, y) as sxy from l where l_orderkey % 2 = 0), s as (select l.*, x - mx as dx, y - my as dy, sxx, syy, sxy from l, f) select l_orderkey, l_partkey, l_linenumber, round({MAHA}, 5) as score from s")
def mahalanobis_2d(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000).alias("reduced"))
    model = models.Mahalanobis.fit(x.where("l_orderkey % 2 = 0"))
    return model.score(x).select("l_orderkey", "l_partkey", "l_linenumber", F.round("score", 5).alias("score"))


EMB2 = "v as (select vec_id, label as atom, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


@query()
def mahalanobis_per_atom(spark, sf):
    """All 64 components; a fit of so many needs a matrix that SQL has no inverse for."""
    x = _atoms(spark, sf).drop("features").join(_embedding_rows(spark, sf).withColumnRenamed("vec_id", "step"), "step")
    return models.PerAtom.fit(x).score_atoms(x).select(F.col("step").alias("vec_id"), "atom", F.round("score", 4).alias("score"))


def _atoms(spark, sf):
    return table(spark, sf, "embeddings").select(F.lit("r").alias("run"), F.lit(0).alias("bead"), F.col("vec_id").alias("step"), F.col("label").alias("atom"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("features"))


@query(f"with {EMB2}, f as (select atom, avg(x) as mx, avg(y) as my, var_samp(x) + 1e-8 as sxx, var_samp(y) + 1e-8 as syy, covar_samp(x, y) as sxy from v group by atom), s as (select vec_id, v.atom, x - mx as dx, y - my as dy, sxx, syy, sxy from v join f on v.atom = f.atom) select vec_id, atom, round({MAHA}, 5) as score from s")
def mahalanobis_per_atom_2d(spark, sf):
    x = _atoms(spark, sf)
    return models.PerAtom.fit(x).score_atoms(x).select(F.col("step").alias("vec_id"), "atom", F.round("score", 5).alias("score"))


@query(f"with {EMB2}, f as (select atom, avg(x) as mx, avg(y) as my, var_samp(x) + 1e-8 as sxx, var_samp(y) + 1e-8 as syy, covar_samp(x, y) as sxy from v group by atom), s as (select vec_id // 10 as step, x - mx as dx, y - my as dy, sxx, syy, sxy from v join f on v.atom = f.atom) select step, round(max({MAHA}), 5) as score from s group by step")
def max_over_atoms_2d(spark, sf):
    x = _atoms(spark, sf)
    return models.PerAtom.fit(x).score(x.withColumn("step", F.floor(F.col("step") / 10).cast("long"))).select("step", F.round("score", 5).alias("score"))


# --- selection and graphs --------------------------------------------------------------


@query("select vec_id, round(sqrt(((embedding[1]::double - 0.1) ** 2 + (embedding[2]::double - 0.2) ** 2) / 0.09::double + ((embedding[3]::double - 0.3) ** 2 + (embedding[4]::double - 0.4) ** 2) / 0.25::double), 6) as distance from embeddings where ((embedding[1]::double - 0.1) ** 2 + (embedding[2]::double - 0.2) ** 2) / 0.09::double + ((embedding[3]::double - 0.3) ** 2 + (embedding[4]::double - 0.4) ** 2) / 0.25::double <= 1")
def ellipse_filter(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    d = v.select("vec_id", select.ellipse_distance(F.col("e"), [0.1, 0.2, 0.3, 0.4], [0.3, 0.5]).alias("distance"))
    return d.where("distance <= 1").select("vec_id", r6("distance").alias("distance"))


@query("with recursive v as (select vec_id, embedding::double[] as e from embeddings), d as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as d from v), r as (select 0 as rank, arg_max(struct_pack(vec_id, e), struct_pack(d := d, n := -vec_id)) as pick, list(struct_pack(vec_id, d)) as ds from d union all select rank + 1, (select arg_max(struct_pack(vec_id := q.vec_id, e := q.e), struct_pack(d := q.d, n := -q.vec_id)) from (select v.vec_id, v.e, least(u.d, sqrt(list_sum(list_transform(list_zip(v.e, r.pick.e), lambda x: (x[1] - x[2]) ** 2)))) as d from (select unnest(r.ds) as u) join v on v.vec_id = u.vec_id) q), (select list(struct_pack(vec_id := v.vec_id, d := least(u.d, sqrt(list_sum(list_transform(list_zip(v.e, r.pick.e), lambda x: (x[1] - x[2]) ** 2)))))) from (select unnest(r.ds) as u) join v on v.vec_id = u.vec_id) from r where rank < 9) select cast(rank as int) as rank, pick.vec_id as frame from r")
def farthest_points(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("features"))
    return select.farthest_points(v, [0.0] * 64, 10)


KINDS = "case l_returnflag when 'A' then 'rattle' when 'N' then 'stretch' else 'torsion_scan' end"


def _rates(spark, sf):
    """lineitem as a benchmark table: kind, size, detection rate of each row."""
    kind = F.expr(KINDS)
    return table(spark, sf, "lineitem").select(kind.alias("distortion"), F.col("l_linenumber").cast("int").alias("magnitude"), (F.col("l_quantity") > 25).cast("double").alias("detection_rate"), F.when(kind == "torsion_scan", F.col("l_suppkey") % 5).cast("long").alias("train_count_at_target"))


@query(f"with x as (select {KINDS} as d, cast(l_linenumber as int) as magnitude, case when l_quantity > 25 then 1.0 else 0.0 end as hit from lineitem) select magnitude, round(avg(case when d = 'rattle' then hit end), 6) as rattle, round(avg(case when d = 'stretch' then hit end), 6) as stretch, round(avg(case when d = 'torsion_scan' then hit end), 6) as torsion_scan from x group by magnitude")
def distortion_pivot(spark, sf):
    out = studies.rate_pivot(_rates(spark, sf))
    return out.select("magnitude", *[r6(c).alias(c) for c in ("rattle", "stretch", "torsion_scan")])


@query(f"with x as (select {KINDS} as d, l_suppkey % 5 as n, case when l_quantity > 25 then 1.0 else 0.0 end as hit from lineitem) select round(avg(case when n = 0 then hit end), 6) as unvisited, round(avg(case when n >= 2 then hit end), 6) as dense from x where d = 'torsion_scan'")
def slice_means(spark, sf):
    out = studies.slice_rates(_rates(spark, sf).where("distortion = 'torsion_scan'"), 2)
    return out.select(r6("unvisited").alias("unvisited"), r6("dense").alias("dense"))


@query(f"with {TRAJECTORY} select run, cast(frame as bigint) as frame, step from t where frame in (0, 3, 7, 20)")
def frame_semi_join(spark, sf):
    return xyz.select_frames(trajectory(spark, sf), [0, 3, 7, 20]).select("run", "frame", "step")


@query(f"with {DAILY}, b as (select run, cast(floor(bead_max / 20) as int) as bin, bead_max from steps) select bin, cast(count(*) as bigint) as n_frames, round(min(bead_max), 6) as score_min, round(max(bead_max), 6) as score_max from b group by bin")
def bin_report(spark, sf):
    s = daily_steps(spark, sf)
    out = evaluation.bin_report(s.select(F.floor(F.col("bead_max") / 20).cast("int").alias("bin"), F.col("bead_max").alias("score")))
    return out.select("bin", "n_frames", r6("score_min").alias("score_min"), r6("score_max").alias("score_max"))


REPORTS = ((0.05, 500, 50, 20_000, 0.06, 0.4, 1), (0.01, 500, 50, 200_000, 0.038, 0.0, 1), (0.01, 100, 10, 5_000, 0.2, 0.25, 4), (0.05, 10, 5, 8, 0.5, 0.0, 1))
NUMBERS = "alpha, w, s, n, f, rho, beads"


@query(f"""with c as (select * from (values {', '.join('(' + ', '.join(f'cast({x} as {"double" if isinstance(x, float) else "bigint"})' for x in r) + ')' for r in REPORTS)}) v({NUMBERS})),
k as (select *, case when n < w then 0 else (n - w) // s + 1 end as windows, greatest(1, n // w) as disjoint, greatest(1, cast(round_even(w * (1 - rho) / (1 + rho) * beads, 0) as bigint)) as trials from c),
m as (select *, least(greatest(cast(ceil(f * trials - 1e-9) as bigint), 1), trials) as needed from k),
p as (select *, (select sum(exp(lgamma(trials + 1) - lgamma(i + 1) - lgamma(trials - i + 1) + i * ln(alpha) + (trials - i) * ln(1 - alpha))) from generate_series(1, 2000) g(i) where i >= needed and i <= trials) as tail from m)
select w as window_frames, windows as n_windows_tested, disjoint as n_disjoint_windows, trials as effective_trials_per_window, needed as flags_needed_per_window, round(alpha * n, 6) as expected_false_flags_per_frame_series, round(1 / alpha, 6) as frames_to_first_false_flag,
round(least(1, tail), 9) as false_alarm_probability_per_window, round(least(1, tail * greatest(windows, 1)), 9) as false_alarm_probability_per_run, round(least(1, tail * disjoint), 9) as false_alarm_probability_per_run_nonoverlapping from p""")
def design_report(spark, sf):
    keys = ("window_frames", "n_windows_tested", "n_disjoint_windows", "effective_trials_per_window", "flags_needed_per_window", "expected_false_flags_per_frame_series", "frames_to_first_false_flag", "false_alarm_probability_per_window", "false_alarm_probability_per_run", "false_alarm_probability_per_run_nonoverlapping")
    rows = []
    for a, w, s, n, f, rho, beads in REPORTS:
        r = false_alarm.design_report(a, w, s, n, f, rho, beads)
        rows.append(tuple(r[k] if k in keys[:5] else round(float(r[k]), 9 if k in keys[7:] else 6) for k in keys))
    return spark.createDataFrame(rows, ", ".join(f"{k} {'long' if k in keys[:5] else 'double'}" for k in keys))


# the standardised matrix of all 64 components, and its principal components
STANDARD = "e as (select vec_id, embedding::double[] as v from embeddings), u as (select vec_id, i.i, v[i.i + 1] as x from e, generate_series(0, 63) i(i)), z as (select vec_id, i, (x - avg(x) over (partition by i)) / stddev_pop(x) over (partition by i) as z from u)"


def _embedding_rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


@query(f"with {STANDARD}, r as (select a.i, b.i as j, avg(a.z * b.z) as r from z a join z b using (vec_id) group by a.i, b.i) select cast(64 as bigint) as components, round(sum(case when i = j then r end) / 64, 6) as total, round(sum(r * r) / 4096, 6) as squares from r")
def pca_spectrum(spark, sf):
    """What the ratios of all components have to sum up to: 1, and the mean square of the correlations."""
    pca = models.ScalerPCA.fit(_embedding_rows(spark, sf), 1.0)
    return spark.createDataFrame([(pca.n_components, round(float(pca.ratio.sum()), 6), round(float((pca.ratio**2).sum()), 6))], "components long, total double, squares double")


@query(f"with {STANDARD} select vec_id, round(sum(z * z), 5) as squares, 0.0::double as residual from z group by vec_id")
def pca_rows(spark, sf):
    """All components keep a row's squares and leave no residual."""
    x = _embedding_rows(spark, sf)
    pca = models.ScalerPCA.fit(x, 1.0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    both = pca.residual(pca.transform(x))
    return both.select("vec_id", F.round(total(F.transform("reduced", lambda v: v * v)), 5).alias("squares"), (F.round(total("residual"), 5) + F.lit(0.0)).alias("residual"))


@query(f"with {STANDARD}, r as (select a.i, b.i as j, avg(a.z * b.z) as r from z a join z b using (vec_id) group by a.i, b.i) select cast(i as int) as i, cast(j as int) as j, round(r, 6) as correlation from r")
def pca_reconstruction(spark, sf):
    """Components and their variances give the correlation matrix back."""
    pca = models.ScalerPCA.fit(_embedding_rows(spark, sf), 1.0)
    r = pca.components.T @ (pca.ratio[:, None] * len(pca.mean) * pca.components)
    return spark.createDataFrame([(i, j, round(float(v), 6) + 0.0) for i, row in enumerate(r) for j, v in enumerate(row)], "i int, j int, correlation double")


@query(f"with {DAILY}, {windows_sql('sum(frac) over o as x, sum(case when centroid_score > 45 then 1.0 else 0.0 end) over o as y', 'true', 'again')}, k as (select run, min(case when x >= 2 - 1e-9 then frame end) as p, min(case when y >= 2 - 1e-9 then frame end) as c from w where n = {W} and frame % {S} = 0 group by run) select a.run, cast(min(case when frac > 0 then a.frame end) as bigint) as first_bead_anomaly_frame, cast(any_value(k.p) as bigint) as persistent_bead_anomaly_frame, cast(any_value(k.c) as bigint) as centroid_anomaly_frame from again a left join k on a.run = k.run group by a.run".replace("w as (select", "again as (select run, frame, min(step) as step, sum(case when score > 45 then 1 else 0 end) / cast(count(*) as double) as frac, avg(score) as centroid_score from d group by run, frame), w as (select", 1))
def redetected(spark, sf):
    """Onsets of saved scores at another threshold."""
    d = daily(spark, sf)
    centre = d.groupBy("run", "frame").agg(F.avg("score").alias("score"))
    out = studies.redetect(d, centre, 45.0, {"window_frames": W, "step_frames": S}, 0.2)
    return out.select("run", "first_bead_anomaly_frame", "persistent_bead_anomaly_frame", "centroid_anomaly_frame")


@query(f"with l as ({LINE}), f as (select avg(x) as mx, avg(y) as my, var_samp(x) + 1e-8 as sxx, var_samp(y) + 1e-8 as syy, covar_samp(x, y) as sxy from l where l_orderkey % 2 = 0), s as (select l.*, x - mx as dx, y - my as dy, sxx, syy, sxy from l, f), m as (select l_orderkey, {MAHA} as score from s), t as (select quantile_cont(score, 0.9) as bead, quantile_cont(score, 0.99) as centroid from m where l_orderkey % 2 = 0) select cast(sum(case when score > bead then 1 else 0 end) as bigint) as bead, cast(sum(case when score > centroid then 1 else 0 end) as bigint) as centroid from m, t where l_orderkey % 2 = 1")
def calibrated_flags(spark, sf):
    """Scores above thresholds calibrated for two tracks on the fitting half, counted on the other."""
    x = table(spark, sf, "lineitem").select("l_orderkey", F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000).alias("reduced"))
    train, rest = x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1")
    model = models.Mahalanobis.fit(train)
    scored = model.score(train)
    for track, percentile in (("bead", 90.0), ("centroid", 99.0)):
        model.calibrate(scored, percentile, track)
    new = model.score(rest)
    n = lambda track: model.is_ood(new, track).agg(F.sum(F.col("ood").cast("long")).alias(track))
    return n("bead").crossJoin(n("centroid"))  # one row each


@query("with x as (select o_totalprice as score, case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 'nan'::double when o_orderkey % 17 = 0 then 'inf'::double else o_custkey::double end as error from orders), f as (select * from x where error is not null and not isnan(error) and not isinf(error)) select cast(count(*) as bigint) as n, round(corr(score, error), 6) as pearson from f")
def finite_pairs(spark, sf):
    """Pairs with a null, NaN or infinite side are left out of a correlation."""
    k = F.col("frame")
    odd = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit(float("nan"))).when(k % 17 == 0, F.lit(float("inf"))).otherwise(F.col("error"))
    m = evaluation.correlation(pairs(spark, sf).withColumn("error", odd), "score", "error")
    return spark.createDataFrame([(m["n"], round(m["pearson"], 6))], "n long, pearson double")


@query(f"with {ORDERS}, b as (select *, ntile(10) over (order by score, frame) - 1 as bin from o), m as (select bin, avg(error) as e from b group by bin) select round(max(case when bin = 9 then e end) / max(case when bin = 0 then e end), 6) as ratio from m")
def decile_ratio(spark, sf):
    return spark.createDataFrame([(round(evaluation.top_over_bottom(evaluation.bin_means(pairs(spark, sf), 10)), 6),)], "ratio double")


RULES = (("fixed", None, 0.3, 0.0), ("budget", 0.01, None, 0.25))


@query(f"with c as (select * from (values ('fixed', cast(null as double), cast(0.3 as double), cast(0.0 as double)), ('budget', 0.01, null, 0.25)) v(rule, budget, fraction, rho)), a as (select c.*, x.alpha from c, (values (cast(0.05 as double)), (cast(0.01 as double))) x(alpha)), n as (select *, greatest(1, cast(round_even(100 * (1 - rho) / (1 + rho), 0) as bigint)) as trials from a), p as (select n.*, m.m, least(1.0, 491 * (select sum(exp(lgamma(trials + 1) - lgamma(k + 1) - lgamma(trials - k + 1) + k * ln(alpha) + (trials - k) * ln(1 - alpha))) from generate_series(1, 500) g(k) where k >= m.m and k <= trials)) as bound from n, generate_series(1, 500) m(m) where m.m <= trials), b as (select rule, alpha, min(m) / cast(any_value(trials) as double) as f from p where bound <= budget group by rule, alpha) select n.rule, round(max(coalesce(b.f, n.fraction)), 9) as fraction from n left join b on n.rule = b.rule and n.alpha = b.alpha group by n.rule")
def two_track_rule(spark, sf):
    """The stricter of two tracks' fractions, fixed or from a budget, over 5000 frames."""
    rows = []
    for name, budget, fraction, rho in RULES:
        config = {"window_frames": 100, "step_frames": 10, "false_alarm_budget": budget, "fraction_threshold": fraction, "frame_autocorrelation": rho}
        rows.append((name, round(false_alarm.two_track_rule(config, 95.0, 99.0, 5000)[0], 9)))
    return spark.createDataFrame(rows, "rule string, fraction double")


@query("select cast(count(*) as bigint) as n, round(64 * (count(*) - 1) / cast(count(*) as double), 3) as mean_square from embeddings")
def mahalanobis_trace(spark, sf):
    """Squared distances of the rows of the fit, in all 64 dimensions, average to the dimension."""
    x = _embedding_rows(spark, sf)
    s = models.Mahalanobis.fit(x, "features").score(x, "features")
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.col("score") * F.col("score")), 3).alias("mean_square"))


from driftmark.plans import catalogue_geometry  # noqa: E402, F401
