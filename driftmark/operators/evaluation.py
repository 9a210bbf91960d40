"""Detector evaluation: conformal thresholds, separation, correlation and bins.

Every statistic is an aggregation with a fixed number of result rows; ranks come
from counts by distinct score, so no step needs one global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators import ranks


def conformal_threshold(scores: DataFrame, alpha: float, column: str = "score") -> float:
    """The k-th largest score, k = ceil((n + 1) alpha) within 1 and n; nulls and NaN are no scores."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must be between 0 and 1, not {alpha}")
    n = scores.where(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).isNotNull()).count()
    if n == 0:
        raise ValueError("no scores")
    return ranks.largest(scores, column, min(max(math.ceil((n + 1) * alpha), 1), n), n)


PARTS = 64


def _part(df: DataFrame, column: str) -> Column:
    """The number of a row's range of ``column``; ranges hold about equally many rows."""
    at = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    edges = sorted(set(df.agg(F.percentile_approx(column, at, F.lit(2000))).first()[0] or []))
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(column)))


def running(df: DataFrame, column: str, order: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with running sums along ``order``, which starts with ``column``.

    Totals of at most ``PARTS`` ranges are summed first, then rows within their
    range: no task sorts more than one range.
    """
    way = F.desc if descending else F.asc
    rows = df.withColumn("__part", _part(df, column))
    before = Window.orderBy(way("__part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(totals), "__part")
    return out.withColumns({n: F.col(f"__{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop("__part", *[f"__{n}" for n in sums])


def _by_score(df: DataFrame) -> DataFrame:
    """Distinct scores with counts of each label (score, label 0/1), and running counts from above."""
    grouped = df.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    return running(grouped, "score", ["score"], {"tp": "pos", "fp": "neg"}, descending=True)


def separation(df: DataFrame) -> DataFrame:
    """One row: auroc and average_precision of (score, label); null if a label is missing."""
    by = _by_score(df)
    p, n = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * (F.lit(0.5) * F.col("neg")) + F.col("neg") * (F.col("tp") - F.col("pos")))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return by.agg(F.try_divide(wins, (p * n).cast("double")).alias("auroc"), F.when(n > 0, F.try_divide(ap, p.cast("double"))).alias("average_precision"))


def detection_metrics(normal: DataFrame, abnormal: DataFrame, alpha: float = 0.01) -> dict:
    """Separation of two score columns, and the rate detected at the conformal threshold."""
    (n0, m0), (n1, m1) = ((d.count(), ranks.percentiles(d, "score", [0.5])[0]) for d in (normal, abnormal))
    out = {"n_in_distribution": n0, "n_abnormal": n1, "median_score_in_distribution": m0, "median_score_abnormal": m1, "false_flag_rate": alpha, "auroc": None, "average_precision": None, "detection_rate": None, "threshold": None}
    if n0 and n1:
        both = normal.select("score", F.lit(0).alias("label")).unionAll(abnormal.select("score", F.lit(1).alias("label")))
        out["auroc"], out["average_precision"] = separation(both).first()
        out["threshold"] = conformal_threshold(normal, alpha)
        out["detection_rate"] = abnormal.agg(F.avg((F.col("score") > out["threshold"]).cast("double"))).first()[0]
    return out


def force_error(reference: Column, predicted: Column, metric: str = "mae") -> Column:
    """Per-frame error of arrays of 3-vectors: mean absolute, root mean square, or the largest atom's."""
    d = F.zip_with(reference, predicted, lambda a, b: F.zip_with(a, b, lambda x, y: y - x))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    flat = F.flatten(d)
    if metric == "mae":
        return total(F.transform(flat, F.abs)) / F.size(flat)
    if metric == "rmse":
        return F.sqrt(total(F.transform(flat, lambda x: x * x)) / F.size(flat))
    if metric == "max":
        return F.array_max(F.transform(d, lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))))
    raise ValueError(f"metric is 'mae', 'rmse' or 'max', not {metric!r}")


def force_magnitudes(frames: DataFrame, column: str = "forces") -> DataFrame:
    """One row: how many atoms, and the mean and largest length of their vectors."""
    size = F.transform(column, lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)))
    per = frames.select(F.size(column).cast("long").alias("n"), F.aggregate(size, F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max(size).alias("most"))
    return per.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("max"))


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with mid-ranks of a column, from counts of its distinct values."""
    counts = df.groupBy(column).agg(F.count("*").alias("__m"))
    ranked = running(counts, column, [column], {"__upto": "__m"}).select(column, (F.col("__upto") - (F.col("__m") - 1) / F.lit(2.0)).alias(name))
    return df.join(ranked, column)


def finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1) if f != 1.0 else front


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, from Student's t."""
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return _beta_tail((n - 2) / 2, 0.5, 1 - r * r)


def correlation(df: DataFrame, x: str, y: str) -> dict:
    """Spearman and Pearson over finite pairs, with p-values; at least three pairs. None of a constant side."""
    pairs = finite(df.select(x, y), x, y).persist()
    try:
        ranked = mid_ranks(mid_ranks(pairs, x, "__rx"), y, "__ry")
        n, rho, r = ranked.agg(F.count("*"), *[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)) for a, b in (("__rx", "__ry"), (x, y))]).first()
    finally:
        pairs.unpersist()
    if n < 3:
        raise ValueError(f"at least 3 finite pairs are needed, not {n}")
    return {"n": n, "spearman": rho, "spearman_p": correlation_p(rho, n), "pearson": r, "pearson_p": correlation_p(r, n)}


def _plain() -> list[Column]:
    return [F.count("*").alias("n"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("error").alias("error_mean")]


def _binned(df: DataFrame, n_bins: int, order: str) -> tuple[DataFrame, int]:
    """(bin, score, error) in equal-count bins of the score, and the rows of the smallest bin; ties by ``order``."""
    if n_bins < 2:
        raise ValueError("at least 2 bins are needed")
    rows = running(df.withColumn("__one", F.lit(1).cast("long")), "score", ["score", order], {"__at": "__one"})
    n = df.count()
    big, size = n % n_bins, n // n_bins  # the first ``big`` bins hold one more
    at = F.col("__at") - 1
    place = F.when(at < big * (size + 1), F.floor(at / (size + 1))).otherwise(big + F.floor((at - big * (size + 1)) / max(size, 1))).cast("int")
    return rows.select(place.alias("bin"), "score", "error"), size


def bin_means(df: DataFrame, n_bins: int = 10, order: str = "frame") -> DataFrame:
    """``error_bins`` without the median and the percentile."""
    return _binned(df, n_bins, order)[0].groupBy("bin").agg(*_plain())


def error_bins(df: DataFrame, n_bins: int = 10, order: str = "frame") -> DataFrame:
    """Errors by equal-count bins of the score (score, error); ties by ``order``."""
    binned, size = _binned(df, n_bins, order)
    if size <= ranks.ONE_TASK_ROWS:  # a bin fits into a task
        return binned.groupBy("bin").agg(*_plain(), F.percentile("error", F.lit(0.5)).alias("error_median"), F.percentile("error", F.lit(0.95)).alias("error_p95"))
    binned = binned.persist()
    found = ranks.percentiles_by(binned, "bin", "error", [0.5, 0.95], ranks.ONE_TASK_ROWS)
    middle = df.sparkSession.createDataFrame([(b, *found.get(b, (None, None))) for b in range(n_bins)], "bin int, error_median double, error_p95 double")
    return binned.groupBy("bin").agg(*_plain()).join(F.broadcast(middle), "bin")


def bin_report(binned: DataFrame) -> DataFrame:
    """(bin, n_frames, score_min, score_max) of rows (bin, score)."""
    return binned.groupBy("bin").agg(F.count("*").alias("n_frames"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))


def top_over_bottom(bins: DataFrame) -> float | None:
    n, top, bottom = bins.agg(F.count("*"), F.max_by("error_mean", "bin"), F.min_by("error_mean", "bin")).first()
    return top / bottom if n >= 2 and bottom > 0 else None


def bin_edges(scores: DataFrame, n_bins: int, scheme: str = "quantile", tail_from: float = 0.9) -> list[float]:
    """Quantile edges; ``tail-enriched`` spends half of the bins above ``tail_from``."""
    if scheme == "quantile":
        at = [i / n_bins for i in range(n_bins + 1)]
    elif scheme == "tail-enriched":
        tail = max(1, n_bins // 2)
        bulk = n_bins - tail
        at = [tail_from * i / bulk for i in range(bulk)] if bulk else []
        at += [tail_from + (1 - tail_from) * i / tail for i in range(tail + 1)]
    else:
        raise ValueError(f"scheme is 'quantile' or 'tail-enriched', not {scheme!r}")
    return ranks.percentiles(scores, "score", [min(q, 1.0) for q in at])


def digitise(score: Column, edges: list[float]) -> Column:
    """The bin of a score: closed on the left, the last bin on both sides."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e <= score))
