"""Exact order statistics of columns of any size.

Approximate edges cut the values into ranges, the ranges are counted, and only
those that hold a wanted rank are looked into further, until a range is one value
or small enough for one task. Each pass is a partial aggregation with a few result
rows, so no task ever holds the whole column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows, one task orders the values itself.
ONE_TASK_ROWS = 500_000
PARTS = 128


def _clean(df: DataFrame, column: str, group: str) -> DataFrame:
    """(g, v); nulls and NaN have no rank."""
    v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return df.select(F.col(group).cast("int").alias("g"), v.alias("v")).where("v is not null")


def _at(rows: DataFrame, n: dict[int, int], wanted: dict[int, set[int]], limit: int) -> dict[int, dict[int, float]]:
    """The values of 0-based ranks within each group of the rows (g, v); group g has ``n[g]``. All groups share each pass."""
    found: dict[int, dict[int, float]] = {g: {} for g in wanted}
    literal = lambda x: F.create_map(*[c for g, v in x.items() for c in (F.lit(g), F.array(*map(F.lit, sorted(v))))])[F.col("g")]
    small = {g: k for g, k in wanted.items() if k and n[g] <= limit}
    large = {g: k for g, k in wanted.items() if k and n[g] > limit}
    if small:
        counts = rows.where(F.col("g").isin(*small)).groupBy("g", "v").agg(F.count("*").alias("c"))
        upto = counts.select("g", "v", "c", F.sum("c").over(Window.partitionBy("g").orderBy("v")).alias("upto"))
        hits = upto.where(F.exists(literal(small), lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("c"))))
        for r in hits.collect():
            found[r.g] |= {k: r.v for k in small[r.g] if r.upto - r.c <= k < r.upto}
    if not large:
        return found
    rows = rows.where(F.col("g").isin(*large))
    at = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    marks = literal({r.g: set(r.e) for r in rows.groupBy("g").agg(F.percentile_approx("v", at, F.lit(10_000)).alias("e")).collect()})
    # values equal to an edge are a range of their own, so every range is smaller than the whole
    part = F.size(F.filter(marks, lambda e: e <= F.col("v"))) + F.size(F.filter(marks, lambda e: e < F.col("v")))
    ranges, before = [], dict.fromkeys(large, 0)
    for r in rows.groupBy("g", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "part").collect():
        inside = {k for k in large[r.g] if before[r.g] <= k < before[r.g] + r.n}
        if r.low == r.high:
            found[r.g] |= dict.fromkeys(inside, r.low)
        elif inside:
            ranges.append((r, before[r.g], inside))
        before[r.g] += r.n
    if ranges:
        label = F.coalesce(*[F.when((F.col("g") == r.g) & (F.col("v") >= r.low) & (F.col("v") <= r.high), F.lit(i)) for i, (r, _, _) in enumerate(ranges)])
        within = _at(rows.select(label.alias("g"), "v").where("g is not null"), {i: r.n for i, (r, _, _) in enumerate(ranges)}, {i: {k - b for k in inside} for i, (_, b, inside) in enumerate(ranges)}, limit)
        for i, (r, b, _) in enumerate(ranges):
            found[r.g] |= {k + b: v for k, v in within[i].items()}
    return found


def _spots(n: int, fractions: list[float]) -> list[float]:
    return [(n - 1) * float(q) for q in fractions]


def _ends(spots: list[float]) -> set[int]:
    return {math.floor(s) for s in spots} | {math.ceil(s) for s in spots}


def _between(at: dict[int, float], spots: list[float]) -> list[float]:
    out = []
    for s in spots:
        low, high = at[math.floor(s)], at[math.ceil(s)]
        out.append(low if low == high else low * (1 - (s - math.floor(s))) + high * (s - math.floor(s)))
    return out


def percentiles(df: DataFrame, column: str, fractions: list[float], limit: int = ONE_TASK_ROWS) -> list[float | None]:
    """Interpolated percentiles at ``fractions``; None of an empty column."""
    return percentiles_by(df.withColumn("__g", F.lit(0)), "__g", column, fractions, limit).get(0, [None] * len(fractions))


def percentiles_by(df: DataFrame, group: str, column: str, fractions: list[float], limit: int = ONE_TASK_ROWS) -> dict[int, list[float]]:
    """The same within each of a few groups (int), in as many jobs as for one; groups without values are missing."""
    rows = _clean(df, column, group)
    n = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    spots = {g: _spots(m, fractions) for g, m in n.items()}
    at = _at(rows, n, {g: _ends(s) for g, s in spots.items()}, limit)
    return {g: _between(at[g], s) for g, s in spots.items()}


def largest(df: DataFrame, column: str, k: int, n: int | None = None, limit: int = ONE_TASK_ROWS) -> float:
    """The k-th largest value."""
    rows = _clean(df.withColumn("__g", F.lit(0)), column, "__g")
    n = rows.count() if n is None else n
    return _at(rows, {0: n}, {0: {n - k}}, limit)[0][n - k]
