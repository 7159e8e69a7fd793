"""Exact percentiles without a buffer of all values.

A sketch gives each percentile a narrow bracket that is sure to hold it, as the sketch's error
is bounded. In a second pass rows are counted by cells: every value inside of a bracket is a
cell of its own, and all values between two brackets are one. So what one task orders is a
five-hundredth of a group's values, however large the group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketch is a share of 1 / ACCURACY; a bracket reaches MARGIN to both sides.
ACCURACY, MARGIN = 10_000, 0.001
#: Groups of up to so many rows are ordered whole.
SMALL = 4_000


def percentiles(rows: DataFrame, value: str | Column, shares: dict[str, float], by: tuple[str, ...] = (), digits: int | None = 6) -> DataFrame:
    """The columns `by` and one column for each of `shares` (name: share), with linear
    interpolation between the two nearest values. NULL values don't count; a group without
    others doesn't occur, and without `by` there is always one row."""
    x = F.col(value) if isinstance(value, str) else value
    keys = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    v = rows.select(*keys, x.cast("double").alias("_v")).where("_v is not null")
    names = [f"_b{i}" for i in range(len(by))]
    names_, ps = list(shares), list(shares.values())
    ends = [max(0.0, p - MARGIN) for p in ps] + [min(1.0, p + MARGIN) for p in ps]
    cut = v.groupBy(*names).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_q"))
    if by:
        cut_ = cut.select(*(F.col(c).alias(f"{c}_") for c in names), "_n", "_q")
        on = [v[c].eqNullSafe(cut_[f"{c}_"]) for c in names]
        joined = v.join(cut_, on).drop(*(f"{c}_" for c in names))
    else:
        joined = v.join(F.broadcast(cut))  # one row
    low = [F.get("_q", F.lit(i)) for i in range(len(ps))]
    high = [F.get("_q", F.lit(len(ps) + i)) for i in range(len(ps))]
    inside = F.col("_n") <= SMALL
    for lo, hi in zip(low, high):
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
    region = sum((F.when(F.col("_v") > hi, 1).otherwise(0) for hi in high), F.lit(0))
    cells = joined.groupBy(*names, F.when(inside, F.col("_v")).alias("_in"), F.when(~inside, region).alias("_out")).agg(F.count("*").alias("_c"), F.min("_v").alias("_m"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_m"))
    cells = cells.withColumn("_upto", upto)
    picks = []
    for i, p in enumerate(ps):
        rank = (F.col("_n") - 1) * F.lit(p)
        picks += [F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_m"))).alias(f"_f{i}"), F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_m"))).alias(f"_c{i}")]
    found = cells.groupBy(*names).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, (name, p) in enumerate(zip(names_, ps)):
        rank = (F.col("_n") - 1) * F.lit(p)
        a, b = F.col(f"_f{i}"), F.col(f"_c{i}")
        y = F.when(a == b, a).otherwise((F.ceil(rank) - rank) * a + (rank - F.floor(rank)) * b)
        out.append((F.round(y, digits) if digits is not None else y).alias(name))
    return found.select(*(F.col(c).alias(n) for c, n in zip(names, by)), *out)


def with_percentiles(summary: DataFrame, rows: DataFrame, value: str | Column, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """A summary, of one row or of one row for each group, with percentile columns."""
    p = percentiles(rows, value, shares, by)
    if not by:
        return summary.join(F.broadcast(p))  # one row each
    p = p.select(*(F.col(c).alias(f"{c}__") for c in by), *shares)
    return summary.join(p, [summary[c].eqNullSafe(p[f"{c}__"]) for c in by], "left").drop(*(f"{c}__" for c in by))
