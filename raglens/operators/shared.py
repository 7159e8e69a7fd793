"""Reports whose sections share scans: every table is grouped in all ways that the sections need
by one aggregate (grouping sets), percentiles of all groupings come from one pair of passes, and
the groups turn into the report's rows (section, key, metric, value) without a plan for each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raglens.operators.percentiles import with_percentiles


@dataclass(frozen=True)
class Section:
    """A report's section: the metrics of the groups of one grouping. key: what names a group,
    '' for the only one."""

    name: str
    grouping: str
    metrics: list[str]
    key: Column | None = None


@dataclass(frozen=True)
class Groups:
    """What grouped() returns, with the columns that tell its groups apart."""

    rows: DataFrame
    keys: list[str]


def grouped(rows: DataFrame, sets: dict[str, tuple[str, ...]], measures: dict[str, Column], shares: dict[str, float] | None = None, value: str = "", of: tuple[str, ...] = ()) -> Groups:
    """The groups of rows in each of `sets` (name: columns): columns `grouping`, all columns of
    the sets, NULL where they aren't the set's own, and the measures. shares: percentiles
    (name: share) of the column `value` for the groupings `of`, NULL for others.

    A set without columns has one group, of an empty table too. A NULL in a set's own column is
    a group like others. The rows are read once, and twice more for percentiles."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    ids = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for name, s in sets.items()}
    if len(set(ids.values())) < len(ids):
        raise ValueError("two groupings have the same columns")
    named = [c.alias(n) for n, c in measures.items()]
    if keys:
        sums = rows.groupingSets([[F.col(k) for k in s] for s in sets.values()], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("_id"), *named)
        tag = F.coalesce(*(F.when(F.col("_id") == i, name) for name, i in ids.items()))
        out = sums.select(tag.alias("grouping"), *keys, *measures)
    else:
        out = rows.agg(*named).select(F.lit(next(iter(sets))).alias("grouping"), *measures)
    if shares:
        each = [F.struct(F.lit(n).alias("grouping"), *((F.col(k) if k in sets[n] else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys)) for n in of]
        values = rows.select(F.explode(F.array(*each)).alias("_g"), F.col(value).alias("_value")).where("_value is not null").select("_g.*", "_value")
        out = with_percentiles(out, values, "_value", shares, ("grouping", *keys))
    whole = [n for n, s in sets.items() if not s]
    if keys and whole:
        # grouping sets over no rows have no groups: the only group of an empty table
        none = rows.sparkSession.createDataFrame([], rows.schema).agg(*named)
        nulls = [F.lit(None).cast(out.schema[k].dataType).alias(k) for k in [*keys, *(shares or ())]]
        out = out.withColumn("_filler", F.lit(0)).unionByName(none.select(F.lit(whole[0]).alias("grouping"), *nulls, *measures, F.lit(1).alias("_filler")))
    else:
        out = out.withColumn("_filler", F.lit(0))
    return Groups(out, keys)


def kept(groups: Groups, grouping: str, order: list[Column], limit: int) -> Groups:
    """The groups, of one grouping only the first `limit`."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("grouping").orderBy(*order))
    return Groups(groups.rows.withColumn("_n", n).where((F.col("grouping") != grouping) | (F.col("_n") <= limit)).drop("_n"), groups.keys)


def sections(groups: Groups, *parts: Section) -> DataFrame:
    """The rows of the sections; for report()."""
    tie = F.to_json(F.struct(*groups.keys), {"ignoreNullFields": "false"}) if groups.keys else F.lit("")
    each = []
    for p in parts:
        k = F.lit("") if p.key is None else p.key.cast("string")
        values = F.array(*(F.struct(F.lit(p.name).alias("section"), k.alias("key"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in p.metrics))
        each.append(F.when(F.col("grouping") == p.grouping, values))
    found = F.explode(F.flatten(F.array_compact(F.array(*each))))
    return groups.rows.select(tie.alias("_tie"), "_filler", found.alias("x")).select("x.*", "_tie", "_filler")


def skeleton(buckets: DataFrame, name: str, key: Column, metrics: list[str]) -> DataFrame:
    """The rows of a series without anything in it; for report()."""
    each = F.array(*(F.lit(m) for m in metrics))
    return buckets.select(F.lit(name).alias("section"), key.cast("string").alias("key"), F.explode(each).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("").alias("_tie"), F.lit(1).alias("_filler"))


def report(*rows: DataFrame, series: str = "series") -> DataFrame:
    """The rows (section, key, metric, value) of sections() and skeleton(). What fills in for a
    missing group gives way to the group; rows of a series are told apart by their key alone,
    and those outside its skeleton are left out. Other groups of the same key stay apart."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    tie = F.when(F.col("section") == series, "").otherwise(F.col("_tie"))
    one = out.groupBy("section", "key", "metric", tie.alias("_tie")).agg(F.min_by("value", "_filler").alias("value"), F.max("_filler").alias("_filler"))
    return one.where((F.col("section") != series) | (F.col("_filler") == 1)).select("section", "key", "metric", "value")
