"""The most frequent prefixes of texts, exact.

A mergeable summary of bounded size (frequent items) names candidates in one pass, and a second
pass counts these alone, so that what is shuffled are candidates. A summary bounds what any
prefix that it doesn't name may count; where the k-th exact count is above that bound, the
candidates' order is proven. Where it isn't, as the counts are flat, the rest is counted too:
first by hash, of which only those that reach the k-th count so far can matter, then by prefix.

Defined results: NULL texts don't count, an empty text is a prefix. Ties go to the lesser text,
by code points. No texts give no rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefixes that a summary tracks, and those of them that are counted exactly.
TRACKED, CANDIDATES = 8_192, 512
#: A summary's error is a share of 3.5 / (its map's size), a power of two that TRACKED fills by 3/4.
ERROR = 3.5 / 2 ** math.ceil(math.log2(TRACKED / 0.75))


def _counts(prefixes: DataFrame) -> DataFrame:
    return prefixes.groupBy("prefix").agg(F.count("*").alias("n"))


def top_prefixes(texts: DataFrame, text: str = "text", length: int = 200, k: int = 20) -> DataFrame:
    """rank, prefix, n, share (of all texts) of the k most frequent prefixes."""
    spark = texts.sparkSession
    prefixes = texts.where(F.col(text).isNotNull()).select(F.left(text, F.lit(length)).alias("prefix"))
    facts = prefixes.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(prefix, {CANDIDATES}, {TRACKED})").alias("top")).first()
    n, named = facts["n"], [(x["item"], x["count"]) for x in facts["top"] or []]
    # a summary that never forgot holds every text
    whole = len(named) < CANDIDATES and sum(c for _, c in named) == n
    unseen = 0 if whole else max(ERROR * n, named[-1][1] if len(named) == CANDIDATES else 0)
    order = [F.desc("n"), "prefix"]
    candidates = spark.createDataFrame([(p,) for p, _ in named], "prefix string")
    found = _counts(prefixes.join(F.broadcast(candidates), "prefix", "left_semi")).orderBy(*order).limit(k).collect()
    least = found[-1]["n"] if len(found) == k else 0
    if whole or least > unseen:
        best = spark.createDataFrame(found, "prefix string, n long")
    else:
        if least > 1:
            h = F.xxhash64("prefix").alias("_h")
            enough = prefixes.select(h).groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_h")
            prefixes = prefixes.withColumn("_h", h).join(enough, "_h", "left_semi").drop("_h")
        best = _counts(prefixes).orderBy(*order).limit(k)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "prefix"))).alias("_l"))  # k rows
    listed = listed.select(F.posexplode("_l").alias("i", "x"))
    return listed.select((F.col("i") + 1).alias("rank"), "x.prefix", (-F.col("x.m")).alias("n"), F.round(-F.col("x.m") / F.lit(n), 9).alias("share"))
