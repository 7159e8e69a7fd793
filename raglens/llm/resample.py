"""Importance resampling towards a target distribution over hashed n-grams.

1. A position table: posexplode gives every word of a text its place, and lead() over a
   document's places the words behind it, whose concatenations are the runs of each order. For
   orders above 1 the texts are dealt by document before they are split, so that the words
   themselves aren't shuffled. The buckets of the runs are written once.
2. Both corpora are counted by bucket, pre-aggregated in each task. A bucket's gain is the
   logarithm of how much likelier it is in the target; the table of gains has one row for each
   bucket, so `buckets` bounds what is broadcast.
3. Gains are joined to the runs and summed by document, again pre-aggregated.
4. A score adds Gumbel noise, drawn from a hash of the seed and the id, to the mean gain; the
   highest scores are a sample without replacement in proportion to exp(mean gain). Scores are
   ranked by ranges and their counts, never in one task.

Defined results: null and empty texts, and texts without words, have no runs, the weight 0 and
no part in the draw unless `least` is 0. A null id is drawn with the text `null` in its hash.
Repeated rows are scored and drawn each; rows of equal score and id keep any order among them.
Without target texts all gains follow the corpus alone. Further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.llm.common import materialise, placed
from raglens.llm.merkle import lower_ascii

#: A word, once A-Z are lower-cased: digits, a-z and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def runs(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """row, doc_id, k, bucket: the runs of 1 to `orders` consecutive words of rows (row, doc_id,
    text); a row without words has one with null k and bucket."""
    if orders > 1:
        rows = rows.repartition("row")
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    at = rows.select("row", "doc_id", F.posexplode_outer(words).alias("pos", "word"))
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    if orders == 1:
        return at.select("row", "doc_id", F.when(F.col("word").isNotNull(), 1).alias("k"), bucket(F.col("word")).alias("bucket"))
    behind = Window.partitionBy("row").orderBy("pos")
    at = at.select("row", "doc_id", "word", *(F.lead("word", j).over(behind).alias(f"_{j}") for j in range(1, orders)))
    run = lambda k: F.concat_ws(" ", "word", *(f"_{j}" for j in range(1, k)))
    last = lambda k: F.col(f"_{k - 1}" if k > 1 else "word")
    every = F.array(*(F.when(last(k).isNotNull(), F.struct(F.lit(k).alias("k"), bucket(run(k)).alias("bucket"))) for k in range(1, orders + 1)))
    there = F.filter(every, lambda x: x.isNotNull())
    return at.select("row", "doc_id", F.explode_outer(there).alias("x")).select("row", "doc_id", "x.k", "x.bucket")


def numbered(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))


def counts(found: DataFrame) -> DataFrame:
    return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("c"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int, scale: int) -> DataFrame:
    """bucket, gain of the buckets that the corpus has; of counts (bucket, c)."""
    total = lambda c: float(c.agg(F.sum("c")).first()[0] or 0)
    s_all, t_all = F.lit(total(corpus)), F.lit(total(target))
    both = corpus.select("bucket", F.col("c").cast("double").alias("s")).join(target.select("bucket", F.col("c").cast("double").alias("t")), "bucket", "left").fillna(0.0)
    one, all_ = F.lit(1.0), F.lit(float(buckets))
    return both.select("bucket", F.floor(scale * F.log(((F.col("t") + one) * (s_all + all_)) / ((F.col("s") + one) * (t_all + all_)))).alias("gain"))


def noise(id_col: Column, seed: int, scale: int) -> Column:
    """Gumbel noise, scaled and rounded down, of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(found: DataFrame, gain: DataFrame) -> DataFrame:
    """row, doc_id, n_features, n_words, weight of every row of runs(); gain has at most one row
    for each bucket."""
    x = found.join(F.broadcast(gain), "bucket", "left")
    sums = x.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.count(F.when(F.col("k") == 1, 1)).alias("n_words"), F.sum("gain").alias("_s"))
    # the floor of the mean in integers, for sums of any sign
    return sums.select("row", "doc_id", "n_features", "n_words", F.expr("if(n_features > 0, (_s - pmod(_s, n_features)) div n_features, 0L)").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, scale: int = 1000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank counts the percentage of the
    rows with at least `least` words that is drawn and is null for all others."""
    found = materialise(runs(numbered(docs, id_col, text), orders, buckets), "runs")
    goal = runs(numbered(target.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), "id", "text"), orders, buckets)
    gain = materialise(gains(materialise(counts(found), "corpus"), materialise(counts(goal), "target"), buckets, scale), "gains")
    w = weights(found, gain)
    w = w.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale)).withColumn("enough", F.col("n_words") >= least)
    # those that take part come first
    w = placed(w, [F.desc("enough"), F.desc("score"), F.asc("doc_id"), F.asc("row")], "scores", column="place")
    drawn = w.agg(F.count_if("enough")).first()[0] * percent // 100
    return w.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
