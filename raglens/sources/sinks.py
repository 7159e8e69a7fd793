"""Sinks of evaluations, anomalies and vectors: frames of rows as they are stored, and a write
that can be run again. A run's rows are a folder of their own (run_id=...), so a write that is
repeated, or that lost executors broke off, replaces just these and adds nothing twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.functions.scalars import unit_vector
from raglens.operators.anomaly import feature_deviation, percentile_band

#: How the answers' scores were made, as a closed run states it.
METHOD = "deterministic_embedding"
#: Means that every closed run has, and those of runs with judged answers.
SCORES = ["faithfulness", "context_relevance", "answer_relevance", "citation_coverage", "unsupported_claim_ratio"]
JUDGED = ["judge_faithfulness", "judge_answer_relevance"]
#: Columns of a stored answer.
ANSWER = ["run_id", "trace_id", "question", "answer", "context", "reference_answer", *SCORES, *JUDGED, "judge_model", "claims", "duration_ms"]


def stored(rows: DataFrame, path: str, by: str = "run_id") -> None:
    """Writes rows under path, in place of what is there of the same `by` values; other rows stay."""
    rows.repartition(by, F.pmod(F.xxhash64(*rows.columns), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored_metrics(by_k: DataFrame, k: int) -> DataFrame:
    """One row (k, queries, metrics): the means at k as a JSON object, with those of every k
    under by_k. by_k: rows of metrics_by_k()."""
    names = [c for c in by_k.columns if c not in ("k", "queries")]
    each = F.struct(*(F.col(c).cast("double").alias(c) for c in names))
    rows = by_k.select(F.col("k").cast("int").alias("k"), "queries", each.alias("m"))
    one = rows.groupBy().agg(F.max_by("queries", F.col("k") == k).alias("queries"), F.max(F.when(F.col("k") == k, F.col("m"))).alias("m"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("k"), F.col("m"))))).alias("all"))
    return one.select(F.lit(k).alias("k"), "queries", F.to_json(F.struct("m.*", F.col("all").alias("by_k"))).alias("metrics"))


def retrieval_run(metrics: DataFrame, run_id: str, name: str, dataset: str, config: Column | None = None) -> DataFrame:
    """The row of a finished retrieval run. metrics: stored_metrics()."""
    c = F.lit("{}") if config is None else config
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("name"), F.lit(dataset).alias("dataset_name"), F.lit("retrieval").alias("evaluation_type"), F.lit("completed").alias("status"), "k", F.col("queries").alias("num_queries"), "metrics", c.alias("config"))


def retrieval_results(metrics: DataFrame, hits: DataFrame, relevant: DataFrame, run_id: str, k: int) -> DataFrame:
    """run_id, query_id, k, metrics (JSON), retrieved, relevant (ids as text; the retrieved ones
    by rank) of every query of retrieval_metrics()."""
    near = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))).getField("d").alias("retrieved"))
    own = relevant.groupBy("query_id").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("relevant"))
    names = [c for c in metrics.columns if c != "query_id"]
    rows = metrics.select("query_id", F.to_json(F.struct(*names)).alias("metrics")).join(near, "query_id", "left").join(own, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(F.lit(run_id).alias("run_id"), "query_id", F.lit(k).alias("k"), "metrics", F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("relevant", none).alias("relevant"))


def answer_rows(rows: DataFrame) -> DataFrame:
    """Evaluated answers as they are stored: columns that rows lack, such as those of a judge
    that wasn't asked, are NULL, and so are a context and claims without entries."""
    types = {c: "double" for c in (*SCORES, *JUDGED, "duration_ms")} | {"context": "array<string>", "claims": "array<string>"}
    out = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in ANSWER))
    return out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("context", "claims")})


def closed_runs(answers: DataFrame) -> DataFrame:
    """run_id, status, num_items, method and the means of what was measured, 0.0 where nothing
    was; a judge's means are NULL for a run without judged answers. A row with the judge's
    faithfulness is a judged one. answers: answer_rows()."""
    judged = F.col("judge_faithfulness").isNotNull()
    own = [F.when(F.count_if(judged) > 0, F.coalesce(F.avg(F.when(judged, F.col(c))), F.lit(0.0))) for c in JUDGED]
    return answers.groupBy("run_id").agg(
        F.lit("completed").alias("status"),
        F.count("*").alias("num_items"),
        F.lit(METHOD).alias("method"),
        *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in SCORES),
        *(F.round(x, 6).alias(c) for c, x in zip(JUDGED, own)),
    )


def anomaly_rows(found: DataFrame, rows: DataFrame, features: list[str], key: str, method: str = "isolation_forest") -> DataFrame:
    """The stored rows of flagged ones: the feature that strayed most, its value and band, the
    score, and the bands and deviations of all features as JSON. found: key, score, flagged;
    rows: key, application_id and the features of the window."""
    rows = rows.dropna(subset=features)
    band = percentile_band(rows, features, None)
    bands = F.broadcast(band.groupBy().agg(*(F.max(F.when(F.col("feature") == f, F.struct("low", "high"))).alias(f) for f in features)).select(F.struct(*features).alias("_bands")))  # one row
    flagged = found.where("flagged").select(key, F.col("score").alias("anomaly_score"))
    x = flagged.join(rows.select(key, "application_id", F.struct(*(F.col(f).cast("double").alias(f) for f in features)).alias("_x")), key).join(feature_deviation(rows, features, key), key).join(bands)
    at = lambda of: F.coalesce(*(F.when(F.col("peak_feature") == f, of(f)) for f in features))
    evidence = F.to_json(F.struct(F.lit(method).alias("detection_method"), F.array(*map(F.lit, features)).alias("features_examined"), F.struct(*(F.col(f"{f}_dev").alias(f) for f in features)).alias("feature_deviation"), F.col("_bands").alias("window_band")))
    return x.select(
        key,
        "application_id",
        F.lit("feature_outlier").alias("anomaly_type"),
        "severity",
        F.col("peak_feature").alias("metric"),
        at(lambda f: F.col("_x")[f]).alias("observed_value"),
        at(lambda f: F.col("_bands")[f]["low"]).alias("expected_low"),
        at(lambda f: F.col("_bands")[f]["high"]).alias("expected_high"),
        "anomaly_score",
        evidence.alias("evidence"),
    )


def save_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding") -> None:
    """Writes a vector index: the ids with their vectors, of length one; rows without either
    are left out."""
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0))
    rows.select(F.col(id_col).alias("vec_id"), unit_vector(F.col(vector)).alias("embedding")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, embedding of an index; vectors of several lengths are an error."""
    rows = spark.read.parquet(path)
    sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"the index holds vectors of {sizes['a']} to {sizes['b']} entries")
    return rows
