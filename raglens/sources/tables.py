"""Tables and the telemetry views over them. A view is a plan: nothing is read until used,
and only the columns that a query needs reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def organizations(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def applications(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("organization_id"))


def api_keys(spark: SparkSession, at: str) -> DataFrame:
    owner = applications(spark, at).select(F.col("id").alias("_a"), "organization_id")
    keys = table(spark, at, "supplier")
    return keys.join(owner, keys.s_nationkey == F.col("_a")).select(F.col("s_suppkey").alias("id"), "organization_id")


def users(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("external_id"), F.col("c_nationkey").alias("application_id"))


def models(spark: SparkSession, at: str) -> DataFrame:
    """One row per (provider, name): prices per thousand tokens and context window."""
    part = table(spark, at, "part")
    return part.groupBy(F.col("p_type").alias("provider"), F.col("p_brand").alias("name")).agg(
        (F.max("p_size") * 1024).cast("long").alias("context_window"),
        F.min("p_retailprice").alias("input_cost_per_1k"),
        F.max("p_retailprice").alias("output_cost_per_1k"),
        (F.min("p_size") < 5).alias("is_local"),
    )


def traces(spark: SparkSession, at: str) -> DataFrame:
    owner = table(spark, at, "customer").select("c_custkey", F.col("c_nationkey").alias("application_id"))
    o = table(spark, at, "orders")
    return o.join(owner, o.o_custkey == owner.c_custkey).select(
        F.col("o_orderkey").alias("trace_id"),
        "application_id",
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("start_time"),
        F.col("o_totalprice").alias("duration_ms"),
        F.col("o_orderpriority").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("error"),
    )


def llm_calls(spark: SparkSession, at: str, model: bool = True, application: bool = True) -> DataFrame:
    """Calls; without their model and provider, or their application, where these aren't asked for."""
    out = table(spark, at, "lineitem")
    more: list = []
    if application:
        trace = table(spark, at, "orders").select("o_orderkey", "o_custkey")
        owner = table(spark, at, "customer").select("c_custkey", F.col("c_nationkey").alias("application_id"))
        out = out.join(trace, out.l_orderkey == trace.o_orderkey).join(owner, F.col("o_custkey") == F.col("c_custkey"))
        more.append("application_id")
    if model:
        part = table(spark, at, "part").select("p_partkey", F.col("p_brand").alias("model"), F.col("p_type").alias("provider"))
        out = out.join(part, F.col("l_partkey") == F.col("p_partkey"))
        more += ["model", "provider"]
    return out.select(
        F.col("l_orderkey").alias("trace_id"),
        F.col("l_linenumber").alias("call_no"),
        *more,
        F.floor(F.col("l_quantity") * 100).cast("long").alias("input_tokens"),
        F.floor("l_extendedprice").cast("long").alias("output_tokens"),
        F.col("l_extendedprice").alias("latency_ms"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(6,2)")).cast("decimal(20,4)").alias("cost"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("success").alias("status"),
    )


def retrieved_documents(spark: SparkSession, at: str) -> DataFrame:
    """The documents of each trace's one retrieval, by rank."""
    part = table(spark, at, "part")
    line = table(spark, at, "lineitem")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("trace_id"),
        F.col("l_linenumber").alias("rank"),
        F.col("l_partkey").cast("string").alias("document_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_brand", F.col("l_suppkey").cast("string")).alias("content"),
        (1 - F.col("l_discount").cast("decimal(6,2)")).cast("double").alias("final_score"),
        F.col("l_shipdate").alias("created_at"),
    )


def retrieval_calls(spark: SparkSession, at: str) -> DataFrame:
    """trace_id, created_at, num_results, top_score."""
    return retrieved_documents(spark, at).groupBy("trace_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("num_results"), F.max("final_score").alias("top_score"))


def answer_evaluations(spark: SparkSession, at: str) -> DataFrame:
    """Judged answers: some have no faithfulness."""
    return traces(spark, at).select(
        "trace_id",
        "application_id",
        F.col("kind").alias("run_id"),
        F.col("start_time").alias("created_at"),
        F.when(F.col("error").isNull(), (F.col("trace_id") % 101) / 100.0).alias("faithfulness"),
        ((F.col("user_id") % 97) / 96.0).alias("answer_relevance"),
    )


def anomalies(spark: SparkSession, at: str) -> DataFrame:
    return traces(spark, at).where("error is not null").select(
        F.col("trace_id").alias("id"), "application_id", F.col("start_time").alias("detected_at"), F.lit("feature_outlier").alias("anomaly_type"), F.element_at(F.split("kind", "-"), 1).alias("severity"), (F.col("trace_id") % 2 == 0).alias("resolved")
    )


def recommendations(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("application_id"), F.col("s_name").alias("title"), (F.col("s_acctbal") / 10000).alias("severity"), (F.col("s_suppkey") % 3 == 0).alias("dismissed"))


def spans(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").select(
        F.col("event_id").alias("span_id"),
        F.col("user_id").alias("session_id"),
        F.col("ts").alias("start_time"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("duration_ms"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("props").alias("attributes"),
    )
