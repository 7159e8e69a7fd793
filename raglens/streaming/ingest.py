"""Streams of spans: rollups with a watermark, sessions, and an idempotent upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raglens.streaming.log import KeyedLog


def rollup(spans: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Spans by kind and tumbling window; late rows are taken until the watermark passes."""
    return spans.withWatermark("start_time", late).groupBy(F.window("start_time", every).alias("w"), "kind").agg(F.count("*").alias("spans"), F.count_if("failed").alias("errors"))


def sessions(spans: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return spans.withWatermark("start_time", late).groupBy(F.session_window("start_time", gap).alias("w"), "session_id").agg(F.count("*").alias("spans"))


def latest(payloads: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last payload of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return payloads.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(table: DataFrame, payloads: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table after a batch: a key's newest payload replaces its row. A replay changes nothing."""
    new = latest(payloads, key, order)
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def keyed_log(spark: SparkSession, path: str, key: list[str], order: list[str], **sizes: int) -> KeyedLog:
    """A log that keeps the newest row of each key."""
    return KeyedLog(spark, path, key, lambda rows, by: latest(rows, by, order), **sizes)


def upsert_stream(stream: DataFrame, spark: SparkSession, path: str, key: list[str], order: list[str], checkpoint: str, **sizes: int):
    """Starts a query that drains the stream into the log under path; a batch that is run again
    changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        keyed_log(spark, path, key, order, **sizes).append(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
