"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a session of one process
    (tests) takes a folder of its own; a cluster has no other."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_scratch_dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark._scratch_dir = f"file://{tempfile.mkdtemp(prefix='raglens-')}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what reads it several times computes it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, *tables: DataFrame, name: str = "report") -> DataFrame:
    """df as a written table, after which the written tables that it was made of are deleted."""
    out = written(df, name)
    for x in tables:
        removed(x)
    return out
