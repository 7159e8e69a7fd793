"""Sources of files: folders of texts, and labelled datasets of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def title_of(text: Column, name: Column) -> Column:
    """The first heading of the first level, else the first line that isn't blank (200
    characters at most), else the file's name without its ending."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(\S.*?)[ \t]*$", 1))
    line = F.left(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S.*)$", 1)), F.lit(200))
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.when(heading != "", heading).when(line != "", line).otherwise(stem)


def documents(spark: SparkSession, folder: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """source (the path within the folder), title, content, content_hash of all texts below a
    folder, by source; blank files are left out."""
    root = folder.rstrip("/").removeprefix("file://")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = rows.select(F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), r"^file:/*", "/").alias("path"), F.col("value").alias("content"))
    rows = rows.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    source = F.substr("path", F.lit(len(root) + 2))
    return rows.select(source.alias("source"), title_of(F.col("content"), F.col("path")).alias("title"), "content", F.sha2("content", 256).alias("content_hash")).orderBy("source")


_FIELDS = {
    "query": "string",
    "question": "string",
    "text": "string",
    "relevant_document_ids": "array<string>",
    "relevant_documents": "array<string>",
    "relevance_grades": "map<string,string>",
    "grades": "map<string,string>",
    "category": "string",
    "no_answer": "boolean",
}


def examples(lines: DataFrame, column: str = "value") -> DataFrame:
    """query, relevant, grades, category, no_answer, bad of lines that are a JSON object each,
    either of one question or of `examples`. A line that is neither, or has no question, is bad."""
    inner = ",".join(f"{k}:{v}" for k, v in _FIELDS.items())
    whole = F.from_json(column, f"struct<{inner},examples:array<struct<{inner}>>>")
    rows = lines.where(F.trim(column) != "").select(whole.alias("w"))
    one = F.array(F.struct(*(F.col(f"w.{c}").alias(c) for c in _FIELDS)))
    rows = rows.select(F.explode_outer(F.coalesce("w.examples", one)).alias("x"))
    text = F.coalesce("x.query", "x.question", "x.text")
    graded = F.coalesce("x.relevance_grades", "x.grades", F.create_map().cast("map<string,string>"))
    numbers = F.map_filter(F.transform_values(graded, lambda _, v: v.try_cast("int")), lambda _, v: v.isNotNull())
    none = F.coalesce("x.no_answer", F.lower("x.category") == "no_answer", F.lit(False))
    return rows.select(
        text.alias("query"),
        F.coalesce("x.relevant_document_ids", "x.relevant_documents", F.array().cast("array<string>")).alias("relevant"),
        numbers.alias("grades"),
        F.coalesce("x.category", F.lit("uncategorised")).alias("category"),
        none.alias("no_answer"),
        F.coalesce(F.trim(text) == "", F.lit(True)).alias("bad"),
    )


def scored_examples(rows: DataFrame) -> DataFrame:
    """Examples that name relevant documents."""
    return rows.where(~F.col("bad") & (F.size("relevant") > 0))


def dataset_facts(rows: DataFrame) -> DataFrame:
    """category, examples, labelled, no_answer, bad: one row for each category."""
    return rows.groupBy("category").agg(F.count("*").alias("examples"), F.count_if(~F.col("bad") & (F.size("relevant") > 0)).alias("labelled"), F.count_if("no_answer").alias("no_answer"), F.count_if("bad").alias("bad"))


def stale_labels(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relevant ids of examples that no chunk (chunk_id) has."""
    ids = rows.select(F.explode("relevant").alias("chunk_id")).distinct()
    return ids.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
