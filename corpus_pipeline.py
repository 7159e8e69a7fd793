"""From raw documents to a training mixture: language ID, toxicity, near duplicates,
benchmark decontamination, mixing. Each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm import decontaminate, jaccard, langid, mixing, toxicity
from raglens.llm.common import crc_mod, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: none predicted, or none that is likelier than all
    others; so null and empty texts, and those without a letter, go. Without labelled rows no
    language is known and none stays. Rows with a null id and repeated rows are judged alike."""
    model = langid.fit(docs)
    return docs.withColumn("_p", langid.predict(spark, model)).where("_p.lang_pred <> 'und' and _p.score >= 0.5").select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; learns from the labelled rows of the documents it is given.
    Null and empty texts, and all texts where no label was learned from, stay; rows with a null
    id are judged like others, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    grammar = toxicity.fit(toxicity.labelled(docs.select("doc_id", "text"), labels.where(crc_mod("doc_id", 4) != 2)))
    return docs.withColumn("_s", toxicity.score(spark, grammar)).where("_s < 0.3").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles of five words and a similarity of 0.8,
    the one of the smallest id stays. Null texts and those without words, and rows with a null
    id, stay; so do repeated rows of the id that stays."""
    return jaccard.distinct_groups(docs, words=5, num=8, den=10).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item; null and empty texts hold none. Without
    items all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document that it takes, with how often (copies) and the words taken.
    Each row, repeated ones and those with a null id too, gets copies of its own; a null text
    has no words and is taken by its source's whole share."""
    rows = docs.select(COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mixed(rows, id_col="doc_id", source="source", size="size")
    return out.where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
