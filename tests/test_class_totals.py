"""Relevance by a class without a row for each pair of a query and a document."""

from pyspark.sql import functions as F

from raglens.operators import retrieval


def test_totals_by_class_equal_those_of_pairs(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 40, F.when(F.col("id") == 30, 9).otherwise(F.col("id") % 4)).alias("class"), (1 + F.col("id") % 3).cast("double").alias("gain"))
    queries = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "class")
    rel = queries.join(docs, "class").where("query_id <> doc_id").select("query_id", "doc_id", F.col("gain").alias("grade"))
    hits = queries.select("query_id", F.explode(F.array(*(F.lit(i).cast("long") for i in (3, 4, 8, 20, 31)))).alias("doc_id")).withColumn("rank", F.col("doc_id") % 7 + 1)
    for k in (1, 5, 50):
        want = sorted(retrieval.retrieval_metrics(hits, rel, k).collect())
        total = retrieval.class_totals(queries, docs, k)
        near = rel.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        assert sorted(retrieval.retrieval_metrics(hits, near, k, total=total).collect()) == want and len(want) == 4


def test_missed_pairs_are_not_shuffled(spark):
    rel = spark.range(1000).select((F.col("id") % 10).alias("query_id"), F.col("id").alias("doc_id"))
    hits = spark.createDataFrame([(1, 1, 1), (2, 12, 9)], "query_id long, doc_id long, rank int")
    got = retrieval.missed_documents(hits, rel, 5, once=False)
    assert got.count() == 999
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
