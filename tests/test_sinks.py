"""Stored rows of evaluations and anomalies, repeated writes, the vector index, RAG payloads."""

import json

import pytest
from pyspark.sql import functions as F

from raglens.operators import analytics
from raglens.sources import sinks
from raglens.streaming import traces as nested


def test_stored_replaces_only_its_runs(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    sinks.stored(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int"), at)
    sinks.stored(spark.createDataFrame([("b", 3), ("b", 4)], "run_id string, x int"), at)
    sinks.stored(spark.createDataFrame([("b", 3), ("b", 4)], "run_id string, x int"), at)
    assert sorted((r.run_id, r.x) for r in spark.read.parquet(at).collect()) == [("a", 1), ("b", 3), ("b", 4)]


def test_closed_runs(spark):
    rows = spark.createDataFrame(
        [("r", 0.5, None, None), ("r", None, 0.25, 0.75), ("s", None, None, None)],
        "run_id string, faithfulness double, judge_faithfulness double, judge_answer_relevance double",
    )
    out = {r.run_id: r for r in sinks.closed_runs(sinks.answer_rows(rows)).collect()}
    assert (out["r"].num_items, out["r"].faithfulness, out["r"].judge_faithfulness, out["r"].judge_answer_relevance) == (2, 0.5, 0.25, 0.75)
    # nothing measured is 0.0 of a closed run; a run that no judge saw has no judge's means
    assert (out["s"].faithfulness, out["s"].citation_coverage, out["s"].judge_faithfulness, out["s"].judge_answer_relevance) == (0.0, 0.0, None, None)
    assert sinks.closed_runs(sinks.answer_rows(rows.limit(0))).collect() == []


def test_answer_rows_empty_lists_are_null(spark):
    rows = spark.createDataFrame([("r", [], ["c"])], "run_id string, context array<string>, claims array<string>")
    r = sinks.answer_rows(rows).first()
    assert (r.context, r.claims, r.judge_model, r.faithfulness) == (None, ["c"], None, None)
    assert sinks.answer_rows(rows).columns == sinks.ANSWER


def test_stored_metrics_and_results(spark):
    by_k = spark.createDataFrame([(5, 2, 0.4), (3, 2, 0.5)], "k int, queries long, precision double")
    r = sinks.retrieval_run(sinks.stored_metrics(by_k, 5), "r", "n", "d").first()
    assert json.loads(r.metrics) == {"precision": 0.4, "by_k": {"3": {"precision": 0.5}, "5": {"precision": 0.4}}}
    assert (r.run_id, r.num_queries, r.status, r.k) == ("r", 2, "completed", 5)
    metrics = spark.createDataFrame([(1, 0.5), (2, 0.0)], "query_id int, precision double")
    hits = spark.createDataFrame([(1, 7, 2), (1, 9, 1), (1, 8, 3)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 9), (2, 5), (2, 5)], "query_id int, doc_id int")
    out = {r.query_id: r for r in sinks.retrieval_results(metrics, hits, rel, "r", 2).collect()}
    assert (out[1].retrieved, out[1].relevant, json.loads(out[1].metrics)) == (["9", "7"], ["9"], {"precision": 0.5})
    assert (out[2].retrieved, out[2].relevant) == ([], ["5"])


def test_anomaly_rows(spark):
    rows = spark.createDataFrame([(i, 1, float(i), 1.0) for i in range(100)] + [(100, 2, 50.0, 9.0), (101, 2, None, 99.0)], "id int, application_id int, a double, b double")
    found = rows.select("id", F.lit(0.75).alias("score"), (F.col("id") >= 100).alias("flagged"))
    out = sinks.anomaly_rows(found, rows, ["a", "b"], "id").collect()
    # a row without one of its features isn't examined
    assert [(r.id, r.application_id, r.metric, r.observed_value, r.expected_low, r.expected_high, r.severity, r.anomaly_score) for r in out] == [(100, 2, "b", 9.0, 1.0, 1.0, "high", 0.75)]
    told = json.loads(out[0].evidence)
    assert told["features_examined"] == ["a", "b"] and told["feature_deviation"] == {"a": 0.0, "b": 8.0} and told["window_band"]["b"] == {"low": 1.0, "high": 1.0}


def test_index_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    sinks.save_index(rows, at)
    assert {r.vec_id: r.embedding for r in sinks.load_index(spark, at).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    sinks.save_index(rows.unionByName(spark.createDataFrame([(4, [1.0])], rows.schema)), at)
    with pytest.raises(ValueError, match="1 to 2"):
        sinks.load_index(spark, at)


def test_organization_counts(spark):
    rows = lambda *x: spark.createDataFrame([(i, o) for i, o in enumerate(x)], "id int, organization_id int")
    organizations = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    out = analytics.organization_counts(organizations, rows(1, 1, 3), rows(2))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 2, 0), (2, "b", 0, 1)]


def test_rag_payloads_keep_failed_questions(spark):
    queries = spark.createDataFrame([(1, "q", 1), (2, "r", 1)], "query_id int, text string, seq long").withColumn("start_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    hits = spark.createDataFrame([(1, 2, 8, "t", "three more words", 0.5), (1, 1, 9, "t", "four", 0.7)], "query_id int, rank int, doc_id int, title string, content string, score double")
    replies = spark.createDataFrame([(1, "yes", "m", "p", 5, None, 2.0)], "query_id int, completion string, model string, provider string, input_tokens long, output_tokens long, duration_ms double")
    made = nested.rag_payloads(queries, hits, replies, "demo")
    log = nested.ingest(None, made)
    assert nested.dead_letters(made).count() == 0
    prices = spark.createDataFrame([], "provider string, name string, input_cost_per_1k double, output_cost_per_1k double, is_local boolean")
    kids = nested.children(log, prices)
    out = {r.trace_id: r for r in nested.totals(log, kids).collect()}
    assert (out["1"].status, out["1"].documents, out["1"].calls, out["1"].input_tokens, out["1"].output_text, out["1"].error) == ("success", 2, 1, 5, "yes", None)
    assert (out["2"].status, out["2"].documents, out["2"].calls, out["2"].error) == ("error", 0, 0, "the generation failed")
    assert [r.document_id for r in kids["documents"].orderBy("rank").collect()] == ["9", "8"]
    # the same payloads again change nothing
    again = nested.ingest(log, made)
    assert {r.trace_id: r.documents for r in nested.totals(again, nested.children(again, prices)).collect()} == {"1": 2, "2": 0}
