"""Registered queries against their SQL, and hand-computed cases of the scalars."""

import json
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raglens.functions import scalars as fn
from raglens.operators import analytics, anomaly, evaluation, percentiles, retrieval
from raglens.operators.chunking import _windows, split
from raglens.plans import registry
from raglens.sources import files
from raglens.streaming import ingest, traces as nested

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    return repr(float(x)) if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float", "Decimal")) else str(x)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{AT}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{AT}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    ours, said = registry.QUERIES[name](spark, AT).toPandas(), con.execute(registry.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(said.columns)
    assert _rows(ours) == _rows(said)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, AT).count() > 0


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("hello world", 2), ("a1b22", 4), ("x" * 17, 5), ("日本語 abc", 4), ("it's 3.5", 6)])
def test_estimate_tokens(spark, text, n):
    assert _one(spark, fn.estimate_tokens(F.lit(text).cast("string"))) == n


def test_ratio_and_clamp(spark):
    assert _one(spark, fn.ratio(F.lit(1.0), F.lit(0))) == 0.0
    assert _one(spark, fn.clamp01(F.lit(float("nan")))) == 0.0
    assert _one(spark, fn.clamp01(F.lit(1.7))) == 1.0
    assert _one(spark, fn.finite(F.lit(float("inf")))) is None


@pytest.mark.parametrize("x,y", [(0.4, 0.4), (85.0, 0.85), (1.5, None), (-1.0, None), (101.0, None)])
def test_unit_interval(spark, x, y):
    assert _one(spark, fn.unit_interval(F.lit(x))) == y


def test_claims_and_citations(spark):
    assert _one(spark, fn.claims(F.lit("One is. Two!\nThree"))) == ["One is.", "Two!", "Three"]
    assert _one(spark, fn.citation_markers(F.lit("a [3] b [S4] c [1, 2] d [source: X]"))) == ["3", "4", "1", "2", "x"]
    doc = F.array(F.struct(F.lit("d").alias("id"), F.lit(" Refund Policy ").alias("title"), F.lit("docs/a.md").alias("source")))
    assert _one(spark, evaluation.citation_coverage(F.lit("see [1] and [9]"), doc)) == 0.5
    assert _one(spark, evaluation.citation_coverage(F.lit("(source: refund policy) [ref=DOCS/a.md] [d]"), doc)) == 1.0


@pytest.mark.parametrize(
    "text,found",
    [
        ("[S1] then [doc-2] then [src_1]", ["1", "doc-2", "src_1"]),
        ("[1;2/3] and [see 3]", ["1", "2", "3"]),
        ("(doc = Billing FAQ.) [ref: x]", ["billing faq", "x"]),
        ("[1][1]", ["1", "1"]),
        ("none, (see 3)", []),
        ("[see [3] (note: [4] and [b, c]) [foo: [5]", ["3", "4", "b", "c", "5"]),
        ("(source: Billing (EU)) [ source: x] [source: a [b] [Doc:]", ["billing (eu", "a [b"]),
        ("[1 3] [a b, 2] [a,,b] [-x] [x/ S9 ]", ["x", "9"]),
    ],
)
def test_citation_markers(spark, text, found):
    assert _one(spark, fn.citation_markers(F.lit(text))) == found


def test_grounding(spark):
    """Overlap settles a claim or supports it, similarity replaces; an empty claim isn't supported."""

    def of(answer, context, sims=None):
        s = None if sims is None else F.lit([[float(x) for x in row] for row in sims]) if sims else None
        g = _one(spark, evaluation.grounding(F.lit(answer), F.array(*map(F.lit, context)), s))
        return g["claims"], g["supported"], g["score"]

    assert of("The cat sat. Dogs fly high.", ["A cat sat there."]) == (2, 1, 0.5)
    assert of("", ["A cat."]) == (0, 0, 1.0)
    assert of("It is. Cats sleep.", ["Cats sleep."]) == (2, 1, 0.5)  # no content word, no support
    assert of("Cats sleep long.", ["Dogs bark.", "Birds sing."], [[0.2, 0.6]]) == (1, 1, 1.0)
    assert of("Cats sleep long.", ["Dogs bark.", "Birds sing."], [[0.2, 0.5]]) == (1, 0, 0.0)
    # a greater similarity also replaces the better overlap of a sentence before
    assert of("Cats sleep long daily.", ["Cats sleep.", "Birds sing."], [[0.1, 0.2]]) == (1, 0, 0.0)
    # full overlap ends the search
    assert of("Cats sleep.", ["Cats sleep.", "Birds sing."], [[0.0, 0.9]]) == (1, 1, 1.0)


def test_ir_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id int, doc_id string")
    m = {r["query_id"]: r for r in retrieval.retrieval_metrics(hits, rel, 2).collect()}
    assert m[1]["precision"] == 0.5 and m[1]["recall"] == 0.5 and m[1]["reciprocal_rank"] == 0.5
    assert m[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert m[2]["precision"] == 0.0 and m[2]["hit"] is False


def test_graded_and_repeated_hits(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "z", -5)], "query_id int, doc_id string, grade int")
    m = retrieval.retrieval_metrics(hits, rel, 4).first()
    assert m["precision"] == 0.5 and m["recall"] == pytest.approx(2 / 3)
    assert m["ndcg"] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert [r["doc_id"] for r in retrieval.missed_documents(hits, rel, 4).collect()] == ["z"]


def test_bm25_takes_the_mean_over_the_vocabulary(spark):
    """Three of four documents hold the asked term: its negative idf becomes a quarter of the
    mean idf of all terms."""
    texts = ["cat dog", "cat bird", "cat", "fish"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25_search(docs, spark.createDataFrame([(1, "Cat")], "query_id long, text string")).collect()}
    idf = lambda df: math.log(4 - df + 0.5) - math.log(df + 0.5)
    low = 0.25 * (idf(3) + 3 * idf(1)) / 4
    assert got == {i: round(low * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / 1.5)), 6) for i, n in ((0, 2), (1, 2), (2, 1))}


def test_rerank_and_stages(spark):
    fused = spark.createDataFrame([(1, "a", 1, 0.3), (1, "b", 2, 0.2), (1, "c", 3, 0.1)], "query_id int, doc_id string, rank int, score double")
    new = retrieval.rerank(fused, F.when(F.col("doc_id") == "c", 0.9).when(F.col("doc_id") == "a", -1.0))
    assert [r["doc_id"] for r in new.orderBy("rank").collect()] == ["c", "a", "b"]
    lex = spark.createDataFrame([(1, "a", 4.0)], "query_id int, doc_id string, score double")
    got = {r["doc_id"]: (r["bm25_score"], r["vector_score"]) for r in retrieval.with_stages(fused, lex, lex.withColumn("doc_id", F.lit("b"))).collect()}
    assert got == {"a": (4.0, None), "b": (None, 4.0), "c": (None, None)}


@pytest.mark.parametrize("n,small", [(0, 4000), (1, 4000), (7, 4000), (9000, 4000), (9000, 10)])
def test_percentiles_are_exact(spark, monkeypatch, n, small):
    monkeypatch.setattr(percentiles, "SMALL", small)
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.lognormal(5, 1, n), 2))
    rows = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, v double")
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0}
    got = percentiles.percentiles(rows, "v", shares, digits=None).collect()
    assert len(got) == 1
    assert list(got[0]) == ([None] * 5 if not n else pytest.approx(list(np.quantile(x, list(shares.values())))))
    by = {r["g"]: list(r)[1:] for r in percentiles.percentiles(rows, "v", shares, ("g",), digits=None).collect()}
    assert by == {g: pytest.approx(list(np.quantile(x[g::2], list(shares.values())))) for g in (0, 1) if len(x[g::2])}


def test_efficiency_and_texts(spark):
    e = _one(spark, fn.token_efficiency(F.lit(-5), F.lit(10), F.lit(3), F.lit(4), F.lit(1)))
    assert e["score"] == pytest.approx(100 * (0.4 * 0.75 + 0.25 + 0.35)) and e["wasted_tokens"] == 0 and e["potential_waste_pct"] == 0.0
    e = _one(spark, fn.token_efficiency(F.lit(100), F.lit(80), F.lit(10), F.lit(4), F.lit(1)))
    assert (e["duplicate_tokens"], e["wasted_tokens"], e["potential_waste_pct"]) == (20, 60, 60.0)
    assert e["score"] == pytest.approx(100 * (0.4 * 0.75 + 0.25 * 0.4 + 0.35 * 0.5))
    assert _one(spark, fn.truncate_to_tokens(F.lit("one two three four"), 3)) == "one two" and _one(spark, fn.truncate_to_tokens(F.lit("short"), 3)) == "short"
    assert _one(spark, fn.truncate_to_tokens(F.lit("x" * 30), 3)) == "x" * 12
    assert _one(spark, fn.slug(F.lit("  My App! (v2) "))) == "my-app-v2"
    assert _one(spark, fn.preview(F.lit("a" * 201))) == "a" * 200 + "..." and _one(spark, fn.preview(F.lit("a" * 200))) == "a" * 200
    assert _one(spark, fn.title_fingerprint(F.lit("##  The  Title "))) == "the title"
    assert [_one(spark, fn.stored_number(F.lit(x))) for x in ("0.5", "true", "{}", " 3 ", "x")] == [0.5, None, None, 3.0, None]
    r = _one(spark, fn.judge_reply(F.lit('Sure: {"faithfulness": 85, "answer_relevance": true, "rationale": "ok"} done')))
    assert (r["faithfulness"], r["answer_relevance"], r["rationale"]) == (0.85, None, "ok")
    assert _one(spark, fn.judge_reply(F.lit("no json"))) is None
    assert _one(spark, fn.unit_vector(F.lit([3.0, 4.0]))) == pytest.approx([0.6, 0.8]) and _one(spark, fn.unit_vector(F.lit([0.0, 0.0]))) == [0.0, 0.0]
    assert _one(spark, fn.message_tokens(F.array(F.lit("two words"), F.lit("")))) == 3 + 4 + 2 + 4
    assert [_one(spark, fn.window_label(F.lit(x).cast("array<string>"))) for x in ([], ["local"], ["local", "simulated"])] == ["no model calls", "local", "mixed"]
    assert _one(spark, fn.mean_present(F.lit(None).cast("double"), F.lit(0.5))) == 0.5 and _one(spark, fn.mean_present(F.lit(None).cast("double"))) is None
    t = spark.range(1).select(fn.settled(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.lit(1500.0), F.lit("success")).alias("x")).select("x.*").first()
    assert str(t["end_time"]) == "2024-01-01 00:00:01.500000"


def test_duplicate_documents(spark):
    d = [(1, "a", "T", "t"), (2, "a", "T", "t"), (2, "b", "# Other", "x"), (3, "a", "One title", "c1"), (3, "b", "# one  TITLE", "c2"), (3, "c", "zz", "zz"), (4, "a", None, None), (4, "a", None, None), (4, "b", "same", "same")]
    docs = spark.createDataFrame(d, "trace_id int, document_id string, title string, content string")
    got = {(r["trace_id"], r["document_id"]) for r in analytics.duplicate_documents(docs).collect()}
    assert got == {(3, "a"), (3, "b"), (4, "a"), (4, "b")}


def test_window_of():
    scope, label = analytics.window_of("24h", "2024-01-02 00:00:00")
    assert (scope.start, scope.unit, label) == ("2024-01-01 00:00:00", "hour", "24h")
    assert analytics.window_of("odd", "2024-01-08 00:00:00")[0].start == "2024-01-01 00:00:00"
    scope, label = analytics.window_of("7d", "2024-01-08 00:00:00", start="2024-01-03 10:37:00")
    assert (scope.start, scope.unit, label) == ("2024-01-03 10:37:00", "hour", "custom")


def test_directions_and_sentences(spark):
    a = spark.createDataFrame([("p95_duration_ms", 100.0), ("mrr", 0.0), ("wasted_tokens", 5.0)], "metric string, value double")
    b = spark.createDataFrame([("p95_duration_ms", 106.0), ("mrr", -0.1), ("wasted_tokens", 5.0)], "metric string, value double")
    d = evaluation.metric_deltas(a, b)
    assert {r["metric"] for r in evaluation.regressions(d).collect()} == {"p95_duration_ms", "mrr"}
    assert {r["sentence"] for r in evaluation.delta_sentences(d).collect()} == {"p95_duration_ms rose from 100 to 106 (regression)", "mrr fell from 0 to -0.1 (regression)", "wasted_tokens stayed from 5 to 5"}
    runs = spark.createDataFrame([(1, '{"k": 5, "model": {"name": "a", "t": 0.1}}'), (2, '{"k": 5, "model": {"name": "b"}}')], "run_id int, config string")
    flat = evaluation.flat_config(runs)
    assert [tuple(r) for r in evaluation.config_diff(flat.where("run_id = 1"), flat.where("run_id = 2")).collect()] == [("model.name", "a", "b")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x y.md").write_text("intro\n# The Title \nmore")
    (tmp_path / "b/1+1.txt").write_text("two")
    (tmp_path / "a.txt").write_text("\n first line\nmore")
    (tmp_path / "c.md").write_text("  \n")
    (tmp_path / "d.pdf").write_text("no")
    got = [tuple(r)[:2] for r in files.documents(spark, tmp_path.as_uri()).collect()]
    assert got == [("a.txt", "first line"), ("b/1+1.txt", "two"), ("b/x y.md", "The Title")]
    lines = ['{"query": "q1", "relevant_document_ids": ["a"], "category": "easy"}', '{"question": "q2", "relevant_documents": ["b"], "grades": {"b": "2", "c": "x"}}', "not json", "", '{"examples": [{"text": "q3", "category": "no_answer"}, {"query": "q4", "relevant_documents": ["zz"]}]}']
    rows = files.examples(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((r["query"] or "", r["relevant"], r["grades"], r["no_answer"], r["bad"]) for r in rows.collect())
    assert got == [("", [], {}, False, True), ("q1", ["a"], {}, False, False), ("q2", ["b"], {"b": 2}, False, False), ("q3", [], {}, True, False), ("q4", ["zz"], {}, False, False)]
    assert files.scored_examples(rows).count() == 3
    assert {r["chunk_id"] for r in files.stale_labels(rows, spark.createDataFrame([("a",), ("b",)], "chunk_id string")).collect()} == {"zz"}


PAYLOADS = [
    '{"application": "app", "trace_id": "t1", "kind": "rag", "status": "running", "input_text": "q", "context_tokens": 9, "metadata": {"a": "1", "token_efficiency": "x"}, "spans": [{"span_id": "s1", "name": "llm"}],'
    ' "generations": [{"model": "m", "provider": "p", "prompt": "one two", "completion": "x", "input_tokens": 1000, "span_id": "s1"}, {"model": "m", "provider": "p", "prompt": "one two", "completion": "x", "span_id": "other"}],'
    ' "retrievals": [{"query": "q", "documents": [{"document_id": "d", "title": "T one", "final_score": 0.5, "content": "three small words"}, {"document_id": "d", "title": "T two", "final_score": 0.75, "content": "four more small words"}]}]}',
    '{"application": "app", "trace_id": "t1", "kind": "chat", "status": "success", "duration_ms": 5, "metadata": {"b": "2"}}',
    '{"application": "app", "trace_id": "t2", "context_tokens": 4}',
    '{"application": "", "trace_id": "t3"}',
    "broken",
    '{"application": "app", "trace_id": "t4", "duration_ms": -1}',
]


def test_nested_ingest(spark, tmp_path):
    p = nested.parsed(spark.createDataFrame(list(enumerate(PAYLOADS)), "seq long, value string"))
    prices = spark.createDataFrame([("p", "m", 0.5, 1.0, False)], "provider string, name string, input_cost_per_1k double, output_cost_per_1k double, is_local boolean")
    assert nested.dead_letters(p).count() == 3
    once = nested.ingest(None, p)
    for log in (once, nested.ingest(once, p)):  # a replay changes nothing
        kids = nested.children(log, prices)
        got = {r["trace_id"]: r for r in nested.totals(log, kids).collect()}
        assert set(got) == {"t1", "t2"}
        r = got["t1"]
        assert (r["kind"], r["status"], r["input_text"], r["duration_ms"], r["metadata"]) == ("rag", "success", "q", 5.0, {"a": "1", "b": "2"})
        assert (r["calls"], r["input_tokens"], r["output_tokens"], r["context_tokens"], r["documents"], r["duplicates"]) == (2, 1002, 2, 7, 2, 1)
        assert r["cost"] == pytest.approx(0.501 + 0.002)
        assert (got["t2"]["context_tokens"], got["t2"]["calls"], got["t2"]["status"]) == (4, 0, None)
        assert sorted(x["span_id"] or "" for x in kids["generations"].collect()) == ["", "s1"]
        assert [(x["num_results"], x["top_score"]) for x in kids["retrievals"].collect()] == [(2, 0.75)]
        assert sorted(x["rank"] for x in kids["documents"].collect()) == [1, 2]
    # children that are sent again replace those of their sort
    more = nested.parsed(spark.createDataFrame([(9, '{"application": "app", "trace_id": "t1", "generations": []}')], "seq long, value string"))
    log = nested.ingest(once, more)
    kids = nested.children(log, prices)
    assert {r["trace_id"]: r["calls"] for r in nested.totals(log, kids).collect()} == {"t1": 0, "t2": 0} and kids["documents"].count() == 2
    assert {r["name"] for r in nested.new_applications(spark.createDataFrame([("x",)], "name string"), p).collect()} == {"app"}
    seeded = nested.seeded_models(prices, prices.withColumn("name", F.lit("n")).unionByName(prices.withColumn("is_local", F.lit(True))))
    assert sorted((r["name"], r["is_local"]) for r in seeded.collect()) == [("m", False), ("n", False)]
    # as a stream, one file a batch
    for i, x in enumerate(PAYLOADS):
        spark.createDataFrame([(i, x)], "seq long, value string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = nested.parsed(spark.readStream.schema("seq long, value string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*")))
    nested.ingest_stream(stream, spark, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = nested.trace_log(spark, str(tmp_path / "log"))
    same = lambda df: sorted(map(str, nested.totals(df, nested.children(df, prices)).drop("seq").collect()))
    assert same(nested.shown(log.read())) == same(once)
    dead = spark.read.parquet(str(tmp_path / "log/dead/*"))
    assert sorted(r["error"] for r in dead.collect()) == ["negative duration_ms", "no application", "not a JSON object"]
    told = log.commits().counters.values()
    assert [sum(c[k] for c in told) for k in ("payloads", "accepted", "dead")] == [6, 3, dead.count()]


def test_ingest_keeps_all_documents_of_a_retrieval(spark):
    """The best of 250 documents and the only two alike are behind the hundredth; another
    retrieval of the trace has 101, a third one none."""
    docs = [{"document_id": f"d{i}", "title": f"title {i}", "final_score": i / 1000, "content": f"two {chr(97 + i % 26) * (3 + i // 26)}"} for i in range(250)]
    docs[249]["content"] = docs[201]["content"] = "these three words"
    line = json.dumps({"application": "a", "trace_id": "t", "retrievals": [{"query": "q", "documents": docs}, {"query": "r", "documents": docs[:101]}, {"query": "s"}]})
    prices = spark.createDataFrame([], "provider string, name string, input_cost_per_1k double, output_cost_per_1k double, is_local boolean")
    log = nested.ingest(None, nested.parsed(spark.createDataFrame([(1, line)], "seq long, value string")))
    kids = nested.children(log, prices)
    got = kids["retrievals"].orderBy("retrieval_no").select("num_results", "context_tokens", "top_score").collect()
    assert [tuple(r) for r in got] == [(250, 248 * 2 + 2 * 3, 0.249), (101, 202, 0.1), (0, 0, None)]
    assert sorted((r["retrieval_no"], r["rank"]) for r in kids["documents"].collect()) == [(n, i + 1) for n, k in ((0, 250), (1, 101)) for i in range(k)]
    r = nested.totals(log, kids).first()
    assert (r["documents"], r["context_tokens"], r["duplicates"]) == (351, 704, 2)


def test_trace_ingest_equals_sql_for_long_orders(spark, tmp_path):
    """Orders of few lines, and 24 of some 200, each of which is a document."""
    con = duckdb.connect()
    for t, rows in (("lineitem", "* replace (if(l_orderkey < 300, l_orderkey, 300 + l_orderkey % 24) as l_orderkey)"), ("part", "*")):
        con.execute(f"create table {t} as select {rows} from read_parquet('{AT}/{t}.parquet')")
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    ours, said = registry.QUERIES["trace_ingest"](spark, str(tmp_path)).toPandas(), con.execute(registry.SQL["trace_ingest"]).fetchdf()
    assert said["documents"].nlargest(24).min() > 100
    assert _rows(ours) == _rows(said)


def test_stream_rollup_and_sessions(spark, tmp_path):
    """Run as streams, the windows are those of the whole table."""
    s = spark.read.parquet(f"{AT}/events.parquet").select(F.col("event_id").alias("span_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("start_time"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("failed"))
    late = [s, s.limit(1).withColumns({"start_time": F.lit("2030-01-01").cast("timestamp"), "kind": F.lit("end")})]  # moves the watermark past all
    for i, x in enumerate(late):
        x.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for name, of in (("rollup", ingest.rollup), ("sessions", ingest.sessions)):
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = of(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, of(s).collect()))


def test_rrf_order(spark):
    r = [spark.createDataFrame(x, "query_id int, doc_id string, rank int") for x in ([(1, "a", 1), (1, "b", 2)], [(1, "b", 1), (1, "c", 2)])]
    assert [x["doc_id"] for x in retrieval.rrf(r).orderBy("rank").collect()] == ["b", "a", "c"]


def test_metric_deltas_direction(spark):
    a = spark.createDataFrame([("mrr", 0.5), ("total_cost", 1.0), ("other", 1.0), ("gone", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("mrr", 0.4), ("total_cost", 0.5), ("other", 9.0)], "metric string, value double")
    d = {r["metric"]: r for r in evaluation.metric_deltas(a, b).collect()}
    assert set(d) == {"mrr", "total_cost", "other"}
    assert d["mrr"]["is_regression"] and not d["total_cost"]["is_regression"] and not d["other"]["is_regression"]


@pytest.mark.parametrize("size,overlap", [(80, 0), (80, 15), (500, 50)])
def test_chunks_hold_every_word(size, overlap):
    text = "\n\n".join(f"Paragraph {i}. It has some words; more words, and {'long' * 5}." for i in range(20))
    pieces = split(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    assert set(text.split()) <= set(" ".join(pieces).split())


def test_chunks_without_separators():
    assert [len(p) for p in split("x" * 950)] == [500, 500, 50]
    assert [len(p) for p in split("a " + "x" * 950, 500, 0)] == [1, 500, 450]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split("text", size, overlap)


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_of_whole_words(seed):
    """Windows cover the text, end at the last space that fits and start behind one within the
    overlap, found here by looking at every character."""
    r = np.random.default_rng(seed)
    text = " ".join("w" * int(n) for n in r.integers(0, 14, 60))
    size, overlap = int(r.integers(5, 30)), int(r.integers(1, 5))
    spaces = [i for i, c in enumerate(text) if c == " "]
    found = list(_windows(spaces, len(text), size, overlap))
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, _) in zip(found, found[1:]):
        inside = [i for i in spaces if a < i < a + size]
        assert b == (inside[-1] if inside else a + size) and a < c <= b
        behind = [i for i in range(max(a + 1, b - overlap), b) if text[i] == " "]
        assert c == (behind[0] + 1 if inside and behind else b)
    assert all(b - a <= size for a, b in found)


def test_upsert_replay_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 1)], "id int, v string, at int")
    once = ingest.upserted(old, new, ["id"], ["at"])
    twice = ingest.upserted(once, new, ["id"], ["at"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", 1), (2, "y", 3), (3, "z", 1)]


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, at int").write.parquet(src)
    stream = spark.readStream.schema("id int, v string, at int").parquet(src)
    q = ingest.upsert_stream(stream, spark, str(tmp_path / "out"), ["id"], ["at"], str(tmp_path / "cp"))
    q.awaitTermination()
    assert [tuple(r) for r in ingest.keyed_log(spark, str(tmp_path / "out"), ["id"], ["at"]).read().collect()] == [(1, "b", 2)]


@pytest.mark.parametrize("local", [4096, 512])
def test_isolation_forest_sees_every_row(spark, monkeypatch, local):
    """20,000 rows, of which a few equal ones and one lone row lie apart: trees of all rows
    give each its path length, whatever part of the tree is grown in one task."""
    n = 20_000
    rows = spark.range(n).select("id", F.when(F.col("id") == 7, 1e6).otherwise((F.col("id") * 7919 % n).cast("double")).alias("a"), (F.col("id") % 50).cast("double").alias("b"))
    got = {r["id"]: r for r in anomaly.isolation_forest(rows, ["a", "b"], "id", trees=20, nodes=local).collect()}
    assert len(got) == n and got[7]["flagged"] and max(got.values(), key=lambda r: r["score"])["id"] == 7
    assert 0.01 < sum(r["flagged"] for r in got.values()) / n <= 0.0201
    # a tree over all rows is deeper than one over 256: inner rows lie below log2(256) + c(n / 256)
    paths = sorted(-np.log2(r["score"]) * float(anomaly._c(n)) for r in got.values())
    assert paths[n // 2] > 12
    again = {r["id"]: r["score"] for r in anomaly.isolation_forest(rows.repartition(7), ["a", "b"], "id", trees=20, nodes=local).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in got.items()}, rel=1e-9)


@pytest.mark.parametrize("nodes", [1 << 30, 50])
def test_isolation_forest_equals_recursive_trees(spark, monkeypatch, nodes):
    """Trees grown by recursion over all rows, from the same draws, give the same scores."""
    monkeypatch.setattr(anomaly, "AT_ONCE", 64)
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(size=(300, 3)), [[9.0, 0.0, 0.0]], np.zeros((40, 3))]).round(3)
    most, least = int(np.ceil(np.log2(len(x)))), len(x) // nodes

    def paths(tree, rows, name=1, depth=0):
        lo, hi = x[rows].min(0), x[rows].max(0)
        if depth == most or len(rows) <= least or (lo == hi).all():
            return {i: depth + float(anomaly._c(len(rows))) for i in rows}
        f, cut = (v[0] for v in anomaly.splits(1, tree, np.array([name]), lo[None], hi[None]))
        right = x[rows, f] >= cut
        return paths(tree, rows[~right], 2 * name, depth + 1) | paths(tree, rows[right], 2 * name + 1, depth + 1) if right.any() and not right.all() else paths_one(tree, rows, name, depth, right)

    def paths_one(tree, rows, name, depth, right):
        return paths(tree, rows, 2 * name + int(right[0]), depth + 1)

    total = np.zeros(len(x))
    for t in range(7):
        for i, p in paths(t, np.arange(len(x))).items():
            total[i] += p
    want = 2.0 ** -(total / 7 / float(anomaly._c(len(x))))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double").repartition(3)
    got = {r["id"]: r["score"] for r in anomaly.isolation_forest(rows, ["a", "b", "c"], "id", trees=7, seed=1, nodes=nodes).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(list(want), rel=1e-9)


def test_isolation_forest_odd(spark):
    few = spark.createDataFrame([(i, 1.0) for i in range(5)], "id int, a double")
    assert {(r["score"], r["flagged"]) for r in anomaly.isolation_forest(few, ["a"], "id").collect()} == {(0.0, False)}
    flat = spark.createDataFrame([(i, None if i % 2 else float("nan")) for i in range(30)], "id int, a double")
    got = anomaly.isolation_forest(flat, ["a"], "id", trees=3).collect()
    assert len(got) == 30 and len({r["score"] for r in got}) == 1 and not any(r["flagged"] for r in got)
