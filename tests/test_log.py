"""The keyed log: batches, replays, kills and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from raglens.streaming import ingest, log as keyed, traces as nested

SCHEMA = "id int, v string, at int"


def open_log(spark, path, **sizes):
    return ingest.keyed_log(spark, str(path), ["id"], ["at", "v"], **sizes)


def rows(log, **more):
    return sorted(tuple(r) for r in log.read(**more).collect())


def test_log_equals_a_dictionary(spark, tmp_path, monkeypatch):
    """Many batches with compactions of both sorts and snapshots between them."""
    monkeypatch.setattr(keyed, "SNAPSHOT", 3)
    r, want = random.Random(1), {}
    log = open_log(spark, tmp_path, buckets=3, most=2)
    for n in range(8):
        batch = [(r.randrange(30), f"b{n}", r.randrange(20)) for _ in range(3 if n else 40)]
        for i, v, at in batch:
            want[i] = max(want.get(i, (-1, "")), (at, v))
        assert log.append(spark.createDataFrame(batch, SCHEMA), n)
        assert not log.append(spark.createDataFrame(batch, SCHEMA), n)  # a replay
    assert rows(log) == sorted((i, v, at) for i, (at, v) in want.items())
    live = log.commits().live
    assert all(sum(not x[1] for x in xs) <= 2 for xs in live.values())
    # another process finds the same, with the buckets that the log was made with
    again = open_log(spark, tmp_path, buckets=99)
    assert again.buckets == 3 and rows(again) == rows(log)
    some = spark.createDataFrame([(1,), (2,), (77,)], "id int")
    assert rows(log, keys=some) == [x for x in rows(log) if x[0] in (1, 2)]


def test_log_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    log = open_log(spark, tmp_path, buckets=2, most=2)
    log.append(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedLog, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            log.append(spark.createDataFrame([(1, "lost", 2)], SCHEMA), 1)
        assert rows(log) == [(1, "a", 1), (2, "b", 1)]  # nothing of it is seen
    assert log.append(spark.createDataFrame([(1, "c", 2), (3, "d", 1)], SCHEMA), 1)
    assert rows(log) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]
    # a kill in a compaction, after its rows are written
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedLog, "_commit", killed)
        m.setattr(log, "most", 1)
        with pytest.raises(KeyboardInterrupt):
            log.compact()
    assert rows(log) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]
    log.most = 1
    assert log.compact() and rows(log) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]


def test_log_batch_cost_follows_the_batch(spark, tmp_path):
    """A small batch into a large log writes its own buckets only, batch after batch."""
    log = open_log(spark, tmp_path, buckets=16)
    log.append(spark.range(20_000).select(F.col("id").cast("int"), F.lit("x").alias("v"), F.lit(0).alias("at")), 0)
    base = sum(x[2] for xs in log.commits().live.values() for x in xs)
    for n in range(1, 7):
        log.append(spark.createDataFrame([(n, "y", n)], SCHEMA), n)
        made = [x for xs in log.commits().live.values() for x in xs if x[0].startswith(f"data/b{n}/")]
        assert len(made) == 1 and made[0][2] < base / 20
    assert log.read().where("v = 'y'").count() == 6 and log.read().count() == 20_000


def test_states_in_any_order(spark):
    """States of states, interleaved and repeated, give what all payloads give at once."""
    r = random.Random(3)
    lines = []
    for seq in range(60):
        body = {"application": "a", "trace_id": f"t{r.randrange(4)}"}
        for c, v in (("status", '"s%d"'), ("input_text", '"i%d"'), ("kind", '"k%d"'), ("metadata", '{"m%d": "x%d"}'), ("generations", '[{"model": "g%d"}]')):
            if r.random() < 0.4:
                body[c] = v % ((r.randrange(3), seq) if c == "metadata" else seq)
        lines.append((seq, "{" + ", ".join(f'"{k}": {v if k not in ("application", "trace_id") else chr(34) + v + chr(34)}' for k, v in body.items()) + "}"))
    p = nested.parsed(spark.createDataFrame(lines, "seq long, value string"))
    want = sorted(map(str, nested.merged(p).drop("sent").collect()))
    parts = [nested.joined(nested.states(p.where(F.col("seq") % 3 == k))) for k in (2, 0, 1)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[1])
    assert sorted(map(str, nested.shown(nested.joined(both)).drop("sent").collect())) == want
    assert len(want) == 4


def test_dealt_states_are_merged_without_another_shuffle(spark):
    p = spark.createDataFrame([(1, '{"application": "a", "trace_id": "t", "status": "x"}'), (2, '{"application": "a", "trace_id": "t", "status": "y"}')], "seq long, value string")
    dealt = nested.states(nested.parsed(p)).withColumn("_bucket", F.length("trace_id")).repartition("_bucket")
    out = nested.joined(dealt, ["_bucket", *nested.KEY])
    assert [(r["_bucket"], r["seq"], r["status"]["v"]) for r in out.collect()] == [(1, 2, "y")]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan  # nested states aren't aggregated twice


def test_generations_keep_span_ids_of_their_trace(spark):
    lines = [
        (1, '{"application": "a", "trace_id": "t", "spans": [{"span_id": "s"}, {"span_id": "s"}, {"name": "n"}], "generations": [{"span_id": "s"}, {"span_id": "u"}, {"model": "m"}]}'),
        (1, '{"application": "a", "trace_id": "u", "spans": [{"span_id": "u"}], "generations": [{"span_id": "s"}]}'),
        (1, '{"application": "a", "trace_id": "v", "generations": [{"span_id": "s"}]}'),
    ]
    traces = nested.merged(nested.parsed(spark.createDataFrame(lines, "seq long, value string")))
    prices = spark.createDataFrame([], "provider string, name string, input_cost_per_1k double, output_cost_per_1k double, is_local boolean")
    gens = nested.children(traces, prices)["generations"]
    got = {(r["trace_id"], r["call_no"]): r["span_id"] for r in gens.select("trace_id", "call_no", "span_id").collect()}
    assert got == {("t", 0): "s", ("t", 1): None, ("t", 2): None, ("u", 0): None, ("v", 0): None}
