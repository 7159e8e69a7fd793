"""BM25 from the stored index against a loop over all documents."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from raglens.operators.text_index import TextIndex


def brute(docs, queries, k1=1.5, b=0.75):
    texts = {i: re.findall(r"\w+", t.lower()) for i, t in docs if t is not None}
    avg = sum(map(len, texts.values())) / len(texts)
    df = Counter(w for ws in texts.values() for w in set(ws))
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, text in queries:
        for i, ws in texts.items():
            tf = Counter(ws)
            shared = [w for w in set(re.findall(r"\w+", text.lower())) if tf[w]]
            if shared:
                out[q, i] = {w: (low if idf[w] < 0 else idf[w]) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avg)) for w in shared}
    return out


def data(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocab, [1 / (j + 1) for j in range(60)], k=r.randrange(1, 40)))) for i in range(300)] + [(900, ""), (901, None), (902, "Only HERE once")]
    queries = [(1, "w1 w1 w40"), (2, "w59 w58 w57 w0"), (3, "only here"), (4, "nowhere"), (5, "")]
    frame = lambda x, c: spark.createDataFrame(x, f"{c} long, text string").repartition(3)
    return docs, queries, frame(docs, "doc_id"), frame(queries, "query_id")


def test_search_equals_a_loop(spark):
    docs, queries, d, q = data(spark)
    index = TextIndex.build(d, size=20)
    want = {key: round(max(sum(x.values()), 0.0), 6) for key, x in brute(docs, queries).items()}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in index.scores(q).collect()} == want
    for k in (1, 4, 500):
        got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in index.search(q, k).collect()}
        best = {}
        for qid, _ in queries:
            rows = sorted(((i, s) for (p, i), s in want.items() if p == qid), key=lambda x: (-x[1], x[0]))[:k]
            best |= {(qid, n): x for n, x in enumerate(rows, 1)}
        assert got == best
    told = index.skipped(q, 1).first()
    assert 0 < told["skipped"] < told["postings"]


def test_explained_parts_sum_to_the_score(spark):
    docs, queries, d, q = data(spark)
    index, want = TextIndex.build(d, size=50), brute(docs, queries)
    hits = index.search(q, 2)
    got = {}
    for r in index.explain(q, hits).collect():
        got.setdefault((r["query_id"], r["doc_id"]), {})[r["term"]] = round(r["weight"], 9)
    assert got == {key: {w: round(x, 9) for w, x in want[key].items()} for key in ((r["query_id"], r["doc_id"]) for r in hits.collect())}


def test_index_of_nothing(spark):
    _, _, d, q = data(spark)
    index = TextIndex.build(d.where("false"))
    assert index.search(q).count() == 0 and index.explain(q, d.limit(1).select(F.lit(1).alias("query_id"), "doc_id")).count() == 0
    assert tuple(index.statistics().first())[:3] == (0, 0, 0)


def test_tasks_follow_the_text_and_not_the_shuffle_partitions(spark, monkeypatch):
    docs, queries, d, q = data(spark)
    monkeypatch.setattr("raglens.operators.text_index.CHARS", 1000)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        index = TextIndex.build(d, size=20)
        assert index.parts == min(index.ranges, -(-sum(len(t or "") for _, t in docs) // 1000))
        assert len(index.blocks.inputFiles()) > 5  # a task for each part that has documents
        pairs = index.bounds(index.asked(q)).where("rng < 3")
        assert index.contributions(index.asked(q), pairs).rdd.getNumPartitions() == index.parts
        best = {(r["query_id"], r["doc_id"]) for r in index.search(q, 1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = {}
    for (p, i), x in brute(docs, queries).items():
        want.setdefault(p, []).append((-round(max(sum(x.values()), 0.0), 6), i))
    assert best == {(p, min(x)[1]) for p, x in want.items()}
