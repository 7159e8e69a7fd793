"""Vector search over clusters against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raglens.operators import vector_index
from raglens.operators.vector_index import VectorIndex

AT = "/root/testdata/sf0.01"


def brute(x, ids, k):
    out = set()
    for i, q in zip(ids, x):
        s = np.round(x @ q, 6)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out |= {(int(i), int(ids[j]), float(s[j]) + 0.0, r) for r, j in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("cell, block, k", [(65_536, 16_384, 5), (40, 30, 3), (65_536, 16_384, 400)])
def test_index_equals_all_pairs(spark, monkeypatch, cell, block, k):
    """Clusters far apart, of which one holds most vectors, one alone; ties and vectors of length 0."""
    for name, value in (("CELL", cell), ("BLOCK", block), ("PER_CLUSTER", 20), ("AT_ONCE", 16)):
        monkeypatch.setattr(vector_index, name, value)
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(size=(200, 8)) * 0.1 + 3, r.normal(size=(60, 8)) * 0.1 - 3, r.normal(size=(39, 8)), np.zeros((2, 8)), np.ones((3, 8))]).round(2)
    ids = r.permutation(len(x))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(None, [1.0] * 8), (9999, None)], "vec_id long, embedding array<double>").repartition(4)
    index = VectorIndex.build(rows)
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(a["query_id"], a["doc_id"], a["score"] + 0.0, a["rank"]) for a in index.search(queries, k).collect()}
    want = brute(x, ids, k)
    assert not got ^ want, sorted(got ^ want)[:6]
    if k == 5:
        assert len(index.bounds.n) > 5 and 0.2 < index.skipped(queries, k) < 1


def test_ranks_are_counted(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PER_CLUSTER", 50)
    e = spark.read.parquet(f"{AT}/embeddings.parquet")
    x, ids = np.stack(e.toPandas()["embedding"]).astype(float), e.toPandas()["vec_id"].to_numpy()
    want = {}
    asked = []
    for i in (0, 100, 300):
        q = x[list(ids).index(i)]
        s = np.round(x @ q, 6)
        for at in (1, 77):
            j = [j for j in np.lexsort((ids, -s)) if ids[j] != i][at]
            asked.append((i * 10 + at, q.tolist(), float(s[j]), int(ids[j])))
            # a query id that is no vector's: its own vector counts as well
            want[i * 10 + at] = sum(1 for m in range(len(ids)) if s[m] > s[j] or s[m] == s[j] and ids[m] < ids[j]) - (1 if (i * 10 + at) in ids and (s[list(ids).index(i * 10 + at)] > s[j]) else 0)
    q = spark.createDataFrame(asked, "query_id long, q array<double>, score double, doc_id long")
    assert {r["query_id"]: r["n"] for r in VectorIndex.build(e).before(q).collect()} == want


def test_index_odd(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")
    assert VectorIndex.build(none).search(q).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
