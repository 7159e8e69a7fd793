"""Rows of the isolation forest: boxes of them against each row alone, and their tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raglens.operators import anomaly


@pytest.mark.parametrize("k", [1, 2, 3])
def test_boxes_route_as_their_rows(k):
    x = np.random.default_rng(k).normal(size=(3001, k)).round(2)
    tree, boxes = anomaly.Tree(), anomaly.Boxes(x)
    assert sorted(boxes.order) == list(range(len(x)))
    for depth in range(9):
        node = tree.nodes(x)
        found = [(v, *x[node == v].min(0), *x[node == v].max(0), (node == v).sum()) for v in np.unique(node[node >= tree.open])]
        v, lo, hi, n = boxes.ranges(tree)
        assert [(a, *b, *c, d) for a, b, c, d in zip(v, lo, hi, n)] == found
        ranges = [np.zeros((len(tree.f) - tree.open, k)), np.zeros((len(tree.f) - tree.open, k)), np.zeros(len(tree.f) - tree.open)]
        for r, y in zip(ranges, (lo, hi, n)):
            r[v - tree.open] = y
        tree.grow(3, 0, *ranges, depth, 8, 20)
    path = np.empty(len(x))
    path[boxes.order] = boxes.paths(tree)
    assert (path == tree.path[tree.nodes(x)]).all()


def test_rows_of_one_file_are_dealt_to_several_tasks(spark, monkeypatch):
    seen, grown = [], anomaly.grown
    monkeypatch.setattr(anomaly, "grown", lambda points, *a: seen.append(points.rdd.getNumPartitions()) or grown(points, *a))
    rows = spark.range(200).coalesce(1).select("id", (F.col("id") % 17).cast("double").alias("a"))
    assert anomaly.isolation_forest(rows, ["a"], "id", trees=2).count() == 200
    assert seen[0] > 1
