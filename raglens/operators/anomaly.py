"""Anomaly bands, deviations and an isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raglens.functions.scalars import finite
from raglens.operators.percentiles import percentiles
from raglens.sources.shared import written


def percentile_band(rows: DataFrame, features: list[str], digits: int | None = 6) -> DataFrame:
    """feature, low (p5), high (p95): one row each."""
    out = None
    for f in features:
        one = percentiles(rows, finite(F.col(f)), {"low": 0.05, "high": 0.95}, digits=digits).select(F.lit(f).alias("feature"), "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


def deviation(x: Column, low: Column, high: Column) -> Column:
    """How far a value is outside of its band, in band widths; a band without width counts 1."""
    span = F.when(high > low, high - low).otherwise(1.0)
    return F.round(F.greatest((low - x) / span, (x - high) / span, F.lit(0.0)), 4)


def feature_deviation(rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, one deviation per feature, the peak feature (the first on ties) and the severity.
    Rows with a NULL feature are dropped."""
    rows = rows.dropna(subset=features)
    band = percentile_band(rows, features, None).groupBy().agg(*(F.max(F.when(F.col("feature") == f, F.array("low", "high"))).alias(f"_{f}") for f in features))
    d = rows.join(F.broadcast(band)).select(key, *(deviation(F.col(f), F.get(F.col(f"_{f}"), 0), F.get(F.col(f"_{f}"), 1)).alias(f"{f}_dev") for f in features))
    devs = [F.col(f"{f}_dev") for f in features]
    top = F.greatest(*devs) if len(devs) > 1 else devs[0]
    peak = F.coalesce(*(F.when(c == top, F.lit(f)) for c, f in zip(devs, features)))
    return d.withColumn("peak_feature", peak).withColumn("severity", severity(top))


def severity(dev: Column) -> Column:
    return F.when(dev >= 1, "high").when(dev >= 0.5, "medium").otherwise("low")


def detection_report(found: DataFrame, deviations: DataFrame, key: str) -> DataFrame:
    """One row: rows, flagged ones and their share, and the mean of their peak deviation."""
    devs = [c for c in deviations.columns if c.endswith("_dev")]
    top = F.greatest(*devs) if len(devs) > 1 else F.col(devs[0])
    rows = found.join(deviations.select(key, top.alias("_d")), key, "left")
    return rows.agg(F.count("*").alias("rows"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"), F.round(F.avg(F.when(F.col("flagged"), F.col("_d"))), 6).alias("mean_deviation"))


#: Nodes of a level that a tree grows at most: one with a smaller share of the rows is a leaf.
NODES = 4096
#: Rows that a task routes at once, and rows of a box of these.
AT_ONCE, BOX = 1 << 20, 16
#: Tasks for each core of the cluster: routing is work for each row and tree, however few bytes.
TASKS = 2


def _c(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (many - 1) / many))


def uniform(seed: int, tree: int, node: np.ndarray, j: int) -> np.ndarray:
    """Numbers from 0 to 1 of a hash of seed, tree, node and j: the same wherever they are drawn."""
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) * 64 + j + 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def splits(seed: int, tree: int, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every node (1 is the root, 2v and 2v + 1 are the children of v) a random feature of
    those with a range, and a random cut in it."""
    draws = np.column_stack([uniform(seed, tree, node, j) for j in range(lo.shape[1])])
    f = np.where(hi > lo, draws, -1.0).argmax(1)
    at = np.arange(len(f))
    return f, lo[at, f] + uniform(seed, tree, node, 63) * (hi[at, f] - lo[at, f])


class Tree:
    """Node by node: its name (1 is the root), feature (-1: a leaf or still open), cut, left child
    (the right one follows) and the path length that ends in it."""

    def __init__(self) -> None:
        self.name, self.f, self.cut, self.kid, self.path = np.array([1]), np.array([-1], np.int16), np.zeros(1), np.zeros(1, np.int64), np.zeros(1)
        self.open = 0  # the first open node; all behind it are open too

    def nodes(self, x: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """The lowest node of each point, from the node (else the root) that it is known to be in."""
        node = np.zeros(len(x), np.int64) if node is None else node.copy()
        live = np.flatnonzero(self.f[node] >= 0)
        while len(live):
            at = node[live]
            at = self.kid[at] + (x[live, self.f[at]] >= self.cut[at])
            node[live] = at
            live = live[self.f[at] >= 0]
        return node

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The lowest node that holds a whole box, for boxes from lo to hi."""
        node, live = np.zeros(len(lo), np.int64), np.arange(len(lo) if self.f[0] >= 0 else 0)
        while len(live):
            at = node[live]
            f, cut = self.f[at], self.cut[at]
            right = lo[live, f] >= cut
            one = right | (hi[live, f] < cut)
            live, at = live[one], self.kid[at[one]] + right[one]
            node[live] = at
            live = live[self.f[at] >= 0]
        return node

    def grow(self, seed: int, tree: int, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, depth: int, most: int, least: int) -> bool:
        """Splits the open nodes, of whose rows lo, hi and n are ranges and numbers, or makes them
        leaves; whether nodes are open now."""
        v = slice(self.open, len(self.f))
        f, cut = splits(seed, tree, self.name[v], lo, hi)
        grows = (hi > lo).any(1) & (n > least) & (depth < most)
        self.path[v] = depth + _c(n)
        self.f[v], self.cut[v] = np.where(grows, f, -1), cut
        self.open, kids = len(self.f), self.name[v][grows]
        at = self.kid[v]
        at[grows] = self.open + 2 * np.arange(len(kids))
        new = np.column_stack([2 * kids, 2 * kids + 1]).ravel()
        zero = np.zeros(len(new))
        self.name, self.f, self.cut, self.kid, self.path = (np.concatenate(x) for x in ((self.name, new), (self.f, np.full(len(new), -1, np.int16)), (self.cut, zero), (self.kid, zero.astype(np.int64)), (self.path, zero)))
        return len(new) > 0


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= AT_ONCE:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


class Boxes:
    """Points in an order in which neighbours are near each other, cut into boxes of BOX points: a
    tree routes a box as one for as long as it lies on one side of the cuts."""

    def __init__(self, x: np.ndarray) -> None:
        n, k = x.shape
        strips = max(1, round((n / BOX) ** (1 / k)))
        strip, self.order = np.zeros(n, np.int64), np.arange(n)
        for j in range(k):  # strips of equal numbers of points, cut again by each further feature
            self.order = np.lexsort((x[:, j], strip))
            if j < k - 1:
                first = np.searchsorted(strip[self.order], np.arange(strip.max() + 2))
                place = np.empty(n, np.int64)
                place[self.order] = np.arange(n) - np.repeat(first[:-1], np.diff(first))
                strip = strip * strips + place * strips // np.diff(first)[strip]
                strip = np.unique(strip, return_inverse=True)[1]
        self.x, self.first = x[self.order], np.arange(0, n, BOX)
        self.n = np.diff(np.append(self.first, n))
        self.lo, self.hi = np.minimum.reduceat(self.x, self.first), np.maximum.reduceat(self.x, self.first)
        self.box = np.repeat(np.arange(len(self.first)), self.n)

    def routed(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The node that each box shares; the points of boxes that were cut, and their nodes."""
        node = tree.shared(self.lo, self.hi)
        cut = np.flatnonzero((tree.f[node] >= 0)[self.box])
        return node, cut, tree.nodes(self.x[cut], node[self.box[cut]])

    def paths(self, tree: Tree) -> np.ndarray:
        """The path length of each point, in the order of the boxes."""
        node, cut, low = self.routed(tree)
        out = tree.path[node][self.box]
        out[cut] = tree.path[low]
        return out

    def ranges(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Open nodes that have points, and the least and greatest values and numbers of these."""
        node, cut, low = self.routed(tree)
        whole, part = np.flatnonzero(node >= tree.open), np.flatnonzero(low >= tree.open)
        points = self.x[cut[part]]
        node, n = np.concatenate([node[whole], low[part]]), np.concatenate([self.n[whole], np.ones(len(part), np.int64)])
        lo, hi = np.vstack([self.lo[whole], points]), np.vstack([self.hi[whole], points])
        if not len(node):
            return node, lo, hi, n
        by = np.argsort(node, kind="stable")
        node = node[by]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        return node[first], np.minimum.reduceat(lo[by], first), np.maximum.reduceat(hi[by], first), np.add.reduceat(n[by], first)


def grown(points: DataFrame, names: list[str], trees: int, most: int, least: int, seed: int) -> list[Tree]:
    """All trees, level by level. A task routes its rows to their nodes and reports the ranges and
    the number of rows of each open node, once for all of its rows; these are merged by (tree,
    node), so that nodes are shuffled and never rows. A level has at most 2 x NODES open nodes for
    each tree."""
    spark, k = points.sparkSession, len(names)
    forest, columns = [Tree() for _ in range(trees)], [*(f"lo{i}" for i in range(k)), *(f"hi{i}" for i in range(k))]
    alive, depth = set(range(trees)), 0
    while alive:
        held = spark.sparkContext.broadcast((forest, sorted(alive)))

        def facts(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            forest, alive = held.value
            total: dict[int, list[np.ndarray]] = {}
            for pdf in _chunks(batches):
                boxes = Boxes(pdf[names].to_numpy())
                for t in alive:
                    node, lo, hi, n = boxes.ranges(forest[t])
                    at = node - forest[t].open
                    if t not in total:
                        size = len(forest[t].f) - forest[t].open
                        total[t] = [np.full((size, k), np.inf), np.full((size, k), -np.inf), np.zeros(size, np.int64)]
                    total[t][0][at] = np.minimum(total[t][0][at], lo)
                    total[t][1][at] = np.maximum(total[t][1][at], hi)
                    total[t][2][at] += n
            for t, (lo, hi, n) in total.items():
                some = np.flatnonzero(n)
                yield pd.DataFrame(np.hstack([lo[some], hi[some]]), columns=columns).assign(tree=t, node=some + forest[t].open, n=n[some])

        rows = points.mapInPandas(facts, ", ".join([*(f"{c} double" for c in columns), "tree int, node long, n long"]))
        low, high = [F.min(c).alias(c) for c in columns[:k]], [F.max(c).alias(c) for c in columns[k:]]
        found = rows.groupBy("tree", "node").agg(*low, *high, F.sum("n").alias("n")).toPandas()
        by = {t: g.sort_values("node") for t, g in found.groupby("tree")}
        for t in sorted(alive):
            tree, g = forest[t], by[t]
            lo, hi, n = np.zeros((len(tree.f) - tree.open, k)), np.zeros((len(tree.f) - tree.open, k)), np.zeros(len(tree.f) - tree.open)
            at = g["node"].to_numpy() - tree.open
            lo[at], hi[at], n[at] = g[columns[:k]].to_numpy(), g[columns[k:]].to_numpy(), g["n"].to_numpy()
            if not tree.grow(seed, t, lo, hi, n, depth, most, least):
                alive.discard(t)
        depth += 1
        held.unpersist()
    return forest


def isolation_forest(rows: DataFrame, features: list[str], key: str, trees: int = 100, contamination: float = 0.02, seed: int = 42, nodes: int = NODES) -> DataFrame:
    """key, score (higher: more anomalous), flagged. Every tree is fitted on all rows and cut at a
    depth of log2 of their number; a node that holds no more than one of `nodes` parts of all rows
    is a leaf, whose rows get the mean path length of trees over as many. The rows are dealt once to
    TASKS tasks for each core; growing then moves nodes' ranges, and scoring reads each row once,
    with the trees broadcast (at most some 100 bytes x trees x nodes x depth). Values that are NULL or no numbers count as 0.
    Fewer than 10 rows score 0; rows without any range score alike and none is flagged."""
    names = [f"_x{i}" for i in range(len(features))]
    x = written(rows.select(F.col(key).alias("k"), *(F.coalesce(finite(F.col(f)), F.lit(0.0)).cast("double").alias(c) for f, c in zip(features, names))).repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism), "features")
    n = x.count()
    if n < 10:
        return x.select(F.col("k").alias(key), F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    most = int(np.ceil(np.log2(n)))
    forest = rows.sparkSession.sparkContext.broadcast(grown(x.select(*names), names, trees, most, n // nodes, seed))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(batches):
            boxes, path = Boxes(pdf[names].to_numpy()), np.zeros(len(pdf))
            path[boxes.order] = sum(boxes.paths(tree) for tree in forest.value)
            yield pd.DataFrame({"k": pdf["k"], "score": 2.0 ** -np.round(path / trees / float(_c(n)), 12)})

    kind = x.schema["k"].dataType.simpleString()
    s = written(x.mapInPandas(scored, f"k {kind}, score double"), "scores").withColumnRenamed("k", key)
    cut = s.agg(F.percentile_approx("score", 1 - contamination, 100_000).alias("_cut"))
    return s.join(F.broadcast(cut)).select(key, "score", (F.col("score") > F.col("_cut")).alias("flagged"))
