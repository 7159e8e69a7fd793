"""Exact inner-product search over clusters of vectors.

An index deals all vectors to the nearest of a few centres and keeps, for each cluster, the
largest distance (radius) and the number of its vectors. For any vector v of a cluster and any
query q, |q.v - q.centre| <= |q| * radius, so that whole clusters are skipped without losing a
neighbour: a query first meets the clusters whose centres it is most like, and then, with the
k-th score found there, those of the others that may hold a better one.

Queries meet vectors by a join on the cluster, in groups of at most about CELL vectors and BLOCK
queries, as matrix products. No query passes through the driver, and the number of passes over
the vectors doesn't follow the number of queries. Only the centres, at most CLUSTERS of them and
fitted on a sample of about SAMPLE vectors, are held whole; every vector is indexed.

How much is skipped depends on the vectors: VectorIndex.skipped() measures it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raglens.sources.shared import written

#: Most centres, and vectors for each below that.
CLUSTERS, PER_CLUSTER = 256, 2048
#: Vectors, about, that the centres are fitted on, and rounds of that.
SAMPLE, ROUNDS = 16_384, 4
#: Vectors and queries that meet at once, and queries of one matrix product.
CELL, BLOCK, AT_ONCE = 65_536, 16_384, 256
#: Scores are rounded to six digits; bounds leave room for that.
MARGIN = 2e-6


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fitted(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centres of the rows of x, by rounds of nearest centres and their means."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, c)[0]
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, np.column_stack([np.bincount(near, w, k) for w in x.T]) / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
    return near, np.linalg.norm(x - c[near], axis=1)


def greatest(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The greatest score that a query may have in each cluster."""
    return q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radius + MARGIN


@dataclass
class Bounds:
    """What tasks know of the clusters: centres, radius and n, one for each."""

    centres: np.ndarray
    radius: np.ndarray
    n: np.ndarray

    def home(self, q: np.ndarray, k: int) -> np.ndarray:
        """The clusters of the likest centres that together hold more than k vectors."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before <= k, 1)
        return out & (self.n > 0)

    def reach(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The clusters that may hold a score of `least`."""
        return (self.n > 0) & (greatest(q, self.centres, self.radius) >= least[:, None])


@dataclass
class VectorIndex:
    """rows: cluster, doc_id, embedding of every vector, and what is known of the clusters."""

    rows: DataFrame
    bounds: Bounds

    @staticmethod
    def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS) -> VectorIndex:
        """Rows without an id or a vector are left out; vectors of several lengths are an error."""
        v = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector).alias("embedding")).where("doc_id is not null and size(embedding) > 0")
        about = v.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
        if about["a"] != about["b"]:
            raise ValueError(f"the vectors have {about['a']} to {about['b']} entries")
        if not about["n"]:
            return VectorIndex(v.withColumn("cluster", F.lit(0)), Bounds(np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64)))
        share = min(1.0, SAMPLE / about["n"])
        some = v.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))) if share < 1 else v
        x = _matrix(some.select("embedding").toPandas()["embedding"])
        held = fitted(x, max(1, min(clusters, len(x), about["n"] // PER_CLUSTER)))

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    near, far = nearest(_matrix(pdf["embedding"]), held)
                    yield pdf.assign(cluster=near, far=far)

        kind = v.schema["embedding"].dataType.simpleString()
        rows = written(v.mapInPandas(dealt, f"doc_id long, embedding {kind}, cluster int, far double"), "clusters")
        facts = rows.groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n")).toPandas().set_index("cluster").reindex(range(len(held)), fill_value=0)
        return VectorIndex(rows.drop("far"), Bounds(held, facts["radius"].to_numpy(float), facts["n"].to_numpy(np.int64)))

    def _pairs(self, queries: DataFrame, chosen: Callable[[np.ndarray, pd.DataFrame], np.ndarray], extra: str = "") -> DataFrame:
        """A row for each query (query_id, q and the columns of extra) and cluster that chosen()
        marks for it."""
        columns = ["query_id", "q", *(x.split()[0] for x in extra.split(", ") if x)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for s in range(0, len(pdf), AT_ONCE):
                    some = pdf.iloc[s : s + AT_ONCE]
                    row, cluster = np.nonzero(chosen(_matrix(some["q"]), some))
                    yield some.iloc[row][columns].assign(cluster=cluster.astype(np.int32))

        return queries.mapInPandas(run, ", ".join(["query_id long", "q array<double>", *([extra] if extra else []), "cluster int"]))

    def _met(self, pairs: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """work(ids, matrix, queries, their rows) for each group of vectors and queries of a cluster."""
        spark = pairs.sparkSession
        pairs = written(pairs, "asked")
        asked = pairs.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each cluster at most
        subs = spark.createDataFrame([(c, int(-(-n // CELL))) for c, n in enumerate(self.bounds.n.tolist()) if n], "cluster int, subs int")
        sizes = F.broadcast(asked.join(F.broadcast(subs), "cluster"))
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        key = ["cluster", "sub", "block"]
        left = self.rows.join(sizes, "cluster").select("cluster", deal("doc_id", "subs").alias("sub"), every("blocks").alias("block"), "doc_id", "embedding")
        right = pairs.join(sizes, "cluster").withColumn("block", deal("query_id", "blocks")).withColumn("sub", every("subs")).drop("blocks", "subs")
        names = [x.split()[0] for x in schema.split(", ")]

        def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(v) or not len(q):
                return pd.DataFrame({c: [] for c in names})
            ids, m = v["doc_id"].to_numpy(), _matrix(v["embedding"])
            return pd.concat([work(ids, m, _matrix(some["q"]), some) for some in (q.iloc[s : s + AT_ONCE] for s in range(0, len(q), AT_ONCE))])

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, doc_id, score, rank of the k best vectors of each query (query_id, q) but the
        one of its own id; ties by doc_id."""
        queries = _asked(queries)
        schema = "query_id long, doc_id long, score double"

        def best(ids: np.ndarray, m: np.ndarray, q: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
            ask = rows["query_id"].to_numpy()
            s = np.round(q @ m.T, 6)
            s[ask[:, None] == ids[None]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            found = np.take_along_axis(s, order, 1)
            keep = found.ravel() > -np.inf
            return pd.DataFrame({"query_id": np.repeat(ask, order.shape[1])[keep], "doc_id": ids[order].ravel()[keep], "score": found.ravel()[keep]})

        b = self.bounds
        if not len(b.n):
            return _ranked(queries.sparkSession.createDataFrame([], schema), k)
        hits = _ranked(self._met(self._pairs(queries, lambda q, _: b.home(q, k)), best, schema), k)
        if len(b.n) == 1:
            return hits
        hits = written(hits, "near")
        least = hits.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        rest = queries.join(least, "query_id", "left").fillna(float("-inf"), "least")
        more = self._met(self._pairs(rest, lambda q, rows: ~b.home(q, k) & b.reach(q, rows["least"].to_numpy())), best, schema)
        return _ranked(hits.drop("rank").unionByName(more), k)

    def before(self, queries: DataFrame) -> DataFrame:
        """query_id, n: how many vectors but the query's own come before a score and id that the
        query brings (query_id, q, score, doc_id). Clusters that lie wholly behind it aren't
        read."""
        extra = "score double, doc_id long"
        queries = _asked(queries, ["score", "doc_id"])

        def count(ids: np.ndarray, m: np.ndarray, q: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
            s, top, at = np.round(q @ m.T, 6), rows["score"].to_numpy()[:, None], rows["doc_id"].to_numpy()[:, None]
            ask = rows["query_id"].to_numpy()
            return pd.DataFrame({"query_id": ask, "n": (((s > top) | ((s == top) & (ids[None] < at))) & (ask[:, None] != ids[None])).sum(1)})

        b = self.bounds
        parts = self._met(self._pairs(queries, lambda q, rows: b.reach(q, rows["score"].to_numpy()), extra), count, "query_id long, n long")
        return queries.select("query_id").join(parts.groupBy("query_id").agg(F.sum("n").alias("n")), "query_id", "left").fillna(0, "n")

    def skipped(self, queries: DataFrame, k: int = 5) -> float:
        """The share of (query, vector) pairs that search() doesn't compare."""
        queries = _asked(queries)
        least = self.search(queries, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        rest = queries.join(least, "query_id", "left").fillna(float("-inf"), "least")
        b = self.bounds
        met = self._pairs(rest, lambda q, rows: b.home(q, k) | b.reach(q, rows["least"].to_numpy()), "least double").groupBy("cluster").agg(F.count("*").alias("c")).toPandas()
        return 1 - float((b.n[met["cluster"]] * met["c"]).sum()) / max(1, int(b.n.sum()) * queries.count())


def _asked(queries: DataFrame, more: list[str] = []) -> DataFrame:
    return queries.where("query_id is not null and size(q) > 0").select("query_id", F.col("q").cast("array<double>").alias("q"), *more)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
