"""Lexical, vector and hybrid retrieval, and its metrics, as relations: queries x postings,
queries x vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import estimate_tokens, words
from raglens.operators.text_index import TextIndex
from raglens.operators.vector_index import VectorIndex

#: Fused candidates that a reranker scores.
RERANKED = 20


def ranked(scores: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score (floored at 0) of the documents that hold a term of the query.
    docs: doc_id, text; queries: query_id, text."""
    return TextIndex.build(docs, k1, b).scores(queries)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best of bm25_scores() for each query, with their rank; ties by doc_id."""
    return TextIndex.build(docs, k1, b).search(queries, k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact inner-product neighbours of every query among all other vectors: query_id, doc_id,
    score, rank; through an index of clusters built for it."""
    return VectorIndex.build(vectors).search(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


def first_relevant(vectors: DataFrame, queries: DataFrame, relevant: DataFrame, index: VectorIndex | None = None) -> DataFrame:
    """query_id, first: the rank of the best relevant document in the whole ranking, without
    ranking all: the documents before it are counted. relevant: query_id, doc_id."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).where("q is not null")
    v = vectors.select(F.col("vec_id").alias("doc_id"), "embedding").where("embedding is not null")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rel = relevant.where("query_id <> doc_id").join(q, "query_id").join(v, "doc_id").select("query_id", F.round(dot, 6).alias("score"), "doc_id")
    # vectors aren't sorted along
    best = rel.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("back"))).alias("x")).select("query_id", "x.score", (-F.col("x.back")).alias("doc_id")).join(q, "query_id")
    return (index or VectorIndex.build(vectors)).before(best).select("query_id", (F.col("n") + 1).alias("first"))


def rrf(rankings: list[DataFrame], k: int = 60, top: int = 5) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank); a document counts once in
    each, where it stands first. Ties: the best rank, then that in the first ranking, then the id."""
    every = None
    for i, r in enumerate(rankings):
        one = r.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).withColumn("first", F.lit(i == 0))
        every = one if every is None else every.unionByName(one)
    scores = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (max(0, k) + F.col("rank"))), 9).alias("score"), F.min("rank").alias("_best"), F.min(F.when(F.col("first"), F.col("rank"))).alias("_lexical"))
    return ranked(scores, top, F.desc("score"), "_best", F.asc_nulls_last("_lexical"), "doc_id").drop("_best", "_lexical")


def hybrid_search(lexical: DataFrame, dense: DataFrame, top: int = 5, gate: float = 0.25) -> DataFrame:
    """RRF of both lists; a query's dense list counts only if its best score reaches the gate."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return rrf([lexical, dense.withColumn("_b", best).where(F.col("_b") >= gate)], top=top)


def with_stages(fused: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """The fused rows with their scores in each stage, NULL where a list doesn't hold them."""
    key = ["query_id", "doc_id"]
    side = lambda d, name: d.groupBy(*key).agg(F.max("score").alias(name))
    return fused.join(side(lexical, "bm25_score"), key, "left").join(side(dense, "vector_score"), key, "left")


def rerank(fused: DataFrame, score: Column, top: int = 5) -> DataFrame:
    """The first RERANKED rows of each query by a new score, best first, those behind them in
    their order; `score` is a column over the rows of `fused`."""
    s = fused.withColumn("rerank_score", F.when(F.col("rank") <= RERANKED, score))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def context_block(hits: DataFrame) -> DataFrame:
    """query_id, context, context_tokens, top_score of hits (query_id, rank, title, source,
    content, score): numbered passages by rank."""
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(" ("), "source", F.lit(")\n"), "content")
    g = hits.withColumn("_p", piece).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_p"))).alias("x"), F.max("score").alias("top_score"))
    g = g.select("query_id", F.array_join(F.transform("x", lambda e: e["_p"]), "\n\n").alias("context"), "top_score")
    return g.select("query_id", "context", estimate_tokens(F.col("context")).alias("context_tokens"), "top_score")


def class_totals(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, relevant (their number) and ideal (the greatest DCG at k) where the relevant
    documents of a query are those of its class but itself, without a row for each pair.
    queries: query_id, class; docs: doc_id, class, gain."""
    order = [F.desc("gain"), "doc_id"]
    # one more than k, as the query itself may be among them
    best = docs.where("class is not null").withColumn("_p", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("_p") <= k + 1).drop("_p")
    best = queries.join(best, "class").where("query_id <> doc_id")
    best = best.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_p") <= k)
    best = best.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("_p") + 1)).alias("ideal"))
    own = docs.select(F.col("doc_id").alias("query_id"), "class", F.lit(1).alias("_own"))
    n = docs.groupBy("class").agg(F.count("*").alias("_n"))
    relevant = queries.join(n, "class").join(own, ["query_id", "class"], "left").select("query_id", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("relevant"))
    return relevant.join(best, "query_id")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int, first: DataFrame | None = None, total: DataFrame | None = None) -> DataFrame:
    """Metrics at k of each query with relevant documents. hits: query_id, doc_id, rank;
    relevant: query_id, doc_id and maybe grade (else 1; negative ones count 0); first: rank of
    the first relevant document (query_id, first), where hits don't hold the whole ranking;
    total: query_id, relevant, ideal, where `relevant` has only the pairs that are hits."""
    grade = F.greatest(F.lit(0.0), F.col("grade").cast("double")) if "grade" in relevant.columns else F.lit(1.0)
    rel = relevant.select("query_id", "doc_id", grade.alias("gain")).groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    if total is None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id"))
        best = F.sum(F.when(F.col("_p") <= k, F.col("gain") / F.log2(F.col("_p") + 1)))
        total = rel.withColumn("_p", place).groupBy("query_id").agg(F.count("*").alias("relevant"), best.alias("ideal"))
    once = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = once.join(rel, ["query_id", "doc_id"])
    near = F.col("rank") <= k
    g = found.groupBy("query_id").agg(F.count_if(near).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(near, F.col("gain") / F.log2(F.col("rank") + 1))).alias("dcg"))
    if first is not None:
        g = g.drop("first").join(first, "query_id", "full")
    g = total.join(g, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    p, r = F.col("hits") / k, F.col("hits") / F.col("relevant")
    return g.select(
        "query_id",
        p.alias("precision"),
        F.round(r, 9).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9).alias("f1"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"),
        F.round(F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).otherwise(0.0), 9).alias("ndcg"),
        (F.col("hits") > 0).alias("hit"),
    )


def missed_documents(hits: DataFrame, relevant: DataFrame, k: int, once: bool = True) -> DataFrame:
    """query_id, doc_id of relevant documents that aren't among the first k; once: each pair once,
    which holds all pairs in a shuffle."""
    near = hits.where(F.col("rank") <= k).select("query_id", "doc_id")
    pairs = relevant.select("query_id", "doc_id")
    return (pairs.distinct() if once else pairs).join(F.broadcast(near), ["query_id", "doc_id"], "left_anti")


def metrics_by_k(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...], first: DataFrame | None = None, asked: DataFrame | None = None, total: dict[int, DataFrame] | None = None) -> DataFrame:
    """Means over the queries for each k. asked: all queries (query_id), of which some may
    have no hit: their share is zero_result_rate, and avg_documents counts theirs as 0. total: for
    each k what retrieval_metrics() takes."""
    shown = hits.select("query_id").distinct() if asked is None else asked.select("query_id").distinct()
    out = None
    for k in ks:
        m = retrieval_metrics(hits, relevant, k, first, total and total[k]).agg(
            F.lit(k).alias("k"), F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "ndcg")), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate")
        )
        n = shown.join(hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
        n = n.agg(F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("zero_result_rate"), F.round(F.avg("n"), 6).alias("avg_documents"))
        m = m.join(F.broadcast(n))  # one row each
        out = m if out is None else out.unionByName(m)
    return out


def no_answer_report(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: queries that have no answer (query_id), and how many of them got documents."""
    got = asked.select("query_id").distinct().join(hits.select("query_id").distinct().withColumn("_g", F.lit(1)), "query_id", "left")
    return got.agg(F.count("*").alias("queries"), F.count("_g").alias("with_results"), F.round(F.coalesce(F.avg(F.coalesce("_g", F.lit(0))), F.lit(0.0)), 6).alias("share"))
