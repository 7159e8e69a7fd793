"""A stored inverted index for BM25.

The documents are dealt to ranges of about RANGE documents by a hash of their id, once, and each
range is tokenised and grouped in the task that has it: a block holds the postings of one term in
one range - documents, frequencies and lengths - with the greatest frequency and the least length
in it, from which no posting of the block can weigh more than bound(). Terms have their document
frequency and idf beside.

A search bounds every (query, range) by the sum over the query's terms. It scores the range of
the greatest bound first; ranges whose bound is below the k-th score found there hold no better
document, as all postings of a document are in its one range, and are skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import words
from raglens.sources.shared import written

#: Documents of a range, about.
RANGE = 256
#: Characters of a task, about, whatever the number of shuffle partitions: a task holds the distinct
#: words of its documents, and in a search a score for each of them and query.
CHARS = 4_000_000
#: Terms of queries that are broadcast; more of them meet the blocks in a shuffle.
TERMS = 200_000
#: Pairs of queries and ranges that are broadcast, some 50 bytes each.
PAIRS = 1_000_000
#: Scores are rounded to six digits; bounds leave room for that.
MARGIN = 1e-6


@dataclass
class TextIndex:
    """blocks: term, rng, n, most (greatest frequency), least (least length), postings; terms:
    term, df, idf; ranges, parts (the tasks that they are dealt to) and avg_len: numbers."""

    blocks: DataFrame
    terms: DataFrame
    ranges: int
    parts: int
    n: int
    avg_len: float
    k1: float
    b: float

    @staticmethod
    def build(docs: DataFrame, k1: float = 1.5, b: float = 0.75, size: int = RANGE) -> TextIndex:
        """The index of docs (doc_id, text). Documents without words count in the mean length,
        those without a text only among the documents. A term in more than half of all documents has a negative idf, for which a quarter of the
        mean over the vocabulary stands."""
        docs = docs.select("doc_id", "text")
        n, texts, chars = docs.agg(F.count("*"), F.count("text"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        ranges = max(1, -(-n // size))
        parts = max(1, min(ranges, -(-chars // CHARS)))
        rng = F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")
        dealt = docs.withColumn("rng", rng).repartition(parts, "rng")
        tokens = dealt.select("rng", "doc_id", words(F.col("text")).alias("ws"))
        # a document without words keeps one row, of a null term
        each = tokens.select("rng", "doc_id", F.size("ws").alias("len"), F.explode_outer("ws").alias("term"))
        counts = each.groupBy("rng", "doc_id", "len", "term").agg(F.count("*").cast("int").alias("tf"))
        blocks = counts.groupBy("rng", "term").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("len").alias("least"), F.sum("tf").alias("words"), F.collect_list(F.struct("doc_id", "tf", "len")).alias("postings"))
        blocks = written(blocks.sortWithinPartitions("term", "rng"), "blocks")
        facts = blocks.where("term is not null").agg(F.sum("words").alias("w")).first()  # each document's words are the sum of its frequencies
        df = blocks.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
        df = written(df.withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
        mean = df.agg(F.avg("idf").alias("m")).first()["m"] or 0.0
        terms = df.withColumn("idf", F.when(F.col("idf") < 0, F.lit(0.25 * mean)).otherwise(F.col("idf")))
        return TextIndex(blocks.where("term is not null"), terms, ranges, parts, n, (facts["w"] or 0) / max(texts, 1), k1, b)

    def statistics(self) -> DataFrame:
        """One row: documents, terms, postings and the mean length of a text in words."""
        return self.terms.agg(F.lit(self.n).cast("long").alias("documents"), F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.round(F.lit(self.avg_len), 6).alias("avg_len"))

    def weight(self, tf: Column, length: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.avg_len))

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, idf of the terms of queries (query_id, text) that the corpus has."""
        each = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        terms = each.select("term").distinct()
        few = terms.count() <= TERMS
        known = self.terms.join(F.broadcast(terms) if few else terms, "term", "left_semi").select("term", "idf")
        return written(each.join(known, "term").select("query_id", "term", "idf"), "asked")

    def _own(self, asked: DataFrame, columns: list[str]) -> DataFrame:
        """The blocks of the terms that are asked for, only those columns of them."""
        terms = asked.select("term").distinct()
        few = terms.count() <= TERMS
        return self.blocks.select("term", "rng", *columns).join(F.broadcast(terms) if few else terms, "term", "left_semi")

    def bounds(self, asked: DataFrame) -> DataFrame:
        """query_id, rng, bound, postings (their number) of the ranges that hold a term of a query."""
        own = self._own(asked, ["n", "most", "least"]).join(asked, "term")
        most = F.greatest(F.col("idf"), F.lit(0.0)) * self.weight(F.col("most"), F.col("least"))
        return own.groupBy("query_id", "rng").agg(F.sum(most).alias("bound"), F.sum("n").alias("postings"))

    def contributions(self, asked: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """query_id, rng, doc_id, term, tf, idf, weight (its part of the score) of all postings of
        the queries' terms, or of those in pairs (query_id, rng). The blocks are dealt by range, so
        that what is summed for a document stays where it is."""
        few = lambda x, most: F.broadcast(x) if x.count() <= most else x
        own = self._own(asked, ["postings"])
        if pairs is not None:  # only the ranges of some pair are shuffled
            own = own.join(few(pairs.select("rng").distinct(), PAIRS), "rng", "left_semi")
        met = own.repartition(self.parts, "rng").join(few(asked, TERMS), "term")
        if pairs is not None:
            met = met.join(few(pairs.select("query_id", "rng"), PAIRS), ["query_id", "rng"], "left_semi")
        each = met.select("query_id", "rng", "term", "idf", F.explode("postings").alias("p")).select("query_id", "rng", "p.doc_id", "term", "p.tf", "idf", "p.len")
        return each.select("query_id", "rng", "doc_id", "term", "tf", "idf", (F.col("idf") * self.weight(F.col("tf"), F.col("len"))).alias("weight"))

    @staticmethod
    def summed(parts: DataFrame, k: int | None = None) -> DataFrame:
        """The scores; with k only those that are among the k best of their query and range."""
        out = parts.groupBy("query_id", "rng", "doc_id").agg(F.round(F.greatest(F.sum("weight"), F.lit(0.0)), 6).alias("score"))
        if k is not None:
            w = Window.partitionBy("rng", "query_id").orderBy(F.desc("score"), "doc_id")
            out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
        return out.select("query_id", "doc_id", "score")

    def scores(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, score (floored at 0) of every document that holds a term of the query."""
        return self.summed(self.contributions(self.asked(queries)))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, doc_id, score, rank of the k best documents of each query; ties by doc_id."""
        return self._search(queries, k)[0]

    def _search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The hits, and the pairs (query_id, rng) that were scored for them."""
        asked = self.asked(queries)
        bounds = written(self.bounds(asked), "bounds")
        first = bounds.groupBy("query_id").agg(F.max_by("rng", F.struct("bound", "rng")).alias("rng"))
        first = written(first, "first")
        near = written(_ranked(self.summed(self.contributions(asked, first), k), k), "near")
        least = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        rest = bounds.join(first, ["query_id", "rng"], "left_anti").join(least, "query_id").where(F.col("bound") + MARGIN >= F.col("least"))
        rest = written(rest.select("query_id", "rng"), "rest")
        hits = near.drop("rank").unionByName(self.summed(self.contributions(asked, rest), k))
        return _ranked(hits, k), first.unionByName(rest)

    def skipped(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """One row: blocks' postings of the queries' terms, and how many of them search() leaves."""
        _, met = self._search(queries, k)
        every = self.bounds(self.asked(queries))
        read = every.join(met, ["query_id", "rng"], "left_semi").agg(F.coalesce(F.sum("postings"), F.lit(0)).alias("read"))
        return every.agg(F.coalesce(F.sum("postings"), F.lit(0)).alias("postings")).join(F.broadcast(read)).select("postings", (F.col("postings") - F.col("read")).alias("skipped"))

    def explain(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """query_id, doc_id, term, tf, idf, weight: what each term gives to the score of the hits
        (query_id, doc_id), read from the blocks of their ranges."""
        hits = hits.select("query_id", "doc_id").distinct()
        pairs = hits.select("query_id", F.pmod(F.xxhash64("doc_id"), F.lit(self.ranges)).cast("int").alias("rng")).distinct()
        return self.contributions(self.asked(queries), pairs).join(hits, ["query_id", "doc_id"], "left_semi").drop("rng")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
