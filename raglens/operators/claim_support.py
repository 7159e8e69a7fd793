"""Claims of answers against the sentences of their context, by overlap and similarity.

Claims and sentences of an item are cut into blocks of BLOCK. Every block of claims meets every
block of sentences of its item in one row, where a task takes two matrix products: of the
vectors for the similarities, of the content words for the overlaps. What a claim knows of one
block is a state of fixed size, and the states of a claim are merged in the order of the
sentences, so that no task and no row ever holds an item's whole matrix. The sentence blocks of
an item of several claim blocks are dealt to these, so that a long item isn't one task's.

Vectors may come with the texts. Where no model is, signed feature hashing of the letter triples
of the words stands in: texts that share parts of words are alike without sharing a word.

Defined results: a null or empty answer has no claims and scores 1.0; a claim without context is
unsupported, its sentence NULL and its numbers 0. Of equal similarities the first sentence
counts. A zero vector is like nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import claims, content_words
from raglens.operators.evaluation import SETTLES, SIMILAR, SUPPORTS

#: Texts of a block.
BLOCK = 256
#: Answers of a task, about: what it gets at once is held by its Python worker.
ANSWERS = 1000
#: States that a task hands on at once.
AT_ONCE = 4096
#: Width of hashed vectors; two hexadecimal digits name a place.
WIDTH = 256
#: Names of what a claim's verdict rests on.
BY_EMBEDDING, BY_SIMILARITY, BY_WORDS = "deterministic_embedding", "embedding_similarity", "deterministic_alignment"


def hashed_features(text: Column) -> Column:
    """Signed places (1 to WIDTH, negative where the hash says so) of the letter triples of the
    words, each word between two marks; repeated ones stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    triples = F.flatten(F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("#"), w, F.lit("#")), i, F.lit(3)))))

    def place(triple: Column) -> Column:
        h = F.md5(F.encode(triple, "utf-8"))
        at = F.conv(F.substring(h, 1, 2), 16, 10).cast("int") + 1
        return F.when(F.substring(h, 3, 1) < "8", at).otherwise(-at)

    return F.transform(triples, place)


def _vectors(rows: list, hashed: bool) -> np.ndarray:
    if not hashed:
        width = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=1)
        return np.array([np.zeros(width) if r["vector"] is None else np.asarray(r["vector"], float) for r in rows]).reshape(len(rows), width)
    out = np.zeros((len(rows), WIDTH))
    for i, r in enumerate(rows):
        places = np.asarray(r["vector"] if r["vector"] is not None else [], np.int64)
        np.add.at(out[i], np.abs(places) - 1, np.sign(places))
    return out


def _products(said: list, sentences: list, hashed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and overlaps of claims (rows) and sentences (columns)."""
    a, b = _vectors(said, hashed), _vectors(sentences, hashed)
    size = np.sqrt(np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)))
    sims = np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)
    known = {w: i for i, w in enumerate({w for r in said for w in r["words"]})}
    has = lambda rows: np.array([np.bincount([known[w] for w in r["words"] if w in known], minlength=len(known)) for r in rows], float).reshape(len(rows), -1)
    if not known:
        return sims, np.zeros_like(sims)
    c = has(said)
    n = c.sum(axis=1, keepdims=True)
    return sims, np.divide(c @ has(sentences).T, n, out=np.zeros_like(sims), where=n > 0)


_STATE = "claim_no int, claim string, block int, settled struct<at: long, sim: double, over: double>, top struct<sim: double, back: long, over: double>, over double, touched long"


def _state(c: dict, block: int | None, at: np.ndarray, sims: np.ndarray, over: np.ndarray) -> dict:
    """What a block says of a claim: the first sentence that settles it, the most alike one
    (`back`: its place, negative) with the greatest overlap from there on, the greatest overlap
    of the block, and the first place with any."""
    out = {"claim_no": c["claim_no"], "claim": c["claim"], "block": block, "settled": None, "top": None, "over": 0.0, "touched": None}
    if not len(at):
        return out
    full, some = np.flatnonzero(over >= SETTLES), np.flatnonzero(over > 0)
    if len(full):
        out["settled"] = {"at": int(at[full[0]]), "sim": float(sims[full[0]]), "over": float(over[full[0]])}
    best = int(np.argmax(sims))
    if sims[best] > 0:
        out["top"] = {"sim": float(sims[best]), "back": -int(at[best]), "over": float(over[best:].max())}
    return out | {"over": float(over.max()), "touched": int(at[some[0]]) if len(some) else None}


def claim_support(answers: DataFrame, passages: DataFrame, keys: tuple[str, ...], vectors: bool = False, threshold: float = SIMILAR) -> DataFrame:
    """keys, claim_no, claim, supported, sentence_no, similarity, overlap, method of every claim.
    answers: keys, answer, one row for each item; passages: keys, passage_no, passage, in the
    order of passage_no. With `vectors`, answers have claim_vectors and passages
    sentence_vectors: an array (of doubles) for each of the texts that claims() cuts."""
    both = lambda text, given: F.arrays_zip(text.alias("text"), (given if vectors else F.transform(text, hashed_features)).alias("vector"))
    vector = lambda c: F.col(c) if vectors else None
    said = answers.select(*keys, claims(F.col("answer")).alias("_t"), *([vector("claim_vectors")] if vectors else []))
    said = said.where(F.size("_t") > 0).select(*keys, "_t", *(["claim_vectors"] if vectors else []))
    blocks = F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / BLOCK).cast("int"))
    zipped = F.transform(F.col("_z"), lambda x, i: F.struct(i.alias("claim_no"), x["text"].alias("claim"), content_words(x["text"]).alias("words"), x["vector"].alias("vector")))
    said = said.withColumn("_z", both(F.col("_t"), vector("claim_vectors"))).select(*keys, F.size(blocks).alias("_blocks"), zipped.alias("_z"), F.explode(blocks).alias("_c"))
    said = said.select(*keys, "_blocks", "_c", F.slice("_z", F.col("_c") * BLOCK + 1, F.lit(BLOCK)).alias("said"))

    cut = passages.select(*keys, "passage_no", claims(F.col("passage")).alias("_t"), *([F.col("sentence_vectors")] if vectors else [])).where(F.size("_t") > 0)
    before = F.coalesce(F.sum(F.size("_t")).over(Window.partitionBy(*keys).orderBy("passage_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("_before", before).select(*keys, "_before", F.posexplode(both(F.col("_t"), vector("sentence_vectors"))).alias("_i", "_x"))
    one = F.struct((F.col("_before") + F.col("_i")).alias("at"), content_words(F.col("_x.text")).alias("words"), F.col("_x.vector").alias("vector"))
    cut = cut.select(*keys, one.alias("_s")).groupBy(*keys, F.floor(F.col("_s.at") / BLOCK).cast("int").alias("block")).agg(F.collect_list("_s").alias("sentences"))
    # items of several claim blocks have their sentences once for each of these
    several = said.where("_c = 0 and _blocks > 1").select(*keys, "_blocks")
    cut = cut.join(several, list(keys), "left").withColumn("_c", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    pairs = said.drop("_blocks").join(cut, [*keys, "_c"], "left").select(*keys, "said", "block", "sentences")

    types = dict(answers.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + _STATE
    own = pairs.sparkSession.createDataFrame([], _STATE).toArrow().schema

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for b in batches:
            fields = pa.schema([*(b.schema.field(k) for k in keys), *own])
            for i in range(b.num_rows):  # only one row of a batch is ever Python objects
                row = b.slice(i, 1).to_pylist()[0]
                said, found = row["said"], sorted(row["sentences"] or [], key=lambda s: s["at"])
                sims, over = _products(said, found, not vectors) if found else (np.zeros((len(said), 0)),) * 2
                at, block = np.array([s["at"] for s in found], np.int64), row["block"] if found else None
                key = {k: row[k] for k in keys}
                out += [key | _state(c, block, at, s, o) for c, s, o in zip(said, sims, over)]
                if len(out) >= AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)
                out = []

    # an Arrow batch has at most all rows of its task, which the number of shuffle partitions doesn't bound
    pairs = pairs.repartition(max(1, -(-answers.count() // ANSWERS)))
    states = pairs.mapInArrow(met, schema)
    merged = states.groupBy(*keys, "claim_no").agg(
        F.first("claim").alias("claim"),
        F.min("settled").alias("settled"),
        F.max(F.when(F.col("top").isNotNull(), F.struct("top.sim", "top.back", "top.over", "block"))).alias("top"),
        F.collect_list(F.struct("block", "over")).alias("_over"),
        F.min("touched").alias("touched"),
    )
    later = F.array_max(F.transform(F.filter("_over", lambda x: F.col("top").isNull() | (x["block"] > F.col("top.block"))), lambda x: x["over"]))
    merged = merged.withColumns({"_later": F.coalesce(later, F.lit(0.0)), "_full": F.col("settled").isNotNull(), "_alike": F.col("top").isNotNull()})
    pick = lambda full, alike, else_: F.when(F.col("_full"), full).when(F.col("_alike"), alike).otherwise(else_)
    merged = merged.select(
        *keys,
        "claim_no",
        "claim",
        pick(F.col("settled.at"), -F.col("top.back"), F.col("touched")).alias("sentence_no"),
        pick(F.col("settled.sim"), F.col("top.sim"), F.lit(0.0)).alias("_sim"),
        pick(F.col("settled.over"), F.greatest("top.over", "_later"), F.col("_later")).alias("overlap"),
        pick(F.lit(BY_EMBEDDING), F.lit(BY_SIMILARITY), F.lit(BY_WORDS)).alias("method"),
    )
    supported = (F.col("_sim") >= threshold) | (F.col("overlap") >= SUPPORTS)
    shown = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_sim"))), 6)
    return merged.select(*keys, "claim_no", "claim", supported.alias("supported"), "sentence_no", shown.alias("similarity"), F.round("overlap", 9).alias("overlap"), "method")


def grounding_scores(answers: DataFrame, support: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, claims, supported, by_similarity (supported by likeness alone), score and
    unsupported_ratio of every answer. support: claim_support()."""
    alone = F.col("supported") & (F.col("overlap") < SUPPORTS)
    g = support.groupBy(*keys).agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"), F.count_if(alone).alias("by_similarity"))
    out = answers.select(*keys).join(g, list(keys), "left").fillna(0, ["claims", "supported", "by_similarity"])
    share = F.when(F.col("claims") > 0, F.col("supported") / F.col("claims"))
    return out.select(*keys, "claims", "supported", "by_similarity", F.round(F.coalesce(share, F.lit(1.0)), 9).alias("score"), F.round(F.coalesce(1 - share, F.lit(0.0)), 9).alias("unsupported_ratio"))
