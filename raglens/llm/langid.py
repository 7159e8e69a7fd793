"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting counts the n-grams of a bounded sample of labelled rows in Spark tasks; what
reaches the driver is one count row per language and task, so its size is languages x
buckets. The log-probability matrix is broadcast and batches of texts are scored in numpy:
hash every n-gram, gather its matrix rows, sum by text. Texts are taken whole.

Defined results: a null text, an empty one and one without any letter give `und` with
score 0. Of labels of equal probability the first in order is predicted. Equal texts give
equal results; rows are never dropped, repeated rows stay."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm.common import mix, sampled

LETTER = regex.compile(r"\p{L}")
#: Characters hashed at once, and matrix entries gathered at once.
PART, GATHER = 1 << 20, 1 << 23


def _parts(windows: list[tuple[str, int]], most: int) -> Iterator[tuple[int, int]]:
    """Runs of windows of about `most` characters."""
    s, held = 0, 0
    for i, (t, _) in enumerate(windows):
        if held and held + len(t) > most:
            yield s, i
            s, held = i, 0
        held += len(t)
    if s < len(windows):
        yield s, len(windows)


def _windows(text: str, orders: int, size: int) -> list[tuple[str, int]]:
    """The text, lower-cased and with a space at both ends, in windows: characters, and how
    many of them start an n-gram there. Each n-gram starts in one window."""
    t = f" {text.lower()} "
    return [(t[i : i + size + orders - 1], min(size, len(t) - i)) for i in range(0, len(t), size)]


def gram_buckets(windows: list[tuple[str, int]], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the windows: one row per order; 2**bits where an n-gram would
    run over its text's end or starts in the next window. Also each window's start."""
    codes = np.frombuffer("".join(t for t, _ in windows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t, _ in windows])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(len(codes)) - np.repeat(starts[:-1], sizes)
    late = place >= np.repeat([n for _, n in windows], sizes)
    left = np.repeat(sizes, sizes) - place
    out = np.empty((len(orders), len(codes)), np.int32)
    for row, n in enumerate(orders):
        h = codes + np.uint64(n << 40)
        for j in range(1, n):
            h = h * np.uint64(0x100000001B3)
            h[:-j] += codes[j:]
        out[row] = (mix(h) >> np.uint64(64 - bits)).astype(np.int32)
        out[row][late | (left < n)] = 1 << bits
    return out, starts[:-1]


@dataclass
class LanguageModel:
    """labels; logp: (2**bits + 1) x labels, the last row zeros; prior: log of the shares."""

    labels: list[str]
    logp: np.ndarray
    prior: np.ndarray
    bits: int = 16
    orders: tuple[int, ...] = field(default=(1, 2, 3))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total = np.tile(self.prior, (len(texts), 1))
        has = [t is not None and LETTER.search(t) is not None for t in texts]
        flat, own = [], []
        most = max(1 << 12, min(PART, GATHER // len(self.labels)))
        for i, t in enumerate(texts):
            if has[i]:
                w = _windows(t, max(self.orders), most)
                flat += w
                own += [i] * len(w)
        for s, e in _parts(flat, most):
            buckets, starts = gram_buckets(flat[s:e], self.orders, self.bits)
            for row in buckets:
                np.add.at(total, np.array(own[s:e]), np.add.reduceat(self.logp[row], starts, axis=0))
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.labels[b] if h else "und" for b, h in zip(best, has)]
        return names, np.where(has, p[np.arange(len(texts)), best], 0.0)


def fit(train: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", max_rows: int = 20_000, bits: int = 16, orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5) -> LanguageModel:
    """Fits on at most about max_rows labelled rows (the documented bound), drawn by a hash
    of the id; rows with a null label or text are left out. Without any, the model knows no
    label and predicts `und`."""
    rows = train.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(id_col).alias("id"))
    rows = sampled(rows, "id", max_rows)
    size = (1 << bits) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for lab, part in pdf.groupby("label"):
                texts = [w for t in part["text"] for w in _windows(t, max(orders), PART)]
                acc = sums.setdefault(lab, np.zeros(size, np.int64))
                docs[lab] = docs.get(lab, 0) + len(part)
                for s, e in _parts(texts, PART):
                    acc += np.bincount(gram_buckets(texts[s:e], orders, bits)[0].ravel(), minlength=size)
        if sums:  # a part without rows reports nothing
            yield pd.DataFrame({"label": list(sums), "docs": [docs[k] for k in sums], "counts": [zlib.compress(v.tobytes()) for v in sums.values()]})

    parts = rows.select("label", "text").repartition(12).mapInPandas(count, "label string, docs long, counts binary").collect()
    labels = sorted({r["label"] for r in parts})
    counts = np.full((len(labels), 1 << bits), alpha)
    docs = np.zeros(len(labels))
    for r in parts:
        i = labels.index(r["label"])
        counts[i] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)[:-1]
        docs[i] += r["docs"]
    if not labels:
        return LanguageModel(["und"], np.zeros((size, 1)), np.zeros(1), bits, orders)
    logp = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return LanguageModel(labels, np.vstack([logp, np.zeros(len(labels))]), np.log(docs / docs.sum()), bits, orders)


def predict(spark: SparkSession, model: LanguageModel, text: str | Column = "text") -> Column:
    """A struct column (lang_pred string, score double) of a text column."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            names, scores = m.score(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return scored(F.col(text) if isinstance(text, str) else text)
