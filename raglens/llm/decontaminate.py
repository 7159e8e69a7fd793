"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as bytes: A-Z lower-cased, runs of other ASCII than
letters and digits as one space. An item of m bytes occurs in a text if a stretch of the text
is within k = floor(edits * m) edit operations of it. Such a stretch shares m + 1 - q - k * q
q-grams with the item, all in k + 1 neighbouring diagonals. So a task looks up every q-gram of
its texts among those of the items, counts what falls into overlapping bands of 2 * (k + 1)
diagonals, and aligns, within the band, only where a count meets that bound. Items too short
for the bound at the usual q are sought with a smaller one. Texts are taken whole.

The items' q-grams are broadcast in slices of bounded size, one after the other; more items
take more slices, each with one more pass over the texts.

Defined results: null and empty texts hold no item; null and empty items occur nowhere; equal
items are each reported, items with a null id too. Items of fewer than 10 bytes admit no edit;
those shorter than q are sought as whole words. Repeated rows are each judged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm.common import CHUNK_BYTES, materialise

#: Characters of a q-gram: usually, and for items below SHORT bytes, whose bound needs it.
Q, SHORT_Q, SHORT = 8, 4, 40
EDITS = 0.10
#: Bytes of items in one broadcast slice.
SLICE_BYTES = 4 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(a: np.ndarray) -> np.ndarray:
    """Bytes as they are compared: one space for a run of separators."""
    a = _FOLD[a]
    space = a == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    return a[keep]


def grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-grams of bytes, of 8 or 4, as 64-bit words."""
    if len(a) < q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(a, q).copy().view(f"<u{q}").ravel().astype(np.uint64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    key = np.sort(key)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[new], np.diff(np.append(new, len(key)))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edit distance of item to a stretch of text whose alignment stays on diagonals
    low..high (place in text minus place in item); most + 1 if it is greater than most."""
    width = high - low + 1
    d = np.arange(low, high + 1)
    big = most + 1
    row = np.where((d >= 0) & (d <= len(text)), 0, big).astype(np.int64)  # a stretch starts anywhere
    steps = np.arange(width)
    for i in range(len(item)):
        j = d + i  # the byte of text that diagonal d meets at item's byte i
        inside = (j >= 0) & (j < len(text))
        new = row + 1
        new[inside] = row[inside] + (text[j[inside]] != item[i])
        new[~inside] = big
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a byte of item has no partner
        new = np.minimum.accumulate(new - steps) + steps  # a byte of text has none
        new[(j + 1 < 0) | (j + 1 > len(text))] = big
        row = np.minimum(new, big)
        if row.min() >= big:
            return big
    return int(row.min())


@dataclass
class Items:
    """Items of one slice, all sought with q-grams of one q."""

    ids: list[int | None]
    texts: list[np.ndarray]
    q: int = Q

    def __post_init__(self) -> None:
        q = self.q
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.floor(EDITS * self.m + 1e-9).astype(np.int64)
        self.bound = self.m + 1 - q - self.k * q
        long = [i for i in range(len(self.texts)) if self.bound[i] >= 1]
        self.short = [i for i in range(len(self.texts)) if self.bound[i] < 1 and self.m[i]]
        all_grams = np.concatenate([grams(self.texts[i], q) for i in long]) if long else np.zeros(0, np.uint64)
        own = np.concatenate([np.full(self.m[i] - q + 1, i) for i in long]) if long else np.zeros(0, np.int64)
        off = np.concatenate([np.arange(self.m[i] - q + 1) for i in long]) if long else np.zeros(0, np.int64)
        by = np.argsort(all_grams, kind="stable")
        self.own, self.off = own[by], off[by]
        self.keys, self.first, self.count = np.unique(all_grams[by], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self._slot(self.keys)] = True

    @staticmethod
    def _slot(v: np.ndarray) -> np.ndarray:
        return (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def candidates(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (text, item, band) whose count meets the item's bound."""
        v = grams(buf, self.q)
        pos = np.flatnonzero(self.sieve[self._slot(v)]) if len(self.keys) else np.zeros(0, np.int64)
        if not len(pos):
            return np.zeros((0, 3), np.int64)
        at = np.searchsorted(self.keys, v[pos])
        at[at == len(self.keys)] = 0
        good = self.keys[at] == v[pos]
        pos, at = pos[good], at[good]
        if not len(pos):
            return np.zeros((0, 3), np.int64)
        n = self.count[at]
        hit = np.repeat(pos, n)
        place = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, off = self.own[place], self.off[place]
        text = np.searchsorted(starts, hit, "right") - 1
        d = hit - starts[text] - off + self.m[item] + self.k[item] + 1  # the first band that holds any is 0
        j = d // (self.k[item] + 1)
        spread = np.int64(j.max() + 2)
        key = (text * len(self.m) + item) * spread + j  # the band from j on; that from j - 1 on has it too
        near, reach = _runs(key)
        pair = _runs(np.concatenate([near, near - 1]))[0]
        count = np.zeros(len(pair), np.int64)
        count[np.searchsorted(pair, near)] += reach
        count[np.searchsorted(pair, near - 1)] += reach
        pair = pair[count >= self.bound[pair // spread % len(self.m)]]
        if not len(pair):
            return np.zeros((0, 3), np.int64)
        # a q-gram of the item counts once in a band, however often the text repeats it
        seen = []
        for shift in (0, 1):
            at = np.minimum(np.searchsorted(pair, key - shift), len(pair) - 1)
            good = pair[at] == key - shift
            seen.append(at[good] * np.int64(1 << 32) + off[good])
        count = np.bincount(_runs(np.concatenate(seen))[0] >> 32, minlength=len(pair))
        own = pair // spread
        found = np.column_stack([own // len(self.m), own % len(self.m), pair % spread])
        return found[count >= self.bound[found[:, 1]]]

    def find(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text the items that it holds, with the edits between them."""
        out: list[dict[int, int]] = [{} for _ in texts]
        block: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal block, held
            if block:
                starts = np.cumsum([0, *(len(a) + 1 for _, a in block)])[:-1]
                buf = np.full(int(starts[-1] + len(block[-1][1]) + 1), 10, np.uint8)
                for (_, a), s in zip(block, starts):
                    buf[s : s + len(a)] = a
                self._verify(block, self.candidates(buf, starts), out)
            block, held = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            a = folded(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
            block.append((i, a))
            held += len(a)
            if self.short:
                raw = b" " + a.tobytes().strip() + b" "
                for s in self.short:
                    if b" " + self.texts[s].tobytes() + b" " in raw:
                        out[i][s] = 0
            if held >= CHUNK_BYTES:
                flush()
        flush()
        return out

    def _verify(self, block: list[tuple[int, np.ndarray]], found: np.ndarray, out: list[dict[int, int]]) -> None:
        whole: dict[int, bytes] = {}
        for text, item, j in found.tolist():
            i, a = block[text]
            if out[i].get(item) == 0:
                continue
            k, m = int(self.k[item]), int(self.m[item])
            low = (j - 1) * (k + 1) - m
            high = low + 2 * (k + 1) - 1
            s, e = max(0, low - k), min(len(a), high + m + k)
            if text not in whole:
                whole = {text: a.tobytes()}
            if whole[text].find(self.texts[item].tobytes(), s, e) >= 0:
                out[i][item] = 0
                continue
            edits = banded_distance(self.texts[item], a[s:e], low - s, high - s, k)
            if edits <= k:
                out[i][item] = min(edits, out[i].get(item, k))


def slices(benchmark: DataFrame, text: str = "text", id_col: str = "item_id") -> Iterator[Items]:
    """The items in slices of about SLICE_BYTES by a hash of the text; only one slice at a
    time is held by the driver."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = -(-int(total) // SLICE_BYTES)
    for k in range(parts):
        tiers: dict[int, tuple[list, list]] = {}
        for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).orderBy("i", "t").collect():
            a = folded(np.frombuffer(r["t"].encode("utf-8", "surrogatepass"), np.uint8))
            a = a[1:] if len(a) and a[0] == 32 else a
            a = a[:-1] if len(a) and a[-1] == 32 else a
            ids, texts = tiers.setdefault(SHORT_Q if 10 <= len(a) < SHORT else Q, ([], []))
            ids.append(r["i"])
            texts.append(a)
        for q, (ids, texts) in sorted(tiers.items()):
            yield Items(ids, texts, q)


def hits(spark: SparkSession, items: Items, text: str | Column = "text") -> Column:
    """A struct column (items array<long>, edits array<long>, bytes array<long>) of a text column."""
    held = spark.sparkContext.broadcast(items)

    @F.pandas_udf("items array<long>, edits array<long>, bytes array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            rows = [sorted(x.items()) for x in m.find(texts.tolist())]
            yield pd.DataFrame({"items": [[m.ids[i] for i, _ in r] for r in rows], "edits": [[e for _, e in r] for r in rows], "bytes": [[int(m.m[i]) for i, _ in r] for r in rows]})

    return found(F.col(text) if isinstance(text, str) else text)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, edits, item_bytes, similarity of every document and item it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits long, item_bytes long, similarity double"
    out = None
    for items in slices(benchmark):
        h = docs.select(F.col(id_col).cast("long").alias("doc_id"), hits(spark, items, text).alias("h")).where(F.size("h.items") > 0)
        rows = h.select("doc_id", F.explode(F.arrays_zip("h.items", "h.edits", "h.bytes")).alias("x"))
        rows = rows.select("doc_id", F.col("x.items").alias("item_id"), F.col("x.edits").alias("edits"), F.col("x.bytes").alias("item_bytes"))
        rows = materialise(rows.withColumn("similarity", 1 - F.col("edits") / F.col("item_bytes")), "leaks")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns."""
    for items in slices(benchmark):
        docs = docs.where(F.size(hits(docs.sparkSession, items, text)["items"]) == 0)
    return docs
