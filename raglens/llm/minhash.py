"""MinHash near-duplicates: documents whose sets of distinct word shingles have a Jaccard
similarity of num / den or more.

1. Signatures. BANDS x ROWS universal hash functions h(x) = a * x + b modulo 2^64, a odd, are
   taken over every shingle of a text; a signature is their minima. Two sets agree in each
   with the probability of their similarity. Rows of identical sets become one class, whose
   smallest id goes on.
2. Banding. A band is the hash of ROWS consecutive minima; classes that share one are
   candidates. At a similarity of 0.8 a pair shares none of the 40 bands of 5 with the
   probability (1 - 0.8^5)^40 = 1.2e-7, and a component misses a link only if all its links
   to it are missed.
3. Signature verification. Of a crowded band no pairs are made: each class goes to the one hub,
   the first class of a band, that it shares the most bands with and whose signature agrees
   with its own in at least the share that a link leaves but for SIGMAS standard errors. Classes
   of different components that share a band are compared by signatures in blocks later on.
4. Confirmation. Only shingle sets themselves make a link: the candidates meet in tasks of
   bounded size, where overlaps are counted exactly.
5. Components of the links by alternating large-star and small-star rounds.

A signature keeps one byte of each minimum (b-bit minima): sets of similarity s agree in
s + (1 - s) / 256 of them, so no true link loses by it.

Defined results: null and empty texts, and texts without words, have the empty set and link with
nothing, nor with each other. Rows with a null id come back with a null component and kept
null. Rows that share an id share its component. Further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm import jaccard
from raglens.llm.common import binary_texts, materialise, mix, signed, text_slices

BANDS, ROWS = 40, 5
#: Standard errors that a signature may be below a link's similarity.
SIGMAS = 5
#: Shingles that are hashed at once; bounds the temporaries and keeps them in cache.
AT_ONCE = 1 << 15

_G = np.random.Generator(np.random.PCG64(11))
_A = _G.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _G.integers(0, 1 << 64, 4096, dtype=np.uint64)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The minima of k hash functions over each set, one row each; sets aren't empty."""
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), n)
    for s in range(0, len(flat), AT_ONCE):
        x, rows = flat[s : s + AT_ONCE], own[s : s + AT_ONCE]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        first, last = rows[0], rows[-1] + 1
        h = np.empty_like(x)
        for i in range(k):
            np.multiply(x, _A[i], out=h)
            h += _B[i]
            np.minimum(out[first:last, i], np.minimum.reduceat(h, starts), out=out[first:last, i])
    return out


def bands(minima: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each `rows` consecutive minima, different from band to band."""
    out = np.zeros((len(minima), minima.shape[1] // rows), np.uint64)
    for j in range(out.shape[1]):
        h = np.full(len(minima), j + 1, np.uint64)
        for i in range(j * rows, (j + 1) * rows):
            h = mix(h ^ minima[:, i])
        out[:, j] = h
    return out


def least_agreement(num: int, den: int, k: int) -> float:
    s = num / den
    return s - SIGMAS * (s * (1 - s) / k) ** 0.5


def alike(na, nb, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and signatures leave a link of sets, row by row."""
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & ((a == b).mean(axis=-1) >= least_agreement(num, den, a.shape[-1]))


def signature_table(docs: DataFrame, words: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, n (size of the set), s1, s2 (128 bits that identify it), prefix (its bands), hist
    (its signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            sets = jaccard.shingle_sets(binary_texts(b.column("text")), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            minima = signatures([sets[i] for i in full], n_bands * rows)
            keys = dict(zip(full, signed(bands(minima, rows))))
            short = dict(zip(full, (minima >> np.uint64(56)).astype(np.uint8) ^ (minima & np.uint64(255)).astype(np.uint8)))
            sums = np.array([(s.sum(dtype=np.uint64), mix(s ^ np.uint64(words)).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed(sums[:, 0].copy())),
                    pa.array(signed(sums[:, 1].copy())),
                    pa.array([keys.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([short[i].tobytes() if i in short else None for i in range(len(sets))], pa.binary()),
                ],
                names=["doc_id", "n", "s1", "s2", "prefix", "hist"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>, hist binary")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, n_bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = materialise(signature_table(docs, words, n_bands, rows), "signatures")
    found = jaccard.joined(docs, table, words, num, den, alike)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
