"""Shared helpers of the training-data operators: shared scratch space, bounded text
batches and vectorised hashing of words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a worker hashes at once; bounds numpy's temporaries.
CHUNK_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset,
    a session of one process (tests) takes a folder of its own; a cluster has no other."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_shared_dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark._shared_dir = f"file://{tempfile.mkdtemp(prefix='raglens-')}"
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back, which cuts the lineage:
    a lost executor costs the files nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise() wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if path.startswith(("file:", "hdfs:")) or "://" in path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it
    else does when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or if they are more than `most` about that many, chosen by a hash of the id."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))


def prefix_apart(*columns: list[str]) -> str:
    """The start of column names that none of the columns has, whatever the case."""
    mark = "_"
    while any(c.lower().startswith(mark) for cs in columns for c in cs):
        mark += "_"
    return mark


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as remainder null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def placed(rows: DataFrame, by: list[str | Column], name: str, group: str | None = None, column: str = "pos") -> DataFrame:
    """The rows, written once, with their place (0, 1, 2 and so on) by `by`, or that within their
    group, whose column `by` then begins with. The rows are dealt by ranges and only the counts
    of the ranges, one for each and group in it, meet; no group is in one task."""
    at = F.monotonically_increasing_id()
    rows = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at), name)
    own = [group] if group else []
    part = F.shiftright("_at", 33)
    facts = rows.groupBy(part.alias("_part"), *own).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    facts = facts.withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_first", "_rows")
    return rows.withColumn("_part", part).join(facts, ["_part", *own]).withColumn(column, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


# ---------------------------------------------------------------- hashing of words

_G = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _G.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_P = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[key] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["i"][:n]


def _hash_block(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a block of bytes."""
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[a]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inv = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * p[: len(a)], out=total[1:])
    return mix((total[e] - total[s]) * inv[s]), s


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    """The texts, very long ones cut where there is white space."""
    for i, t in enumerate(texts):
        t = t or b""
        at = 0
        while len(t) - at > 4 * CHUNK_BYTES:
            cut = at + CHUNK_BYTES
            while cut < len(t) and not _SPACE[t[cut]]:
                cut += 1
            yield i, t[at:cut]
            at = cut
        yield i, t[at:] if at else t


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of the texts, one
    text after the other, and where each text's words start (one entry more than texts)."""
    hashes, owners = [], []
    block: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal block, held
        lens = np.array([len(b) + 1 for _, b in block], np.int64)
        h, s = _hash_block(b"\n".join(b for _, b in block))
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        own = np.array([i for i, _ in block], np.int64)
        hashes.append(h)
        owners.append(own[np.searchsorted(first, s, "right") - 1])
        block, held = [], 0

    for i, t in _pieces(texts):
        if block and held + len(t) > CHUNK_BYTES:
            flush()
        block.append((i, t))
        held += len(t) + 1
    if block:
        flush()
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return h, np.searchsorted(own, np.arange(len(texts) + 1))


def binary_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `limit` bytes of text at most."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in binary_texts(b.column(column))], np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield b.slice(s, e - s)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Components of the graph of `edges` (a long, b long): rows (node, root), root being
    the smallest id of its component. Alternates large-star and small-star rounds, each of
    which only groups and joins; no component is ever gathered in one place. Nulls and
    self-links are ignored; nodes without a link don't occur."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, name)
    before = None
    for _ in range(rounds):
        # large star: the greater neighbours of each node go to the least of its neighbourhood
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = e.join(least, e.b == least.u).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the lesser neighbours of each node, and itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = large.join(least, large.a == least.u).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = materialise(moved.select("x.*").where("a <> b").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
