"""LM scoring by a hierarchical Pitman-Yor model over words.

Every text is its words and one end token. There is a restaurant for each preceding word, its
dishes are all words, and all restaurants share one parent over the whole vocabulary, whose
base is uniform over the words of the training texts and one that stands for all others. The
restaurants are a table (context u, word w, customers c, tables t) that grows with the corpus.
A sweep of the Gibbs sampler runs over its rows in parallel: the customers of a dish leave and
are seated again, one after the other (a dish of very many customers in growing groups), given
all other tables; the new tables are the parent's customers, which is seated in its turn. A
row needs only its context's number of tables and its word's probability in the parent, so
the rows of a large context are dealt over many tasks. Pairs of frequent words, which are most
of all, are rows of arrays and find both in what is broadcast; those of rarer ones are joined. A dish of one customer has one table in
every sweep, so pairs that occur once aren't kept: a word's occurrences less those of its kept
pairs are its pairs that occur once. The predictive probabilities of the sweeps after the first
ones are averaged, exactly, for pairs seen and not seen; for each preceding word, seen or
not, those of all words sum to one.

A word's code is its rank if it is among the most frequent ones, else its hash, made negative.
Broadcast are what the model says of the most frequent words and pairs (both bounded);
everything else, which grows with the corpus, is dealt into buckets of about DEALT bytes of text
each: a pair goes with its preceding word if that is rare, else with its word if that is, else
by both. A task sends a bucket all that it has for it as one row of arrays. Pairs are counted by
bucket, and asked for by bucket, which answers a chunk of texts with a sum for each text; only
words after a rare word that are rare themselves meet a join after that. A pair of a training
text that isn't kept occurs once. Texts are scored in SLICES parts by their id, so that the
files of one part at a time are on the disks.

Defined results: a null text is empty, which leaves the end token. Without training rows
every count is 0. Rows with a null id are scored and not learned from. Repeated rows are
learned from, and scored, as often as they occur."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm.common import binary_texts, dropped, materialise, mix, released, signed, text_slices, word_hashes

#: The end token's hash.
END = np.uint64(0x5851F42D4C957F2D)
#: Bits of the rank of a frequent word.
RANK = 18
#: Words, and pairs of words, that are broadcast; all others are dealt into buckets.
BROADCAST, PAIRS = 1 << RANK, 1 << 19
#: Bytes of text, of all texts, for each bucket of pairs.
DEALT = 1 << 22
#: Discount and strength of the context restaurants and of their parent.
CONTEXT, PARENT = (0.75, 1.0), (0.5, 1.0)
SWEEPS, BURN_IN = 6, 2
#: Customers of a dish that are seated one by one; those behind them come in growing groups.
ONE_BY_ONE = 1024
#: Dishes that are seated together, in one pass over their customers.
SEATED = 1 << 18
#: Frequent words whose sums a task sends as one row.
TOGETHER = 1 << 12
#: Parts of the texts that are scored one after the other; a part's shuffles go before the next.
SLICES = 1
#: Tokens that a task holds before it reports them.
HELD = 1 << 20


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, one after the other, and each text's start (one more)."""
    h, at = word_hashes(texts)
    out = np.insert(h, at[1:], END)
    return out, at + np.arange(len(at))


def _before(codes: np.ndarray, at: np.ndarray, end: np.int64) -> np.ndarray:
    """The token before each token; the end token at a text's start."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[at[:-1]] = end
    return out


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, the last one first, and where the runs of equal keys start."""
    by = np.lexsort(keys)
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    return by, np.flatnonzero(new)


def _codes(h: np.ndarray, ranks: Near) -> np.ndarray:
    met, rank = ranks.look(h)
    return np.where(met, rank.astype(np.int64), signed(h | np.uint64(1 << 63)))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(new)


def _bucket(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair of codes; that of a rare word u is the bucket of (u, u)."""
    key = np.where(u < 0, u, np.where(w < 0, w, u << RANK | w))
    return (mix(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _blobs(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the rows of x, cut at `at`."""
    x = np.ascontiguousarray(x)
    size = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(x)])


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a column of _blobs(), one after the other."""
    parts = [np.zeros(0, np.uint8)]
    for c in column.chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else parts[0])
    return np.concatenate(parts).view(kind)


def _steps(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ascending numbers, cut at `at`, as steps, which take less room; _rows() has them again."""
    out = np.diff(row, prepend=0)
    out[at[:-1]] = row[at[:-1]]
    return out.astype(np.uint32)


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and of which value of the column each is."""
    step = _flat(column, np.uint32).astype(np.int64)
    m = pc.binary_length(column).to_numpy() // 4
    own, at = np.repeat(np.arange(len(m)), m), np.cumsum(m) - m
    total = np.cumsum(step)
    return total - np.repeat((total - step)[at[m > 0]], m[m > 0]), own


def _halves(key: np.ndarray) -> dict[str, np.ndarray]:
    return {"low": key.astype(np.uint32), "high": (key >> np.uint64(32)).astype(np.uint8)}


def _keys(rows: pa.Table) -> np.ndarray:
    return _flat(rows["low"], np.uint32).astype(np.uint64) | _flat(rows["high"], np.uint8).astype(np.uint64) << np.uint64(32)


def _sent(names: list[str], at: np.ndarray, bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its part, cut at `at`, of each column."""
    kind = pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int64)), *(_blobs(columns[x], at) if x in columns else pa.nulls(len(at) - 1, kind) for x in names)], names=["bucket", *names])


def _dealt(names: list[str], bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """As _sent(), of columns in any order; that of a bucket's rows stays."""
    by = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[by]
    at = np.append(_starts(bucket), len(bucket))
    columns = {x: y[by] for x, y in columns.items()}
    if "row" in columns:
        columns["row"] = _steps(columns["row"], at)
    return _sent(names, at, bucket, **columns)


def _given(rows: pa.Table, *names: str, none: tuple[str, ...] = ()) -> pa.Table:
    """The rows that have all of these columns, and not those of `none`."""
    for x in names:
        rows = rows.filter(pc.is_valid(rows[x]))
    for x in none:
        rows = rows.filter(pc.is_null(rows[x]))
    return rows


#: Columns of counted pairs (frequent words: low, high; else u, w), and of what the model says.
_COUNTS = ["low", "high", "u", "w", "c", "asked"]
_SAYS = ["low", "high", "u", "w", "seen", "says"]


def _binaries(names: list[str]) -> str:
    return ", ".join(f"{x} binary" for x in names)


def _pairs_counted(batches: Iterator[pa.RecordBatch], ranks: Near, buckets: int) -> Iterator[pa.RecordBatch]:
    """By bucket: c (occurrences in training texts), asked (in others) of each pair of codes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def report() -> Iterator[pa.RecordBatch]:
        u, w, out = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        bucket = _bucket(u, w, buckets)
        near = (u >= 0) & (w >= 0)
        # bucket, pair and whether it is asked for in one number
        joint = bucket[near] << np.uint64(2 * RANK + 1) | (u[near] << (RANK + 1) | w[near] << 1).view(np.uint64) | out[near]
        joint.sort()
        pair = joint >> np.uint64(1)
        new = _starts(pair)
        if len(new):
            asked = np.add.reduceat(joint & np.uint64(1), new).astype(np.uint32)
            c = np.diff(np.append(new, len(pair))).astype(np.uint32) - asked
            pair = pair[new]
            b = pair >> np.uint64(2 * RANK)
            yield _sent(_COUNTS, np.append(_starts(b), len(b)), b, c=c, asked=asked, **_halves(pair & np.uint64((1 << 2 * RANK) - 1)))
        u, w, out, bucket = (x[~near] for x in (u, w, out, bucket))
        by, new = _grouped(w, u, bucket)
        if len(new):
            asked = np.add.reduceat(out[by], new).astype(np.uint32)
            c = np.diff(np.append(new, len(by))).astype(np.uint32) - asked
            u, w, b = (x[by][new] for x in (u, w, bucket))
            yield _sent(_COUNTS, np.append(_starts(b), len(b)), b, c=c, asked=asked, u=u, w=w)

    for b in text_slices(batches, "text"):
        h, at = token_hashes(binary_texts(b.column("text")))
        codes = _codes(h, ranks)
        end = _codes(np.array([END]), ranks)[0]
        held.append((_before(codes, at, end), codes, np.repeat(b.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(at))))
        size += len(h)
        if size >= HELD:
            yield from report()
            size = 0
    if held:
        yield from report()


def _pairs_merged(counts: pa.Table) -> pa.Table:
    """u, w, c of a bucket's pairs that occur more than once, or once where other texts ask for them."""
    near, rare = _given(counts, "low"), _given(counts, "u")
    out = []
    for rows, keys in ((near, (_keys(near),)), (rare, (_flat(rare["w"], np.int64), _flat(rare["u"], np.int64)))):
        c, asked = (_flat(rows[x], np.uint32).astype(np.int64) for x in ("c", "asked"))
        by = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
        keys = [k[by] for k in keys]
        new = _starts(*keys)
        if len(new):
            c, asked = np.add.reduceat(c[by], new), np.add.reduceat(asked[by], new)
            keep = (c > 1) | (c == 1) & (asked > 0)
            w, u = (k[new][keep].astype(np.int64) for k in (keys if len(keys) > 1 else (keys[0] & np.uint64((1 << RANK) - 1), keys[0] >> np.uint64(RANK))))
            out.append(pa.table({"u": u, "w": w, "c": c[keep]}))
    return pa.concat_tables(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def report() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(signed(keys[new])), pa.array(np.diff(np.append(new, len(keys))))], names=["h", "c"])

    for b in text_slices(batches, "text"):
        h, _ = token_hashes(binary_texts(b.column("text")))
        held.append(h)
        size += len(h)
        if size >= 2 * HELD:
            yield report()
            held, size = [], 0
    if held:
        yield report()


def seat(c: np.ndarray, t: np.ndarray, base: np.ndarray, d: float, theta: float, rng: np.random.Generator, total: np.ndarray | int | None = None, key: np.ndarray | None = None) -> np.ndarray:
    """Seats the customers c of every dish anew, given the tables t of the others; returns
    the tables of each dish. `total`: all tables of each dish's restaurant, else those of t.
    With a `key` of each dish, single customers draw by it, wherever and beside whatever it is."""
    out = (c > 0).astype(np.int64)  # the first customer opens a table
    others = (t.sum() if total is None else total) - t
    j = 1
    live = np.flatnonzero(c > 1)
    while len(live):
        step = 1 if j < ONE_BY_ONE else j // 8
        m = np.minimum(step, c[live] - j)
        opens = (theta + d * (others[live] + out[live])) * base[live]
        p = opens / (opens + np.maximum(j - d * out[live], 1e-9))
        if key is not None and step == 1:
            out[live] += (mix(key[live] + np.uint64(j)) >> np.uint64(11)) * 2.0**-53 < p
        else:
            out[live] += rng.binomial(m, np.clip(p, 0.0, 1.0))
        j += step
        live = live[c[live] > j]
    return np.minimum(out, c)


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together to about that many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@dataclass
class Near:
    """Sorted keys of the most frequent words or pairs, with a value of each."""

    keys: list[np.ndarray]  # the last one sorted first
    value: np.ndarray

    @classmethod
    def of(cls, table: dict[str, np.ndarray], names: list[str], value: str) -> Near:
        keys = [np.asarray(table[x], np.int64).view(np.uint64) for x in names]
        joint = keys[0] if len(keys) == 1 else mix(keys[0]) * np.uint64(3) + keys[1]
        by = np.argsort(joint)
        return cls([joint[by], *(k[by] for k in keys)], np.asarray(table[value])[by])

    def look(self, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the keys are among these, and their values (0 where they aren't)."""
        joint = keys[0] if len(keys) == 1 else mix(keys[0]) * np.uint64(3) + keys[1]
        if not len(self.value):
            return np.zeros(len(joint), bool), np.zeros(len(joint))
        at = np.minimum(np.searchsorted(self.keys[0], joint), len(self.value) - 1)
        good = np.all([x[at] == k for x, k in zip(self.keys[1:], keys)], axis=0)
        return good, np.where(good, self.value[at], 0)


#: Names of what each kept sweep says of a word: its tables as a context, its probability in the parent.
TABLES, BASES = ([f"{x}{i}" for i in range(SWEEPS - BURN_IN)] for x in "tb")


def _collected(rows: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size, as arrays on the driver."""
    table = rows.toArrow()
    return {x: table[x].to_numpy() for x in table.column_names}


@dataclass
class Model:
    """pairs: u, w, c, seen (customers less the mean discount of their tables), those of c > 1;
    near: c, TABLES and BASES of the most frequent words, by rank; rare_contexts: u, TABLES of
    the others, of those with such pairs (all others have a table for each customer);
    rare_words: w, BASES of the others, of those that occur more than once; once and new: the
    BASES of words that occur once and never."""

    pairs: DataFrame
    near: dict[str, np.ndarray]
    rare_contexts: DataFrame
    rare_words: DataFrame
    once: list[float]
    new: list[float]

    def _all(self, rare: DataFrame, code: str, names: list[str]) -> DataFrame:
        near = pa.table({code: np.arange(len(self.near["c"])), **{x: self.near[x] for x in names}})
        return rare.unionByName(rare.sparkSession.createDataFrame(near)) if near.num_rows else rare

    @property
    def contexts(self) -> DataFrame:
        return self._all(self.rare_contexts, "u", TABLES)

    @property
    def words(self) -> DataFrame:
        return self._all(self.rare_words, "w", BASES)


#: Pairs of frequent words, many in one row of arrays.
_SEATS = ["low", "high", "c", "t", "kept"]


def _near_pair(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(RANK)).view(np.int64), (key & np.uint64((1 << RANK) - 1)).view(np.int64)


def _seats(key: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row: the pairs with their customers and tables."""
    columns |= _halves(key)
    return pa.RecordBatch.from_arrays([_blobs(columns[x], np.array([0, len(key)])) for x in _SEATS], names=_SEATS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, w, c of pairs of frequent words as rows of arrays; each pair has one table."""
    for b in _joined(batches, SEATED):
        u, w, c = (b.column(x).to_numpy() for x in ("u", "w", "c"))
        key = (u << RANK | w).view(np.uint64)
        by = np.argsort(key)
        yield _seats(key[by], c=c[by], t=np.ones(len(c), np.int64), kept=np.zeros(len(c), np.int64))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs' keys, c, t and kept, row by row of _seats()."""
    for b in batches:
        for i in range(b.num_rows):
            rows = pa.Table.from_batches([b.slice(i, 1)])
            yield _keys(rows), *(_flat(rows[x], np.int64) for x in _SEATS[2:])


def _summed(near: DataFrame, rare: DataFrame, size: int, name: str) -> DataFrame:
    """side, part, sums: the column's sums by the pairs' first words (side 0) and second ones (1),
    as many rows as tasks for each part of TOGETHER frequent words."""

    def run(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for u, w, x in batches:
            for side, code in enumerate((u, w)):
                common = code >= 0
                sums[side] += np.bincount(code[common], x[common], size).astype(np.int64)
        for side in (0, 1):
            starts = [s for s in range(0, size, TOGETHER) if sums[side, s : s + TOGETHER].any()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), side)), pa.array(np.array(starts, np.int64) // TOGETHER), pa.array([sums[side, s : s + TOGETHER].tobytes() for s in starts], pa.binary())], names=["side", "part", "sums"])

    def of_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run((*_near_pair(key), {"c": c, "t": t}[name]) for key, c, t, _ in _unpacked(batches))

    def of_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(tuple(b.column(i).to_numpy() for i in range(3)) for b in batches)

    kind = "side long, part long, sums binary"
    return near.mapInArrow(of_near, kind).unionByName(rare.select("u", "w", name).mapInArrow(of_rare, kind))


def sample(many: DataFrame, vocab: DataFrame, v: int, ones: int, seed: int = 11) -> Model:
    """Fits the model to the pairs (u, w, c) of c > 1. vocab: code, c (how often the word
    occurs, and as often is a word after it) of all v words; `ones` of them occur once. Pairs of
    frequent words are seated by what is broadcast of these, and others meet their rarer words
    in joins."""
    spark, d = many.sparkSession, CONTEXT[0]
    count, own = F.count("*").alias("t"), F.sum("c").alias("m")
    often = _collected(vocab.where("code >= 0").select("code", "c"))
    size = int(often["code"].max()) + 1 if len(often["code"]) else 0
    occurs = np.zeros(size, np.int64)
    occurs[often["code"]] = often["c"]
    is_near = "u >= 0 and w >= 0"
    near = materialise(many.where(is_near).mapInArrow(_packed, _binaries(_SEATS)), "seats")
    rare = materialise(many.where(f"not ({is_near})").select("u", "w", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("kept")), "seats")
    vocab = vocab.where("code < 0")
    contexts = rare.where("u < 0").groupBy(F.col("u").alias("code")).agg(own, count).join(vocab, "code")
    contexts = materialise(contexts.select(F.col("code").alias("u"), (F.col("c") - F.col("m")).alias("n1"), (F.col("c") - F.col("m") + F.col("t")).alias("total")), "contexts")
    words = vocab.where("c > 1").join(rare.where("w < 0").groupBy(F.col("w").alias("code")).agg(own), "code", "left")
    words = materialise(words.select(F.col("code").alias("w"), (F.col("c") - F.coalesce("m", F.lit(0))).alias("n1"), F.lit(1).cast("long").alias("top"), F.lit(1.0 / (v + 1)).alias("p")), "words")
    once: list[float] = []
    new: list[float] = []
    root_total = v

    def drawn(sweep: int, level: int, *codes: np.ndarray) -> np.ndarray:
        """What the single customers of each dish draw by."""
        key = np.full(len(codes[0]), seed + 2 * sweep + level, np.uint64)
        for x in codes:
            key = mix(mix(key) + x.view(np.uint64))
        return mix(key)

    def chance(sweep: int, level: int) -> np.random.Generator:
        from pyspark import TaskContext

        return np.random.default_rng([seed, sweep, level, 1 << 2 * RANK, TaskContext.get().partitionId()])

    def seated_near(sweep: int, said: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, base = said.value
            for key, c, t, kept in _unpacked(batches):
                u, w = _near_pair(key)
                rng = np.random.default_rng([seed, sweep, 0, int(key[0])])
                t = seat(c, t, base[w], *CONTEXT, rng, total=total[u], key=drawn(sweep, 0, u, w))
                yield _seats(key, c=c, t=t, kept=kept + t if sweep >= BURN_IN else kept)

        return run

    def seated_rare(sweep: int, said: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (total, base), rng = said.value, chance(sweep, 0)
            for b in _joined(batches, SEATED):
                u, w, c, t, kept = (b.column(x).to_numpy() for x in ("u", "w", "c", "t", "kept"))
                n, p = (b.column(x).fill_null(0).to_numpy().copy() for x in ("total", "p"))
                n[u >= 0], p[w >= 0] = total[u[u >= 0]], base[w[w >= 0]]
                t = seat(c, t, p, *CONTEXT, rng, total=n, key=drawn(sweep, 0, u, w))
                kept = kept + t if sweep >= BURN_IN else kept
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, w, c, t, kept)], names=["u", "w", "c", "t", "kept"])

        return run

    def seated_words(sweep: int, root: int):
        """The parent's dishes of rarer words: r is seated."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = chance(sweep, 1)
            for b in _joined(batches, SEATED):
                w, r, t = (b.column(x).to_numpy() for x in ("w", "r", "top"))
                t = seat(r, t, np.full(len(r), 1.0 / (v + 1)), *PARENT, rng, total=np.full(len(r), root), key=drawn(sweep, 1, w))
                yield b.set_column(b.schema.get_field_index("top"), "top", pa.array(t))

        return run

    def added(rows: pa.Table) -> np.ndarray:
        return np.sum([np.frombuffer(x.as_buffer(), np.int64) for c in rows["sums"].chunks for x in c], axis=0)

    def seated_often(sweep: int, root: int, said: Broadcast):
        """A part's sums and, of second words, the parent's tables of these customers."""

        def run(rows: pa.Table) -> pa.Table:
            n1, top = said.value
            side, part, sums = rows["side"][0].as_py(), rows["part"][0].as_py(), added(rows)
            rng = np.random.default_rng([seed, sweep, 1, part])
            w = part * TOGETHER + np.arange(len(sums))
            t = seat(n1[w] + sums, top[w], np.full(len(w), 1.0 / (v + 1)), *PARENT, rng, total=np.full(len(w), root), key=drawn(sweep, 1, w)) if side else sums
            return pa.table({"side": [side], "part": [part], "sums": [sums.tobytes()], "top": [t.tobytes()]})

        return run

    def sums(name: str, how) -> tuple[np.ndarray, np.ndarray]:
        """By rank: the column's sums by first and by second word, and the latter's tables."""
        rows = _summed(near, rare, size, name)
        if size:  # parts without customers are seated, too
            none = spark.range(0, 2 * -(-size // TOGETHER)).select((F.col("id") % 2).alias("side"), F.expr("id div 2").alias("part"))
            least = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bytes(8 * min(TOGETHER, size - x * TOGETHER)) for x in b.column(1).to_pylist()], pa.binary())], names=["side", "part", "sums"]) for b in batches)
            rows = rows.unionByName(none.mapInArrow(least, "side long, part long, sums binary"))
        got = rows.groupBy("side", "part").applyInArrow(how, "side long, part long, sums binary, top binary").toArrow().sort_by("part")
        first, second = (got.filter(pc.equal(got["side"], i)) for i in (0, 1))
        return tuple(_flat(x, np.int64) for x in (first["sums"], second["sums"], second["top"]))

    def plain(rows: pa.Table) -> pa.Table:
        return pa.table({"side": rows["side"][:1], "part": rows["part"][:1], "sums": [(x := added(rows).tobytes())], "top": [x]})

    of_u, of_w, _ = sums("c", plain)
    n1_u, n1_w = occurs - of_u, occurs - of_w
    of_near = {"c": occurs}
    total, top, base = n1_u + sums("t", plain)[0], np.ones(size, np.int64), np.full(size, 1.0 / (v + 1))
    for sweep in range(SWEEPS):
        keep = sweep - BURN_IN
        before = [near, rare, contexts, words]
        said, of_parent = (spark.sparkContext.broadcast(x) for x in ((total, base), (n1_w, top)))
        near = materialise(near.mapInArrow(seated_near(sweep, said), _binaries(_SEATS)), "seats")
        asked = rare.where("w >= 0").withColumn("p", F.lit(None).cast("double")).unionByName(rare.where("w < 0").join(words.select("w", "p"), "w"))
        asked = asked.where("u >= 0").withColumn("total", F.lit(None).cast("long")).unionByName(asked.where("u < 0").join(contexts.select("u", "total"), "u"))
        rare = materialise(asked.mapInArrow(seated_rare(sweep, said), rare.schema), "seats")
        # the tables are the parent's customers
        of_u, of_w, top = sums("t", seated_often(sweep, root_total, of_parent))
        each = rare.where("w < 0").groupBy("w").agg(F.sum("t").alias("more"))
        words = words.join(each, "w", "left").withColumn("r", F.col("n1") + F.coalesce("more", F.lit(0))).drop("more")
        words = materialise(words.mapInArrow(seated_words(sweep, root_total), words.schema), "words")
        facts = words.agg(F.sum("r").alias("r"), F.sum("top").alias("t")).first()
        many_often = occurs > 1
        r_near = n1_w + of_w
        r, root_total = (int(facts[x] or 0) + int(y[many_often].sum()) + ones for x, y in (("r", r_near), ("t", top)))
        left = (PARENT[1] + PARENT[0] * root_total) / (v + 1)
        base = (r_near - PARENT[0] * top + left) / (PARENT[1] + r)
        words = words.withColumn("p", (F.col("r") - PARENT[0] * F.col("top") + left) / (PARENT[1] + r)).drop("r")
        # the pull on the parent that goes with it
        total = n1_u + of_u
        contexts = contexts.drop("total").join(rare.where("u < 0").groupBy("u").agg(F.sum("t").alias("more")), "u").withColumn("total", F.col("n1") + F.col("more")).drop("more")
        if keep >= 0:
            words, contexts = words.withColumn(BASES[keep], F.col("p")), contexts.withColumn(TABLES[keep], F.col("total"))
            of_near |= {BASES[keep]: base, TABLES[keep]: total}
            once.append((1 - PARENT[0] + left) / (PARENT[1] + r))
            new.append(left / (PARENT[1] + r))
        contexts = materialise(contexts, "contexts")
        dropped(*before)
        for x in (said, of_parent):
            x.destroy()
        released(spark)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, c, _, kept in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (*_near_pair(key), c, kept))], names=["u", "w", "c", "kept"])

    pairs = near.mapInArrow(told, "u long, w long, c long, kept long").unionByName(rare.select("u", "w", "c", "kept"))
    pairs = pairs.select("u", "w", "c", (F.col("c") - d * F.col("kept") / float(SWEEPS - BURN_IN)).alias("seen"))
    return Model(pairs, of_near, contexts.select("u", *TABLES), words.select("w", *BASES), once, new)


def logs(seen: np.ndarray, n: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
    """log10 of the averaged predictive probability of words after contexts of n customers;
    tables, base: one column a sweep."""
    d, theta = CONTEXT
    return np.log10((seen + ((theta + d * tables) * base).mean(axis=1)) / (theta + n))


#: Of texts (doc), of what a bucket answers a chunk of texts, and of words that are still to be met.
_SETTLED = "chunk long, place long, doc struct<doc_id: {id}, held_out: boolean, n_tokens: long, n_known: long, base: double, model: double>, row binary, log binary, base binary, known binary, w long, seen double, n long, " + ", ".join(f"{x} double" for x in TABLES)
_SCORES = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _filled(schema: pa.Schema, **columns: pa.Array | np.ndarray) -> pa.Table:
    """A table of that schema; columns that aren't given are null."""
    columns = {x: y if isinstance(y, (pa.Array, pa.ChunkedArray)) else pa.array(y, schema.field(x).type) for x, y in columns.items()}
    n = len(next(iter(columns.values())))
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _by_text(chunks: pa.ChunkedArray, own: np.ndarray, row: np.ndarray, **values: np.ndarray) -> dict[str, pa.Array | pa.ChunkedArray]:
    """The values summed by text, as one row for each of the chunks; own: which of them."""
    new = _starts(own, row)
    at = np.searchsorted(own[new], np.arange(len(chunks) + 1))
    keep = np.flatnonzero(np.diff(at))
    at = np.append(at[keep], len(new))
    sums = {x: _blobs(np.add.reduceat(y, new) if len(new) else y, at) for x, y in values.items()}
    return {"chunk": chunks.take(pa.array(keep)), "row": _blobs(_steps(row[new], at), at)} | sums


def score(docs: DataFrame, held_out: Column, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row;
    rows for which held_out is false are learned from."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    counted = materialise(docs.where("not held_out").select("text").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    facts = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("ones")).first()
    n, v, ones = int(facts["n"] or 0), int(facts["v"]), int(facts["ones"])
    often = _collected(counted.orderBy(F.desc("c"), "h").limit(BROADCAST).select("h"))
    ranks = spark.sparkContext.broadcast(Near.of(often | {"rank": np.arange(len(often["h"]))}, ["h"], "rank"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_codes(b.column("h").to_numpy().view(np.uint64), ranks.value)), b.column("c")], names=["code", "c"])

    vocab = materialise(counted.mapInArrow(coded, "code long, c long"), "vocab")
    dropped(counted)
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0)).alias("n")).first()["n"]
    buckets = size // DEALT + 1
    pairs = docs.select("text", "held_out").mapInArrow(lambda batches: _pairs_counted(batches, ranks.value, buckets), f"bucket long, {_binaries(_COUNTS)}")
    pairs = materialise(pairs.groupBy("bucket").applyInArrow(_pairs_merged, "u long, w long, c long"), "pairs")
    released(spark)
    model = sample(pairs.where("c > 1"), vocab, v, ones)
    known = materialise(model.pairs.unionByName(pairs.where("c = 1").select("u", "w", "c", F.lit(1.0 - CONTEXT[0]).alias("seen"))), "known")
    dropped(pairs, model.pairs)
    says = vocab.where("code < 0").join(model.rare_contexts.withColumnRenamed("u", "code"), "code", "left").join(model.rare_words.withColumnRenamed("w", "code"), "code", "left")
    says = materialise(says.select("code", "c", *(F.coalesce(x, "c").alias(x) for x in TABLES), *(F.coalesce(x, F.lit(p)).alias(x) for x, p in zip(BASES, model.once))), "says")
    dropped(vocab, model.rare_contexts, model.rare_words)
    near = model.near
    often = known.where("u >= 0 and w >= 0")
    by_count = often.groupBy("c").count().orderBy(F.desc("c")).collect()
    cut, more = 2, 0
    for r in by_count:  # how often pairs occur that are among the most frequent ones
        cut, more = r["c"], more + r["count"]
        if more >= PAIRS:
            break
    top = _collected(often.where(F.col("c") >= cut).orderBy(F.desc("c"), "u", "w").limit(PAIRS).select("u", "w", "seen"))
    of_near = near["c"], *(np.stack([near[x] for x in names], 1).astype(float) for names in (TABLES, BASES))
    held = spark.sparkContext.broadcast((of_near, Near.of(top, ["u", "w"], "seen")))
    base_of = float(np.log10(n + 0.5 * (v + 1)))
    id_type = dict(docs.dtypes)["doc_id"]

    doc_names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "model"]

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts (doc, at their place in the chunk), and by bucket their pairs that aren't
        broadcast; row: twice the place, odd if held out."""
        from pyspark import TaskContext

        (count, tables, base), pairs = held.value
        names = ["row", "low", "high", "u", "w"]
        chunk = TaskContext.get().partitionId() << 32
        end = _codes(np.array([END]), ranks.value)[0]
        waiting: list[tuple[np.ndarray, ...]] = []
        place = size = 0

        def asked() -> Iterator[pa.RecordBatch]:
            row, u, w = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            bucket, near = _bucket(u, w, buckets), (u >= 0) & (w >= 0)
            common = _dealt(names, bucket[near], row=row[near], **_halves((u[near] << RANK | w[near]).view(np.uint64)))
            rare = _dealt(names, bucket[~near], row=row[~near], u=u[~near], w=w[~near])
            for b in (common, rare):
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(m, chunk)), pa.nulls(m, pa.int64()), pa.nulls(m, doc_type), *b.columns[1:]], names=["bucket", "chunk", "place", "doc", *names])

        for b in text_slices(batches, "text"):
            h, at = token_hashes(binary_texts(b.column("text")))
            w = _codes(h, ranks.value)
            u, m = _before(w, at, end), b.num_rows
            out = b.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
            common = w >= 0
            part = np.zeros(len(w))
            part[common] = np.log10(count[w[common]] + 0.5)
            met, seen = pairs.look(u.view(np.uint64), w.view(np.uint64))
            log = np.zeros(len(w))
            log[met] = logs(seen[met], count[u[met]], tables[u[met]], base[w[met]])
            sums = [np.add.reduceat(x, at[:-1]) for x in (common.astype(np.int64), part, log)]
            doc = pa.StructArray.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.diff(at)), pa.array(sums[0]), pa.array(sums[1] - base_of * np.diff(at)), pa.array(sums[2])], names=doc_names)
            doc_type = doc.type
            places = place + np.arange(m)
            to = _bucket(-1 - (chunk + places), places, buckets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(m, chunk)), pa.array(places), doc, *(pa.nulls(m, pa.binary()) for _ in names)], names=["bucket", "chunk", "place", "doc", *names])
            waiting.append((np.repeat(2 * places + out, np.diff(at))[~met], u[~met], w[~met]))
            place, size = place + m, size + len(waiting[-1][0])
            if size >= HELD or place >= HELD:
                yield from asked()
                chunk, place, size = chunk + 1, 0, 0
        if waiting:
            yield from asked()

    once, unseen = model.once, model.new

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket: the pairs of the model, with `seen`."""
        for b in _joined(batches, HELD):
            u, w, seen = (b.column(x).to_numpy() for x in ("u", "w", "seen"))
            bucket, near = _bucket(u, w, buckets), (u >= 0) & (w >= 0)
            yield _dealt(_SAYS, bucket[near], seen=seen[near], **_halves((u[near] << RANK | w[near]).view(np.uint64)))
            yield _dealt(_SAYS, bucket[~near], seen=seen[~near], u=u[~near], w=w[~near])

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket: what the model says of rarer words; only their codes if they occur once."""
        for b in _joined(batches, SEATED):
            u = b.column("code").to_numpy()
            says = np.stack([b.column(x).to_numpy().astype(float) for x in ("c", *TABLES, *BASES)], 1)
            bucket, many = _bucket(u, u, buckets), says[:, 0] > 1
            yield _dealt(_SAYS, bucket[many], u=u[many], says=says[many])
            yield _dealt(_SAYS, bucket[~many], u=u[~many])

    def answered(texts: pa.Table, model: pa.Table) -> pa.Table:
        """Of a bucket: what its pairs add to each text's score; texts' own rows pass."""
        count, tables, base = held.value[0]
        docs = _given(texts, "doc")
        kinds = {"chunk": pa.int64(), "place": pa.int64(), "doc": texts.schema.field("doc").type} | dict.fromkeys(("row", "log", "base", "known"), pa.binary()) | {"w": pa.int64(), "seen": pa.float64(), "n": pa.int64()} | dict.fromkeys(TABLES, pa.float64())
        schema = pa.schema(list(kinds.items()))
        out = [_filled(schema, chunk=docs["chunk"], place=docs["place"], doc=docs["doc"])]
        first = lambda row: np.where(row & 1, 0.0, 1.0 - CONTEXT[0])  # noqa: E731  of a pair that isn't kept

        ask, known = _given(texts, "low"), _given(model, "low")
        key, (row, own) = _keys(ask), _rows(ask["row"])
        if len(key):
            pairs = Near.of({"key": _keys(known).view(np.int64), "seen": _flat(known["seen"], np.float64)}, ["key"], "seen")
            log = np.empty(len(key))
            for s in range(0, len(key), SEATED):
                k = key[s : s + SEATED]
                met, seen = pairs.look(k)
                u, w = (k >> np.uint64(RANK)).view(np.int64), (k & np.uint64((1 << RANK) - 1)).view(np.int64)
                log[s : s + SEATED] = logs(np.where(met, seen, first(row[s : s + SEATED])), count[u], tables[u], base[w])
            out.append(_filled(schema, **_by_text(ask["chunk"], own, row, log=log)))

        ask, known = _given(texts, "u"), _given(model, "w")
        u, w, (row, own) = _flat(ask["u"], np.int64), _flat(ask["w"], np.int64), _rows(ask["row"])
        if len(u):
            pairs = Near.of({"u": _flat(known["u"], np.int64), "w": _flat(known["w"], np.int64), "seen": _flat(known["seen"], np.float64)}, ["u", "w"], "seen")
            many, single = _given(model, "says"), _flat(_given(model, "u", none=("w", "says"))["u"], np.int64)
            of_once = [1.0, *(1.0 for _ in TABLES), *once]
            says = np.concatenate([_flat(many["says"], np.float64).reshape(-1, len(of_once)), np.tile(of_once, (len(single), 1)), [[0.0, *(0.0 for _ in TABLES), *unseen]]])
            words = Near.of({"code": np.concatenate([_flat(many["u"], np.int64), single]), "at": np.arange(len(says) - 1)}, ["code"], "at")
            at = lambda code: (lambda met, x: np.where(met, x, len(says) - 1).astype(np.int64))(*words.look(code.view(np.uint64)))
            met, seen = pairs.look(u.view(np.uint64), w.view(np.uint64))
            seen = np.where(met, seen, first(row))
            of_u, of_w, k = says[at(u)], says[at(w)], len(TABLES)
            n, t, c, p = of_u[:, 0], of_u[:, 1 : 1 + k], of_w[:, 0], of_w[:, 1 + k :]
            x, y = u >= 0, w >= 0
            n[x], t[x], p[y] = count[u[x]], tables[u[x]], base[w[y]]
            both = ~x & ~y
            one = ~both
            part, is_known = np.where(y, 0.0, np.log10(c + 0.5)), (~y & (c > 0)).astype(np.int64)
            out.append(_filled(schema, **_by_text(ask["chunk"], own[one], row[one], log=logs(seen, n, t, p)[one], base=part[one], known=is_known[one])))
            chunks = ask["chunk"].to_numpy()
            out.append(_filled(schema, chunk=chunks[own[both]], place=row[both] >> 1, w=w[both], seen=seen[both], n=n[both].astype(np.int64), **{name: t[both, i] for i, name in enumerate(TABLES)}))
        return pa.concat_tables(out)

    of_w = says.select(F.col("code").alias("w"), "c", *BASES)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What rare words after rare words add to their texts' scores."""
        for b in batches:
            get = lambda x: b.column(x).fill_null(0).to_numpy(zero_copy_only=False)
            seen, n, c = map(get, ("seen", "n", "c"))
            t = np.stack([get(x) for x in TABLES], 1)
            p = np.stack([b.column(x).fill_null(y).to_numpy(zero_copy_only=False) for x, y in zip(BASES, unseen)], 1)
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("place"), pa.array(logs(seen, n, t, p)), pa.array(np.log10(c + 0.5)), pa.array((c > 0).astype(np.int64))], names=["chunk", "place", "one_log", "one_base", "one_known"])

    def gathered(rows: pa.Table) -> pa.Table:
        """A chunk's texts with their sums."""
        docs, some, single = _given(rows, "doc"), _given(rows, "row"), _given(rows, "one_log")
        m, place = docs.num_rows, docs["place"].to_numpy()
        sums = {}
        for name in ("log", "base", "known"):
            kind = np.int64 if name == "known" else np.float64
            part = _given(some, name)
            at = np.concatenate([_rows(part["row"])[0] >> 1, single["place"].to_numpy()])
            sums[name] = np.bincount(at, np.concatenate([_flat(part[name], kind), single[f"one_{name}"].to_numpy()]), m)[place] if m else np.zeros(0)
        get = lambda x: pc.struct_field(docs["doc"], x)
        return pa.table({"doc_id": get("doc_id"), "held_out": get("held_out"), "n_tokens": get("n_tokens"), "n_known": get("n_known").to_numpy() + sums["known"].astype(np.int64), "train_tokens": np.full(m, n, np.int64), "base_score": get("base").to_numpy() + sums["base"], "score": get("model").to_numpy() + sums["log"]})

    doc = _SETTLED.format(id=id_type).split(", row binary")[0]
    spoken_of = known.select("u", "w", "seen").mapInArrow(spoken, f"bucket long, {_binaries(_SAYS)}").unionByName(says.mapInArrow(said, f"bucket long, {_binaries(_SAYS)}"))

    def scored(part: DataFrame) -> DataFrame:
        rows = part.mapInArrow(shipped, f"bucket long, {doc}, {_binaries(['row', 'low', 'high', 'u', 'w'])}")
        rows = rows.groupBy("bucket").cogroup(spoken_of.groupBy("bucket")).applyInArrow(answered, _SETTLED.format(id=id_type))
        done = materialise(rows, "settled")
        del rows
        released(spark)
        rare = done.where("w is not null").select("chunk", "place", "w", "seen", "n", *TABLES).join(of_w, "w", "left")
        rare = rare.mapInArrow(told, "chunk long, place long, one_log double, one_base double, one_known long")
        sums = done.where("w is null").select("chunk", "place", "doc", "row", "log", "base", "known").unionByName(rare, allowMissingColumns=True)
        out = materialise(sums.groupBy("chunk").applyInArrow(gathered, _SCORES.format(id=id_type)), "scores")
        dropped(done)
        return out

    scores = None
    for i in range(SLICES):
        part = scored(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == i))
        released(spark)
        scores = part if scores is None else scores.unionByName(part)
    dropped(known, says)
    return scores


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, perplexity and base_perplexity over all tokens of score()'s rows."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(each("score").alias("perplexity"), each("base_score").alias("base_perplexity"))
