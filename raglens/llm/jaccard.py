"""N-gram Jaccard join: documents whose sets of distinct word shingles are alike, by set
relations and skipping.

1. Sets. Every text becomes the set of its shingle hashes. Identical sets form one class;
   only the class's smallest id goes on, its copies take over its answers.
2. Index lists. A set's prefix under one global order of shingles - the frequent ones last,
   all others by hash - is indexed. For thresholds of 0.8 or more a list belongs to two
   neighbouring shingles: of the gaps between the shingles that two linked sets share, one
   of the first D + 1 is empty in both, D being the shingles that only one of them has; and
   both prefixes hold it. Below 0.8 a list belongs to one shingle. A list is sorted by size
   and falls into runs, between which sizes alone rule out a link.
3. Families. Every set goes to the one hub of its lists, the first set of a run, that sizes
   and histograms - how many of the shingles fall into each range of hashes, whose distance
   is never more than the number of shingles that only one set has - leave as a partner and
   that it shares the most lists with. The sets of a hub meet in tasks of bounded size, each
   with the hub. There a local index skips whole blocks of list entries whose size or
   position can't reach the required overlap, and a set's overlaps are derived from those of
   a highly similar reference set, one of which is held for each family, by reading only the
   lists of the few shingles in which the two differ. Sets already connected aren't compared.
4. The rest. Sets that didn't meet and aren't connected meet by their lists, again in bounded
   tasks that skip blocks by size and position and test histograms. Components that may be
   linked form pools, and in each the sets outside of its largest component are joined with
   all of its sets in such tasks.
5. Components of the links found; only true links enter them.

So a family's sets are sent once, however large it is, but for its few outliers. The frequent
shingles come from all rows: every window of rows reports its own frequent ones. The order
affects only the work, never the result.

Defined results: null and empty texts, and texts without words, have the empty set and link
with nothing, nor with each other. Rows with a null id come back with a null component.
Rows that share an id share its component; further columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.llm.common import binary_texts, connected_components, materialise, mix, signed, text_slices, word_hashes

#: A shingle is frequent if it is in this share of the documents of a window of rows.
FREQUENT_SHARE, FREQUENT_LEAST = 0.0003, 3
#: Most frequent shingles that are told apart; the rest of them keep the order by hash.
FREQUENT_KEPT = 200_000
#: Shingles of the sets that meet in a task, about.
ELEMENTS = 1 << 20
#: Entries of an index list that meet in a task.
ENTRIES = 4096
#: Slots in which index lists are counted; those of slots with more than HOT entries (and
#: many times the mean) are dealt over several tasks.
SLOTS, HOT = 1 << 16, 1 << 16
#: Rows of a class beyond which its label is broadcast instead of joined by key.
LARGE_CLASS = 1_000_000
#: Bits of a shingle's hash that choose its place in a histogram.
RANGE_BITS = 6
#: Entries of a list that are skipped together.
SKIP = 64
#: Reference sets whose overlaps a task holds.
REFS = 64

#: Ids of placed sets that are broadcast, some 50 bytes each, so that only their texts move.
MOST_IDS = 2_000_000

_C = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts)
    if len(h) >= words:
        k = len(h) - words + 1
        rolled = np.zeros(k, np.uint64)
        for j in range(words):
            rolled += mix(h[j : j + k] + _C[j % 5 : j % 5 + 1] * np.uint64(j + 1))
        rolled = mix(rolled)
    out = []
    for s, e in zip(at, at[1:]):
        n = e - s
        if n >= words:
            out.append(np.unique(rolled[s : e - words + 1]))
        elif n:
            out.append(mix(np.array([sum((int(x) * (2 * j + 3) for j, x in enumerate(h[s:e])), int(n)) & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def histogram(s: np.ndarray) -> bytes:
    """How many of the shingles (255 at most) fall into each range of hashes."""
    n = np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS)
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def needed(nx, ny, num: int, den: int):
    """The least overlap of sets of these sizes with overlap / union >= num / den."""
    return -(-(num * (nx + ny)) // (num + den))


def neighbours(num: int, den: int) -> bool:
    """Whether lists belong to two neighbouring shingles: linked sets that differ share two
    shingles more, at least, than they have of their own."""
    return 5 * num >= 4 * den


def lists_of(order: _Order, s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index lists that a set is in. With o shared shingles of sizes n and m, the empty gap
    ends before place D + 2 + (n - o) = 2n + m - 3o + 2, which is 2 * (n - m) + 2 at most for
    the smallest m that links."""
    own = len(s) - -(-num * len(s) // den)  # shingles that a linked set may lack
    if not neighbours(num, den):
        return order.prefix(s, own + 1)
    if not own and den * len(s) // num == len(s):
        return s[:0]  # only equal sets link with it
    p = order.prefix(s, 2 * own + 3)
    return mix(p[:-1] ^ mix(p[1:] + _C[1]))


def _frequent(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def report() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        few = n >= max(FREQUENT_LEAST, int(np.ceil(FREQUENT_SHARE * len(held))))
        return pa.RecordBatch.from_arrays([pa.array(signed(keys[few])), pa.array(n[few].astype(np.int64))], names=["h", "c"])

    total = 0
    for b in text_slices(batches, "text"):
        sets = shingle_sets(binary_texts(b.column("text")), words)
        held += sets
        total += sum(map(len, sets))
        if total >= 1 << 21:
            yield report()
            held, total = [], 0
    if held:
        yield report()


class _Order:
    def __init__(self, rows) -> None:
        """rows: a frame of frequent shingles h, the most frequent first."""
        h = np.asarray(rows["h"], np.int64).view(np.uint64)
        by = np.argsort(h)
        self.keys, self.rank = h[by], np.arange(len(h), 0, -1)[by]  # rank: the most frequent last

    def prefix(self, s: np.ndarray, size: int) -> np.ndarray:
        if not len(self.keys):
            return s[:size]
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        hot = self.keys[at] == s
        rare = s[~hot]
        if len(rare) >= size:
            return rare[:size]
        late = s[hot]
        return np.concatenate([rare, late[np.argsort(self.rank[at[hot]], kind="stable")]])[:size]


def set_table(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n (size of the set), s1, s2 (128 bits that identify the set), prefix, hist."""
    spark = docs.sparkSession
    top = docs.select("text").mapInArrow(lambda it: _frequent(it, words), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT_KEPT).toPandas()
    order = spark.sparkContext.broadcast(_Order(top))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for b in text_slices(batches, "text"):
            sets = shingle_sets(binary_texts(b.column("text")), words)
            sums = [(s.sum(dtype=np.uint64), mix(s ^ _C[0]).sum(dtype=np.uint64)) for s in sets]
            n = [len(s) for s in sets]
            prefix = [signed(lists_of(o, s, num, den)) if len(s) else None for s in sets]
            hist = [histogram(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(np.array([x[k] for x in sums], np.uint64).view(np.int64)) for k in (0, 1)), pa.array(prefix, pa.list_(pa.int64())), pa.array(hist, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "prefix", "hist"],
            )

    return docs.mapInArrow(rows, "doc_id long, n long, s1 long, s2 long, prefix array<long>, hist binary")


def possible(na, nb, ha: np.ndarray, hb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and histograms leave a link of sets, row by row."""
    apart = np.abs(ha.astype(np.int16) - hb.astype(np.int16)).sum(axis=-1)
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (apart <= na + nb - 2 * needed(na, nb, num, den))


def shared_entries(reps: DataFrame, num: int, den: int) -> DataFrame:
    """t, pos, n, rep, run: the entries of index lists that share their run with others; run
    is the first set, as struct(n, rep), of the run. Lists of crowded slots are dealt over
    several parts, each with runs of its own; these have a `top`, the list's first set."""
    entries = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "t"))
    slot = F.pmod("t", F.lit(SLOTS)).cast("int").alias("slot")
    counts = materialise(entries.groupBy(slot).agg(F.count("*").alias("c")), "slots")
    mean = counts.agg(F.avg("c").alias("m")).first()["m"] or 0
    most = max(HOT, 4 * int(mean))
    crowded = counts.where(F.col("c") > most).select("slot", F.ceil(F.col("c") / most).alias("parts"))
    hot = crowded.count() > 0  # at most SLOTS / 4 slots are
    if hot:
        entries = entries.withColumn("slot", slot).join(F.broadcast(crowded), "slot", "left")
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.lit(-1))
        entries = entries.select("rep", "n", "pos", "t", part.cast("int").alias("part"))
    w = Window.partitionBy("t", *["part"] * hot).orderBy("n", "rep")
    before = F.lag("n").over(w)
    e = entries.withColumn("run", F.when(before.isNull() | (den * before < num * F.col("n")), F.struct("n", "rep")))
    e = e.withColumn("run", F.last("run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("next", F.lead("run.rep").over(w))
    alone = (F.col("run.rep") == F.col("rep")) & ~F.coalesce(F.col("next") == F.col("run.rep"), F.lit(False))
    if not hot:
        return e.where(~alone).select("t", "pos", "n", "rep", "run", F.col("run").alias("top"))
    e = materialise(e.where(~alone | (F.col("part") >= 0)).select("t", "pos", "n", "rep", "run", "part"), "parts")
    tops = e.where("part >= 0").groupBy("t").agg(F.min("run").alias("top"), F.count("*").alias("c")).where("c > 1").drop("c")
    return e.where("part < 0").select("t", "pos", "n", "rep", "run", F.col("run").alias("top")).unionByName(e.where("part >= 0").join(tops, "t").select("t", "pos", "n", "rep", "run", "top"))


def hubs(reps: DataFrame, shared: DataFrame, num: int, den: int, test: Callable = possible) -> DataFrame:
    """rep, n, hub of every set with a hub other than itself. Of the first sets of its runs
    that may link with it, it is the smallest of those that it shares most lists with (a
    quarter of the most, at least)."""
    star = shared.where(F.col("run.rep") != F.col("rep")).select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("run.rep").alias("b"), F.col("run.n").alias("nb"))
    over = shared.where((F.col("run.rep") == F.col("rep")) & (F.col("top.rep") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("top.rep").alias("b"), F.col("top.n").alias("nb"))
    pairs = star.unionByName(over).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")).where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    side = lambda r, n, h: reps.select(F.col("rep").alias(r), F.col("n").alias(n), F.col("hist").alias(h))
    pairs = pairs.join(side("a", "na", "ha"), ["a", "na"]).join(side("b", "nb", "hb"), ["b", "nb"])

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ha, hb = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(x.num_rows, -1) for k in ("ha", "hb"))
            na, nb = (x.column(k).to_numpy() for k in ("na", "nb"))
            yield x.select(["a", "na", "b", "nb", "c"]).filter(pa.array(test(na, nb, ha, hb, num, den)))

    pairs = pairs.mapInArrow(tested, "a long, na long, b long, nb long, c long")
    best = pairs.groupBy(F.col("a").alias("rep"), F.col("na").alias("n")).agg(F.sort_array(F.collect_list(F.struct("nb", "b", "c"))).alias("x"))
    most = F.array_max(F.transform("x", lambda e: e["c"]))
    return best.select("rep", "n", F.get(F.filter("x", lambda e: 4 * e["c"] >= most), F.lit(0))["b"].alias("hub"))


class LocalJoin:
    """Links among the sets of one task, smallest sets first. side: sets of one side aren't
    compared; label: sets of one label are connected already."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> None:
        self.num, self.den = num, den
        self.by = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in self.by]
        self.side = None if side is None else side[self.by]
        self.label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1][self.by]
        self.n = np.array([len(s) for s in sets], np.int64)
        keys, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(df, kind="stable"), kind="stable")  # rare shingles first
        ends = np.cumsum(self.n)
        self.sets = [np.sort(rank[inv[e - k : e]]) for e, k in zip(ends, self.n)]
        flat = np.concatenate(self.sets)
        own = np.repeat(np.arange(len(sets)), self.n)
        pos = np.arange(len(flat)) - np.repeat(ends - self.n, self.n)
        o = np.argsort(flat, kind="stable")  # lists by shingle, in each the smaller sets first
        self.own, self.pos = own[o], pos[o]
        self.at = np.searchsorted(flat[o], np.arange(len(keys) + 1))
        # blocks of a list: first entry, and the most that any entry leaves for an overlap
        per = -(-np.diff(self.at) // SKIP)
        self.block_at = np.concatenate(([0], np.cumsum(per)))
        self.starts = np.repeat(self.at[:-1], per) + SKIP * _ragged(per)
        self.ends = np.minimum(self.starts + SKIP, np.repeat(self.at[1:], per))
        self.room = np.maximum.reduceat(self.n[self.own] - self.pos, self.starts)
        self.refs: dict[int, np.ndarray] = {}
        self.ref_of = np.full(len(sets), -1)

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        n = self.at[tokens + 1] - self.at[tokens]
        entries = np.repeat(self.at[tokens], n) + _ragged(n)
        return np.bincount(self.own[entries], minlength=len(self.n))

    def probe(self, x: int) -> np.ndarray:
        """Smaller sets, not connected with x, that size and position leave as candidates."""
        n = int(self.n[x])
        tokens = self.sets[x][: n - -(-self.num * n // self.den) + 1]
        lo = np.searchsorted(self.n, -(-self.num * n // self.den))
        per = self.block_at[tokens + 1] - self.block_at[tokens]
        block = np.repeat(self.block_at[tokens], per) + _ragged(per)
        place = np.repeat(np.arange(len(tokens)), per)
        first, last = self.own[self.starts[block]], self.own[self.ends[block] - 1]
        least = needed(n, self.n[np.maximum(first, lo)], self.num, self.den)
        good = (last >= lo) & (first < x) & (np.minimum(n - place, self.room[block]) >= least)
        block, place = block[good], place[good]  # all others are skipped whole
        per = self.ends[block] - self.starts[block]
        entry = np.repeat(self.starts[block], per) + _ragged(per)
        place = np.repeat(place, per)
        own = self.own[entry]
        ny = self.n[own]
        good = (own >= lo) & (own < x) & (self.label[own] != self.label[x])
        good &= np.minimum(n - place, ny - self.pos[entry]) >= needed(n, ny, self.num, self.den)
        if self.side is not None:
            good &= self.side[own] != self.side[x]
        return np.unique(own[good])

    def _join(self, x: int, y: int, out: list[tuple[int, int]]) -> None:
        a, b = sorted((self.label[x], self.label[y]))
        if a != b:
            self.label[self.label == b] = a
            out.append((int(self.by[x]), int(self.by[y])))

    def _linked(self, x: int, y: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return self.den * overlap >= self.num * (self.n[x] + self.n[y] - overlap)

    def links(self) -> list[tuple[int, int]]:
        """Links that connect all sets that links connect, as indexes of the sets given."""
        out: list[tuple[int, int]] = []
        for x in range(len(self.n)):
            cand = self.probe(x)
            if not len(cand):
                continue
            ref = int(self.ref_of[cand[-1]])
            if ref < 0:
                ref = int(cand[-1])
            more = np.setdiff1d(self.sets[x], self.sets[ref], assume_unique=True)
            shared = int(self.n[x]) - len(more)
            less = int(self.n[ref]) - shared
            allowed = self.side is None or self.side[ref] != self.side[x]
            if allowed and self._linked(x, ref, shared):
                self._join(x, ref, out)
                cand = cand[self.label[cand] != self.label[x]]
            self.ref_of[x] = ref
            if not len(cand):
                continue
            if 3 * (len(more) + less) <= 2 * self.n[x]:  # derived from a similar set's answers
                if ref not in self.refs:
                    self.refs[ref] = self.overlaps(self.sets[ref])
                gone = np.setdiff1d(self.sets[ref], self.sets[x], assume_unique=True)
                overlap = self.refs[ref] + self.overlaps(more) - self.overlaps(gone)
            else:
                overlap = self.overlaps(self.sets[x])
                self.refs[x], self.ref_of[x] = overlap, x
            while len(self.refs) > REFS:
                del self.refs[next(iter(self.refs))]
            for y in cand[self._linked(x, cand, overlap[cand])]:
                self._join(x, int(y), out)
        return out


def _ragged(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _joined(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The links of every task's rows (g, i, j, side, label, doc_id, text), which come sorted."""
    key, held, seen = None, [], set()

    def solve() -> list[tuple[int, int]]:
        ids = [h[0] for h in held]
        side = np.array([h[1] for h in held])
        label = np.array([h[2] for h in held])
        if len(held) < 2 or (label == label[0]).all():
            return []
        side = None if (side == 0).all() else side
        return [(ids[a], ids[b]) for a, b in LocalJoin([h[3] for h in held], num, den, side, label).links()]

    def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in text_slices(batches, "text"):
        out: list[tuple[int, int]] = []
        sets = shingle_sets(binary_texts(b.column("text")), words)
        for g, i, j, d, side, label, s in zip(*(b.column(c).to_pylist() for c in ("g", "i", "j", "doc_id", "side", "label")), sets):
            if (g, i, j) != key:
                out += solve()
                key, held = (g, i, j), []
            if not held or held[-1][0] != d:
                seen = set()
            if (mark := (side, label, hash(s.tobytes()))) not in seen:  # rows of one id and set come once
                seen.add(mark)
                held.append((d, side, label, s))
        if out:
            yield batch(out)
    if out := solve():
        yield batch(out)


def verified(docs: DataFrame, placed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the sets that `placed` (doc_id, g, i, j, side, label) sends to the
    same task (g, i, j)."""
    ids = materialise(placed.select("doc_id").distinct(), "ids")
    if ids.count() <= MOST_IDS:  # else all texts are shuffled
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    rows = docs.join(placed, "doc_id").select("g", "i", "j", "doc_id", "side", "label", "text")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id", "side", "label")
    return materialise(rows.mapInArrow(lambda it: _joined(it, words, num, den), "a long, b long"), "found")


def _tasks(size: Column) -> Column:
    return F.ceil(size / ELEMENTS).cast("int")


def placed_at_hubs(hub: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where sets meet first, as verified() takes it, and the cell (rep, n, cell) of each set:
    sets of one cell were compared."""
    groups = materialise(hub.groupBy("hub").agg(_tasks(F.sum("n")).alias("tasks")), "groups")
    centre = groups.select(F.col("hub").alias("g"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("i"), F.col("hub").alias("doc_id"))
    own = F.pmod(F.xxhash64("rep"), F.col("tasks").cast("long")).cast("int")
    members = hub.join(groups, "hub").select(F.col("hub").alias("g"), own.alias("i"), F.col("rep").alias("doc_id"), "n")
    zero = F.lit(0)
    placed = members.select("g", "i", "doc_id").unionByName(centre).select("doc_id", "g", "i", zero.alias("j"), zero.alias("side"), F.col("doc_id").alias("label"))
    return placed, members.select(F.col("doc_id").alias("rep"), "n", F.xxhash64("g", "i").alias("cell"))


def _met(batches: Iterator[pa.RecordBatch], num: int, den: int, test: Callable) -> Iterator[pa.RecordBatch]:
    """rep, n, comp, low of the sets that may link with one of another component: of the
    entries (t, i, j, rep, n, pos, blk, comp, cell, hist) of each task, which come sorted by
    task and size. A task joins components into pieces by such pairs; low is the least
    component of a piece, and of two components of one piece no further pairs are sought."""
    key, held = None, []

    def solve() -> pa.RecordBatch:
        rep, n, pos, blk, comp, cell, hist = (np.concatenate([h[k] for h in held]) for k in range(7))
        names, which = np.unique(comp, return_inverse=True)
        piece = np.arange(len(names))
        for s in range(0, len(rep), SKIP):
            x = np.arange(s, min(s + SKIP, len(rep)))
            # blocks of sizes that can't link with any of x's are skipped whole
            for e in range(int(np.searchsorted(n, -(-num * int(n[s]) // den))), int(x[-1]) + 1, 8 * SKIP):
                y = np.arange(e, min(e + 8 * SKIP, int(x[-1]) + 1))
                good = (piece[which[x]][:, None] != piece[which[y]][None]) & (cell[x][:, None] != cell[y][None]) & (x[:, None] > y[None])
                if key[1] != key[2]:
                    good &= blk[x][:, None] != blk[y][None]
                p, q = np.nonzero(good)
                p, q = p + s, q + e
                # before a shared list and behind it, each difference of places counts
                apart = np.abs(pos[p] - pos[q]) + np.abs((n - pos)[p] - (n - pos)[q])
                near = apart <= n[p] + n[q] - 2 * needed(n[p], n[q], num, den)
                p, q = p[near], q[near]
                ok = test(n[p], n[q], hist[p], hist[q], num, den)
                for c, d in np.unique(np.column_stack([which[p[ok]], which[q[ok]]]), axis=0).tolist():
                    low, high = sorted((piece[c], piece[d]))
                    piece[piece == high] = low
        joint = np.bincount(piece, minlength=len(names))[piece] > 1
        of = joint[which]
        cols = [rep[of], n[of], comp[of], names[piece[which[of]]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rep", "n", "comp", "low"])

    for b in batches:
        if not b.num_rows:
            continue
        out = []
        task = np.column_stack([b.column(c).to_numpy() for c in ("t", "i", "j")])
        hist = np.frombuffer(b"".join(b.column("hist").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        cols = [*(b.column(c).to_numpy() for c in ("rep", "n", "pos", "blk", "comp", "cell")), hist]
        cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1).tolist(), len(task)]
        for s, e in zip(cuts, cuts[1:]):
            if key != tuple(task[s]):
                if held:
                    out.append(solve())
                key, held = tuple(task[s]), []
            held.append([c[s:e] for c in cols])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else out[0]
    if held:
        yield solve()


def distant_links(docs: DataFrame, reps: DataFrame, shared: DataFrame, cells: DataFrame, links: DataFrame, words: int, num: int, den: int, test: Callable = possible) -> DataFrame:
    """Links between sets of different cells that `links` doesn't connect yet. Components
    that may be linked form pools; of a pool, the sets outside of its largest component meet
    all of its sets."""
    roots = connected_components(links, "apart").withColumnRenamed("node", "rep")
    about = reps.select("rep", "n", "hist").join(roots, "rep", "left").join(cells, ["rep", "n"], "left")
    about = materialise(about.select("rep", "n", "hist", F.coalesce("root", "rep").alias("comp"), F.coalesce("cell", "rep").alias("cell")), "about")
    named = shared.select("t", "pos", "n", "rep").join(about.select("rep", "n", "comp", "cell"), ["rep", "n"])
    facts = named.groupBy("t").agg(F.count("*").alias("c"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("cell").alias("h1"), F.max("cell").alias("h2"))
    facts = facts.where("c1 <> c2 and h1 <> h2").select("t", F.ceil(F.col("c") / ENTRIES).cast("int").alias("blocks"))
    open_ = materialise(named.join(facts, "t"), "open").join(about.select("rep", "n", "hist"), ["rep", "n"])
    open_ = open_.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    sent = open_.select("t", "rep", "n", F.col("pos").cast("long").alias("pos"), "blk", "comp", "cell", "hist", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    sent = sent.select("t", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "rep", "n", "pos", "blk", "comp", "cell", "hist")
    sent = sent.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", "n", "rep")
    found = materialise(sent.mapInArrow(lambda it: _met(it, num, den, test), "rep long, n long, comp long, low long").distinct(), "open")
    pools = materialise(connected_components(found.select(F.col("comp").alias("a"), F.col("low").alias("b")), "pools"), "pools")
    sets = found.select("rep", "n", "comp").distinct().join(pools.select(F.col("node").alias("comp"), F.col("root").alias("g")), "comp")
    sizes = sets.groupBy("g", "comp").agg(F.sum("n").alias("s"))
    main = sizes.groupBy("g").agg(F.max(F.struct("s", "comp"))["comp"].alias("main"), _tasks(F.sum("s")).alias("tasks"))
    sets = materialise(sets.join(main, "g"), "pooled")
    away = F.col("comp") != F.col("main")
    outs = sets.where(away).groupBy("g").agg(_tasks(F.sum("n")).alias("outs"))
    sets = sets.join(outs, "g")
    dealt = lambda c: F.pmod(F.xxhash64("rep"), F.col(c).cast("long")).cast("int")
    every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    one = sets.where(away & ((F.col("outs") > 1) | (F.col("tasks") > 1))).select(F.col("rep").alias("doc_id"), "g", dealt("outs").alias("i"), every("tasks", "j"), F.lit(1).alias("side"), F.col("comp").alias("label"))
    all_ = sets.select(F.col("rep").alias("doc_id"), "g", every("outs", "i"), dealt("tasks").alias("j"), F.when((F.col("outs") > 1) | (F.col("tasks") > 1), 2).otherwise(0).alias("side"), F.col("comp").alias("label"))
    return verified(docs, one.unionByName(all_), words, num, den)


def join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the components of the links
    overlap / union >= num / den of the rows' shingle sets."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return joined(docs, materialise(set_table(docs, words, num, den), "sets"), words, num, den)


def joined(docs: DataFrame, table: DataFrame, words: int, num: int, den: int, test: Callable = possible) -> DataFrame:
    """join() of docs (doc_id, text) by a written table as set_table() makes it: linked sets share
    an entry of `prefix`, and test() of sizes and `hist` is true of them."""
    full = table.where("n > 0 and doc_id is not null")
    reps = materialise(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.min_by("prefix", "doc_id").alias("prefix"), F.min_by("hist", "doc_id").alias("hist")), "classes")
    shared = materialise(shared_entries(reps, num, den), "shared")
    hub = materialise(hubs(reps, shared, num, den, test), "hubs")
    # the text of a class is that of its smallest id; of rows that share an id, one of the class
    own = table.where("doc_id is not null").select("doc_id", "s1", "s2", "n").distinct().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1")
    placed, cells = placed_at_hubs(hub)
    links = verified(docs, placed, words, num, den)
    links = links.unionByName(distant_links(docs, reps, shared, cells, links, words, num, den, test))
    return finish(table, reps.select("s1", "s2", "n", "rep", "rows"), links, own)


def finish(table: DataFrame, classes: DataFrame, links: DataFrame, several: DataFrame) -> DataFrame:
    """Labels every row. several: ids that have more than one set, whose classes belong together."""
    key = ["s1", "s2", "n"]
    rows = table.select("doc_id", "n", "s1", "s2")
    mixed = materialise(rows.join(several.select("doc_id"), "doc_id", "left_semi").distinct().join(classes.select(*key, "rep"), key).select("doc_id", "rep"), "mixed")
    joint = mixed.join(mixed.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    roots = materialise(connected_components(links.unionByName(joint), "links"), "roots")
    label = classes.join(roots, classes.rep == roots.node, "left").select(*key, "rep", "rows", F.coalesce("root", "rep").alias("root"))
    label = materialise(label, "labels")
    # a row without words has the component of its id's other rows
    of_id = mixed.join(label.select("rep", "root"), "rep").groupBy("doc_id").agg(F.min("root").alias("root"))
    bare = rows.where("n = 0").join(of_id, "doc_id", "left").select("doc_id", *key, "root")
    rows = rows.where("n > 0")
    # classes of very many rows are few, as no more of them fit into the table
    large = label.where(F.col("rows") > LARGE_CLASS).select(*key, "root")
    wide = rows.join(F.broadcast(large), key, "left")
    done, rest = wide.where("root is not null"), wide.where("root is null").drop("root")
    small = label.where(F.col("rows") <= LARGE_CLASS).select(*key, "root")
    found = done.unionByName(rest.join(small, key, "left")).unionByName(bare)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def distinct_groups(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, **columns: str) -> DataFrame:
    """The rows of docs, all columns, that stay if each component keeps its smallest id.
    Rows that share the kept id all stay; rows with a null id stay."""
    id_col = columns.get("id_col", "doc_id")
    found = join(docs, words=words, num=num, den=den, **columns)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
