"""Merkle manifest of a table: one leaf for each row, a tree for each source, one over them.

1. Leaves. A row's fields are framed by their lengths and hashed where the row is read; only
   digests go on.
2. Places. The rows are dealt by ranges of (source, id) and counted, so that a source of any
   share of all rows is numbered without being in one task.
3. Blocks. Every 4,096 (FAN ** LEVELS) consecutive leaves of a source are reduced to one node
   in a task of their own. While there are more nodes than TOP, these are blocks' leaves again;
   where each source has come down to its subroot and these still are more, so are they.
4. Top. At most TOP nodes remain: the driver builds the tree above them and broadcasts it, and
   each block takes from it the siblings on its way to the root.
5. Proofs. Every block is read again with that way: each row hashes its siblings and folds its
   leaf - the tampered one where there is one - up to the root.

Defined results: null fields are framed as `-`, and so differ from empty ones. A null source is
a source of its own and comes first; null ids come first in theirs. Rows that share an id follow
each other by their digests; equal rows get proofs of their own places. An empty table has no
rows. Further columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raglens.llm.common import crc_mod, materialise, placed

#: Children of a node.
FAN = 16
#: Levels that a task reduces at once.
LEVELS = 3
#: Nodes whose tree the driver builds, some 100 bytes each.
TOP = 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """Hexadecimal sha256 of the fields, each framed by its length in bytes."""
    framed = (F.coalesce(F.concat(F.octet_length(s := f.cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for f in fields)
    return F.sha2(F.concat(*framed), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _h(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def grown(nodes: list[bytes], levels: int | None = None) -> list[list[bytes]]:
    """The levels above nodes: so many, or until one node remains."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([_h(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return out


def way(tree: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """The siblings left and right of a node's ancestors, level by level."""
    out = []
    for level in tree[:-1]:
        first = at - at % FAN
        out.append((b"".join(level[first:at]), b"".join(level[at + 1 : first + FAN])))
        at //= FAN
    return out


class Top:
    """The tree above the last nodes of all lists."""

    def __init__(self, lists: dict[str, list[bytes]]) -> None:
        names = sorted(lists, key=str.encode)
        self.trees = {name: grown(lists[name]) for name in names}
        self.place = {name: i for i, name in enumerate(names)}
        self.upper = grown([self.trees[name][-1][0] for name in names] or [_h([])])
        self.root = self.upper[-1][0]

    def above(self, name: str, at: int) -> tuple[list[tuple[bytes, bytes]], bytes, bool]:
        """A node's way to the root, its list's subroot, and whether the list has no other."""
        tree = self.trees[name]
        return way(tree, at) + way(self.upper, self.place[name]), tree[-1][0], len(tree[0]) == 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """The rows of each (src, block) of sorted batches."""
    key, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if key != (row["src"], row["block"]):
                if held:
                    yield *key, held
                key, held = (row["src"], row["block"]), []
            held.append(row)
    if held:
        yield *key, held


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _many(rows: Iterator[list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of some thousand rows."""
    held: list[tuple] = []
    for some in rows:
        held += some
        if len(held) >= 4096:
            yield _frame(held, schema)
            held = []
    if held:
        yield _frame(held, schema)


class _Trees:
    """Of every block of sorted rows: src, rows, tree, way to the root, subroot, and whether the
    list has no other block. top: the broadcast tree, if the rows don't bring their way."""

    def __init__(self, levels: int, top: Broadcast | None) -> None:
        self.levels, self.top = levels, top

    def __call__(self, batches: Iterator[pa.RecordBatch]):
        for src, block, held in _blocks(batches):
            if self.top is None:
                w = [x.encode() for x in held[0]["way"]]
                up, subroot, lone = list(zip(w[::2], w[1::2])), held[0]["subroot"].encode(), held[0]["lone"]
                held = held[1:]
            else:
                up, subroot, lone = self.top.value.above(src, block)
            yield src, held, grown([r["node"].encode() for r in held], None if lone else self.levels), up, subroot, lone


class Manifest:
    """The tree over leaves: src, pos, node and further columns. levels and top: as LEVELS and TOP."""

    def __init__(self, leaves: DataFrame, levels: int = LEVELS, top: int = TOP) -> None:
        self.levels, self.top = levels, top
        self.leaves = leaves
        self.root, self.ways = self._above(leaves.select("src", "pos", "node"))

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"pos div {FAN**self.levels}"))

    def _reduced(self, nodes: DataFrame) -> DataFrame:
        """src, pos, whole, lone: the node of every block, as one of several and as a list's only one."""
        schema = pa.schema([("src", pa.string()), ("pos", pa.int64()), ("whole", pa.string()), ("lone", pa.string())])
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for src, block, held in _blocks(batches):
                    nodes = [r["node"].encode() for r in held]
                    yield [(src, block, grown(nodes, levels)[-1][0].decode(), grown(nodes)[-1][0].decode())]

            return _many(rows(), schema)

        dealt = self._dealt(nodes).repartition("src", "block").sortWithinPartitions("src", "block", "pos")
        return materialise(dealt.mapInArrow(run, "src string, pos long, whole string, lone string"), "blocks")

    def _above(self, nodes: DataFrame) -> tuple[str, Broadcast | DataFrame]:
        """The root, and the ways of the blocks of nodes: the top, or a table src, pos, way, subroot, lone."""
        spark = nodes.sparkSession
        blocks = self._reduced(nodes)
        lists = blocks.groupBy("src").agg(F.count("*").alias("_c"))
        n, names = blocks.count(), lists.count()
        if n <= self.top:
            held: dict[str, list[bytes]] = {}
            found = sorted(blocks.collect(), key=lambda r: r["pos"])
            for r in found:
                held.setdefault(r["src"], []).append(r)
            top = Top({s: [r["lone" if len(x) == 1 else "whole"].encode() for r in x] for s, x in held.items()})
            return top.root.decode(), spark.sparkContext.broadcast(top)
        if n == names:  # every list is at its subroot: these are one list
            row = placed(blocks.select(F.lit("").alias("src"), F.col("src").alias("name"), F.col("lone").alias("node")), ["name"], "subroots")
            root, ways = self._above(row.select("src", "pos", "node"))
            up = self._expanded(row.select("src", "pos", "node"), ways)
            return root, row.join(up.select("pos", "way"), "pos").select(F.col("name").alias("src"), F.lit(0).cast("long").alias("pos"), "way", F.col("node").alias("subroot"), F.lit(True).alias("lone"))
        nodes = blocks.join(lists, "src").select("src", "pos", F.when(F.col("_c") == 1, F.col("lone")).otherwise(F.col("whole")).alias("node"))
        root, ways = self._above(nodes)
        return root, self._expanded(nodes, ways)

    def _met(self, nodes: DataFrame, ways: Broadcast | DataFrame) -> DataFrame:
        """The nodes by block; where ways is a table, a block's own is its first row (pos -1)."""
        nodes = self._dealt(nodes)
        if isinstance(ways, DataFrame):
            own = ways.select("src", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "way", "subroot", "lone")
            nodes = nodes.unionByName(own, allowMissingColumns=True)
        return nodes.repartition("src", "block").sortWithinPartitions("src", "block", "pos")

    def _expanded(self, nodes: DataFrame, ways: Broadcast | DataFrame) -> DataFrame:
        """src, pos, way, subroot, lone of the nodes themselves."""
        schema = pa.schema([("src", pa.string()), ("pos", pa.int64()), ("way", pa.list_(pa.string())), ("subroot", pa.string()), ("lone", pa.bool_())])
        top = None if isinstance(ways, DataFrame) else ways
        trees = _Trees(self.levels, top)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for src, held, tree, up, subroot, lone in trees(batches):
                    for i, r in enumerate(held):
                        yield [(src, r["pos"], [x.decode() for pair in way(tree, i) + up for x in pair], subroot.decode(), lone and len(held) == 1)]

            return _many(rows(), schema)

        return materialise(self._met(nodes, ways).mapInArrow(run, "src string, pos long, way array<string>, subroot string, lone boolean"), "ways")

    def proofs(self, id_col: str = "doc_id") -> DataFrame:
        """Of every leaf the id, leaf, subroot, root, proof_sha256, folded_root and verified;
        folded from the column `changed`, or from the leaf where that is null."""
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
        top = None if isinstance(self.ways, DataFrame) else self.ways
        trees, root = _Trees(self.levels, top), self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for _, held, tree, up, subroot, _ in trees(batches):
                    rest = b"".join(x for pair in up for x in pair)
                    out = []
                    for i, r in enumerate(held):
                        own = way(tree, i)
                        at = (r["changed"] or r["node"]).encode()
                        for left, right in own + up:
                            at = hashlib.sha256(left + at + right).hexdigest().encode()
                        proof = hashlib.sha256(b"".join(x for pair in own for x in pair) + rest).hexdigest()
                        out.append((r["doc_id"], r["node"], subroot.decode(), root, proof, at.decode(), at.decode() == root))
                    yield out

            return _many(rows(), schema)

        leaves = self.leaves.select("src", "pos", "node", "changed", F.col(id_col).cast("long").alias("doc_id"))
        return self._met(leaves, self.ways).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(rows: DataFrame, changed: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source: str = "source", text: str = "text", levels: int = LEVELS, top: int = TOP) -> Manifest:
    """The manifest of rows. changed: whether a row's text counts as tampered with (its A-Z
    lower-cased) when its leaf is folded."""
    as_read = {f: F.col(f) for f in fields}
    tampered = as_read | {text: lower_ascii(F.col(text))}
    leaves = rows.select(
        F.col(id_col).alias("doc_id"),
        # a null source sorts before all others, an empty one too
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("src"),
        digest(*as_read.values()).alias("node"),
        F.when(F.coalesce(changed, F.lit(False)), digest(*tampered.values())).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialise(leaves, "leaves")
    return Manifest(placed(leaves, ["src", "doc_id", "node", "row"], "places", group="src"), levels, top)


def chosen(id_col: str = "doc_id", n: int = 5) -> Column:
    return crc_mod(id_col, n) == 0
