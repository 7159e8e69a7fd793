"""A keyed log: batches of rows go in, the latest state of every key comes out.

Layout under the log's path:

- `log.json`: the number of buckets and the schema of the states;
- `data/<name>/_bucket=<b>`: states of keys whose hash falls into bucket b, a delta of one batch
  or a base that compaction made;
- `commits/<number>.json`: what a batch or a compaction added and removed; every SNAPSHOT-th
  one lists all that is live, so that a reader needs few of them.

A batch is merged by key, dealt by bucket and written beside what is there: its cost follows the
batch, not the log. Reading merges the live folders by key. A bucket with MOST deltas is
compacted: into a new base if the deltas are half of the base, else into one delta, so that a row
is rewritten a number of times that grows with the logarithm of the log.

Folders count only once a commit names them, and a commit appears whole or not at all. A writer
that was killed leaves folders that its next run overwrites; a batch that is committed is
skipped when it comes again. There is one writer at a time, as a streaming query is. Folders that
compaction replaced are deleted by the compaction after it, so that readers may finish.

`join` merges rows of equal keys, given their columns, and must not depend on their order or on
repeated rows. Before a write these columns begin with the bucket, so that the rows that were
dealt by it are merged where they are, without another shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Deltas of a bucket that are merged.
MOST = 8
#: Commits between two that list all that is live.
SNAPSHOT = 16


@dataclass
class Commits:
    """What the commits say: the next number, the last batch, live folders by bucket (the base,
    if any, first) as [folder, is a base, bytes], and folders that the last compaction replaced."""

    number: int = 0
    batch: int = -1
    live: dict[int, list[list]] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)
    counters: dict[str, dict] = field(default_factory=dict)


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, key: list[str], join: Callable[[DataFrame, list[str]], DataFrame], buckets: int = BUCKETS, most: int = MOST) -> None:
        self.spark, self.path, self.key, self.join, self.most = spark, path.rstrip("/"), key, join, most
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        meta = self._loaded("log.json")
        self.buckets = meta["buckets"] if meta else buckets
        self.schema = StructType.fromJson(meta["schema"]) if meta else None

    # ------------------------------------------------------------ files

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _loaded(self, name: str) -> dict | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _stored(self, name: str, what: dict) -> None:
        """Writes a file under another name and renames it, so that it is never seen in part."""
        new = self._at(f"{name}.tmp")
        out = self._fs.create(new, True)
        try:
            out.write(json.dumps(what).encode())
        finally:
            out.close()
        if not self._fs.rename(new, self._at(name)):
            raise OSError(f"{self.path}/{name} is there already: the log has another writer")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    # ------------------------------------------------------------ commits

    def commits(self) -> Commits:
        numbers = [int(n.split(".")[0]) for n in self._names("commits") if n.endswith(".json")]
        out, held = Commits(), []
        for n in reversed(numbers):
            held.append((n, self._loaded(f"commits/{n:012d}.json")))
            if "live" in held[-1][1]:
                break
        for n, c in reversed(held):
            out.number, out.batch = n + 1, c["batch"]
            if "live" in c:
                out.live = {int(b): x for b, x in c["live"].items()}
            else:
                for b, replaced, new in c["changes"]:
                    kept = [x for x in out.live.get(b, []) if x[0] not in replaced]
                    out.live[b] = ([new] if new[1] else []) + kept + ([] if new[1] else [new])
            if "gone" in c:
                out.gone = c["gone"]
            if c.get("counters"):
                out.counters[str(c["batch"])] = c["counters"]
        return out

    def _commit(self, was: Commits, batch: int, changes: list[list], gone: list[str] | None, counters: dict | None) -> None:
        what: dict = {"batch": batch, "changes": changes, "counters": counters}
        if gone is not None:
            what["gone"] = gone
        if was.number % SNAPSHOT == SNAPSHOT - 1:
            live = {b: list(x) for b, x in was.live.items()}
            for b, replaced, new in changes:
                kept = [x for x in live.get(b, []) if x[0] not in replaced]
                live[b] = ([new] if new[1] else []) + kept + ([] if new[1] else [new])
            what |= {"live": live, "gone": was.gone if gone is None else gone}
        self._stored(f"commits/{was.number:012d}.json", what)

    # ------------------------------------------------------------ rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, name: str) -> dict[int, list]:
        """Merges rows and writes them by bucket under data/name; folder and bytes of each bucket."""
        dealt = rows.withColumn("_bucket", self.bucket()).repartition("_bucket")
        states = self.join(dealt, ["_bucket", *self.key])
        if self.schema is None:
            schema = states.drop("_bucket").schema
            self._stored("log.json", {"buckets": self.buckets, "schema": json.loads(schema.json())})
            self.schema = schema
        states.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        out = {}
        for f in self._names(f"data/{name}"):
            if f.startswith("_bucket="):
                folder = f"data/{name}/{f}"
                out[int(f.removeprefix("_bucket="))] = [folder, False, self._fs.getContentSummary(self._at(folder)).getLength()]
        return out

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def append(self, rows: DataFrame, batch: int, counters: Callable[[], dict] | None = None) -> bool:
        """Adds the states of a batch; false if that batch is in the log already. counters: gives
        what the commit says of the batch, once its rows are written."""
        was = self.commits()
        if batch <= was.batch:
            return False
        new = self._written(rows, f"b{batch}")
        self._commit(was, batch, [[b, [], x] for b, x in new.items()], None, counters and counters())
        self.compact()
        return True

    def compact(self) -> int:
        """Merges what is due; the number of buckets that were."""
        was = self.commits()
        due: dict[int, tuple[list[str], bool]] = {}
        for b, folders in was.live.items():
            deltas = [x for x in folders if not x[1]]
            if len(deltas) >= self.most:
                base = sum(x[2] for x in folders if x[1])
                whole = 2 * sum(x[2] for x in deltas) >= base
                due[b] = ([x[0] for x in (folders if whole else deltas)], whole)
        if not due:
            return 0
        new = self._written(self._rows([f for folders, _ in due.values() for f in folders]), f"c{was.number}")
        changes = [[b, folders, [new[b][0], whole, new[b][2]]] for b, (folders, whole) in due.items()]
        self._commit(was, was.batch, changes, [f for folders, _ in due.values() for f in folders], None)
        for f in was.gone:
            self._fs.delete(self._at(f), True)
        return len(due)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The state of every key, or of those in keys, for which only their buckets are read."""
        live = self.commits().live
        if keys is not None:
            some = {r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most `buckets`
            live = {b: x for b, x in live.items() if b in some}
        folders = [x[0] for xs in live.values() for x in xs]
        rows = self._rows(folders) if folders else self.spark.createDataFrame([], self.schema or StructType())
        if keys is not None and folders:
            rows = rows.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        return self.join(rows, self.key) if folders else rows
