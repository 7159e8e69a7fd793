"""URL filters: path rules, and an exact blocklist in a Bloom filter cascade, in DataFrame
functions only.

A Bloom filter of the listed keys says yes to all of them and to a few others. The key
universe - every host of the corpus with all domains above it - is complete and known, so the
others can be found; a second filter encodes them, a third the listed keys that the second
takes for them, and so on until a level errs no more. A key of the universe is then judged
exactly by reading a few bits: no join by key, however long the corpus is. The bit arrays are
one broadcast row, whose size is checked; it follows the listed keys (some 12 bits each), not
the corpus.

Defined results: a null url and one without `://` have empty host and path, fit no rule and
are allowed. Repeated rows are judged alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm.common import materialise, prefix_apart

#: Rules (verdict, host, path) of the production filter; fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Listed domains of the production filter, each with all its subdomains: these names below
#: each of these zones; fixed values.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ZONES = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{zone}" for name in NAMES for zone in ZONES)
#: Most bytes of all bit arrays, which are broadcast.
MOST_BYTES = 64 << 20
#: Bits for each key of a level, and bits read for each key.
BITS_PER_KEY, HASHES = 12, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def domains(host: Column) -> Column:
    """The host and every domain above it, as an array; empty for the empty host."""
    labels = F.split(host, r"\.", -1)
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def _bits(key: Column, size: int, seed: int) -> list[Column]:
    a, b = (F.pmod(F.xxhash64(key, F.lit(s)), F.lit(1 << 40)) for s in (seed, seed + 1))
    return [F.pmod(a + F.lit(i) * b, F.lit(size)) for i in range(HASHES)]


@dataclass
class Level:
    words: list[int]  # the bit array, 32 bits to a word
    size: int
    seed: int
    column: str

    def has(self, key: Column) -> Column:
        test = None
        for bit in _bits(key, self.size, self.seed):
            one = F.call_function("shiftright", F.get(F.col(self.column), F.shiftright(bit, 5).cast("int")), (bit % 32).cast("int")).bitwiseAND(F.lit(1)) == 1
            test = one if test is None else test & one
        return test


def _level(keys: DataFrame, n: int, k: int, mark: str) -> Level:
    size, seed = max(64, (n * BITS_PER_KEY + 31) // 32 * 32), 100 * k + 7
    if size // 4 > MOST_BYTES:
        raise ValueError(f"{n} listed keys take more than {MOST_BYTES} bytes")
    bit = F.explode(F.array(*_bits(F.col("key"), size, seed)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int"))
    words = [0] * (size // 32)
    for w, bits in keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(mask).alias("bits")).collect():
        words[w] = bits
    return Level(words, size, seed, f"{mark}bits{k}")


@dataclass
class Cascade:
    levels: list[Level]

    def on(self, rows: DataFrame) -> DataFrame:
        """The rows with the bit arrays, as columns that has() reads; off() drops them."""
        if not self.levels:
            return rows
        one = rows.sparkSession.createDataFrame([tuple(x.words for x in self.levels)], ", ".join(f"{x.column} array<long>" for x in self.levels))
        return rows.join(F.broadcast(one))

    def off(self, rows: DataFrame) -> DataFrame:
        return rows.drop(*(x.column for x in self.levels))

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        held = F.lit(False)
        for level in reversed(self.levels):
            held = level.has(key) & ~held
        return held


def cascade(universe: DataFrame, listed: DataFrame, most: int = 24, mark: str = "_") -> Cascade:
    """Encodes `listed` (key string) exactly over `universe` (key string, distinct). mark: what
    no column of the rows that are asked about starts with."""
    listed = materialise(listed.where("key is not null").distinct(), "listed")
    others = universe.join(listed, "key", "left_anti")
    sides = [listed, others]
    levels: list[Level] = []
    for k in range(most):
        keys = sides[k % 2]
        n = keys.count()
        if not n:
            return Cascade(levels)
        levels.append(_level(keys, n, k, mark))
        # of the other side only what this level takes for its own goes on
        last = Cascade(levels[-1:])
        sides[(k + 1) % 2] = materialise(last.off(last.on(sides[(k + 1) % 2]).where(levels[-1].has(F.col("key")))), f"errs{k}")
    raise RuntimeError("the cascade didn't end")


def judge(pages: DataFrame, url: str = "url", rules=RULES, listed=LISTED) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced."""
    spark: SparkSession = pages.sparkSession
    host, path = host_of(F.col(url)), path_of(F.col(url))
    universe = materialise(pages.select(F.explode(domains(host)).alias("key")).distinct(), "hosts")
    names = spark.createDataFrame([(x,) for x in listed], "key string")
    held = cascade(universe, names, mark=prefix_apart(pages.columns))
    blocked = F.exists(domains(F.col("host")), lambda d: held.has(d))
    out = held.on(pages.withColumns({"host": host, "path": path}))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(blocked, "block").otherwise("allow"))
    return held.off(out.withColumns({"rule": rule["rule"], "verdict": verdict}))
