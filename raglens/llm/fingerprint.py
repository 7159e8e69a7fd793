"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text's k-mers of characters hold k - s + 1 inner s-mers; a k-mer is taken where the least
hash of these lies at one of its edges. Whether it is taken depends on its own characters
alone, so a stretch of text has the same anchors wherever it stands: a fingerprint is the
sequence of the anchors' hashes, and the fingerprint of an edited text is put together from
the anchors of its parts and those across the seam.

Defined results: a null text is the empty text. The empty text has the empty fingerprint; a
text without a syncmer (all of less than k characters, and some of up to a few times k) has
one anchor, the hash of the whole text. Likeness is the Dice measure of the distinct anchors,
of 64 bits each, of which a fingerprint shows 24; it is 1 for two empty fingerprints. Rows of
equal id follow each other by their text; rows with a null id come last, in one range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.llm.common import materialise

#: Characters of an anchor, and of its inner substrings.
K, S = 20, 5
#: Documents of a range of ids that are sorted together, on average, and most such ranges.
RANGE_DOCS, RANGES = 512, 4096
#: Hexadecimal digits of an anchor in the fingerprint.
DIGITS = 6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def anchors(text: Column) -> Column:
    """struct(pos array<int>, hash array<bigint>) of the closed syncmers of a text that isn't
    null: places, from 0, and hashes. Empty below K characters."""
    grams = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{S}}}))."), F.lit(1))
    hashes = F.transform(grams, lambda g: F.xxhash64(g))
    last = K - S  # place of the last inner substring

    def chosen(h: Column) -> Column:
        def place(low: Column, i: Column) -> Column:
            test = low <= F.get(h, i + last - 1)
            for j in range(last - 2, 0, -1):  # the first comparison that fails ends the test
                test = (low <= F.get(h, i + j)) & test
            return F.when(test, i)

        edges = F.zip_with(F.slice(h, F.lit(1), F.size(h) - last), F.slice(h, F.lit(1 + last), F.size(h) - last), lambda x, y: F.least(x, y))
        mixed = lambda p: F.transform(p, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + S), F.get(h, i + 2 * S), F.get(h, i + last)))
        return _let(F.array_compact(F.transform(edges, place)), lambda p: F.struct(p.alias("pos"), mixed(p).alias("hash")))

    none = F.struct(F.array().cast("array<int>").alias("pos"), F.array().cast("array<bigint>").alias("hash"))
    return F.when(F.length(text) < K, none).otherwise(_let(hashes, chosen))


def sketch(text: Column, found: Column) -> Column:
    """The anchors array<bigint> of a text in their order, from anchors()["hash"]: where a
    text that isn't empty has none, the hash of the whole text."""
    none = F.array().cast("array<bigint>")
    return F.when(F.length(text) == 0, none).otherwise(_let(found, lambda f: F.when(F.size(f) == 0, F.array(F.xxhash64(text))).otherwise(f)))


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(16**DIGITS - 1))), DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice measure of two arrays of distinct anchors."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with struct(text, pos, hash) of itself and of the next document by
    descending id as `own` and `next`; the first one follows the last. The texts are shuffled
    once, by ranges of ids; only the first document of each range is sent to two."""
    facts = docs.agg(F.count("doc_id").alias("n"), F.count("*").alias("all")).first()
    ranges = min(RANGES, facts["n"] // RANGE_DOCS)
    bounds = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * ranges)).alias("b")).first()["b"]))
    place = F.size(F.filter(F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>"), lambda x: x <= F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(place)
    # the first document of each range, as (range, id), one row per range
    tops = docs.select(part.alias("r"), "doc_id").groupBy("r").agg(F.max("doc_id").alias("top"))
    down = Window.orderBy(F.desc("r"))
    tops = tops.withColumn("to", F.coalesce(F.lag("r").over(down), F.min("r").over(Window.partitionBy())))
    tops = F.broadcast(materialise(tops, "ranges").withColumnRenamed("r", "top_r"))
    rows = docs.withColumn("r", part)
    rows = rows.join(tops, F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("r") == F.col("top_r")), "left")
    copies = F.when(F.col("to").isNull(), F.array(F.struct(F.col("r"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("r"), F.lit(False).alias("ghost")), F.struct(F.col("to").alias("r"), F.lit(True).alias("ghost"))))
    rows = rows.select("doc_id", "text", F.explode(copies).alias("x")).select("doc_id", "text", F.col("x.r").alias("r"), F.col("x.ghost").alias("ghost"))
    rows = rows.repartition("r").withColumn("a", anchors(F.col("text"))).select("doc_id", "r", "ghost", "text", "a")
    own = F.struct("text", F.col("a.pos").alias("pos"), F.col("a.hash").alias("hash"))
    follow = Window.partitionBy("r").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    return rows.select("doc_id", "r", "ghost", "text", own.alias("own")).withColumn("next", F.lead("own").over(follow)).where("not ghost").select("doc_id", "own", "next")


def _until(side: Column, end: Column) -> Column:
    """The hashes of a side's anchors that end at `end` or before it."""
    return F.slice(side["hash"], F.lit(1), F.size(F.filter(side["pos"], lambda p: p + K <= end)))


def compare(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    of every document; the edited text's second half is the next document's start."""
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    own, nxt = F.col("own"), F.col("next")
    n = F.length(own["text"])
    cut = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n": n, "kept": n - cut, "put": F.least(cut, F.length(nxt["text"]))})
    head, tail = F.substring(own["text"], F.lit(1), F.col("kept")), F.substring(nxt["text"], F.lit(1), F.col("put"))
    rows = rows.withColumns({"edited": F.concat(head, tail), "seam": F.concat(F.right(head, F.lit(K - 1)), F.left(tail, F.lit(K - 1)))})
    rows = rows.withColumn("across", anchors(F.col("seam"))["hash"])
    parts = F.concat(_until(own, F.col("kept")), F.col("across"), _until(nxt, F.col("put")))
    rows = rows.withColumns({"o": sketch(own["text"], own["hash"]), "x": sketch(nxt["text"], nxt["hash"]), "e": sketch(F.col("edited"), parts)})
    rows = rows.withColumns({"od": F.array_distinct("o"), "ed": F.array_distinct("e"), "xd": F.array_distinct("x")})
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("o")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("od"), F.col("ed")).alias("near_edited"),
        likeness(F.col("od"), F.col("xd")).alias("near_next"),
    )
