"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source's target in words is its weighted share of the mixture, stopped at a multiple of
its size; what exceeds is reshared by weight. A document of a source of size S and target T is
taken T / S times: the whole part for certain, the fraction as a probability in [0, 1). Pairs
of fractional documents of a source move word mass from one to the other, in a random
direction that keeps every expectation, until one of the two is integral. A reduction tree
does so: a group of some hundred documents leaves one residual, the groups' residuals pair in
the next level, and the source's last residual is drawn. So the words taken of a source differ
from its target by less than the last residual's size.

Random numbers are hashes of ids and texts, so reruns agree. Groups are dealt by hash; none
grows with its source, for rows that are equal in id, source, size and text enter as one unit:
of m such rows floor(m * p) are rounded up for certain, and one has the fraction left.

Defined results: a null text has size 0; the null source is a source like others, the last in
order; documents of size 0 are taken 0 words. Repeated rows, and rows with a null id, have
copies of their own. Empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.llm.common import materialise, prefix_apart

#: Documents of a group of the reduction tree, on average.
GROUP = 192
#: With more sources than this, they aren't broadcast.
FEW_SOURCES = 50_000


def word_count(text: str | Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, n, source_size, target of each source of (source, size, rows)."""
    s = sized.groupBy("source").agg(F.sum("rows").alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))  # one row per source, as in the next windows
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max((F.col("total") - F.col("full")) / F.col("open")).over(Window.partitionBy())
    return s.select("source", "n", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _random(a: Column, b: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(a, b, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _paired(group: Column, seed: int) -> Column:
    """Folds an array of struct(key, size, p) into struct(cur, done): every pair leaves one
    fractional member in cur and one integral member in done."""
    unit = "struct<key:bigint,size:bigint,p:double>"
    start = F.struct(F.element_at(group, 1).alias("cur"), F.array().cast(f"array<{unit}>").alias("done"))

    def member(x: Column, p: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["size"].alias("size"), p.alias("p"))

    def step(acc: Column, e: Column) -> Column:
        i = acc["cur"]
        up = F.least((1 - i["p"]) * i["size"], e["p"] * e["size"])  # mass that i can take from e
        down = F.least(i["p"] * i["size"], (1 - e["p"]) * e["size"])
        takes = (up + down <= 0) | (_random(i["key"], e["key"], seed) * (up + down) < down)
        made = F.struct(up.alias("up"), down.alias("down"), takes.alias("takes"))

        def settled(m: Column) -> Column:
            moved = F.when(m["takes"], m["up"]).otherwise(-m["down"])
            pi = i["p"] + moved / i["size"]
            pe = e["p"] - moved / e["size"]
            # which of the two has become integral
            i_done = F.when(m["takes"], m["up"] >= (1 - i["p"]) * i["size"]).otherwise(m["down"] >= i["p"] * i["size"])
            one = member(i, F.when(i_done, F.when(m["takes"], 1.0).otherwise(0.0)).otherwise(pi))
            two = member(e, F.when(i_done, pe).otherwise(F.when(m["takes"], 0.0).otherwise(1.0)))
            return F.struct(F.when(i_done, two).otherwise(one).alias("cur"), F.array_append(acc["done"], F.when(i_done, one).otherwise(two)).cast(f"array<{unit}>").alias("done"))

        return F.element_at(F.transform(F.array(made), settled), 1)

    return F.aggregate(F.slice(group, F.lit(2), F.greatest(F.size(group) - 1, F.lit(0))), start, step)


def rounded(units: DataFrame, largest: int, seed: int) -> DataFrame:
    """source, key, up (0 or 1) of fractional units (source, n, key, size, p), whose keys are
    distinct in their source: the reduction tree. n: rows of the source, largest: most of them."""
    level = units.select("source", F.ceil(F.col("n") / GROUP).cast("long").alias("groups"), F.struct("key", "size", "p").alias("u"))
    settled, left, k = None, largest, 0
    while left > 1:
        left = -(-left // GROUP)
        dealt = level.withColumn("g", F.pmod(F.xxhash64("u.key", F.lit(seed + 2 * k)), F.col("groups")))
        us = F.sort_array(F.collect_list(F.struct(F.col("u.size").alias("s"), "u")), asc=False).alias("us")
        folded = dealt.groupBy("source", "groups", "g").agg(us).select("source", "groups", _paired(F.col("us.u"), seed + 2 * k + 1).alias("f"))
        folded = materialise(folded, f"mix{k}")
        done = folded.select("source", F.explode("f.done").alias("u")).select("source", "u.key", F.col("u.p").cast("long").alias("up"))
        settled = done if settled is None else settled.unionByName(done)
        level = folded.select("source", F.ceil(F.col("groups") / GROUP).cast("long").alias("groups"), F.col("f.cur").alias("u"))
        k += 1
    last = level.select("source", "u.key", (_random(F.col("u.key"), F.col("u.size"), seed - 1) < F.col("u.p")).cast("long").alias("up"))
    return last if settled is None else settled.unionByName(last)


def mixed(rows: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size", text: str | None = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """rows, all columns, with source_size, target and copies: how often the mixture holds a
    row. Columns of these three names are replaced."""
    mark = F.xxhash64(text) if text is not None else F.lit(0).cast("long")
    plain = rows.select(F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.col(id_col).alias("id"), mark.alias("mark"))
    keys = materialise(plain.groupBy("source", "size", "id", "mark").agg(F.count("*").alias("rows")), "keys")
    goals = keys.select("source", (F.col("size") * F.col("rows")).alias("size"), "rows")
    goals = materialise(targets(goals, weights, share, most), "targets")
    facts = goals.agg(F.count("*").alias("sources"), F.max("n").alias("largest")).first()
    side = F.broadcast(goals) if facts["sources"] <= FEW_SOURCES else goals
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = keys.join(side.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    units = units.withColumn("whole", F.floor(rate).cast("long")).withColumn("p", (rate - F.floor(rate)) * F.col("rows"))
    units = units.withColumns({"certain": F.floor("p").cast("long"), "p": F.when(F.col("size") > 0, F.col("p") - F.floor("p")).otherwise(0.0), "key": F.xxhash64("id", "size", "mark")})
    # two units of one key, which is a matter of chance, enter as one
    open_ = units.where("p > 0").groupBy("source", "n", "key", "size").agg(F.first("p").alias("p"), F.count("*").alias("units"))
    up = rounded(open_.select("source", "n", "key", "size", "p"), int(facts["largest"] or 0), seed)
    up = up.select(F.col("source").alias("_s"), F.col("key").alias("_k"), "up")
    units = units.join(up, (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    m = prefix_apart(rows.columns)
    plan = units.select(F.struct("source", "size", "id", "mark").alias(f"{m}key"), F.col("rows").alias(f"{m}rows"), F.col("whole").alias(f"{m}whole"), F.col("certain").alias(f"{m}certain"), F.coalesce("up", F.lit(0)).alias(f"{m}up"), F.col("source_size").alias(f"{m}size"), F.col("target").alias(f"{m}target"))
    key = F.struct(F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.col(id_col).alias("id"), mark.alias("mark"))
    # the join and the numbering are one shuffle of the rows
    out = rows.withColumn(f"{m}key", key).join(plan, f"{m}key")
    place = F.when(F.col(f"{m}rows") == 1, 1).otherwise(F.row_number().over(Window.partitionBy(f"{m}key").orderBy(f"{m}rows")))
    copies = F.col(f"{m}whole") + F.when(place <= F.col(f"{m}certain"), 1).when(place == F.col(f"{m}certain") + 1, F.col(f"{m}up")).otherwise(0)
    out = out.withColumns({"source_size": F.col(f"{m}size"), "target": F.col(f"{m}target"), "copies": copies.cast("long")})
    return out.drop(f"{m}key", f"{m}rows", f"{m}whole", f"{m}certain", f"{m}up", f"{m}size", f"{m}target")


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of documents, whose size is their
    number of words."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"))
    return mixed(materialise(sized, "sizes"), text="mark", **how).drop("mark")
