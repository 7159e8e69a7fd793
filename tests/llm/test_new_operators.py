"""MinHash near-duplicates, importance resampling and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from raglens.llm import jaccard, merkle, minhash, resample
from raglens.llm.common import placed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "12 !?"), (6, "퟿ é 日本 \x00 x"), (7, "word " * 30_000), (8, "x" * 200_000), (9, "One"), (9, "two three")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos long, prefix array<long>, n int, row string, bucket int, _at long, block int, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """With further columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i else None, None if i in (2, None) else "é" if i == 3 else "a", i, "x", 1, [1], 3, "r", 5, 6, 7, "z") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


# ---------------------------------------------------------------- 11


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def families(n_families, copies, seed, length=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n_families):
        base = r.choices(vocab, k=length)
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(0, 7)):
                own[r.randrange(length)] = r.choice(vocab)
            docs.append(" ".join(own))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k, num, den", [(2, 80, 100), (5, 8, 10), (1, 9, 10)])
def test_minhash_brute_force(spark, k, num, den):
    docs = families(12, 8, k) + [(1000, ""), (1001, None), (1002, "a"), (1003, "A"), (1004, "a b")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), words=k, num=num, den=den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs, k, num, den)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_hot_family_in_small_tasks(spark, monkeypatch):
    for name, value in (("ELEMENTS", 800), ("ENTRIES", 16), ("SLOTS", 8), ("HOT", 20)):
        monkeypatch.setattr(jaccard, name, value)
    docs = families(2, 70, 5) + [(2000 + i, f"tail {i} " + "same words all over again and more of them " * 3) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs, 2, 8, 10)


def test_minhash_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    m = minhash.signatures([a, b], 400)
    assert abs((m[0] == m[1]).mean() - 1 / 3) < 0.1
    # a minimum over parts is that over the whole, however they are cut
    one = minhash.signatures([np.concatenate([a] * 40)], 400)
    assert (one[0] == m[0]).all()


def test_minhash_odd(odd):
    got = minhash.near_duplicates(odd, words=2).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 9)} == {4}
    assert all(r["component_id"] is None and r["kept"] is None for r in got if r["doc_id"] is None)
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 5, 6, 7, 8))
    assert minhash.near_duplicates(odd.where("false")).count() == 0


# ---------------------------------------------------------------- 12


def drawn(docs, targets, orders, buckets, percent, least, seed, scale=1000):
    def tokens(t):
        return TOKEN.findall((t or "").translate(UPPER))

    def features(t):
        w = tokens(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s = Counter(f for _, t in docs for f in features(t))
    g = Counter(f for t in targets for f in features(t))
    n, m = sum(s.values()), sum(g.values())
    gain = {b: math.floor(scale * math.log(((g[b] + 1) * (n + buckets)) / ((s[b] + 1) * (m + buckets)))) for b in s}
    out = []
    for i, t in docs:
        f = features(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296))), None, len(tokens(t)) >= least])
    part = sorted((x for x in out if x[5]), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    for rank, x in enumerate(part[: len(part) * percent // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("orders, buckets", [(1, 10_000), (2, 50), (3, 1000)])
def test_resampling_brute_force(spark, orders, buckets):
    r = random.Random(orders)
    vocab = ["Ab", "ab", "é", "x1", "-", "日本", "don't", "zz"]
    docs = [(i, " ".join(r.choices(vocab, k=r.randrange(0, 40)))) for i in range(120)]
    targets = [" ".join(r.choices(vocab[:3], k=30)) for _ in range(5)] + [None, ""]
    got = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in targets], "text string"), orders, buckets, percent=20, least=10, seed=7)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == drawn(docs, targets, orders, buckets, 20, 10, 7)


def test_resampling_odd(spark, odd):
    target = spark.createDataFrame([("one two",)], "text string")
    got = sorted((tuple(x) for x in resample.resampled(odd, target, orders=2, percent=50, least=1, seed=2024).collect()), key=repr)
    assert got == drawn(ODD, ["one two"], 2, 10_000, 50, 1, 2024)
    nothing = resample.resampled(odd, target.where("false"), orders=1, percent=100, least=0)
    assert sorted(r["rank"] for r in nothing.collect()) == list(range(1, len(ODD) + 1))
    assert resample.resampled(odd.where("false"), target, orders=1).count() == 0


def test_resampling_prefers_the_target(spark):
    docs = [(i, "sports ball goal team win " * 8 if i % 2 else "bond yield stock fund rate " * 8) for i in range(400)]
    target = spark.createDataFrame([("ball goal team win sports",)] * 20, "text string")
    got = [r["doc_id"] for r in resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), target, orders=2).where("rank is not null").collect()]
    assert len(got) == 40 and sum(i % 2 for i in got) >= 36


def test_words_are_not_shuffled(spark):
    """Runs of several words need one exchange, that of the texts."""
    df = spark.createDataFrame([(1, 1, "a b c")], "row long, doc_id long, text string")
    plan = resample.runs(df, 3, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate posexplode") < plan.index("Exchange")


# ---------------------------------------------------------------- 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows, n=5):
    """Rows (doc_id, text, lang, source, n_chars) as the contract says."""
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, src, c: sha(*map(frame, (i, src, lang, c, t)))
    by = defaultdict(list)
    for i, t, lang, src, c in rows:
        own = leaf(i, t, lang, src, c)
        off = i is not None and zlib.crc32(str(i).encode()) % n == 0
        by[src].append((-1 if i is None else i, own, leaf(i, t and t.translate(UPPER), lang, src, c) if off else own, i))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s])]) for s in names}
    upper = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (_, own, now, i) in enumerate(sorted(by[s])):
            proof = ""
            for levels, k in ((trees[s], at), (upper, place)):
                for level in levels[:-1]:
                    run, me = level[k - k % 16 : k - k % 16 + 16], k % 16
                    proof += "".join(run[:me] + run[me + 1 :])
                    now = sha(*run[:me], now, *run[me + 1 :])
                    k //= 16
            out.append((i, own, trees[s][-1][0], upper[-1][0], sha(proof), now, now == upper[-1][0]))
    return sorted(out, key=repr)


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels, top", [(3, 1 << 16), (1, 4), (1, 1), (2, 3)])
def test_merkle_brute_force(spark, levels, top):
    """A hot source, sources of one row, and trees of several distributed rounds."""
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 60}", i) for i in range(900)]
    rows += [(5, None, None, None, None), (6, "", None, None, 0), (7, "Z", "en", "", 1), (8, "é Ü", "de", "é", 3), (8, "é Ü", "de", "é", 3), (None, "N", "en", "é", 1)]
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    got = merkle.manifest(df, merkle.chosen(), levels=levels, top=top).proofs().collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest(rows)


def test_merkle_many_sources(spark):
    """More subroots than the driver takes."""
    rows = [(i, "x", "en", f"s{i % 97}", i) for i in range(200)]
    got = merkle.manifest(spark.createDataFrame(rows, FIELDS), merkle.chosen(), levels=1, top=2).proofs().collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest(rows)


def test_merkle_odd(odd):
    got = merkle.manifest(odd, merkle.chosen()).proofs().collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest([tuple(r)[:5] for r in odd.collect()])
    assert merkle.manifest(odd.where("false"), merkle.chosen()).proofs().count() == 0


def test_placed_by_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("g")).repartition(6)
    got = placed(df, ["g", F.desc("id")], "t", group="g").collect()
    for g in (0, 1):
        ids = [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])]
        assert ids == sorted(ids, reverse=True) and sorted(r["pos"] for r in got if r["g"] == g) == list(range(len(ids)))


# ---------------------------------------------------------------- 9, damaged archives


def _archive():
    from raglens.llm import warc

    bodies = [f"page {i} " * (40 if i % 3 else 4000) + "".join(chr(33 + (i * 7 + j * j) % 90) for j in range(300)) for i in range(9)]
    parts = [warc.member(warc.record(i, f"http://x/{i}", b.encode(), "response", None)) for i, b in enumerate(bodies)]
    return parts, [sum(map(len, parts[:i])) for i in range(len(parts))]


def _scan(data, split, damaged):
    import io

    from raglens.llm import warc

    return [r for at in range(0, len(data), split) for r in warc.records_of(io.BytesIO(data), at, at + split, damaged)]


@pytest.mark.parametrize("split", [61, 700, 1 << 20])
def test_warc_damage_is_never_silent(split):
    from raglens.llm import warc

    parts, starts = _archive()
    whole = b"".join(parts)
    assert [r["page_id"] for r in _scan(whole, split, False)] == list(range(9))
    for place in ("magic", "head", "middle", "end"):
        for i in (0, 4, 8):
            at = {"magic": starts[i], "head": starts[i] + 11, "middle": starts[i] + len(parts[i]) // 2, "end": starts[i] + len(parts[i]) - 3}[place]
            bad = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
            with pytest.raises(warc.Damaged):
                _scan(bad, split, False)
            got = _scan(bad, split, True)
            assert {r["page_id"] for r in got if r["record_type"] != "damaged"} == set(range(9)) - {i}
            assert starts[i] in {r["offset"] for r in got if r["record_type"] == "damaged"}
    cut = whole[: starts[8] + 40]
    with pytest.raises(warc.Damaged):
        _scan(cut, split, False)
    assert [r["page_id"] for r in _scan(cut, split, True) if r["record_type"] != "damaged"] == list(range(8))


def test_warc_damage_in_files(spark, tmp_path):
    from raglens.llm import warc

    rows = [(i, f"http://x/{i}", f"page {i} " * 300) for i in range(40)] + [(3, "http://x/3", "page 3 " * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages, f"file://{tmp_path}/w")
    path = manifest.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    import gzip
    import re

    ids = re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(bytes(data)))
    assert len(set(ids)) == len(rows)  # repeated rows are records of their own
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="Damaged"):
        warc.read(manifest, 500).collect()
    got = warc.read(manifest, 500, damaged=True).collect()
    good = [r for r in got if r["record_type"] != "damaged"]
    assert len(good) == len(rows) - 1 and len(got) > len(good) and all(r["path"].endswith(".warc.gz") for r in got)
    open(path, "wb").write(data[:-400])
    with pytest.raises(Exception, match="bytes of"):
        warc.read(manifest, 500).collect()
