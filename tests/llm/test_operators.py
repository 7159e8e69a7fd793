"""The ten operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from raglens.llm import decontaminate, fingerprint, html, jaccard, langid, lm, mixing, queries, toxicity, urlfilter, warc
from raglens.llm.common import connected_components, crc_mod

AT = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rows that every operator on texts must stand: null, empty, blank, odd and repeated ones.
ODD = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "12 !?"), (6, "\ud7ff é 日本 \x00 x"), (7, "word " * 30_000), (8, "x" * 200_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """With further columns whose names the operators use themselves."""
    rows = [(i, t, "en", "a", 1, "x", 0.5, "y", [1], 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, size double, _hits string, prefix array<long>, n int")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---------------------------------------------------------------- 1


def test_language_id_held_out(spark):
    got = queries.op1_language_id(spark, MORE).toPandas()
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    assert len(got) == len(docs)
    m = got.merge(docs, on="doc_id")
    assert all(m["held_out"] == [crc(i, 5) == 0 for i in m["doc_id"]])
    far = m[m["held_out"] & m["lang"].notna() & (m["lang_pred"] != "und")]
    assert (far["lang"] == far["lang_pred"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_language_id_odd(spark, odd, nothing):
    train = spark.createDataFrame([(1, "the house is old", "en"), (2, "das haus ist alt", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = odd.select("text", langid.predict(spark, model).alias("p")).collect()
    assert len(got) == len(ODD)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] in ("en", "de")) if letters else (r["p"]["lang_pred"], r["p"]["score"]) == ("und", 0.0)
    assert langid.fit(nothing).labels == ["und"]
    assert nothing.select(langid.predict(spark, model)).count() == 0


def test_language_id_brute_force(spark, monkeypatch):
    """The model's predictions and scores are those of naive Bayes counted out n-gram by
    n-gram, with windows of a few characters as with whole texts."""
    train = [(i, " ".join(["the old house", "das alte haus", "la maison vieille"][i % 3].split()[: 1 + i % 3]) + f" {i}", "en de fr".split()[i % 3]) for i in range(30)]
    ask = ["the haus", "Maison DAS", "old " * 50, "é", "x"]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), bits=20)

    def grams(t):
        t = f" {t.lower()} "
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    count, docs = defaultdict(Counter), Counter()
    for _, t, lang in train:
        count[lang].update(grams(t))
        docs[lang] += 1
    want = []
    for t in ask:
        z = {c: np.log(docs[c] / 30) + sum(np.log((count[c][g] + 0.5) / (sum(count[c].values()) + 0.5 * 2**20)) for g in grams(t)) for c in count}
        top = max(z.values())
        want.append((max(sorted(z), key=z.get), 1 / sum(np.exp(v - top) for v in z.values())))
    for size in (1 << 20, 1 << 12):
        monkeypatch.setattr(langid, "PART", size)
        names, scores = model.score(ask)
        assert names == [n for n, _ in want] and scores == pytest.approx([p for _, p in want], rel=1e-6)
    long = "the old house in the rain " * 2000
    monkeypatch.setattr(langid, "GATHER", 3 << 12)
    assert model.score([long])[0] == ["en"]
    assert sum((b != 1 << 20).sum() for b in langid.gram_buckets(langid._windows(long, 3, 1000), (1, 2, 3), 20)[0]) == len(grams(long))


# ---------------------------------------------------------------- 2


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, num, den):
    """Brute force over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and den * len(s & t) >= num * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_docs(n=160, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "the", "Of"]
    out, texts = [], []
    for i in range(n):
        kind = rng.integers(4)
        if texts and kind:
            w = texts[rng.integers(len(texts))].split()
            for _ in range(int(rng.integers(0, 4))):
                w[rng.integers(len(w))] = vocab[rng.integers(len(vocab))]
            w = w[: len(w) - int(rng.integers(0, 3))] or ["a"]
        else:
            w = [vocab[x] for x in rng.integers(len(vocab), size=int(rng.integers(1, 80)))]
        texts.append(" ".join(w))
        out.append((int(1000 - 3 * i), texts[-1]))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_brute_force(spark, k, num, den):
    docs = near_docs() + [(5000, None), (5001, ""), (5002, " "), (5003, "Same Two"), (5004, "same two")]
    got = {r["doc_id"]: r for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), words=k, num=num, den=den).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == components(docs, k, num, den)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingles(t, k)) for i, t in docs}


def test_jaccard_hot_group_in_blocks(spark, monkeypatch):
    """A group of many near copies, dealt in many blocks, gives the same components."""
    monkeypatch.setattr(jaccard, "ELEMENTS", 1000)
    base = [f"v{i}" for i in range(120)]
    docs = [(i, " ".join(base[:60] + [f"u{i}"] + base[60:])) for i in range(50)] + near_docs(60, 9)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components(docs, 3, 9, 10)


def test_jaccard_crowded_lists_and_interleaved_families(spark, monkeypatch):
    """Lists dealt over parts, long classes, and three families of equal sizes between whose
    sets others lie at the threshold: the same components as by all pairs."""
    for name, value in (("HOT", 10), ("ENTRIES", 8), ("ELEMENTS", 3000), ("LARGE_CLASS", 2), ("REFS", 2), ("SKIP", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(5)
    docs = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(90)]
        for i in range(40):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"n{rng.integers(50)}"
            docs.append((3 * i + f, " ".join(w)))
    docs += [(1000 + i, docs[0][1]) for i in range(5)] + [(2000, docs[1][1]), (2000, docs[2][1]), (2000, None)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = components(docs[:-3], 3, 9, 10)
    joint = {want[docs[1][0]], want[docs[2][0]]}  # the id 2000 has a set of each
    assert got == {i: min(joint) if c in joint else c for i, c in want.items()} | {2000: min(joint)}


def test_jaccard_odd(odd, nothing):
    got = jaccard.join(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[4] == {(1, 4)} and by[7] == {(1, 7)} and by[None] == {(0, None)}
    kept = jaccard.distinct_groups(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert jaccard.join(nothing).count() == 0 and jaccard.distinct_groups(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# ---------------------------------------------------------------- 3


def targets(sizes, share=1.5, most=2.0):
    """Sources' targets by resharing until none is above its limit. sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def test_mixing_meets_targets(spark):
    got = queries.op3_source_mixing(spark, MORE).toPandas()
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text", "source").toPandas().set_index("doc_id")
    assert sorted(got["doc_id"]) == sorted(docs.index)
    want = {i: len(words(t)) for i, t in docs["text"].items()}
    assert dict(zip(got["doc_id"], got["size"])) == want
    source = {i: s if isinstance(s, str) else None for i, s in docs["source"].items()}
    sizes = Counter()
    for i, n in want.items():
        sizes[source[i]] += n
    goal = targets(sizes)
    for s, part in got.assign(s=[source[i] for i in got["doc_id"]]).groupby("s", dropna=False):
        s = s if isinstance(s, str) else None
        assert set(part["source_size"]) == {sizes[s]}
        assert part["target"].to_numpy() == pytest.approx(goal[s])
        assert abs(part["taken"].sum() - goal[s]) <= part["size"].max()
    assert (got["taken"] <= 2 * got["size"]).all()
    again = queries.op3_source_mixing(spark, MORE).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_mixing_is_unbiased(spark):
    """Over many seeds a document is taken as often as its probability says."""
    sized = spark.createDataFrame([(i, "a", 10 + i % 7) for i in range(40)], "doc_id long, source string, size long")
    runs = [mixing.mixed(sized, text=None, share=0.5, seed=s).select("doc_id", "copies").toPandas().set_index("doc_id")["copies"] for s in range(40, 56)]
    assert np.mean(runs, axis=0).mean() == pytest.approx(0.5, abs=0.05)
    assert 0 < np.mean(runs, axis=0).min() and np.mean(runs, axis=0).max() < 1


def test_mixing_of_repeated_rows(spark):
    """A third of all rows are one row, or share a null id and a size: none is lost, and the
    words taken still come near the target."""
    rows = [(1, "a", "w " * 10)] * 60 + [(None, "a", "w " * 9 + str(i)) for i in range(60)] + [(i, "b", "x y z") for i in range(100, 160)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.7).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 2).all()
    for _, part in got.groupby("source"):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= part["size"].max()


def test_mixing_odd(odd, nothing):
    got = mixing.mixed(odd.withColumns({"size": F.lit(3), "copies": F.lit("x")})).collect()
    assert len(got) == len(ODD) and {r["h"] for r in got} == {"x"} and all(0 <= r["copies"] <= 2 for r in got)
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix(nothing).count() == 0
    assert all(r["copies"] == 0 or r["size"] == 0 for r in mixing.mix(odd.where("size is null or doc_id < 4")).collect())


# ---------------------------------------------------------------- 4


ARTICLE = "<p>First&nbsp;paragraph of the article, long enough to count as text &amp; more of it.</p><p>Second\n  paragraph with <b>bold</b> and <a href='#'>a link</a> in it, again long enough.</p>"


def test_html_main_text():
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a> <a href=/x>Menu</a></nav><header>Site</header><article><h1>Title &eacute;</h1>{ARTICLE}<script>var x = '<p>no</p>';</script></article><div class='sidebar'>side</div><div id='comments'><p>Reader says a lot of things here, which nobody wants to have in the text.</p></div><footer>foot</footer></body></html>"
    assert html.main_text(page).split("\n") == ["Title é", "First paragraph of the article, long enough to count as text & more of it.", "Second paragraph with bold and a link in it, again long enough."]


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain &lt;b&gt;", "plain <b>"), ("<p></p>", ""), ("<div>" * 3000 + "deep", "deep"), ("<p>a<p>b", "a\nb"), ("<p>one < two</p>", "one < two"), ("<script>x", "")])
def test_html_odd(page, text):
    assert html.main_text(page) == text


def prose(name, n):
    return [f"Paragraph {i} of the {name} says in plain words what it has to say, and that isn't short." for i in range(n)]


@pytest.mark.parametrize("open_,close", [("<div>", "</div>"), ("", ""), ("<div><div>", "</div></div>")])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_html_keeps_siblings_on_the_way_up(open_, close, tag):
    """Pages without article or main: no section, lead or heading beside the chosen node is lost."""
    first, second = prose("first", 10), prose("second", 8)
    lead = "A lead of one paragraph, which stands beside the sections and is long enough to be one of them, as it says much."
    p = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    page = f"<html><body><nav><a href=/>Home</a></nav>{open_}<h1>Title</h1><p>{lead}</p><div>{p(first)}</div><h2>More</h2><{tag}>{p(second)}</{tag}><ul><li><a href=/x>Elsewhere</a></li><li><a href=/y>Another page</a></li></ul>{close}<footer>foot</footer></body></html>"
    assert html.main_text(page).split("\n") == ["Title", lead, *first, "More", *second]


@pytest.mark.parametrize("open_,close", [(f'<div class="{c}">', "</div>") for c in ("page has-sidebar", "content with-sidebar", "no-comments post", "layout--no-nav", "legal-news", "share-price-report", "sidebar", "widget")] + [("<form>", "</form>"), ("<aside>", "</aside>"), ("<div id=comments-page>", "</div>")])
@pytest.mark.parametrize("heading", ["<h1>Title</h1>", ""])
def test_html_names_do_not_cut_the_main_part(open_, close, heading):
    text = prose("article", 12)
    page = f"<html><body><nav><a href=/>Home</a></nav>{open_}{heading}{''.join(f'<p>{x}</p>' for x in text)}{close}<footer>foot</footer></body></html>"
    assert html.main_text(page).split("\n") == ["Title"] * bool(heading) + text


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "cookie-banner", "comment-list", "related-posts", "share-buttons", "ad-slot", "comments widget-area"])
def test_html_names_cut_asides(name):
    """Also where they hold more text than the article."""
    text = prose("article", 3)
    page = f"<html><body><article><h1>Title</h1>{''.join(f'<p>{x}</p>' for x in text)}</article><div class='{name}'>{''.join(f'<p>{x}</p>' for x in prose('reader', 9))}</div></body></html>"
    assert html.main_text(page).split("\n") == ["Title", *text]


def test_html_densities_brute_force():
    """On generated trees the sums are those of the formula, written out from each subtree."""
    rng = np.random.default_rng(3)

    def tree(depth):
        out = ""
        for _ in range(int(rng.integers(1, 4))):
            tag = str(rng.choice(["div", "section", "b", "a"]))
            out += "word " * int(rng.integers(0, 6)) + f"<{tag}>" + (tree(depth - 1) if depth else "leaf") + f"</{tag}>"
        return out

    def facts(x, link=False):
        """Characters, tags, and those of links, of a subtree."""
        link = link or x.tag == "a"
        c = t = lc = lt = 0
        for k in x.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                c, lc = c + n, lc + n * link
            else:
                a, b, d, e = facts(k, link)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (k.tag == "a")
        return c, t, lc, lt

    def density(c, t, lc, lt, whole):
        if not c:
            return 0.0
        t, lc1, lt = max(1, t), max(1, lc), max(1, lt)
        return c / t * np.log(max(1, c / lc1 * t / lt)) / np.log(max(1.0001, np.log(c / max(1, c - lc) * lc1 + whole * c + np.e)))

    for _ in range(30):
        root = html.parse(f"<html><body>{tree(3)}</body></html>")
        c, _, lc, _ = facts(root)
        whole = lc / max(1, c)
        for x in html.densities(root):
            if x.tag == "a" or any(k.tag == "a" for k in iter_up(x)):
                continue  # within a link, all is link text
            want = sum(density(len("".join(k.split())), 1, 0, 0, whole) if isinstance(k, str) else density(*facts(k), whole) for k in x.kids)
            assert x.density == pytest.approx(density(*facts(x), whole)) and x.sum == pytest.approx(want)


def iter_up(x):
    while x.parent is not None:
        x = x.parent
        yield x


def test_html_odd_rows(spark):
    """Empty tables, repeated rows, a very long page and columns of any name."""
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, "x"), (3, "u", "<article>" + "<p>word word word</p>" * 50_000 + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.select("page_id", "text", html.extract(spark).alias("found")).collect()
    assert sorted((r["page_id"], len(r["found"])) for r in got) == [(1, 1), (1, 1), (2, 0), (3, 50_000 * 15 - 1)]
    assert pages.where("false").select(html.extract(spark)).count() == 0


def test_html_query(spark):
    got = queries.op4_html_extraction(spark, AT).toPandas()
    assert len(got) == spark.read.parquet(f"{AT}/pages.parquet").count()
    assert all(len(t) == n for t, n in zip(got["text"], got["n_chars"]))
    # references were decoded and markup is gone; "&amp;lt;p&amp;gt;" in a page may still give "<p>"
    assert not got["text"].str.contains(r"</(?:div|p|nav|footer|script)>").any()
    assert (got["text"] != "").mean() > 0.8


# ---------------------------------------------------------------- 5


def fold(text):
    return re.sub(rb"[\x00-/:-@\[-`{-\x7f]+", b" ", (text or "").translate(UPPER).encode())


def within(item, text, most):
    """Whether a stretch of text is within `most` edits of item: the plain quadratic table."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(1, len(row)):
            new[j] = min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min() <= most, row.min()


def test_decontamination_brute_force(spark):
    rng = np.random.default_rng(1)
    alphabet = list("abcdefghijklmnopqrstuvwxyz   ")
    make = lambda n: "".join(rng.choice(alphabet, n)).strip() or "a"
    items = [(i, make(int(rng.integers(*((40, 120) if i < 5 else (12, 40)))))) for i in range(8)] + [(90, None), (91, ""), (92, "Tiny")]
    docs = []
    for i in range(40):
        body = make(150)
        if i % 2:
            p = list(items[i % 8][1])
            for _ in range(int(rng.integers(0, 12))):
                at = int(rng.integers(len(p)))
                p[at : at + 1] = [[], [str(rng.choice(alphabet))], [p[at], "z"]][int(rng.integers(3))]
            body = body[:60] + "." + "".join(p).upper() + "." + body[60:]
        docs.append((i, body))
    docs += [(100, None), (101, ""), (102, "a tiny thing"), (103, "tinyish")]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(102, 92): 0}
    for d, t in docs:
        for i, item in items[:8]:
            b = fold(item).strip()
            yes, edits = within(b, fold(t), len(b) // 10)
            if yes:
                want[d, i] = edits
    assert got == want


def test_decontamination_of_single_texts():
    """Texts whose q-grams hit the sieve but no item, each alone in its batch."""
    rng = np.random.default_rng(6)
    items = decontaminate.Items([1], [np.frombuffer(b"the quick brown fox jumps over the lazy dog and runs away", np.uint8)])
    items.sieve[:] = True
    texts = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(200)]
    assert all(items.find([t]) == [{}] for t in texts)
    assert items.find(["x The quick, brown fox jumps over the lazy dog and runs away!"]) == [{0: 0}]


def test_decontamination_query(spark):
    """Every verbatim passage is found."""
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, MORE).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{MORE}/benchmark.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, b in items if b and t and b in t}
    assert exact and exact <= got


def test_decontamination_odd(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "word " * 20), (2, None), (None, "a")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()} == {(7, 1)}
    unnamed = spark.createDataFrame([(None, "one")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, unnamed).collect()} == {(4, None)}
    assert decontaminate.clean(odd, unnamed).count() == len(ODD) - 2
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert {r["_hits"] for r in kept.select("_hits").collect()} == {"y"}
    assert decontaminate.leaks(odd, bench.where("false")).count() == 0 and decontaminate.clean(nothing, bench).count() == 0


# ---------------------------------------------------------------- 6


def test_lm_counts_and_gain(spark):
    got = queries.op6_lm_scoring(spark, AT).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r["doc_id"]: [*words(r["text"]), None] for r in docs}
    count = Counter(t for i, ts in tokens.items() if crc(i, 5) != 1 for t in ts)
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = got.loc[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 5) == 1, len(ts), sum(count[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel=1e-9)
    far = got[got["held_out"]]
    assert far["score"].sum() > far["base_score"].sum()
    p = {r["held_out"]: r for r in lm.perplexity(queries.op6_lm_scoring(spark, AT)).collect()}
    assert p[True]["perplexity"] < p[True]["base_perplexity"]


def test_lm_probabilities_sum_to_one(spark):
    """Scored as texts of one word and the end, the probabilities of all words at a text's
    start - those seen, a new one and the end - sum to one."""
    train = [(i, " ".join(f"w{(i * j) % 9}" for j in range(1, 12))) for i in range(20)]
    vocab = [f"w{i}" for i in range(9)]
    ask = [*vocab, "new", *(f"{w} {w}" for w in [*vocab, "new"]), ""]
    docs = spark.createDataFrame(train + [(100 + i, t) for i, t in enumerate(ask)], "doc_id long, text string")
    p = {r["doc_id"] - 100: 10 ** r["score"] for r in lm.score(docs, F.col("doc_id") >= 100).where("held_out").collect()}
    # p(w, end) = p(w | start) p(end | w) and p(w w, end) = p(w | start) p(w | w) p(end | w)
    assert len(p) == 21 and all(0 < x < 1 for x in p.values())
    assert sum(p.values()) < 1  # texts of no, one or two words are but some of all
    assert all(p[10 + i] < p[i] for i in range(10))


def test_lm_parts_score_alike(spark, monkeypatch):
    """Texts scored part by part have the scores that they have at once; null ids and repeated
    rows stay, and a part's tables are gone before the next one's are written."""
    monkeypatch.setattr(lm, "BROADCAST", 3)
    docs = [(None if i % 9 == 0 else i, " ".join(f"w{(i * j) % 7}" for j in range(1, 8))) for i in range(30)] + [(4, None), (5, "w1 new")]
    docs = spark.createDataFrame(docs + docs[3:5], "doc_id long, text string")
    live, most, write, drop = set(), [], lm.materialise, lm.dropped

    def written(df, name):
        out = write(df, name)
        live.update((out,) if name == "settled" else ())
        most.append(len(live))
        return out

    def gone(*tables):
        live.difference_update(tables)
        drop(*tables)

    def scores(parts):
        monkeypatch.setattr(lm, "SLICES", parts)
        rows = lm.score(docs, F.col("doc_id") % 5 == 1).collect()
        return sorted(((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows))

    monkeypatch.setattr(lm, "materialise", written)
    monkeypatch.setattr(lm, "dropped", gone)
    want = scores(1)
    assert len(want) == 34 and scores(3) == want
    assert max(most) == 1 and not live


def test_lm_buckets_count_and_send_few_rows():
    """Pairs of frequent and of rare words, counted by bucket in several chunks, are those that
    a plain count finds; a task sends a row of arrays for each bucket, not one for each pair."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 900) for _ in range(60)]
    held_out = [i % 5 == 1 for i in range(60)]
    h, at = lm.token_hashes([t.encode() for t in texts])
    often = np.unique(h)[:40]
    ranks = lm.Near.of({"h": often.view(np.int64), "rank": np.arange(40)}, ["h"], "rank")
    codes, end = lm._codes(h, ranks), lm._codes(np.array([lm.END]), ranks)[0]
    c, asked = Counter(), Counter()
    for i in range(60):
        w = codes[at[i] : at[i + 1]].tolist()
        (asked if held_out[i] else c).update(zip([int(end), *w], w))
    want = {k: n for k, n in c.items() if n > 1 or asked[k]}
    batch = pa.record_batch({"text": texts, "held_out": held_out})
    sent = list(lm._pairs_counted((batch.slice(s, 20) for s in range(0, 60, 20)), ranks, 7))
    counts = pa.Table.from_batches(sent)
    assert counts.num_rows <= 2 * 7 < len(c) and {*counts["bucket"].to_pylist()} == {*range(7)}
    got = [r for k in range(7) for r in lm._pairs_merged(counts.filter(pc.equal(counts["bucket"], k))).to_pylist()]
    assert len(got) == len(want) and {(r["u"], r["w"]): r["c"] for r in got} == want
    assert {(u < 0, w < 0) for u, w in want} == {(x, y) for x in (True, False) for y in (True, False)}


@pytest.mark.parametrize("few", [100_000, 3])
def test_lm_learns_contexts_of_rare_words(spark, monkeypatch, few):
    """1,500 words of equal frequency, each always followed by the same one: every context
    counts, and the probabilities of all words after a context sum to one."""
    monkeypatch.setattr(lm, "BROADCAST", few)
    n = 1500
    train = [(i, " ".join(f"{x}{i}" for _ in range(3) for x in "ab")) for i in range(n)]
    ask = [(10_000 + i, f"a{i} b{i}") for i in range(n)] + [(20_000 + i, f"a{i} b{(i + 1) % n}") for i in range(n)]
    docs = spark.createDataFrame(train + ask, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.col("doc_id") >= 10_000).collect()}
    assert len(got) == len(docs.collect())
    assert all(got[10_000 + i] > got[20_000 + i] + 1.5 for i in range(n))


def test_lm_words_after_a_word_sum_to_one(spark):
    """After every context, one never seen included, the words seen in training and one new."""
    counts = [(u - 4, w - 4, 1 + (u * w) % 4 * 7) for u in range(12) for w in range(12) if (u + w) % 3]
    occurs = Counter()
    for u, w, c in counts:
        occurs[w] += c
    pairs = spark.createDataFrame(counts, "u long, w long, c long")
    model = lm.sample(pairs.where("c > 1"), spark.createDataFrame(list(occurs.items()), "code long, c long"), 12, 0)
    base = {r["w"]: [r[x] for x in lm.BASES] for r in model.words.collect()} | {99: model.new}
    seen = {(u, w): 1 - lm.CONTEXT[0] for u, w, c in counts if c == 1} | {(r["u"], r["w"]): r["seen"] for r in model.pairs.collect()}
    tables = {u: [n] * 4 for u, n in occurs.items()} | {r["u"]: [r[x] for x in lm.TABLES] for r in model.contexts.collect()} | {99: [0] * 4}
    contexts = {u: (occurs[u], lm.CONTEXT[1] + lm.CONTEXT[0] * np.array(t)) for u, t in tables.items()}
    assert len(base) == len(contexts) == 13 and len(seen) == len(counts)
    for u, (n, pull) in contexts.items():
        p = [(seen.get((u, w), 0.0) + np.mean(np.array(pull) * base[w])) / (lm.CONTEXT[1] + n) for w in base]
        assert min(p) > 0 and sum(p) == pytest.approx(1, rel=1e-9)


def test_lm_sweeps_as_by_hand(spark, monkeypatch):
    """Sweeps over frequent pairs in arrays and over rarer ones in rows seat as a plain loop over
    all pairs does; the former aren't a row each."""
    monkeypatch.setattr(lm, "TOGETHER", 5)
    seats, write = [], lm.materialise

    def written(df, name):
        out = write(df, name)
        seats.extend([out.count()] if name == "seats" else [])
        return out

    monkeypatch.setattr(lm, "materialise", written)
    counts = [(u - 4, w - 4, 1 + (u * w) % 4 * 7) for u in range(18) for w in range(18) if (u + w) % 3]
    occurs = Counter()
    for _, w, c in counts:
        occurs[w] += c
    v = len(occurs)
    many = [x for x in counts if x[2] > 1]
    rows = spark.createDataFrame(many, "u long, w long, c long")
    model = lm.sample(rows, spark.createDataFrame(list(occurs.items()), "code long, c long"), v, 0)
    rare = sum(u < 0 or w < 0 for u, w, _ in many)
    assert 0 < rare < len(many) - 50 and max(seats) <= max(rare, rows.rdd.getNumPartitions())

    u, w, c = np.array(many).T
    code = np.array(sorted(occurs))
    n, at_u, at_w = np.array([occurs[x] for x in code]), np.searchsorted(code, u), np.searchsorted(code, w)
    summed = lambda at, x: np.bincount(at, x, v).astype(np.int64)
    n1_u, n1_w = n - summed(at_u, c), n - summed(at_w, c)
    t, top, p, root, kept = np.ones(len(c), np.int64), np.ones(v, np.int64), np.full(v, 1 / (v + 1)), v, 0
    total = n1_u + summed(at_u, t)
    rng = np.random.default_rng(0)  # not drawn from: no dish has many customers

    def drawn(sweep, level, *codes):
        key = np.full(len(codes[0]), 11 + 2 * sweep + level, np.uint64)
        for x in codes:
            key = lm.mix(lm.mix(key) + x.astype(np.int64).view(np.uint64))
        return lm.mix(key)

    bases, tables = [], []
    for sweep in range(lm.SWEEPS):
        t = lm.seat(c, t, p[at_w], *lm.CONTEXT, rng, total=total[at_u], key=drawn(sweep, 0, u, w))
        r = n1_w + summed(at_w, t)
        top = lm.seat(r, top, np.full(v, 1 / (v + 1)), *lm.PARENT, rng, total=np.full(v, root), key=drawn(sweep, 1, code))
        root, total = top.sum(), n1_u + summed(at_u, t)
        p = (r - lm.PARENT[0] * top + (lm.PARENT[1] + lm.PARENT[0] * root) / (v + 1)) / (lm.PARENT[1] + r.sum())
        if sweep >= lm.BURN_IN:
            kept = kept + t
            bases.append(p)
            tables.append(total)
    seen = c - lm.CONTEXT[0] * kept / len(bases)
    got = {(r["u"], r["w"]): (r["c"], r["seen"]) for r in model.pairs.collect()}
    assert got == {(x, y): (m, pytest.approx(z)) for x, y, m, z in zip(u.tolist(), w.tolist(), c.tolist(), seen.tolist())}
    of_w = {r["w"]: [r[x] for x in lm.BASES] for r in model.words.collect()}
    of_u = {r["u"]: [r[x] for x in lm.TABLES] for r in model.contexts.collect()}
    assert of_w == {x: pytest.approx(y) for x, y in zip(code.tolist(), np.array(bases).T.tolist())}
    assert {x: of_u.get(x, [occurs[x]] * len(tables)) for x in occurs} == dict(zip(code.tolist(), np.array(tables).T.tolist()))


def test_seating_keeps_bounds():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 100_000])
    t = lm.seat(c, (c > 0).astype(np.int64), np.full(5, 0.2), 0.75, 1.0, rng)
    assert (t <= c).all() and (t[c > 0] >= 1).all() and t[0] == 0


def test_seating_is_the_same_in_any_order():
    rng = np.random.default_rng(0)
    c, key, by = rng.integers(1, 60, 500), rng.integers(1, 1 << 62, 500).astype(np.uint64), rng.permutation(500)
    one = lm.seat(c, np.ones(500, np.int64), np.full(500, 0.01), 0.75, 1.0, np.random.default_rng(1), total=500, key=key)
    two = lm.seat(c[by], np.ones(500, np.int64), np.full(500, 0.01), 0.75, 1.0, np.random.default_rng(2), total=500, key=key[by])
    assert (one[by] == two).all() and len(set(one)) > 2


def test_lm_odd(odd, nothing):
    got = lm.score(odd, crc_mod("doc_id", 5) == 1).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) and r["n_tokens"] == len(words(t)) + 1 for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"])), sorted(ODD, key=lambda x: (x[0] is not None, x[0])), strict=True))
    assert lm.score(nothing, F.lit(False)).count() == 0
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in lm.score(odd, F.lit(True)).collect())


# ---------------------------------------------------------------- 7


def test_cascade_is_exact(spark):
    every = [(f"host{i}.example.com",) for i in range(4000)]
    universe, listed = spark.createDataFrame(every, "key string"), spark.createDataFrame(every[::3] + [(None,)], "key string")
    held = urlfilter.cascade(universe, listed)
    assert len(held.levels) > 1
    got = {r["key"]: r["x"] for r in held.on(universe).select("key", held.has(F.col("key")).alias("x")).collect()}
    assert got == {k: i % 3 == 0 for i, (k,) in enumerate(every)}


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == x or host.endswith("." + x) for x in urlfilter.LISTED) else "allow"


def test_url_filter_brute_force(spark):
    urls = ["http://spam-farm.example.com/a", "http://spam-farm.example.net", "http://spam-farm.example.edu", "http://x.org/" + "a" * 100_000, None, "", "nothing", "http://", "://x.com/fr/1", "HTTP://A.Example.ORG/en/12?x=1", "http://example.org", "http://spam-farm.example.org", "http://a.SPAM-farm.example.org?x", "http://xspam-farm.example.org", "http://b.com/de/1#f", "http://a://b.org/x", "http://..com/fr/", "http://free-bets.example.com:80/", "ftp://adult-x.example.net", "x\nhttp://a.org/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, _r string")
    got = urlfilter.judge(pages)
    assert {r["_r"] for r in got.select("_r").collect()} == {"r"}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judged(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.where("false")).count() == 0
    table = spark.read.parquet(f"{AT}/pages.parquet").select("page_id", "url").collect()
    assert {tuple(r) for r in queries.op7_url_filter(spark, AT).collect()} == {(r["page_id"], *judged(r["url"])) for r in table}


# ---------------------------------------------------------------- 8


def test_syncmers_are_closed(spark):
    """An anchor is where the least inner hash lies at an edge; checked with the same hashes."""
    text = "".join(np.random.default_rng(2).choice(list("abcde é日"), 300))
    k, s = fingerprint.K, fingerprint.S
    grams = sorted({text[i : i + s] for i in range(len(text) - s + 1)})
    table = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    want = []
    for i in range(len(text) - k + 1):
        h = [table[text[j : j + s]] for j in range(i, i + k - s + 1)]
        if min(h) in (h[0], h[-1]):
            want.append(i)
    got = spark.createDataFrame([(text,)], "t string").select(fingerprint.anchors(F.col("t")).alias("a")).first()["a"]
    assert got["pos"] == want and len(got["hash"]) == len(want)


def test_fingerprints(spark):
    got = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, AT).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{AT}/documents.parquet").collect()), reverse=True)
    edited = {}
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        cut = len(t) // 2
        edited[i] = t[: len(t) - cut] + nxt[:cut]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    # the edited text's fingerprint, put together from parts, is that of the text itself
    alone = spark.createDataFrame(list(edited.items()), "doc_id long, text string").select("doc_id", fingerprint.fingerprint(fingerprint.sketch(F.col("text"), fingerprint.anchors(F.col("text"))["hash"])).alias("f"))
    assert {r["doc_id"]: r["f"] for r in alone.collect()} == {i: r["edited_fingerprint"] for i, r in got.items()}
    same = defaultdict(set)
    for i, t in docs:
        same[t].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_of_texts_without_syncmers(spark):
    """Texts of 20 to 60 characters, many of which have no syncmer, are told apart."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghij "), n)) for n in [*range(20, 61)] * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bare = docs.where(F.size(fingerprint.anchors(F.col("text"))["hash"]) == 0).count()
    got = fingerprint.compare(docs).collect()
    assert bare > 20 and len(got) == len(texts)
    assert all(r["fingerprint"] and r["edited_fingerprint"] and r["near_next"] < 1 and r["near_edited"] < 1 for r in got)
    assert len({r["fingerprint"] for r in got}) == len(texts)
    same = spark.createDataFrame([(1, texts[0]), (2, texts[0])], "doc_id long, text string")
    assert all(r["near_next"] == 1.0 for r in fingerprint.compare(same).collect())


def test_fingerprints_odd(odd, nothing):
    got = fingerprint.compare(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    assert fingerprint.compare(nothing).count() == 0
    one = fingerprint.compare(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 5


# ---------------------------------------------------------------- 9


def test_warc_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, 70_000).astype(np.uint8).tobytes().decode("latin-1")  # gzip magic may occur in it
    magic = "\x1f\u008b\x08" * 500
    bodies = [None, "", "same", "same", "same", noise, magic, "é\r\n\r\nWARC/1.1\r\n", *(f"page {i} " * 50 for i in range(60))]
    rows = [(i, None if i == 3 else f"http://x.org/{i} a\n", b, 7) for i, b in enumerate(bodies)] + [(None, "u", "same", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int").repartition(3)
    manifest = warc.write(pages, f"file://{tmp_path}/w")
    largest = defaultdict(list)
    for i, _, b, _ in rows:
        largest[b or ""].append(i if i is not None else -1)
    for split in (1, 777, 1 << 20) if manifest.agg(F.sum("size")).first()[0] < 200_000 else (777, 1 << 20):
        got = warc.read(manifest, max(split, 61), payload=True).collect()
        assert len(got) == len(rows)
        for r in got:
            body = "same" if r["page_id"] is None else bodies[r["page_id"]] or ""
            top = max(largest[body])
            assert r["payload_bytes"] == len(body.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
            if r["page_id"] == top:
                assert (r["record_type"], r["refers_to"]) == ("response", None) and bytes(r["payload"]).decode() == body
            else:
                assert (r["record_type"], r["refers_to"]) == ("revisit", top)


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none)).count() == 0


def test_warc_files_are_plain_gzip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>y</p>")], "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages, f"file://{tmp_path}/g").first()["path"].removeprefix("file://")
    data = gzip.open(path).read()
    assert data.count(b"WARC/1.1\r\n") == 2 and b"<p>y</p>" in data


# ---------------------------------------------------------------- 10


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        at = np.flatnonzero(score == v)
        rank[at] = (np.searchsorted(score[order], v) + np.searchsorted(score[order], v, "right") + 1) / 2
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, at).toPandas()
    labels = spark.read.parquet(f"{at}/labels.parquet").toPandas()
    assert got["score"].between(0, 1).all() and all(got["predicted"] == (got["score"] >= 0.3))
    m = got[got["held_out"]].merge(labels, on="doc_id")
    assert auc(m["score"].to_numpy(), m["toxic"].to_numpy()) > 0.9
    hit = m["predicted"] == 1
    assert (m["toxic"][hit] == 1).mean() > 0.8 and hit[m["toxic"] == 1].mean() > 0.7


def test_toxicity_clauses():
    g = toxicity.Grammar(words={"idiot": 3.0}, coef=np.array([1.0, 2.0, 0.1, 0.2, 1.0, 2.0, 0.0, 0.1, -4.0]))
    plain, aimed, negated, said, none = g.score(["an idiot.", "you idiot!", "he is not an idiot.", "she said idiot.", "a fine day"])
    assert aimed > plain > said > negated > none
    assert list(g.score([None, ""])) == pytest.approx([none, none])
    # words with apostrophes are whole, and a target may follow
    assert list(g.score(["he isn't an idiot", "he isn\u2019t an idiot"])) == pytest.approx([negated, negated])
    assert g.score(["what an idiot he is"])[0] == pytest.approx(aimed) and g.score(["you're an idiot"])[0] == pytest.approx(aimed)
    assert g.score(["l'idiot"])[0] == pytest.approx(plain)
    # a negation of another clause doesn't count
    assert g.score(["no. you idiot"])[0] == pytest.approx(aimed)


def test_toxicity_composition_brute_force():
    """On all clauses of up to 5 symbols and many of 6 to 9, the composed machine's best path is
    the best of what the five transducers do one after the other; long gaps may be shortened."""
    machine = toxicity.composed()
    rng = np.random.default_rng(0)

    def rewritten(t, s):
        """Every string that a transducer writes for s, with its weights by place."""
        paths = [(q, "", ()) for q in t.start]
        for x in s:
            paths = [(to, out + y, (*ws, w)) for q, out, ws in paths for y, w, to in t.arcs.get(q, {}).get(x, ())]
        return [(out, ws) for q, out, ws in paths if q in t.final]

    def brute(s):
        every = [(s, (0.0,) * len(s))]
        for t in toxicity.PARTS:
            every = [(out, tuple(a + b for a, b in zip(ws, more))) for x, ws in every for out, more in rewritten(t, x)]
        return every

    strings = ["".join(x) for n in range(6) for x in product(toxicity.SYMBOLS if n < 5 else "oNRTK2", repeat=n)]
    strings += ["".join(rng.choice(list(toxicity.SYMBOLS), n)) for n in (6, 7, 8, 9) for _ in range(300)]
    for s in strings:
        every = brute(s)
        best = machine.best(s)
        assert every and best[0] == pytest.approx(max(sum(ws) for _, ws in every))
        assert ("".join(y for y, _ in best[1]), tuple(w for _, w in best[1])) in every
        gap = s.replace("oo", "ooooo")
        kinds = lambda b: [x for x in b[1] if x[0] != "-"]
        assert kinds(machine.best(gap)) == kinds(machine.best(re.sub("o{3,}", "oo", gap)))


def test_toxicity_fit_takes_conflicting_and_repeated_labels(spark):
    rows = [(i, "you vile blork person", 1) for i in range(10)] + [(20 + i, f"a vile blork {i}", 1) for i in range(10)] + [(40 + i, f"a fine day {i}", 0) for i in range(30)] + [(90, "you vile blork person", 0)]
    a, b = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string, toxic int")) for x in (rows, rows[::-1]))
    assert a.words == b.words and set(a.words) == {"vile", "blork"} and list(a.coef) == pytest.approx(list(b.coef))
    assert a.score(["vile"])[0] > a.score(["fine"])[0]


def test_toxicity_odd(spark, odd, nothing):
    g = toxicity.fit(nothing.withColumn("toxic", F.lit(1)))
    got = odd.select(toxicity.score(spark, g).alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r["s"] <= 1 for r in got)
    assert toxicity.fit(odd.withColumn("toxic", F.lit(1))).words == {}
