"""Inputs that broke or slowed down operators once."""

import time

import pytest
from pyspark.sql import functions as F

from raglens.llm import html, mixing, queries, toxicity, urlfilter


@pytest.mark.parametrize(
    "page,text",
    [
        ('<p class="x>hello</p><p>more text here</p>', "hello\nmore text here"),
        ("<p class='x>hello</p><p>more text here</p>", "hello\nmore text here"),
        ('<p class="x" title=\'it"s\'>hello</p>', "hello"),
        ("<p title=it's>hello</p><p class=\"a>b\">more</p>", "hello\nmore"),
        ("<p>one</b></i> two</p></div></article>", "one two"),
        ("<p>a <b>b</p><p>c</b> d</p>", "a b\nc d"),
        ("<ul><li>a<li><b>b<li>c</ul>", "a\nb\nc"),
    ],
)
def test_html_broken_tags(page, text):
    """Quotes that nothing closes, and end tags that close nothing, leave no markup in the text."""
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "</x>" * n, lambda n: "<p>" + "<b>" * n + "<hr>" * n, lambda n: "<p><td>" + "<b>" * n + "<hr>" * n, lambda n: '<p a="=>' * n, lambda n: "<p a='=\">" * n])
def test_html_time_is_linear(page):
    """A page of 16 times the tags doesn't take 256 times as long."""

    def took(n):
        began = time.perf_counter()
        html.parse(page(n))
        return time.perf_counter() - began

    took(500)
    assert took(32_000) < 64 * max(took(2_000), 0.005)


def test_toxicity_time_is_linear_in_a_clause(monkeypatch):
    """One clause of insults takes 16 times as long for 16 times the words, and is remembered
    within bounds."""
    grammar = toxicity.Grammar(words={"idiot": 5.0})

    def took(n):
        began = time.perf_counter()
        found = grammar.matches("idiot " * n)
        assert len(found) == n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 32 * max(took(1_000), 0.005)
    grammar = toxicity.Grammar(words={"idiot": 5.0})
    monkeypatch.setattr(toxicity, "KNOWN", 100)
    for n in range(1, 80):
        assert len(grammar.matches("idiot " * n)) == n
        assert grammar._held <= 100


def test_url_filter_with_clashing_columns(spark):
    """Columns that look like a level's bits stay as they are."""
    plain = spark.createDataFrame([("http://spam0.example.net/a",), ("http://example.org/es/1",), (None,)], "url string")
    odd = plain.withColumns({"_bits0": F.lit(1), "_BITS1": F.lit("x"), "__": F.lit(2)})
    want = sorted(map(tuple, urlfilter.judge(plain).select("url", "rule", "verdict").collect()), key=repr)
    got = urlfilter.judge(odd)
    assert sorted(map(tuple, got.select("url", "rule", "verdict").collect()), key=repr) == want
    assert got.select("_bits0", "_BITS1", "__").distinct().collect() == [(1, "x", 2)]


def test_mixing_with_clashing_columns(spark):
    """Columns that look like the plan's stay as they are; the mixture is the same."""
    plain = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7, "t" * i) for i in range(60)], "doc_id long, source string, size long, text string")
    odd = plain.withColumns({"_rows": F.lit(1), "_KEY": F.lit("x"), "up": F.lit(2)})
    want = sorted((r["doc_id"], r["copies"]) for r in mixing.mixed(plain).collect())
    got = mixing.mixed(odd)
    assert sorted((r["doc_id"], r["copies"]) for r in got.collect()) == want
    assert got.select("_rows", "_KEY", "up").distinct().collect() == [(1, "x", 2)]


def test_held_out_of_a_null_id(spark, tmp_path):
    """A row without an id is scored and isn't held out."""
    docs = [(i, "en" if i % 2 else "fr", "the cat and the dog" if i % 2 else "le chat et le chien") for i in range(40)] + [(None, "en", "the dog")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op1_language_id, queries.op10_toxicity):
        row = query(spark, str(tmp_path)).where("doc_id is null").first()
        assert row["held_out"] is False
        assert 0 <= row["score"] <= 1
