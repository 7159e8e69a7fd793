"""Frequent prefixes against a plain count, where the summary proves them and where it can't."""

from collections import Counter

import pytest

from raglens.operators import prefixes


def _plain(texts, length, k):
    counts = Counter(t[:length] for t in texts if t is not None)
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    return [(i + 1, p, n, round(n / sum(counts.values()), 9)) for i, (p, n) in enumerate(best)]


def _texts():
    hot = [f"{i:03d} same start, other end {j}" for i in range(30) for j in range(400 - 10 * i)]
    return hot + [f"x{i} only once" for i in range(3000)] + [None, "", ""]


@pytest.mark.parametrize("tracked,named,k", [(8192, 512, 20), (64, 24, 20), (64, 24, 5), (16, 8, 20)])
def test_equal_to_a_plain_count(spark, monkeypatch, tracked, named, k):
    """Proven by the summary, or by the counts of hashes where the summary is too small."""
    monkeypatch.setattr(prefixes, "TRACKED", tracked)
    monkeypatch.setattr(prefixes, "CANDIDATES", named)
    monkeypatch.setattr(prefixes, "ERROR", 3.5 / tracked)
    texts = _texts()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    assert sorted(map(tuple, prefixes.top_prefixes(df, length=8, k=k).collect())) == _plain(texts, 8, k)


def test_flat_counts_ties_and_none(spark):
    """Ties go to the lesser text; no texts give no rows."""
    texts = [f"{i % 700:04d}" for i in range(700)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(map(tuple, prefixes.top_prefixes(df, k=3).collect())) == _plain(texts, 200, 3)
    assert prefixes.top_prefixes(df.where("false")).count() == 0
    assert prefixes.top_prefixes(spark.createDataFrame([(None,)], "text string")).count() == 0
