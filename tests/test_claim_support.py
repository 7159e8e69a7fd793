"""Claims against context by overlap and similarity, held against a plain loop."""

import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from raglens.functions.scalars import STOP_WORDS
from raglens.operators import claim_support as cs
from raglens.operators.evaluation import SETTLES, SIMILAR, SUPPORTS

KEYS = ("item",)
WORDS = "cats sleep long on warm mats while dogs bark loudly sleeping catnap it is the".split()


def _claims(text):
    return [x for x in (y.strip() for y in re.split(r"(?<=[.!?])[ \t]+|[\r\n]+", text or "")) if len(x) >= 2]


def _vector(text):
    out = np.zeros(cs.WIDTH)
    for w in re.findall(r"[^\W_]+", text.lower()):
        for i in range(len(w)):
            h = md5(f"#{w}#"[i : i + 3].encode()).hexdigest()
            out[int(h[:2], 16)] += 1 if h[2] < "8" else -1
    return out


def _words(text):
    return set(re.findall("[a-z0-9]+", text.lower())) - set(STOP_WORDS)


def _plain(answer, passages):
    """The rule, one sentence after the other."""
    sentences = [s for p in passages for s in _claims(p)]
    for claim in _claims(answer):
        at, sim, over, method = None, 0.0, 0.0, cs.BY_WORDS
        v, w = _vector(claim), _words(claim)
        for i, s in enumerate(sentences):
            u = _vector(s)
            size = np.sqrt((u @ u) * (v @ v))
            x, o = (u @ v / size if size else 0.0), (len(w & _words(s)) / len(w) if w else 0.0)
            if o >= SETTLES:
                at, sim, over, method = i, x, o, cs.BY_EMBEDDING
                break
            if x > sim:
                at, sim, over, method = i, x, o, cs.BY_SIMILARITY
            elif o > over:
                over, at = o, i if at is None else at
        yield claim, sim >= SIMILAR or over >= SUPPORTS, at, round(max(0.0, sim), 6), round(over, 9), method


def _tables(spark, items):
    answers = spark.createDataFrame([(i, a) for i, (a, _) in items.items()], "item int, answer string")
    passages = spark.createDataFrame([(i, n, p) for i, (_, ps) in items.items() for n, p in enumerate(ps)], "item int, passage_no int, passage string")
    return answers, passages


def _text(rng, n):
    return " ".join(" ".join(rng.choice(WORDS, rng.integers(1, 6))).capitalize() + "." for _ in range(n))


@pytest.mark.parametrize("block", [3, 256])
def test_equal_to_the_plain_rule(spark, monkeypatch, block):
    """Any cut into blocks gives what a loop over all sentences gives; odd items too."""
    monkeypatch.setattr(cs, "BLOCK", block)
    rng = np.random.default_rng(5)
    items = {i: (_text(rng, int(rng.integers(1, 9))), [_text(rng, int(rng.integers(0, 7))) for _ in range(3)]) for i in range(12)}
    items |= {20: (None, ["Cats sleep."]), 21: ("", []), 22: ("Cats sleep.", []), 23: ("It is. So.", ["It is.", None]), 24: ("?! --", ["Cats sleep."])}
    answers, passages = _tables(spark, items)
    got = {(r["item"], r["claim_no"]): tuple(r)[2:] for r in cs.claim_support(answers, passages, KEYS).collect()}
    want = {(i, n): x for i, (a, ps) in items.items() for n, x in enumerate(_plain(a, ps))}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k] == pytest.approx(x), k


def test_support_from_similarity_alone(spark):
    """Shared parts of words support a claim that shares no word; scores tell so."""
    items = {1: ("Sleepers dreamed.", ["Nothing here.", "Sleeper dreams."]), 2: ("Sleepers dreamed.", ["Nothing here."]), 3: (None, ["x."])}
    answers, passages = _tables(spark, items)
    support = cs.claim_support(answers, passages, KEYS)
    got = {r["item"]: tuple(r)[1:] for r in cs.grounding_scores(answers, support, KEYS).collect()}
    assert got == {1: (1, 1, 1, 1.0, 0.0), 2: (1, 0, 0, 0.0, 1.0), 3: (0, 0, 0, 1.0, 0.0)}
    assert support.where("item = 1").first()["sentence_no"] == 1


def test_vectors_given(spark):
    """Vectors that come with the texts replace hashed ones; zero and missing ones are like nothing."""
    answers = spark.createDataFrame([(1, "Red.\nBlue.\nGreen.", [[1.0, 0.0], [0.0, 0.0], None])], "item int, answer string, claim_vectors array<array<double>>")
    passages = spark.createDataFrame([(1, 0, "One.\nTwo.", [[0.6, 0.8], [3.0, 0.0]])], "item int, passage_no int, passage string, sentence_vectors array<array<double>>")
    got = cs.claim_support(answers, passages, KEYS, vectors=True).orderBy("claim_no").collect()
    assert [(r["supported"], r["sentence_no"], r["similarity"]) for r in got] == [(True, 1, 1.0), (False, None, 0.0), (False, None, 0.0)]


def test_empty_tables(spark):
    answers, passages = _tables(spark, {1: ("Cats sleep.", ["Cats sleep."])})
    none = cs.claim_support(answers.where(F.lit(False)), passages, KEYS)
    assert none.count() == 0
    assert cs.claim_support(answers, passages.where(F.lit(False)), KEYS).first()["method"] == cs.BY_WORDS


def test_rows_of_a_task_follow_the_answers(spark, monkeypatch):
    monkeypatch.setattr("raglens.operators.claim_support.ANSWERS", 2)
    answers = spark.createDataFrame([(i, f"Red fox {i}. Blue bird {i}.") for i in range(5)], "k long, answer string").coalesce(1)
    passages = answers.selectExpr("k", "0 as passage_no", "answer as passage")
    from raglens.operators.claim_support import claim_support

    got = claim_support(answers, passages, ("k",))
    assert "RoundRobinPartitioning(3)" in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == 10 and all(r["supported"] and r["sentence_no"] == r["claim_no"] for r in rows)
