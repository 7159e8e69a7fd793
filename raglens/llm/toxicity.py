"""Toxicity by a weighted finite-state pattern grammar.

A clause is a string of symbols, one to a word: insults of three strengths, threats, targets,
negations, words of reported speech, and all others. Five transducers, given as arcs with
weights, rewrite it: the negation transducer marks what stands in a negation's scope, the one
of reported speech what follows its verb, the target transducer (which guesses whether the
clause names a target and must be right) what is aimed at someone, and the threat and insult
transducers turn what is marked into pattern kinds with their weights. They are composed once,
by product construction; a clause is scored by the best path of the composed machine.

The insult lexicon - whole words and word stems - is learned from a bounded sample of labelled
rows: forms that occur in toxic rows and (nearly) never in clean ones. A clause without an
insult or threat scores nothing and isn't read: an Aho-Corasick search finds the others. A
logistic model over the weights that each kind gathers, fitted on the same sample, gives the
score.

Defined results: null and empty texts, and texts without a match, score as the model's
intercept alone. Texts are taken whole. Repeated rows score alike. A text that is labelled
both ways counts as toxic."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm.common import materialise, sampled

#: A word of a clause, which may hold apostrophes; its parts are what the lexicon knows.
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
PART = re.compile(r"[^\W\d_]+")
CLAUSE_ENDS = ".!?;:\n"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")
#: Fixed word lists of the closed classes, by symbol.
CLASSES = {
    "N": frozenset("not no never isn't aren't wasn't weren't don't doesn't didn't can't won't wouldn't shouldn't nicht kein keine keinen nie pas jamais no nunca".split()),
    "R": frozenset("said says wrote called quoted claimed allegedly sagte dit dijo".split()),
    "T": frozenset("you your yours he she they him her them this these that those du dich ihr sie vous tu te ils tú usted ellos".split()),
    "K": frozenset("kill hurt destroy beat murder stab shoot".split()),
}
#: Insults by strength, and the least lexicon weight of each.
STRENGTHS, CUTS = "123", (0.0, 2.5, 4.0)
SYMBOLS = "oNRTK" + STRENGTHS
STEMS = (4, 5, 6)
#: Symbols of clauses that a process remembers with what was found in them.
KNOWN = 1 << 23
#: What the composed machine emits.
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")


@dataclass
class Transducer:
    """start and final states, and for each state and symbol read arcs (symbol written, weight,
    next state). Every arc reads one symbol and writes one."""

    start: list[str]
    final: set[str]
    arcs: dict[str, dict[str, list[tuple[str, float, str]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, start: Iterable[str], final: Iterable[str], arcs: Iterable[tuple[str, str, str, float, str]]) -> Transducer:
        """arcs: state, symbols read, symbols written for them, weight, next state."""
        out = cls(list(start), set(final))
        for state, read, written, weight, to in arcs:
            for x, y in zip(read, written, strict=True):
                out.arcs.setdefault(state, {}).setdefault(x, []).append((y, weight, to))
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: reads what this one reads and writes what the other one writes."""
        name = "{}|{}".format
        out = Transducer([name(a, b) for a in self.start for b in other.start], set())
        todo, seen = [(a, b) for a in self.start for b in other.start], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            if a in self.final and b in other.final:
                out.final.add(name(a, b))
            made = out.arcs.setdefault(name(a, b), {})
            for x, arcs in self.arcs.get(a, {}).items():
                for y, w, a2 in arcs:
                    for z, v, b2 in other.arcs.get(b, {}).get(y, ()):
                        made.setdefault(x, []).append((z, w + v, name(a2, b2)))
                        todo.append((a2, b2))
        return out

    def best(self, symbols: Iterable[str]) -> tuple[float, tuple[tuple[str, float], ...]] | None:
        """Weight of the best path that reads the symbols, and what it writes with the weight
        of each; None if no path is accepted. Of equal paths the first one by its arcs."""
        # what a path has written is a chain of its last symbol and the chain before that
        live: dict[str, tuple[float, tuple | None]] = {s: (0.0, None) for s in self.start}
        for x in symbols:
            new: dict[str, tuple[float, tuple | None]] = {}
            for s, (total, chain) in live.items():
                for y, w, to in self.arcs.get(s, {}).get(x, ()):
                    if to not in new or total + w > new[to][0]:
                        new[to] = (total + w, ((y, w), chain))
            live = new
        ends = [v for s, v in live.items() if s in self.final]
        if not ends:
            return None
        total, chain = max(ends, key=lambda v: v[0])
        written = []
        while chain is not None:
            last, chain = chain
            written.append(last)
        return total, tuple(reversed(written))


# What the transducers mark: negated k a b c, reported Q x y z, aimed M A B C.
_ACTS = "K" + STRENGTHS
_QUIET = "oRT"

#: A negation's scope are the next two words.
NEGATION = Transducer.of(
    "0",
    "012",
    [
        ("0", _QUIET + _ACTS, _QUIET + _ACTS, 0.0, "0"),
        *((s, "N", "N", 0.0, "2") for s in "012"),
        *((s, _QUIET, _QUIET, 0.0, to) for s, to in ("21", "10")),
        *((s, _ACTS, "kabc", 0.0, to) for s, to in ("21", "10")),
    ],
)
#: Reported is what follows a verb of speech in its clause, unless it is negated.
REPORTED = Transducer.of(
    "0",
    "01",
    [
        ("0", "oNT" + _ACTS + "kabc", "oNT" + _ACTS + "kabc", 0.0, "0"),
        *((s, "R", "R", 0.0, "1") for s in "01"),
        ("1", "oNTkabc", "oNTkabc", 0.0, "1"),
        ("1", _ACTS, "Qxyz", 0.0, "1"),
    ],
)
_PASSED = "oNRkabcQxyz"
#: n: no target in the clause. u: one is still to come; v: one was named. What is plain is aimed then.
TARGET = Transducer.of(
    "nu",
    "nv",
    [
        ("n", _PASSED + _ACTS, _PASSED + _ACTS, 0.0, "n"),
        *((s, _PASSED, _PASSED, 0.0, s) for s in "uv"),
        *((s, _ACTS, "MABC", 0.0, s) for s in "uv"),
        *((s, "T", "T", 0.0, "v") for s in "uv"),
    ],
)
_REST = "oNRTabcxyzABC" + STRENGTHS
#: Written digits stand for the kinds: 5 to 8 are the threats, and the insults below are 1 to 4.
THREAT = Transducer.of("0", "0", [("0", _REST, _REST, 0.0, "0"), *(("0", x, y, w, "0") for x, y, w in (("K", "5", 0.5), ("M", "6", 2.0), ("k", "7", 0.1), ("Q", "8", 0.2)))])
INSULT = Transducer.of(
    "0",
    "0",
    [
        ("0", "oNRT", "----", 0.0, "0"),
        ("0", "5678", "stuv", 0.0, "0"),
        *(("0", x, y, float(w), "0") for xs, y in zip((STRENGTHS, "ABC", "abc", "xyz"), "ianr") for x, w in zip(xs, (1.0, 2.0, 3.0))),
    ],
)
#: Kinds by what the composed machine writes.
WRITTEN = {y: KINDS.index(kind) for y, kind in zip("ianrstuv", KINDS)}
PARTS = (NEGATION, REPORTED, TARGET, THREAT, INSULT)


def composed(parts: Iterable[Transducer] = PARTS) -> Transducer:
    first, *rest = parts
    for t in rest:
        first = first.then(t)
    return first


@dataclass
class Grammar:
    """words and stems: the insult lexicon with weights; coef: one per kind, then the intercept."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.2, 0.1, 0.3, 0.3, 1.0, 0.05, 0.1, -3.0]))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "stems", "coef")}

    def prepared(self) -> ahocorasick.Automaton:
        """What a process builds once: the search for insults and threats, and the machine."""
        if not hasattr(self, "_found"):
            self._found = ahocorasick.Automaton()
            for w in sorted({*self.words, *self.stems, *CLASSES["K"]}):
                self._found.add_word(w, len(w))
            self._found.make_automaton()
            self._machine, self._known, self._held = composed(), {}, 0
        return self._found

    def insult(self, word: str) -> float:
        """The weight of a word in the lexicon, 0 if it isn't there."""
        w = self.words.get(word, 0.0)
        for n in STEMS:
            w = max(w, self.stems.get(word[:n], 0.0)) if len(word) > n else w
        return w

    def symbol(self, word: str) -> str:
        """The symbol of a lower-cased word: that of the whole word, else of one of its parts."""
        word = word.replace("’", "'")
        for x in (word, *(PART.findall(word) if "'" in word else ())):
            for s, names in CLASSES.items():
                if x in names:
                    return s
            if (w := self.insult(x)) > 0:
                return STRENGTHS[max(i for i, cut in enumerate(CUTS) if w > cut)]
        return "o"

    def matches(self, clause: str) -> tuple[tuple[int, float], ...]:
        """Kinds and weights on the best path of one lower-cased clause."""
        self.prepared()
        symbols = re.sub("o{3,}", "oo", "".join(map(self.symbol, WORD.findall(clause))))  # no scope is longer
        if symbols not in self._known:
            best = self._machine.best(symbols)
            found = tuple((WRITTEN[y], w) for y, w in best[1] if y in WRITTEN) if best else ()
            size = len(symbols) + len(found) + 8
            if self._held + size > KNOWN:
                self._known.clear()
                self._held = 0
            if size > KNOWN:
                return found
            self._known[symbols] = found
            self._held += size
        return self._known[symbols]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """log(1 + summed weight) of each kind over all clauses of each text."""
        out = np.zeros((len(texts), len(KINDS)))
        found = self.prepared()
        for i, text in enumerate(texts):
            if not text:
                continue
            low = text.lower()
            done = -1
            for end, n in found.iter(low):
                start = end - n + 1
                if start < done or (start and (low[start - 1].isalpha())):
                    continue
                s = 1 + max(low.rfind(c, max(done, 0), start) for c in CLAUSE_ENDS)
                m = CLAUSE_END.search(low, end)
                e = m.start() if m else len(low)
                for kind, w in self.matches(low[max(s, done, 0) : e]):
                    out[i, kind] += w
                done = e
        return np.log1p(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.features(texts) @ self.coef[:-1] + self.coef[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression, of rows that occur n times, towards the prior weights; the
    intercept is free."""
    x = np.column_stack([x, np.ones(len(x))])
    pen = np.array([ridge] * (x.shape[1] - 1) + [1e-3])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), x.T @ (n * (y - p)) - pen * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _forms(texts: pd.Series) -> Iterator[set[str]]:
    """The words, and the stems marked by *, of each text."""
    for t in texts:
        words = set(PART.findall((t or "").lower()))
        yield words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", max_rows: int = 20_000) -> DataFrame:
    """The texts of at most about max_rows labels: these, of that bounded number, are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label)
    return docs.join(F.broadcast(sampled(known, id_col, max_rows)), id_col)


def fit(train: DataFrame, text: str = "text", label: str = "toxic", id_col: str = "doc_id", max_rows: int = 20_000, least: int = 4, least_share: float = 0.005, precision: float = 0.9) -> Grammar:
    """Learns lexicon and weights from at most about max_rows labelled rows (the documented
    bound), drawn by a hash of the id. Equal texts count once. least and least_share: toxic
    rows that hold a form; precision: share of toxic rows among those that hold it. Without
    labelled rows of both kinds the lexicon is empty."""
    spark: SparkSession = train.sparkSession
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(text).alias("text"), F.col(id_col).alias("id"))
    rows = materialise(rows, "labelled")
    rows = materialise(sampled(rows, "id", max_rows).groupBy("text").agg(F.max("y").alias("y")).repartition(12), "train")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for y, found in zip(pdf["y"], _forms(pdf["text"])):
                (toxic if y else clean).update(found)
        for t, c in ((toxic, 1), (clean, 0)):
            if t:  # a part without rows reports nothing
                yield pd.DataFrame({"form": list(t), "t": [n * c for n in t.values()], "c": [n * (1 - c) for n in t.values()]})

    sums = rows.mapInPandas(counts, "form string, t long, c long").groupBy("form").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy((F.col("y") != 0).cast("int").alias("y")).count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Grammar()
    support = max(least, least_share * sizes[1])
    # a form needs so many rows of the bounded sample that few forms have them
    kept = sums.where((F.col("t") >= support) & (F.col("t") >= precision * (F.col("t") + F.col("c")))).collect()
    weight = {r["form"]: float(np.log((r["t"] + 0.5) / (sizes[1] + 1)) - np.log((r["c"] + 0.5) / (sizes[0] + 1))) for r in kept}
    weight = {f: w for f, w in sorted(weight.items()) if w > 1.0}
    words = {f for f in weight if not f.endswith("*")}
    # a stem is taken only if several words of the lexicon share it; the shortest covers the rest
    stems: dict[str, float] = {}
    for f in sorted((f for f in weight if f.endswith("*")), key=lambda f: (len(f), f)):
        stem = f[:-1]
        if not any(stem.startswith(s) for s in stems) and sum(w.startswith(stem) and len(w) > len(stem) for w in words) >= 4:
            stems[stem] = weight[f]
    alone = sorted(w for w in words if not any(w.startswith(s) and len(w) > len(s) for s in stems))
    grammar = Grammar({w: weight[w] for w in alone}, stems)
    held = spark.sparkContext.broadcast(grammar)
    names = [f"x{i}" for i in range(len(KINDS))]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = held.value.features(pdf["text"].tolist())
            yield pd.DataFrame({"y": (pdf["y"] != 0).astype("int32"), **{c: x[:, i].round(3) for i, c in enumerate(names)}})

    table = rows.mapInPandas(features, "y int, " + ", ".join(f"{c} double" for c in names)).groupBy("y", *names).count().orderBy("y", *names).collect()
    x, n, y = (np.array([[r[c] for c in names] for r in table]), *(np.array([float(r[c]) for r in table]) for c in ("count", "y")))
    grammar.coef = _logistic(x, n, y, grammar.coef)
    grammar.coef[:-1] = np.maximum(grammar.coef[:-1], 0.0)
    return grammar


def score(spark: SparkSession, grammar: Grammar, text: str | Column = "text") -> Column:
    """A double column, 0 to 1, of a text column."""
    held = spark.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(texts.tolist()), dtype="float64")

    return scored(F.col(text) if isinstance(text, str) else text)
