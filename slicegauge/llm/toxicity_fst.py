"""Toxicity: a weighted finite-state grammar over clauses (operator 7).

A text is cut into clauses at . ! ? ; : and line ends. A lexicon turns the words
of a clause into symbols; small weighted transducers for insults, threats,
targets, negation and reported speech are composed into one machine, which
reads the symbols and emits matched clause patterns with their weights. A
logistic layer over the summed matches of a document gives the score, so a word
counts by the clause it stands in, not alone.

Learned from labels: the insult words and word beginnings of the lexicon with
their weights (log odds), and the logistic layer, which is fitted on a fold kept from
the lexicon (on all rows of the sample where that fold lacks a class). Both come from a bounded
sample of labelled rows (`per_class` of each label in the order of a hash of the
id); rows with crc32(doc_id) mod 5 = 0 are never in it. Everything else is
scored whole, in one pass without a shuffle.

Null or empty texts match nothing and get the score of a text without matches.
Repeated rows and ties get equal scores. Without any labelled row of one class
the lexicon is empty and every score is the share of toxic labels (0 if none).
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import importable

# Closed-class words of the four languages of the corpus.
TARGETS = frozenset("you your yours yourself he she they them him her his their people everyone du dein deine ihr euch "
                    "er sie tu te toi vous ton ta votre il elle ils vos usted ustedes ella ellos vosotros".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't don't nicht kein keine nie niemals ne pas jamais "
                      "aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls claimed claims wrote quoted reported sagte sagt schrieb nannte dit disait "
                    "écrit appelé dijo dice escribió llamó".split())
THREATS = frozenset("kill hurt destroy beat punish attack shoot töten schlagen vernichten tuer frapper détruire matar "
                    "golpear destruir".split())
CLAUSE = re.compile(r"[^.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "i", "h", "t", "n", "r", "o"
STEM_LENGTHS = (4, 5, 6, 7)


@dataclass
class Transducer:
    """A deterministic transducer; arcs[(state, symbol)] = (output, next state). No arc: copy, stay."""
    name: str
    arcs: dict[tuple[int, str], tuple[str, int]]
    start: int = 0
    states: int = 1

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        return self.arcs.get((state, symbol), (symbol, state))


def negation(reach: int = 3) -> Transducer:
    """An insult or threat at most `reach` words behind a negation becomes a denied one (I, H)."""
    arcs: dict[tuple[int, str], tuple[str, int]] = {}
    for s in range(reach + 1):
        arcs[s, NEGATION] = (NEGATION, reach)
        for x in (OTHER, TARGET, REPORT):
            arcs[s, x] = (x, max(0, s - 1))
        for x in (INSULT, THREAT):
            arcs[s, x] = (x.upper() if s else x, max(0, s - 1))
    return Transducer("negation", arcs, 0, reach + 1)


def reported() -> Transducer:
    """Behind a verb of saying, to the clause's end, matches are quoted ones (q for insults, Q for threats)."""
    arcs = {(0, REPORT): (REPORT, 1)}
    for x, y in ((INSULT, "q"), ("I", "q"), (THREAT, "Q"), ("H", "Q")):
        arcs[1, x] = (y, 1)
    return Transducer("reported", arcs, 0, 2)


def targeted() -> Transducer:
    """A plain insult or threat in a clause that has named somebody is aimed (a, A)."""
    arcs = {(0, TARGET): (TARGET, 1)}
    for x, y in ((INSULT, "a"), (THREAT, "A")):
        arcs[1, x] = (y, 1)
    return Transducer("target", arcs, 0, 2)


def matched() -> Transducer:
    """Only matches leave the grammar; everything else is silent."""
    return Transducer("matched", {(0, x): ("", 0) for x in (OTHER, TARGET, NEGATION, REPORT)})


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The machine that feeds what `first` emits into `then`."""
    symbols = [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER]
    seen = {(first.start, then.start): 0}
    arcs, todo = {}, [(first.start, then.start)]
    while todo:
        a, b = pair = todo.pop()
        for x in symbols:
            y, a2 = first.step(a, x)
            z, b2 = then.step(b, y) if y else ("", b)
            if (a2, b2) not in seen:
                seen[a2, b2] = len(seen)
                todo.append((a2, b2))
            arcs[seen[pair], x] = (z, seen[a2, b2])
    return Transducer(f"{first.name}+{then.name}", arcs, 0, len(seen))


GRAMMAR = compose(compose(compose(negation(), reported()), targeted()), matched())
MATCHES = ("i", "a", "I", "q", "h", "A", "H", "Q")  # insult, aimed, denied, quoted; threat, aimed, denied, quoted


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(MATCHES)))
    bias: float = 0.0


class Reader:
    """Symbols of words, remembered per word up to a bound."""

    def __init__(self, model: ToxicityModel, remembered: int = 200_000):
        self.model, self.remembered, self.seen = model, remembered, {}

    def look_up(self, word: str) -> tuple[str, float] | None:
        m = self.model
        if (w := m.words.get(word)) is None:
            w = max((m.stems[word[:k]] for k in STEM_LENGTHS if len(word) >= k and word[:k] in m.stems), default=None)
        if w is not None:
            found = (INSULT, w)
        elif word in THREATS:
            found = (THREAT, 1.0)
        else:
            found = next(((s, 0.0) for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
                          if word in words), None)
        if len(self.seen) >= self.remembered:
            self.seen.clear()
        self.seen[word] = found
        return found

    def symbols(self, clause: str) -> list[tuple[str, float]]:
        seen, out = self.seen, []
        for w in TOKEN.findall(clause):
            out.append((seen[w] if w in seen else self.look_up(w)) or (OTHER, 0.0))
        return out

    def hot(self, text: str) -> bool:
        seen = self.seen
        for w in set(TOKEN.findall(text)):
            x = seen[w] if w in seen else self.look_up(w)
            if x and x[0] in (INSULT, THREAT):
                return True
        return False

    def features(self, text: str | None) -> np.ndarray:
        """Per match kind: matched clauses and their summed lexicon weight, damped by logarithms."""
        n, weight = Counter(), Counter()
        low = text.lower() if text else ""
        if self.hot(low):
            for clause in CLAUSE.findall(low):
                syms = self.symbols(clause)
                if any(s in (INSULT, THREAT) for s, _ in syms):
                    state, found = GRAMMAR.start, {}
                    for s, w in syms:
                        out, state = GRAMMAR.step(state, s)
                        if out:
                            found[out] = found.get(out, 0.0) + w
                    for k, w in found.items():
                        n[k] += 1
                        weight[k] += w
        return np.array([np.log1p(n[k]) for k in MATCHES] + [np.log1p(weight[k]) for k in MATCHES])


def score(model: ToxicityModel, reader: Reader, text: str | None) -> float:
    z = float(model.bias + model.coef @ reader.features(text))
    return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` labelled ids of each class, none of them held out."""
    rest = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    rest = rest.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [rest.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def _terms(batches):
    """Distinct words and word beginnings of each text, with its label and half."""
    for b in batches:
        n: dict[str, list[int]] = {}
        for doc, text, y in zip(*(b.column(i).to_pylist() for i in range(3))):
            if fold(doc) == 4:
                continue
            words = set(TOKEN.findall((text or "").lower()))
            for t in words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}:
                n.setdefault(t, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), *[pa.array([v[k] for v in n.values()], pa.int64()) for k in (0, 1)]],
            ["term", "clean", "toxic"])


def _features(model):
    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            docs, ys = b.column(0).to_pylist(), b.column(2).to_pylist()
            x = [reader.features(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ys, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; match weights may not be negative."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) / len(y) + reg * w
        h = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 / len(y) + np.diag(reg)
        step = np.linalg.solve(h, g)
        w = w - step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, min_docs: int = 4, min_share: float = 0.004, min_odds: float = 3.0,
        lexicon: int = 5_000) -> ToxicityModel:
    """Learn lexicon and logistic layer from at most 2 * `per_class` labelled documents.

    Bounds: the sample, `lexicon` entries, and one feature vector per sampled
    document of the fold that is kept from the lexicon.
    """
    spark = docs.sparkSession
    importable(spark)
    ids = sample(labels, per_class)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(ids.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id")
    n = {r.toxic: r.n for r in ids.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 4").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    model = ToxicityModel()
    if n1 and n0:
        odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
        top = (text.mapInArrow(_terms, "term string, clean long, toxic long")
               .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .filter(F.col("toxic") >= max(min_docs, min_share * n1)).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
               .orderBy(F.desc("odds"), F.desc("toxic"), "term").limit(lexicon).collect())
        for r in top:
            (model.stems if r.term.endswith("*") else model.words)[r.term.rstrip("*")] = float(r.odds)
    shared = spark.sparkContext.broadcast(model)
    apart = text.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 4")
    # a fold of one class says nothing of how matches weigh: then all sampled rows fit the layer
    both = len(apart.select("toxic").distinct().collect()) == 2
    rows = (apart if both else text).mapInArrow(_features(shared), "doc_id long, toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    if len(set(y)) == 2:
        model.coef, model.bias = logistic(np.array([r.x for r in rows]), y)
    elif len(y):
        model.bias = 30.0 if y[0] else -30.0
    else:
        model.bias = -30.0
    return model


def _scorer(model):
    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            out = [score(model.value, reader, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])
    return run


def judge(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    importable(spark)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scorer(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _passes(model, column: int):
    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            keep = [score(model.value, reader, t) < 0.5 for t in b.column(column).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
    return run


def passing(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic. No join, no shuffle."""
    importable(docs.sparkSession)
    return docs.mapInArrow(_passes(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")), docs.schema)
