"""Personal data by rules and a skip-chain conditional random field (operator 13).

Base spans follow fixed rules for e-mail addresses, IP addresses, card and phone
numbers. The field adds spans the rules miss: a repeated number without its country
code, an address's name standing alone, two card numbers that the rule reads as one.

Nodes are the chunks of a text that hold a digit or an `@`, and chunks equal to the
name in front of a base address; all other words are fixed to `other` and seen only
as context. Neighbouring nodes share a chain potential; nodes with equal or similar
text (same word, same last seven digits, same address name) share a skip potential,
each with the next one like it, so edges grow with the nodes. Nodes under base spans
are evidence. Loopy sum-product messages, all texts of a batch at once in numpy, carry
labels between distant mentions; a node whose likeliest label has `min_prob` or more
and is not `other` becomes a span, neighbouring groups of one card or phone number together.

Training is piecewise: a softmax layer over hashed chunk features (its unary
potentials), and pair potentials from the joint label shares of edges, both from base
spans as labels. Bounds: at most `sample` distinct texts, the first in the order of a
hash, and `sample_nodes` nodes of each. Everything else reads whole texts, one pass,
no shuffle.

Null or empty texts have no spans; equal texts get equal spans; without any base span
in the sample nothing is added. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import importable

# The kinds in the order of their listing, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

ANY = re.compile(r"[0-9@]")
CHUNK = re.compile(r"[A-Za-z0-9_.%+@()-]+")
EDGE = ".-_%"
BUCKETS = 4096
ROUNDS = 12
FEATURES = 10
NONE = "\x00"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += (2 * x - 9 if x > 4 else 2 * x) if i % 2 else x
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ and its domain to the left: the same spans as the plain pattern, in linear time."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        at = i = m.start()
        while i > free and text[i - 1] in LOCAL:
            i -= 1
        if i < at:
            out.append((i, m.end()))
            free = m.end()
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    if not text:
        return []
    out = [(i, 0, j) for i, j in emails(text)] if "@" in text else []
    if ANY.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = only_digits(m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m.group())) <= 15]
    return sorted(out)


def listed(spans) -> str:
    return ",".join([f"{KINDS[k]}:{i}:{j}" for i, k, j in spans])


@dataclass
class Graph:
    """Nodes of one text: where they stand, their hashed features, base label (-1: none), and edges (u, v, 0 chain / 1 skip)."""
    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    digits: list[int] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)


def shape(s: str) -> str:
    return "".join(["9" if c.isdigit() else "a" if c.isalpha() else c for c in s[:24]])


def squeezed(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape(s))


def features(chunk: str, before: str, after: str) -> list[int]:
    """What neighbouring numbers look like is left to the chain potential: as a feature it would teach the rules' own slips."""
    d = only_digits(chunk)
    parts = chunk.strip(EDGE).split(".")
    found = ("s" + shape(chunk), "q" + squeezed(chunk), f"n{min(len(d), 20)}", f"l{14 <= len(d) <= 19 and luhn(d)}{14 <= len(d) <= 19}",
             f"i{len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts)}",
             f"@{bool(DOMAIN.search(chunk))}{chunk.find('@') > 0}", f"+{chunk[:1] == '+'}",
             "b" + before[:24].lower(), "a" + after[:24].lower(), f"h{len(d) > 0}{any(c.isalpha() for c in chunk)}")
    out = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in found]
    for i, context in ((7, before), (8, after)):
        if ANY.search(context):
            out[i] = BUCKETS  # weighs nothing
    return out


def graph(text: str, base: list[tuple[int, int, int]], limit: int | None = None) -> Graph:
    g = Graph()
    if not ANY.search(text):
        return g
    names = {text[i:j].split("@")[0].lower() for i, k, j in base if k == 0}
    last: dict[str, int] = {}
    before, at, end_before = NONE, 0, -9
    chunks = CHUNK.finditer(text)
    m = next(chunks, None)
    while m and (limit is None or len(g.spans) < limit):
        chunk, i, j = m.group(), m.start(), m.end()
        m = next(chunks, None)
        word = chunk.strip(EDGE).lower()
        if ANY.search(chunk) or word in names:
            while at < len(base) and base[at][2] <= i:
                at += 1
            u = len(g.spans)
            g.label.append(base[at][1] if at < len(base) and base[at][0] < j else -1)
            g.spans.append((i, j))
            g.features.append(features(chunk, before, m.group() if m else NONE))
            if u and i - end_before <= 1:
                g.edges.append((u - 1, u, 0))
            d, like = only_digits(chunk), []
            g.digits.append(len(d))
            if len(word) >= 4:
                like.append("w" + word)
            if len(d) >= 7:
                like.append("d" + d[-7:])
            name = word.split("@")[0]
            if name in names:
                like.append("n" + name)
            for v in {last[k] for k in like if k in last}:
                g.edges.append((v, u, 1))
            last.update(dict.fromkeys(like, u))
            end_before = j
        before = chunk
    return g


@dataclass
class Field:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, OTHER + 1)))
    bias: np.ndarray = field(default_factory=lambda: np.where(np.arange(OTHER + 1) == OTHER, 9.0, 0.0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, OTHER + 1, OTHER + 1)))  # chain, skip

    def unary(self, g: list[list[int]]) -> np.ndarray:
        return self.weights[np.array(g, np.int64)].sum(1) + self.bias if g else np.zeros((0, OTHER + 1))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def marginals(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of all nodes by loopy sum-product messages; exact on trees no wider than `rounds`.

    `edges` has rows (u, v, potential); `pairs[potential][i, j]` is added for labels i of u and j of v.
    """
    n, k = unary.shape
    if len(edges):
        u, v, which = edges.T
        source, target = np.concatenate([u, v]), np.concatenate([v, u])
        table = np.concatenate([pairs[which], pairs[which].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        told = np.zeros((len(source), k))
        for r in range(rounds):
            belief = unary + np.stack([np.bincount(target, told[:, c], n) for c in range(k)], 1)
            new = log_sum((belief[source] - told[back])[:, :, None] + table, 1)
            new -= log_sum(new, 1)[:, None]
            told = new if not r else damping * told + (1 - damping) * new
        unary = unary + np.stack([np.bincount(target, told[:, c], n) for c in range(k)], 1)
    return np.exp(unary - log_sum(unary, 1)[:, None]) if n else unary


def _level(docs: DataFrame) -> DataFrame:
    """Texts with a digit or @ under `h`, and `level`, the length of their hash in bits: each level halves the one above."""
    out = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    out = out.withColumn("h", F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)))
    return out.withColumn("level", F.length(F.bin("h")))


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """At most `sample` distinct texts with a digit or @."""
    texts = _level(docs)
    per = {r.level: r.n for r in texts.groupBy("level").agg(F.count_distinct("h").alias("n")).collect()}  # 63 rows at most
    top, total = 0, 0
    while top < 63 and total + per.get(top + 1, 0) <= sample:
        top += 1
        total += per.get(top, 0)
    return texts.filter(F.col("level") <= top).groupBy("h").agg(F.first("text").alias("text")).select("text")


def _graphs(sample_nodes: int):
    def run(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                g = graph(text, base_spans(text), sample_nodes)
                out.append(([x if x >= 0 else OTHER for x in g.label], [x for f in g.features for x in f], [x for e in g.edges for x in e]))
            label, feats, edges = zip(*out) if out else ((), (), ())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in (label, feats, edges)], ["label", "features", "edges"])
    return run


def softmax_layer(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of hashed features by full-batch AdaGrad steps."""
    w, bias = np.zeros((BUCKETS + 1, OTHER + 1)), np.zeros(OTHER + 1)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(bias, 1e-6)
    goal = np.eye(OTHER + 1)[y]
    for _ in range(rounds):
        z = w[x].sum(1) + bias
        d = (np.exp(z - log_sum(z, 1)[:, None]) - goal) / len(y)
        grad = np.stack([np.bincount(x.ravel(), np.repeat(d[:, c], x.shape[1]), BUCKETS + 1) for c in range(OTHER + 1)], 1) + ridge / len(y) * w
        grad[BUCKETS] = 0
        seen_w += grad**2
        seen_b += d.sum(0)**2
        w -= rate * grad / np.sqrt(seen_w)
        bias -= rate * d.sum(0) / np.sqrt(seen_b)
    return w, bias


def fit(docs: DataFrame, sample: int = 4_000, sample_nodes: int = 50) -> Field:
    """The field of a table of documents; at most `sample` * `sample_nodes` nodes reach the driver, as numbers."""
    importable(docs.sparkSession)
    rows = sampled(docs, sample).mapInArrow(_graphs(sample_nodes), "label array<int>, features array<int>, edges array<int>").collect()
    rows = sorted((list(r.label), list(r.features), list(r.edges)) for r in rows)  # any order of arrival gives the same field
    y = np.array([x for r in rows for x in r[0]], np.int64)
    out = Field()
    if not len(y) or (y == OTHER).all():
        return out
    out.weights, out.bias = softmax_layer(np.array([x for r in rows for x in r[1]], np.int64).reshape(len(y), FEATURES), y)
    joint = np.zeros((2, OTHER + 1, OTHER + 1))
    for label, _, edges in rows:
        for u, v, which in zip(edges[::3], edges[1::3], edges[2::3]):
            joint[which, label[u], label[v]] += 1
    for which in range(2):
        n = joint[which] + (joint[which].T if which else 0)
        expected = np.outer(n.sum(1), n.sum(0)) / max(1.0, n.sum())
        # observed against independent labels, shrunk to no say where edges of a kind are few
        out.pairs[which] = np.log((n + 2) / (expected + 2))
    return out


def added(graphs: list[Graph], model: Field, min_prob: float) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to each text, from one run over all their graphs."""
    starts = np.concatenate([[0], np.cumsum([len(g.spans) for g in graphs])]).astype(np.int64)
    unary = model.unary([f for g in graphs for f in g.features])
    label = np.array([x for g in graphs for x in g.label], np.int64)
    fixed = label >= 0
    unary[fixed] = np.where(np.arange(OTHER + 1)[None] == label[fixed, None], 0.0, -30.0)
    edges = np.array([(u + s, v + s, w) for g, s in zip(graphs, starts.tolist()) for u, v, w in g.edges], np.int64).reshape(-1, 3)
    p = marginals(unary, edges, model.pairs)
    best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
    new = ~fixed & (best != OTHER) & (p.max(1) >= min_prob) if len(p) else np.zeros(0, bool)
    out = []
    for g, s in zip(graphs, starts.tolist()):
        spans, end, digits = [], -2, 0
        for u in np.flatnonzero(new[s:s + len(g.spans)]).tolist():
            i, j, k = *g.spans[u], int(best[s + u])
            # groups of one number belong together, two whole numbers do not
            if spans and k >= 2 and spans[-1][1] == k and end == u - 1 and i - spans[-1][2] <= 1 and digits + g.digits[u] <= (19 if k == 2 else 15):
                spans[-1] = (spans[-1][0], k, j)
                digits += g.digits[u]
            else:
                spans.append((i, k, j))
                digits = g.digits[u]
            end = u
        out.append(spans)
    return out


def trimmed(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans without marks at their ends."""
    out = []
    for i, k, j in spans:
        while i < j and text[i] in EDGE:
            i += 1
        while i < j and text[j - 1] in EDGE:
            j -= 1
        if i < j:
            out.append((i, k, j))
    return out


def _find(model, min_prob: float):
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            graphs = [graph(t, s) if t else Graph() for t, s in zip(texts, base)]
            more = added(graphs, model.value, min_prob)
            spans = [sorted(s + trimmed(t, m)) if m else s for t, s, m in zip(texts, base, more)]
            counts = [[sum(k == kind for _, k, _ in s) for s in base] for kind in range(OTHER)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base], pa.string()),
                 pa.array([listed(s) for s in spans], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return run


def find(docs: DataFrame, model: Field, min_prob: float = 0.8) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans."""
    spark = docs.sparkSession
    importable(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _find(spark.sparkContext.broadcast(model), min_prob),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
