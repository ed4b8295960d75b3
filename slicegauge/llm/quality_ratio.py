"""Quality rules: text statistics and a hashed n-gram likelihood ratio (operator 5).

Two multinomials over hashed word n-grams are counted: one over a trusted
target (a bounded sample of the labelled good documents), one over every
document of the raw corpus. A document's score is its mean log ratio per
n-gram, so length does not matter: no sampling, no resampling.

The verdict takes the same mean with the target smoothed towards the corpus. One
cut decides every document alike: the threshold, or what trusted documents reach
when they are left out of the target, if that is lower. With few labels many
n-grams of good texts are not in the target, and the cut follows.

Null or empty texts: all statistics 0, score NULL, base_failed, not kept.
Repeated rows are judged alike. Without trusted documents every score is 0.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import importable, word_bytes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RatioModel:
    """Per bucket: log target probability less log corpus probability, for the score and for the verdict."""
    log_ratio: np.ndarray
    verdict: np.ndarray
    left_out: float = float("inf")  # low quantile of the trusted documents' verdict ratio, each left out of the target

    @property
    def buckets(self) -> int:
        return len(self.log_ratio)


def gram_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """Hash buckets of all unigrams and bigrams of already lower-cased words."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] + np.uint64(0x7F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    return np.concatenate([h * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(40), pairs >> np.uint64(40)]) % np.uint64(buckets)


def trusted_sample(labels: DataFrame, limit: int = 20_000) -> DataFrame:
    """At most `limit` ids labelled good, in the order of a hash of the id: the bound of the target's fit."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _counter(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            grams = {True: [], False: []}
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams[good].append(gram_buckets(word_bytes(text.lower() if text else text), buckets))
            for good, found in grams.items():
                if found:
                    c = np.bincount(np.concatenate(found).astype(np.int64), minlength=buckets)
                    raw += c
                    if good:
                        target += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])
    return run


def pulled(target, total, mass, p_raw):
    """Log ratio with `mass` pseudo counts dealt as the corpus is."""
    return np.log((target + mass * p_raw) / (total + mass)) - np.log(p_raw)


def base_passed(n: int, repeat: int, min_words: int) -> bool:
    return n >= min_words and 100 * repeat <= 50 * n


def _left_out(shared, mass: float, min_words: int):
    """The verdict ratio of trusted texts that pass the base rules, each against a target without it."""
    def run(batches):
        target, p_raw = shared.value
        total = target.sum()
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                n, _, _, _, repeat = statistics(text)
                if n and base_passed(n, repeat, min_words):
                    at, c = np.unique(gram_buckets(word_bytes(text.lower()), len(target)).astype(np.int64), return_counts=True)
                    out.append(float((pulled(target[at] - c, total - c.sum(), mass, p_raw[at]) * c).sum() / c.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["ratio"])
    return run


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, smoothing: float = 1.0, lost: float = 0.005,
        min_words: int = 50) -> RatioModel:
    """Count both multinomials, then score the trusted documents, each left out of the target.

    Only `buckets` sums and one number reach the driver, whatever the corpus. `lost`
    is the share of trusted documents that may fall below the cut.
    """
    importable(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select(F.col("doc_id").alias("_t"))), F.col("doc_id") == F.col("_t"), "left")
    counts = (marked.select("text", F.col("_t").isNotNull().alias("good"))
              .mapInArrow(_counter(buckets), "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return RatioModel(np.zeros(buckets), np.zeros(buckets))
    logp = lambda c: np.log(c + smoothing) - np.log(c.sum() + smoothing * buckets)
    p_raw, mass = (raw + smoothing) / (raw.sum() + smoothing * buckets), smoothing * buckets
    own = marked.filter("_t IS NOT NULL").select("text").mapInArrow(
        _left_out(docs.sparkSession.sparkContext.broadcast((target, p_raw)), mass, min_words), "ratio double")
    low = own.agg(F.percentile("ratio", F.lit(lost))).first()[0]
    return RatioModel(logp(target) - logp(raw), pulled(target, target.sum(), mass, p_raw), float("inf") if low is None else low)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(ids) < 3:
        return 0
    pairs = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 1 << 20:
        pairs, distinct_pairs = np.unique(pairs, return_inverse=True)[1], len(pairs)
        assert distinct_pairs * distinct < 1 << 62
    _, which, n = np.unique(pairs * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] >= 2
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k:len(ids) - 2 + k] |= again
    return int(hit.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = word_bytes(text)
    if not words:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return 0, 0, sum(raw.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))), 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids, len(seen))


def _judge(model):
    def run(batches):
        ratio, verdict = model.value.log_ratio, model.value.verdict
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                n, chars, symbols, dup, repeat = statistics(text)
                score = judged = None
                if n:
                    at = gram_buckets(word_bytes(text.lower()), len(ratio)).astype(np.int64)
                    score, judged = float(ratio[at].mean()), float(verdict[at].mean())
                rows.append((n, chars, symbols, dup, repeat, score, judged))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.float64()) for c in cols[5:]]],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "_judged"])
    return run


def judge(docs: DataFrame, model: RatioModel, threshold: float = -0.17, min_words: int = 50) -> DataFrame:
    """One row per document: statistics, score and both verdicts. One pass, no shuffle."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _judge(shared), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                        "n_repeat_words long, score double, _judged double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.coalesce(F.col("_judged") >= min(threshold, model.left_out), F.lit(False))).drop("_judged")


def _passes(model, threshold: float, min_words: int, column: int):
    def run(batches):
        ratio, cut = model.value.verdict, min(threshold, model.value.left_out)
        for b in batches:
            keep = []
            for text in b.column(column).to_pylist():
                n, _, _, _, repeat = statistics(text)
                keep.append(base_passed(n, repeat, min_words) and
                            float(ratio[gram_buckets(word_bytes(text.lower()), len(ratio)).astype(np.int64)].mean()) >= cut)
            yield b.filter(pa.array(keep, pa.bool_()))
    return run


def passing(docs: DataFrame, model: RatioModel, threshold: float = -0.17, min_words: int = 50) -> DataFrame:
    """The rows of `docs`, with all their columns, that `judge` keeps. No join, no shuffle."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_passes(shared, threshold, min_words, docs.columns.index("text")), docs.schema)
