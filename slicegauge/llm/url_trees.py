"""URL filter: rules, and boosted trees on lexical features for the rest (operator 10).

The longest fitting rule decides a url. Urls without a rule are judged by
gradient-boosted trees over their lexical form: lengths, depth, digit and hyphen
ratios, character entropy, parameter counts and statistics of the host's suffix.
The trees are trained on labelled urls: any table (url, label), label 1 for
block. The query takes the urls that a rule decides as its labels.

Training uses at most `limit` labelled urls, in the order of a hash of the url;
suffix statistics of the labels come from the same sample, suffix counts from
all urls. A suffix without a labelled url tells nothing, so its urls are judged
by a second model that sees the lexical form only. Every url is scored. With labels of one class only, that class is the
verdict; without any, allow.

Null urls and urls without :// have an empty host and path and fit no rule.
Repeated and tied rows get equal verdicts. Columns other than the id and the url
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds host, path, rule and rule_verdict. `rules` is a short list; the longest one that fits wins."""
    host, path = host_path(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", name).withColumn("rule_verdict", verdict)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda c: c == x)) / n)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def suffix() -> Column:
    return F.element_at(F.split("host", r"\."), -1)


BROADCAST_SUFFIXES = 10_000
FORM = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphen_ratio", "host_entropy",
            "path_entropy", "parameters", "query_length", "has_fragment"]
SUFFIX_FEATURES = ["suffix_log_count", "suffix_block_share", "suffix_labelled"]


def lexical(urls: DataFrame) -> DataFrame:
    """The features of a url's own form; needs url, host, path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": count(F.col("path"), "/").cast("double"),
        "labels": (count(F.col("host"), ".") + 1).cast("double"), "digit_ratio": count(url, "0123456789") / n,
        "hyphen_ratio": count(F.col("host"), "-") / F.greatest(F.length("host"), F.lit(1)),
        "host_entropy": entropy(F.col("host")), "path_entropy": entropy(F.col("path")),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0), "query_length": F.length(query).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"), "suffix": suffix()})


@dataclass
class UrlModel:
    suffixes: DataFrame  # suffix, suffix_log_count, suffix_block_share, suffix_labelled
    trees: GBTClassificationModel | None
    form_trees: GBTClassificationModel | None = None  # for suffixes without labels
    constant: float = 0.0


def with_suffix(lex: DataFrame, suffixes: DataFrame) -> DataFrame:
    out = lex.join(suffixes, "suffix", "left")
    return out.fillna({"suffix_log_count": 0.0, "suffix_block_share": 0.5, "suffix_labelled": 0.0})


def fit(labelled: DataFrame, urls: DataFrame, limit: int = 20_000, rounds: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Train on at most `limit` rows of `labelled` (url, host, path, label)."""
    sample = lexical(labelled.filter("label IS NOT NULL AND url IS NOT NULL")
                     .orderBy(F.xxhash64("url"), "url", "label").limit(limit))
    counts = urls.groupBy(suffix().alias("suffix")).agg(F.log1p(F.count(F.lit(1))).alias("suffix_log_count"))
    known = sample.groupBy("suffix").agg(((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("suffix_block_share"),
                                         F.log1p(F.count(F.lit(1))).alias("suffix_labelled"))
    suffixes = materialize(counts.join(known, "suffix", "left"))
    if suffixes.count() <= BROADCAST_SUFFIXES:  # a few hot suffixes would else be the only keys of a shuffle
        suffixes = F.broadcast(suffixes)
    classes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return UrlModel(suffixes, None, constant=float(next(iter(classes), 0)))
    train = with_vectors(with_suffix(sample, suffixes)).select("x", "x_form", F.col("label").cast("double").alias("label")).coalesce(4)
    models = [GBTClassifier(featuresCol=x, labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(train)
              for x in ("x", "x_form")]
    return UrlModel(suffixes, *models)


def with_vectors(rows: DataFrame) -> DataFrame:
    rows = VectorAssembler(inputCols=FORM + SUFFIX_FEATURES, outputCol="x").transform(rows)
    return VectorAssembler(inputCols=FORM, outputCol="x_form").transform(rows)


def block_probability(rows: DataFrame, trees: GBTClassificationModel, name: str) -> DataFrame:
    trees = trees.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_p")
    return trees.transform(rows).withColumn(name, F.get(vector_to_array("_p"), 1)).drop("_p")


def judge(urls: DataFrame, model: UrlModel) -> DataFrame:
    """Adds block_score, and verdict: the rule's where there is one, else the trees'."""
    if model.trees is None:
        out = urls.withColumn("block_score", F.lit(model.constant))
    else:
        x = with_vectors(with_suffix(lexical(urls), model.suffixes))
        out = block_probability(block_probability(x, model.trees, "_known"), model.form_trees, "_form")
        out = out.withColumn("block_score", F.when(F.col("suffix_labelled") > 0, F.col("_known")).otherwise(F.col("_form")))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict)
