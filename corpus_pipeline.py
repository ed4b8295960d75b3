"""The corpus pipeline: documents in, packed training sequences out.

Quality rules and toxicity drop rows, near-dedup leaves one document of each
group, mixing repeats or leaves out documents by the sources' weights, packing
gives the pieces of 2048-token sequences. Every stage but the last returns the
columns it was given. Each reads all its predecessor kept; its result is written
once, so a lost executor repeats one stage's tasks at most.

Rows without text fail the quality rules; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicegauge.llm import minhash_star, pareto_mix, quality_ratio, square_pack, toxicity_fst
from slicegauge.llm.base import table
from slicegauge.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = quality_ratio.trusted_sample(table(spark, sf_dir, "labels"))
    return quality_ratio.passing(docs, quality_ratio.fit(docs, trusted))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_fst.passing(docs, toxicity_fst.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_star.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pareto_mix.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return square_pack.digest(square_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]
# The trained verdicts and the token ids are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
