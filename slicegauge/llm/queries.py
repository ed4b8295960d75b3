"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import (collocations, imatch, minhash_star, mixing_coder, pareto_mix, pii_crf, quality_ratio, slot_shards, square_pack, token_align,
               toxicity_fst, url_trees, warc_derive)
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_minhash_star(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_star.cluster(table(spark, folder, "documents"))


@query
def op5_quality_ratio(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_ratio.fit(docs, quality_ratio.trusted_sample(table(spark, folder, "labels")))
    return quality_ratio.judge(docs, model)


@query
def op7_toxicity_fst(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity_fst.judge(docs, toxicity_fst.fit(docs, table(spark, folder, "labels")))


@query
def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = pareto_mix.measure(table(spark, folder, "documents"))
    goals = pareto_mix.targets(rows)
    taken = pareto_mix.mix(rows, pareto_mix.cuts(rows, goals), size="size", bits="draw")
    return taken.select("doc_id", "source", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
                        (F.col("_mix_copies") * F.col("size")).alias("taken"))


@query
def op8_square_pack(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return square_pack.digest(square_pack.pack(table(spark, folder, "documents"), path, end_id=1), "closed")


@query
def op2_slot_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = slot_shards.records(table(spark, folder, "documents"))
    sums = slot_shards.slot_sums(rows)
    path = f"{checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    slot_shards.write_map(spark, path, 0, slot_shards.first_map(sums, 40), sums)
    placed = slot_shards.place(rows, slot_shards.read_map(spark, path))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query
def op9_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


URL_RULES = [url_trees.Rule("com", "/", "allow"), url_trees.Rule("example.com", "/en/", "block"),
             url_trees.Rule("www.example.com", "/en/", "allow"), url_trees.Rule("net", "/es/", "block"), url_trees.Rule("net", "/fr/", "block")]


@query
def op10_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    urls = url_trees.with_rule(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    labelled = urls.withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    judged = url_trees.judge(urls, url_trees.fit(labelled, urls))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op3_mixing_coder(spark: SparkSession, folder: str) -> DataFrame:
    files = mixing_coder.new_folder(checkpoint_dir(spark))
    mixing_coder.write_ids(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), files)
    return mixing_coder.read_ids(spark, files).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op6_warc_derive(spark: SparkSession, folder: str) -> DataFrame:
    return warc_derive.derive(warc_derive.responses(table(spark, folder, "pages")))


_PHRASES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')), '[^ \t]+') AS w FROM d),
     g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
     x AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS size FROM g),
     f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= 100),
     words AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
     cand AS (SELECT * FROM f WHERE size > 1),
     inner_ AS (SELECT lang, array_to_string(string_split(phrase, ' ')[b:b + m - 1], ' ') AS phrase, n
        FROM (SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM cand))),
     open_ AS (SELECT c.* FROM cand c LEFT JOIN (SELECT lang, phrase, max(n) AS longer FROM inner_ GROUP BY ALL) i
        ON c.lang = i.lang AND c.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 100 * c.n),
     cut AS (SELECT *, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, size)) AS k FROM open_)),
     s AS (SELECT c.lang, c.phrase, c.n AS a, c.k, h.n AS l, t.n AS r, w.n,
        (1000 * CAST(c.n AS HUGEINT) * CAST(w.n AS HUGEINT)) // (CAST(h.n AS HUGEINT) * CAST(t.n AS HUGEINT)) AS score
        FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN words w ON w.lang = c.lang),
     best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
    CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000"""


@query
def op11_son_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op11_son_collocations"] = _PHRASES_SQL


@query
def op12_lockstep_align(spark: SparkSession, folder: str) -> DataFrame:
    return token_align.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_skip_chain_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii_crf.find(docs, pii_crf.fit(docs))
