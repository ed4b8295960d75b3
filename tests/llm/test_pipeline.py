"""The pipeline's stages, each against a plain rule over what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from llm_helpers import edge_rows, words_of
from slicegauge.llm import minhash_star, pareto_mix, quality_ratio, toxicity_fst
from slicegauge.session import materialize


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "mix_sources", "packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], data)))
        assert kept[-1].columns == docs.columns
    ids = [Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality_ratio.fit(docs, quality_ratio.trusted_sample(labels))
    assert set(ids[1]) == {r.doc_id for r in quality_ratio.judge(docs, model).filter("kept").collect()}
    tox = toxicity_fst.judge(kept[1], toxicity_fst.fit(kept[1], labels))
    assert set(ids[2]) == {r.doc_id for r in tox.filter("predicted = 0").collect()}
    assert set(ids[3]) == {r.doc_id for r in minhash_star.cluster(kept[2]).filter("kept").collect()}
    rows = pareto_mix.measure(kept[3])
    taken = pareto_mix.mix(rows, pareto_mix.cuts(rows, pareto_mix.targets(rows)), size="size", bits="draw").collect()
    assert {d: n for d, n in ids[4].items()} == {r.doc_id: r["_mix_copies"] for r in taken if r["_mix_copies"]}
    clean = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    long = {r.doc_id for r in docs.collect() if len(words_of(r.text)) >= 50}
    assert len((clean & long) - set(ids[2])) <= 0.05 * len(clean & long)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], data).collect()
    starts = Counter(r.doc_id for r in pieces if r.start == 0)
    assert starts == ids[4]
    assert corpus_pipeline.STAGES[-1][1](spark, kept[4], data).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_run_applies_the_stages_in_order(spark, data, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [
        ("few", lambda spark, docs, folder: docs.filter("doc_id < 9")), ("odd", lambda spark, docs, folder: docs.filter("doc_id % 2 = 1")),
        ("ids", lambda spark, docs, folder: docs.select("doc_id"))])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, data).collect()) == [1, 3, 5, 7]


def test_edges(spark, data, edge, nothing):
    """Stage by stage, which rows stay; then every id of what is mixed lies in one piece."""
    n = len(edge_rows())
    for table in (edge, nothing):
        docs, sizes = table, []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = Counter(r.doc_id for r in docs.select("doc_id").collect())
            docs = materialize(stage(spark, docs, data))
            after = Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert set(after) <= set(before) and docs.columns == table.columns
            sizes.append(sum(after.values()))
        assert sizes[0] <= n and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= 3 * sizes[2]
        mixed = Counter(r.doc_id for r in docs.select("doc_id").collect())
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
        assert Counter(r.doc_id for r in pieces if r.start == 0) == mixed
        length = Counter()
        for r in pieces:
            assert 0 < r.length <= 2048
            length[r.doc_id] += r.length
        assert length == {r.doc_id: r.doc_tokens * mixed[r.doc_id] for r in pieces}
