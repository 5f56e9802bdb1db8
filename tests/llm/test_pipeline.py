"""The pipeline on the small table: every stage by itself, against brute force over its own input."""

import corpus_pipeline
from cladeforge.llm import quality
from tests.conftest import DATA
from tests.llm.test_contracts import brute_quality, brute_suffixes


def test_stages(spark, duck):
    import sentencepiece

    from cladeforge.llm import mixing, pieces, suffixes

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.materialize(stage(spark, docs, DATA), "test"))
        docs = kept[-1]
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    assert all(k.columns == source.columns for k in kept[:-1])
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in source.collect() if brute_quality(r.text)[-1]}
    near = {r.doc_id: r.text for r in kept[1].collect()}
    assert len(set(near.values())) == len(near) and set(near) <= {r.doc_id for r in kept[0].collect()}
    gone = {r.text for r in kept[0].collect() if r.doc_id not in near}
    assert all(len(t.split()) > 0 for t in gone)
    rows = suffixes.remove_repeats(kept[1].select("doc_id", "text"))
    want = brute_suffixes(list(near.items()))
    from pyspark.sql import functions as F

    assert sorted(str(tuple(r)) for r in rows.select("doc_id", "__n_bytes", "__n_removed", "__n_spans", F.sha2("__kept", 256)).collect()) == want
    sizes = {r[0]: r[1] for r in kept[2].groupBy("source").agg(F.sum(mixing.word_count())).collect()}
    taken = {r[0]: r[1] for r in kept[3].groupBy("source").agg(F.sum(mixing.word_count())).collect()}
    assert taken == {p.name: p.words for p in mixing.plan_sources(list(sizes.items())) if p.words}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces._default_model())
    assert sorted(map(str, ((r.doc_id, r.token_ids) for r in kept[4].collect()))) == sorted(str((r.doc_id, sp.encode(r.text))) for r in kept[3].collect())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert quality.stage_quality(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(0), DATA).count() == 0
