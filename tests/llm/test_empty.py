"""Every operator and stage on tables without rows, and on rows of nulls only."""

import pytest

import corpus_pipeline
from cladeforge.llm import ann, html, mixing, pieces, quality, simhash, suffixes, token_files, urls, warc
from cladeforge.llm.common import scratch_path
from tests.conftest import DATA

DOCS, PAGES, VECTORS = "doc_id long, text string, lang string, source string, n_chars long", "page_id long, url string, html string", "vec_id long, embedding array<float>, label int"
STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 3])
def test_documents(spark, n):
    docs = spark.createDataFrame([(None,) * 5] * n, DOCS)
    assert quality.quality_digest(docs).where("NOT kept").count() == n
    assert simhash.near_duplicates(docs).where("component_id IS NULL AND fp = '0000000000000000'").count() == n
    assert suffixes.remove_repeats(docs).where("__n_removed = 0").count() == n
    assert mixing.mix(docs.withColumn("size", mixing.word_count())).where("taken = 0 AND target = 0").count() == n
    assert pieces.digest(docs, pieces._default_model()).where("n_tokens = 0 AND round_trip").count() == n
    assert sorted(r.start for r in token_files.store(docs, scratch_path(spark, "t"), tokenizer()).collect()) == list(range(n))


@pytest.mark.parametrize("name", list(STAGES))
@pytest.mark.parametrize("n", [0, 3])
def test_stages(spark, name, n):
    docs = spark.createDataFrame([(None,) * 5] * n, DOCS)
    assert STAGES[name](spark, docs, DATA).count() == {"quality rules": 0, "SimHash near-dedup": min(n, 1), "suffix-array dedup": n, "mixing sources to target weights": 0, "SentencePiece encoding and decoding": n}[name]


@pytest.mark.parametrize("n", [0, 3])
def test_pages_and_vectors(spark, n):
    pages = spark.createDataFrame([(None,) * 3] * n, PAGES)
    assert urls.filter_urls(pages).where("verdict = 'allow' AND host = ''").count() == n
    assert html.extract(pages).where("text = ''").count() == n
    assert warc.archive(pages, scratch_path(spark, "w")).where("record_type = 'response' AND payload_bytes = 0").count() == n
    vectors = spark.createDataFrame([(None,) * 3] * n, VECTORS)
    assert ann.search(vectors, vectors.vec_id % 100 == 0).count() == 0
