"""The pipeline as a whole and the registered tokenizer and code queries, over the driver's smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from graphloom.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


def test_pipeline_packs_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(DATA)).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert pieces and {p.doc_id for p in pieces} <= ids
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for row in places.values():  # gapless from 0, at most a sequence long
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("op11_sentencepiece_agenda", "documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
        ("op12_cross_tokenizer_alignment", "documents", ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]),
        ("op13_gnat_product_codes", "embeddings", ["vec_id", "code", "error", "label_error", "codebooks_sha256"]),
    ],
)
def test_whole_tables(spark, name, table, columns):
    out = registry.QUERIES[name](spark, str(DATA))
    assert out.columns == columns and out.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
