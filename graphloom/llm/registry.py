"""The production queries of the operators, each over its whole table, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, html_extract, mixing, packing, permutation_index, pii, product_codes, secrets, sentence_pieces, simhash, token_alignment, toxicity, warc
from graphloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's `spark.graphloom.pii.key`; where it has none, one is drawn for this call and forgotten."""
    key = spark.conf.get("spark.graphloom.pii.key", None) or token_hex(32)
    return pii.replace_pii(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), pieces_path())


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path())


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.product_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_salvage": op1,
    "op2_simhash_anchor_covering": op2,
    "op3_secrets_random_forest": op3,
    "op4_toxicity_ftrl": op4,
    "op5_mixing_soft_membership": op5,
    "op6_ann_permutation_index": op6,
    "op7_pii_surrogates": op7,
    "op8_packing_cutting_stock": op8,
    "op9_exact_dedup_chunk_recipes": op9,
    "op10_html_template_deduction": op10,
    "op11_sentencepiece_agenda": op11,
    "op12_cross_tokenizer_alignment": op12,
    "op13_gnat_product_codes": op13,
}

ORACLES: dict[str, str] = {
    "op1_warc_salvage": warc.OP1_SQL,
    "op9_exact_dedup_chunk_recipes": exact_dedup.OP9_SQL,
    "op13_gnat_product_codes": product_codes.OP13_SQL,
}
