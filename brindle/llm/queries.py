"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import ann, decontamination, licenses, mixing, pii, simhash, substrings, tokens, toxicity, warc
from brindle.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The tokenizer of the registered queries; the operator takes any path, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_tokens": op5_tokens,
    "op6_mixing": op6_mixing,
    "op7_substrings": op7_substrings,
    "op8_decontamination": op8_decontamination,
    "op9_ann": op9_ann,
    "op10_warc": op10_warc,
}
#: For the others SQL has no hash, model, graph or file to compare with; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f
    """,
}
