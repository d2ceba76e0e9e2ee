"""The queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.alignment import op13_alignment
from tidemark.llm.ann import op3_ann
from tidemark.llm.centroids import op11_centroids
from tidemark.llm.mixing import op7_mixing
from tidemark.llm.ngram_join import op4_ngram_join
from tidemark.llm.oracle import ORACLE
from tidemark.llm.order_minhash import op2_order_minhash
from tidemark.llm.packing import op10_packing
from tidemark.llm.pii import op6_pii
from tidemark.llm.quality import op12_quality
from tidemark.llm.secrets import op8_secrets
from tidemark.llm.tokens import op5_token_files
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.warc import op9_warc

OPERATORS = (op1_toxicity, op2_order_minhash, op3_ann, op4_ngram_join, op5_token_files, op6_pii, op7_mixing, op8_secrets, op9_warc, op10_packing, op11_centroids, op12_quality, op13_alignment)


def minhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the fingerprints that SQL can state too."""
    return op2_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans, as counts and as a digest."""
    return op6_pii(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base findings, as counts and as a digest."""
    return op8_secrets(spark, sf_dir).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, minhash_edits, pii_base, secrets_base)}


def oracle_sql() -> dict[str, str]:
    """Models, sketches and file formats cannot be stated in SQL; the other operators are tested against brute force."""
    return dict(ORACLE)
