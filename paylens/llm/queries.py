"""The registered queries of these operators, with production parameters, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm import bpe, conversations, decontaminate, fingerprints, html_text, language, near_dedup, quality, secrets, spelling, token_count, top_search, url_filter
from paylens.llm.oracle import ORACLES  # noqa: F401

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder_is(column: str, modulus: int, value: int) -> Column:
    """Whether the CRC-32 of an id as text has a remainder; an id that is null has none."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == value, F.lit(False))


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, items))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), width=2, percent=80).drop("node")


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(_table(spark, folder, "pages"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(_table(spark, folder, "pages"), RULES)


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(_table(spark, folder, "documents"), remainder_is("doc_id", 4, 2))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = remainder_is("doc_id", 5, 0)
    ranking = quality.learnt(docs, labels.where(~held_out), held_out)
    return quality.scored(docs, ranking, held_out)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.secrets(_table(spark, folder, "documents")))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversations.turns(_table(spark, folder, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return conversations.prefix_trie(conversations.branched(turns, base, shared, most=3))


def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = top_search.integer_vectors(_table(spark, folder, "embeddings"))
    return top_search.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.words(_table(spark, folder, "documents"), every=31), times=10)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_fingerprints, op2_decontamination, op3_near_dedup, op4_html_text, op5_url_filter,
            op6_language, op7_token_counts, op8_quality, op9_bpe, op10_secrets, op11_conversation_trie,
            op12_exact_top_k, op13_spelling_variants,
        )
    }
