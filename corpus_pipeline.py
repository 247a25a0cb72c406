"""The corpus pipeline: documents in, tokens out, in five stages.

Each stage takes the documents that its predecessor kept and writes its result
as Parquet, which the next one reads; a stage that is lost is run again from
there. All stages but the last return the columns of documents.

1. quality: documents that the pairwise ranking rejects go.
2. near_dedup: of each group of near-duplicates (five-word shingles, Jaccard
   similarity of 0.8 or more) the document of the least id stays.
3. decontaminate: spans that occur in a benchmark item are cut out; documents of
   which more than half is such spans go.
4. secrets: secrets are replaced by a placeholder.
5. tokens: doc_id, n_tokens and the ids.

A table without rows goes through all stages; null and empty texts are scored
as any other, have no shingles, match nothing and encode to no ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paylens.llm import bpe, decontaminate, near_dedup, quality, secrets
from paylens.llm.common import prepare
from paylens.llm.queries import remainder_is


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder_is("doc_id", 5, 0)
    ranking = quality.learnt(docs, labels.where(~held_out), held_out)
    return quality.accepted(docs, ranking)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items, length_col="n_chars")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs, length_col="n_chars")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: Training, components and automata have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
