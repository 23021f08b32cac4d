"""A corpus pipeline of five stages over documents; each is written as Parquet and reread as the next one's input.

Every stage takes and returns rows, whatever is in them: a null text counts as empty and stays null until the last stage,
repeated rows are judged alike (copies of one id are no near copies of each other and stay), rows of a null id are never
taken for a copy, further columns are passed on by all stages but the last, and empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from lodestrata.llm.common import drop, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of the classifier, learnt from the labels, is below 0.7."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group that links of Jaccard 0.8 or more on five-word shingles connect."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words stand in benchmark windows."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by its kind."""
    return secrets.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256"), keep=("lang", "source", "n_chars"))


#: Name and function (spark, docs, sf_dir) -> DataFrame of each stage.
STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("tokens", tokenize)]

#: SQL can express neither a classifier's training nor byte-level BPE; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}", "snappy")
        if k:
            drop(before)
    return docs
