"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes the documents that its predecessor kept, is written as Parquet to the shared folder, and is read again by
the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm.bpe import token_digests
from ledgerspark.llm.common import ship, small_batches, table
from ledgerspark.llm.decontaminate import remove_contamination
from ledgerspark.llm.jaccard import keep_one_of_each
from ledgerspark.llm.langid import keep_identified
from ledgerspark.llm.pii import mask_pii
from ledgerspark.session import shared_dir


def prepare(spark: SparkSession) -> None:
    """What a stage needs of its session: the package on the executors, and batches of bounded size."""
    ship(spark)
    small_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without any letter go, and those that no language's code word is near to."""
    prepare(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8 or more."""
    prepare(spark)
    return keep_one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are mostly such passages go."""
    prepare(spark)
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with e-mail and IP addresses, card and phone numbers masked."""
    prepare(spark)
    return mask_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the tokens of each document, and the digest of the text decoded from them."""
    prepare(spark)
    return token_digests(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Trained models, prefix filters and BPE are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
