"""A corpus pipeline of the training-data operators, from ``documents`` to packed sequences.

Each stage takes all that the one before it kept and returns the columns of documents; the last returns
pieces with their places in sequences.  ``ORACLE_SQL`` is None: trained models, signatures and token ids
are beyond SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stellate.llm import near_dup, packing, pii, quality, toxicity
from stellate.llm.common import quoted, written
from stellate.llm.queries import pii_key


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't reject."""
    model = toxicity.fit(*_labelled(spark, sf_dir))
    return toxicity.score(docs, model).where("not toxic").select(*[quoted(c) for c in docs.columns])


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    model = quality.fit(*_labelled(spark, sf_dir))
    return quality.score(docs, model).where("kept").select(*[quoted(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.one_of_each(docs).select(*[quoted(c) for c in docs.columns])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data pseudonymised in their texts; ``n_chars`` follows the text."""
    out = pii.pseudonymize(docs, pii_key(spark))
    if "n_chars" in docs.columns:
        out = out.selectExpr(*[f"`{c}`" for c in out.columns if c != "n_chars"], "cast(char_length(text) as bigint) as n_chars")
    return out.select(*[quoted(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", of_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
