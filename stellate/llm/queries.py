"""The queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language_id, multiset_hash, near_dup, packing, pii, quality, token_store, toxicity, transducer, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return multiset_hash.edit_likeness(_table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids and read back."""
    manifest = token_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_store(spark, manifest)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.train_rows(docs))
    return language_id.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def pii_key(spark: SparkSession) -> bytes:
    """The session's key of pseudonyms (``spark.stellate.pii.key``); without one a public key for demonstrations, which hides nothing."""
    return spark.conf.get("spark.stellate.pii.key", "public demonstration key").encode()


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised."""
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_private", F.array_join("private_spans.kind", ",").alias("kinds"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *quality.BASE, "base_failed", "kept", "quality_probability")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    out = transducer.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "toxic_probability", "grade", "toxic")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP packages and read back."""
    packages = warc_zip.write_archives(_table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(spark, packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 from its hexadecimal digits: each ten of them are eight base32 digits.
_BASE32 = "string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1), '' ORDER BY i)"

_OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, {_BASE32} AS digest FROM (SELECT DISTINCT h FROM p), range(32) t(i) GROUP BY h),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN top END AS refers_to
FROM p JOIN d USING (h) JOIN m USING (h)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_best_fit_packing, op2_document_fingerprints, op3_token_store, op4_minhash_near_dedup, op5_language_id, op6_pii_pseudonyms, op7_quality_rules, op8_byte_bpe, op9_toxicity, op10_warc_zip)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc_zip": _OP10}
