"""Stages that turn raw documents into token ids; each takes and, but for the last, returns the columns of documents.

Defined cases of all stages: null and empty texts, null and repeated doc_ids, empty tables; columns beyond those of documents pass
through, whatever their names, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, minhash, mixing, secrets
from .common import free_name, small_batches

#: Transitions of the tokenizer: its workers share an executor with all that the JVM has grown to in the stages before.
TRANSITIONS = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing lang is filled in. Learns from the rows with lang that it is given.

    Rejected: null texts, texts without a letter, and those too far from all centroids.
    """
    small_batches(spark)
    names = [free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_cosine", "lang_rejected")]
    p = langid.predict(docs, langid.fit(docs.filter(F.col("lang").isNotNull())), names).filter(~F.col(names[3]))
    return p.select(*[F.coalesce("lang", names[0]).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8)."""
    small_batches(spark)
    return minhash.keep_one(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, and n_chars, where there is such a column, made to fit."""
    clean = secrets.redact(docs)
    fit = F.coalesce(F.length("text").cast("bigint"), "n_chars").alias("n_chars") if "n_chars" in docs.columns else None
    return clean.select(*[fit if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids."""
    small_batches(spark)
    import public_tokenizers

    e = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), transitions=TRANSITIONS)
    return e.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
