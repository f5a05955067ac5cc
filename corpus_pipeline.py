"""Documents to training data: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as Parquet to the shared folder and
reads again for the next one.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import pii
from trailmark.llm.bpe import bpe_encode
from trailmark.llm.common import deleted, scratch, shared_folder, table, written
from trailmark.llm.decontaminate import clean_documents
from trailmark.llm.language import accepted_documents
from trailmark.llm.ngram_join import one_of_each_class
from trailmark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` becomes the predicted one."""
    return accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar 5-gram sets."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by marks."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed unsigned 32-bit, little-endian) of each document; other columns but the text are kept unless they have the names of the new ones."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids"))
    return bpe_encode(docs, tokenizer_path(), keep=keep)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]

#: SQL expresses neither compression classifiers nor byte-pair merging; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage wrote on its way, and its input once the next one is written, is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path=path)
        if before:
            deleted(spark, before)
        before = path
    return docs
