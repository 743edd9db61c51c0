"""From raw documents to token ids in five stages; each works on all rows that its predecessor kept.

All stages but the last return the columns of documents.  Nulls, empty and repeated rows go through as the
operators define.  Labels are read from the table beside the documents and never decide about a row directly.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gavelstat.llm import bpe, dart_minhash, digest_index, mixing, quality_ranker
from gavelstat.llm.frames import table
from gavelstat.workspace import materialize

#: The vocabulary that the last stage encodes with.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go."""
    return quality_ranker.keep_good(docs, quality_ranker.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact copies go; of equal texts the row with the largest doc_id stays."""
    return digest_index.temporary_index(spark).keep_new(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least doc_id stays."""
    return dart_minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian unsigned 32-bit integers) of every row."""
    return bpe.encode(docs, bpe.build(docs, VOCABULARY), keep=["doc_id", "source"])


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
