"""Corpus pipeline: quality, toxicity, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
stage's rows in the shared folder and hands what it rereads to the next.  All but the
last return the columns of documents.

Defined results: null and empty texts fail the quality rules and go there; a null doc_id,
lang, source or n_chars is kept; very long texts pass through whole; ties between
near-duplicates go to the smaller doc_id, then to the row hash; rows equal in id and text
are one after near-dedup, different texts that share an id stay apart; an empty table
gives no rows; further columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalens.llm.mixing import repeated
from stratalens.llm.packing import INSTRUCTION_LIMITS, pack_digest
from stratalens.llm.quality import kept
from stratalens.llm.simhash import one_per_group
from stratalens.llm.toxicity import clean, toxicity_model
from stratalens.llm.util import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return kept(docs.select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones of its input."""
    return clean(docs.select(*COLUMNS), toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return one_per_group(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeated(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of at most 2048 tokens."""
    return pack_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), **INSTRUCTION_LIMITS)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: the stages cannot be put in SQL (compression, learned scores, fingerprints, tokens); tests/llm hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
