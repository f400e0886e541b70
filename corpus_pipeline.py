"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapatch.llm import common, packing, queries, simhash, suffixes, toxicity

#: Documents of at least this toxicity go.
TOXIC_AT = 0.3


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_AT; the field is fitted on the table of labels.

    Null and empty texts have the score of a text without offending words and stay; repeated rows stay or go together;
    all columns are kept; an empty table stays empty, and without labels all documents stay.
    """
    common.small_batches(spark)
    field = toxicity.learned(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.below(docs, field, TOXIC_AT)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id, with all its columns.

    Links are those of op4_simhash, and besides those between texts whose five-word shingles are 0.8 alike or more.
    Null, empty and blank texts are one group, repeated rows are copies, null ids come last; an empty table stays empty.
    """
    return simhash.representatives(docs, by_prints=True)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 200 bytes or more that occur elsewhere; n_chars follows the text.

    Null texts stay null, short ones as they are; a text that is all repeated becomes empty; repeated rows lose their
    whole text if it is long enough; an empty table stays empty.
    """
    return suffixes.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens; null and empty texts have one token, repeated rows are packed each, an empty table has no pieces."""
    return packing.packed(docs, queries.vocab_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_copies_out), ("passages", passages_out), ("packing", packed)]

#: DuckDB can't express the stages: they learn, hash with XXH64 and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
