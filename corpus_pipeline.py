"""A training corpus from documents: toxicity, near-duplicates, benchmark, mix, token ids.

Every stage gets all documents that the one before kept, as a table read back from the
shared folder, so a lost executor costs at most one stage. All stages but the last
return documents with the columns they came with; the last returns the records of the
token store it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import table
from gleanery.llm.cube import mix_documents
from gleanery.llm.simhash import drop_near_duplicates
from gleanery.llm.suffix_arrays import decontaminate
from gleanery.llm.token_files import stored_documents
from gleanery.llm.toxicity import drop_toxic
from gleanery.session import remove_folder, scratch_tables, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, written, indexed and read back."""
    return stored_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

# Boosted trees, XXH64 fingerprints, random draws and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Once a stage is written, the tables it needed for itself
    and the output of the stage before go; the token store of the last stage stays."""
    docs, before = table(spark, sf_dir, "documents"), scratch_tables(spark)
    for name, stage in STAGES:
        passed = scratch_tables(spark) - before
        docs = written(stage(spark, docs, sf_dir), name)
        for folder in passed:
            remove_folder(spark, folder)
    return docs
