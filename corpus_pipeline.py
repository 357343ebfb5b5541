"""A training-corpus pipeline: quality, near-duplicates, benchmark contamination, personal data, packing.

Every stage takes the table that the one before it wrote and returns all of its
columns, but for the last, which returns packed token pieces.  A stage only works
on what its predecessor kept.

In every stage null texts count as empty and stay null, very long texts are taken
whole, and an empty table gives an empty one.  Rows that repeat stay as often as they
come but in near-dedup, where a group keeps its row of least doc_id (ties: one of the
equal rows); rows without doc_id are kept, or go, by their text alone.  Private columns
have names that no column of the documents has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.common import staged, table
from lexiloom.llm.decontamination import remove_contaminated
from lexiloom.llm.packing import pack_documents
from lexiloom.llm.pii import mask_personal_data
from lexiloom.llm.quality import keep_good, train
from lexiloom.llm.simhash import keep_one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in as few sequences as best-fit packing finds."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
