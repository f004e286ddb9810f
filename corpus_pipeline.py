"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame with the columns of ``documents``
(the last adds ``rate`` and ``unmet``); it is written as Parquet and read again as the next one's ``docs``.

Defined results: a null text is an empty text, which the quality rules reject; null keys are
carried by all stages; repeated rows are exact copies of each other: one stays; of a group of near
copies the document with the least id stays, a tie of ids goes to one of them; columns beyond those
of ``documents`` are carried, and added names are lengthened where they clash; an empty table
passes through as an empty one. The last stage keeps every row: a rate of 0 is a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmill.llm import decontaminate, mixing, pii, quality_rules, simhash
from starmill.llm.queries import table
from starmill.sources.workdir import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate in the mixture; what the targets ask for beyond the documents that
    are left (the quality rules have removed most poor ones) is told as ``unmet``."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixture),
]

#: SimHash over XXH64, Hamming windows and fitted rates have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
