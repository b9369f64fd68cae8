"""A corpus from `documents`: stages applied in turn, each written to the shared folder and read back by the next.

Every stage works on all that its predecessor kept; all but the last return rows of documents with all their columns,
extra ones included. Odd rows: a null or letterless text leaves at the first stage, so no empty text reaches the others; a null or
repeated doc_id is a row like any other and is decided by its text; of rows that repeat a text one stays, whatever
their ids; very long texts are read whole. An empty table, or one that a stage empties, gives empty results from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplecart.llm.common import saved, table
from ripplecart.llm.decontaminate import decontaminated
from ripplecart.llm.exact_dedup import exact_distinct
from ripplecart.llm.language_id import of_known_language
from ripplecart.llm.ngram_join import one_of_each
from ripplecart.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject; without labelled languages it knows none and rejects all."""
    return of_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return exact_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id's row of each component of documents with a similarity of 0.8 or more on five-word shingles; of rows that tie, one."""
    return one_of_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item, or the whole of a shorter item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in windows of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None
