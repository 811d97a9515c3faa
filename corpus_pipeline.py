"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, token output.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  Every stage works on all rows that the one before
kept, and all but the last return the columns of ``documents``.  ``run``
writes each stage's rows as Parquet into the shared folder and goes on from
the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm.common import stored, table
from rookery.llm.decontaminate import drop_contaminated
from rookery.llm.jaccard_join import keep_one_of_each
from rookery.llm.mixing import mixed_rows
from rookery.llm.queries import MIX_TARGETS, domain_labels, tokenizer_path
from rookery.llm.token_codes import token_output
from rookery.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    del sf_dir
    return keep_one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the languages' token shares are met; none is lost."""
    return mixed_rows(spark, docs, domain_labels(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable files; a row for each document read back."""
    del sf_dir
    return token_output(spark, docs, tokenizer_path=tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Models, components and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
