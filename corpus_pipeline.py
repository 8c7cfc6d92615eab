"""A corpus pipeline over five of the operators: each stage works on the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from quern.llm.common import Scratch
from quern.llm.queries import table, tokenizer_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from labels of rows that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks of two or more lines but for the first of each."""
    return line_dedup.line_dedup(docs, counts=False)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of the smallest identifier."""
    return ngram_join.one_of_each(docs, 5, 80)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("ngram_join", near_copies_out), ("decontamination", leaks_out), ("packing", packed)]

#: SQL has neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again by the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
