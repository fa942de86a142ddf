"""From raw documents to token ids: quality rules, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Stages only drop documents or lines, so all that is clean arrives as token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, decision_list, decontaminate, line_dedup, prob_minhash
from lexmill.llm.shared import Scratch, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no learned rule rejects."""
    return decision_list.apply(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that have come before; those of which no line is left go."""
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return prob_minhash.apply(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.apply(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip."""
    return bpe.encode(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("prob_minhash", near_duplicates), ("decontaminate", decontamination), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
