"""From raw documents to packed training sequences, in five stages.

A null or empty text fails the quality rules and goes. A null doc_id is an id like any other (the
smallest for line dedup, after all others for near duplicates); a null source is a source of its
own. Rows that share an id are one document for line dedup and documents of their own elsewhere.
Repeated rows are near duplicates of each other, so one stays. Texts are worked on whole, whatever
their length. Ties are broken by id, then by hashes of the rows, so reruns agree. An empty table
gives an empty result. Extra columns, whatever their names, pass all stages but the last, which
returns token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm import jaccard, lines, mixing, packing, quality
from flowspark.llm._common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps; the ledger of all stays in the shared folder."""
    return quality.filter_documents(docs, quality.STANDARD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that the largest document holding them keeps."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a similarity of 0.8 or more on five-word n-grams."""
    return jaccard.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to the sources' targets under the standing schedule, in training
    order."""
    return mixing.arrange(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    return packing.pack(written(packing.pieces(docs), "pack-pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("sequence packing", sequence_packing),
]

#: SQL has no tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
