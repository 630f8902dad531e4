"""The corpus pipeline: classify, dedup lines, dedup documents, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all documents of its predecessor; its result is
written as Parquet and read again as the next stage's input. All but the last return the columns of
``documents``. SQL cannot express the stages, so ORACLE_SQL is None and tests compare each stage with
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocadence.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from geocadence.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go. It learns from the labels of ``sf_dir``."""
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality_classifier.scored(docs, net, name).where(F.col(name) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated lines go, and documents of which nothing is left."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sources at their target weights; a document taken twice is two rows."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of token sequences, with their ids."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
