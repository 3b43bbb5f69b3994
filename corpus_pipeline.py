"""A training-data pipeline over `documents`: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage gets what its predecessor kept, as a table written and read again, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewise.llm import decontam, linededup, mixing, neardup, quality
from pagewise.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade rejects go."""
    return quality.filtered(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for their first document's. Copies of whole
    documents stay whole, for the next stage to find."""
    return linededup.deduplicated(spark, docs, spare_copies=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicated(spark, docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.decontaminated(spark, docs, documents(spark, sf_dir, "benchmark"), threshold=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, epochs, repeats, taken."""
    return mixing.mix(spark, docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing_sources)]

#: SQL can express neither the quality cascade's word windows at this scale nor connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
