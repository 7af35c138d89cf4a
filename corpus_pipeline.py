"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

quality rules -> SimHash near-dedup -> benchmark decontamination -> masking of
personal data -> BPE tokens. Every stage works on all rows that the stage before
kept; all but the last return the columns of documents. Nulls, empty texts,
repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.bpe import bpe_stage
from quarry.llm.common import fresh_path, table
from quarry.llm.decontaminate import decontaminate_stage
from quarry.llm.pii_bootstrap import pii_stage
from quarry.llm.quality_rules import quality_stage
from quarry.llm.simhash import dedup_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines go from the others."""
    return quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return dedup_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked."""
    return pii_stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their digests and the text that they decode to."""
    return bpe_stage(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: Fingerprints, components, searches and merges can't be put as one SQL statement; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
