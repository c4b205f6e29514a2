"""A training-corpus pipeline over ``documents``: quality, near duplicates, benchmark passages, personal data, mix.

Every stage takes the documents that the stage before kept and returns documents again (the last one adds
``__drawn``: which time the document is taken, its output shard and its place there). Between stages the rows are
written as Parquet to the folder named in ``spark.checkpoint.dir`` and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilstream.llm.decontaminate import drop_contaminated
from veilstream.llm.mixing import mixed
from veilstream.llm.ngram_join import drop_near_duplicates
from veilstream.llm.pii_tagger import redact
from veilstream.llm.quality_trees import drop_low_quality
from veilstream.llm.registry import table
from veilstream.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least one half."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a noticeable share of benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mix", mix)]

#: Scores and tagged spans cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
