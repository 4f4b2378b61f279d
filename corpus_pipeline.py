"""Corpus preparation as one job: five operators, each on all that the one
before has kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)``. ``run`` applies them to ``documents``, writing each stage's result
as Parquet to the shared folder and reading it again, so that a lost executor
never costs more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import stages
from quire.llm.common import materialize, table
from quire.llm.queries import vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.cut_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("jaccard", near_copies), ("suffixes", repeats), ("secrets", secrets),
          ("packing", packing)]

#: Learned scores decide what is kept, which SQL can't express; the tests
#: compare each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
