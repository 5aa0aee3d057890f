"""From raw documents to a training mix, stage by stage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import stages
from graphloom.llm.common import durable

STAGES = [
    ("language_id", stages.language_id),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("decontaminate", stages.decontaminate),
    ("pii", stages.pii),
    ("mix", stages.mix),
]

#: Several stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of `sf_dir`; each stage's rows are written before the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
