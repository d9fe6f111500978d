"""Raw documents to token ids: language ID, near-duplicate removal, removal of repeated passages, decontamination, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontamination, jaccard_join, language_id, sentencepiece_codec, suffix_dedup
from glyphmill.llm.session import shared

STAGES = [
    ("language_id", language_id.stage),
    ("jaccard_join", jaccard_join.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontamination", decontamination.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: Most of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder, and are the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
