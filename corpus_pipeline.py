"""A training corpus from raw documents, stage by stage.

Each stage takes all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provisio.llm import decontam, pieces, pii, quality, simhash
from provisio.llm.common import table, written

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("pieces", pieces.stage),
]
#: Hashed fingerprints, fitted models and sampled pieces are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
