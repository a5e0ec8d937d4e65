"""From raw documents to packed training sequences, in five written stages.

Each stage reads all that its predecessor wrote. The first four return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.common import drop_since, remove, shared_dir, written_so_far
from cadenza.llm.op2_line_dedup import stage_line_dedup
from cadenza.llm.op5_decontamination import stage_decontamination
from cadenza.llm.op6_packing import stage_packing
from cadenza.llm.op7_near_dedup import stage_near_dedup
from cadenza.llm.op8_quality_rules import stage_quality_rules

STAGES = [
    ("quality_rules", stage_quality_rules),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: Learned rules and BPE tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/cadenza/pipeline-{uuid.uuid4().hex}"
    before, last = written_so_far(), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_since(spark, before)  # what the stage wrote, and its input, are read no more
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
