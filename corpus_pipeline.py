"""Documents to packed training sequences, stage by stage; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.line_dedup import stage_lines
from tessera.llm.mixing import stage_mixing
from tessera.llm.packing import stage_packing
from tessera.llm.quality_rules import stage_quality
from tessera.llm.shared import materialise, table
from tessera.llm.simhash_groups import stage_simhash

STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("simhash_near_dedup", stage_simhash),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL has neither the tokenizer nor fingerprints; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
