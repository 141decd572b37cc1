"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing and packing over ``documents``."""

from __future__ import annotations

from caseweave.llm import stages
from caseweave.plans.scratch import Scratch, scope

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("suffix_dedup", stages.suffix_dedup),
    ("mix_sources", stages.mix_sources),
    ("pack", stages.pack),
]

#: Neither language likelihoods nor tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages in turn over ``documents``; what a stage keeps is written and read again by the next, and the tables that it worked with are removed."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope():
            following = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
