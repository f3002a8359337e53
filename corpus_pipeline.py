"""Documents from raw to packed, in five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from strandloom.llm.common import discard, durable, table, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with written() as made:
            last, docs = docs, durable(stage(spark, docs, sf_dir), name)
        discard(last, *(t for t in made if t is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
