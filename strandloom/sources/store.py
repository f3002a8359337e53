"""Store of a screen's results by run, from which a stopped screen goes on."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, path: str, chunk: int) -> None:
    """Write the rows (with ``acc``) of one chunk of runs.  A chunk that is written again replaces
    itself; others stay."""
    rows.withColumn("chunk", F.lit(chunk)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def newest(rows: DataFrame) -> DataFrame:
    """Rows of the last chunk of each run: a run that was screened again counts once."""
    last = rows.groupBy("acc").agg(F.max("chunk").alias("chunk"))
    return rows.join(last, ["acc", "chunk"], "left_semi").drop("chunk")


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return newest(spark.read.schema(f"{schema}, chunk int").parquet(path))


def resume(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, todo): the wanted runs (acc) that are stored, and those that are not.  A run whose
    screen ended in an error is to do again."""
    good = stored.where("status <> 'error'").select("acc")
    return wanted.join(good, "acc", "left_semi"), wanted.join(good, "acc", "left_anti")


def balanced_chunks(sizes: list[tuple[str, int]], chunks: int) -> list[list[str]]:
    """Runs of one chunk of a screen dealt to ``chunks`` tasks: the largest first, each to the task
    that has least so far (ties: the earlier run by name, the lower task)."""
    out: list[list[str]] = [[] for _ in range(chunks)]
    load = [(0, k) for k in range(chunks)]
    for acc, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        total, k = heapq.heappop(load)
        out[k].append(acc)
        heapq.heappush(load, (total + n, k))
    return out
