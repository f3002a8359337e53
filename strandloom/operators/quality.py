"""Batch quality: uniqueness, gates, statistics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import mapped


def primary(aln: DataFrame) -> DataFrame:
    """Without secondary and supplementary records; unmapped ones stay."""
    return aln.where(F.col("flag").bitwiseAND(256 + 2048) == 0)


def uniqueness_long(aln: DataFrame, least_mapq: int, *more: str) -> DataFrame:
    """num_uniq and uniq_pct: mapped primary records, and the share with enough quality."""
    rows = mapped(primary(aln))
    grouped = rows.groupBy(*more) if more else rows
    uniq = F.count_if(F.col("mapq") >= least_mapq)
    return grouped.agg(F.count("*").alias("n_primary"), uniq.alias("num_uniq"), F.coalesce(F.try_divide(100.0 * uniq, F.count("*")), F.lit(0.0)).alias("uniq_pct"))


def uniqueness_short(batches: DataFrame, batch_size: int) -> DataFrame:
    """uniq_pct from num_uniq: single batches count ``batch_size`` spots even if short, merged ones
    their real range."""
    spots = F.when(F.col("n_batches") > 1, F.col("x") - F.col("n") + 1).otherwise(F.lit(batch_size))
    return batches.withColumn("uniq_pct", 100.0 * F.col("num_uniq") / spots)


def gate(batches: DataFrame, least_pct: float) -> DataFrame:
    return batches.withColumn("success", F.col("uniq_pct") >= least_pct)


def good_runs(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """Runs none of whose batches failed: a failure of any kind ends a run for good."""
    return runs.join(batches.where("not success").select("accession").distinct(), "accession", "left_anti")


def run_statistics(batches: DataFrame) -> DataFrame:
    """times_downloaded and averages weighted by batches, of accepted batches."""
    w = F.col("n_batches")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    return batches.where("success").groupBy("accession").agg(F.sum(w).alias("times_downloaded"), mean("uniq_pct").alias("avg_umr_pct"), mean("spliced_pct").alias("avg_spliced_pct"))


def smoothed_mean(stats: DataFrame, column: str, pseudo: int = 4) -> DataFrame:
    """(100 * pseudo + sum) / (pseudo + count) over runs with data."""
    return stats.agg(((100.0 * pseudo + F.coalesce(F.sum(column), F.lit(0.0))) / (pseudo + F.count(column))).alias("mean"))
