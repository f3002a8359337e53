"""Candidate runs: filters, balanced sampling, availability, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.genomics import batches_of, platform_fits
from ..functions.order import running_sum


def usable_runs(runs: DataFrame, long_reads: bool = False, paired_only: bool = False) -> DataFrame:
    out = runs.where(~F.col("colorspace") & platform_fits(F.col("platform"), long_reads))
    return out.where("paired") if paired_only else out


def left_out_by_platform(runs: DataFrame, long_reads: bool = False) -> DataFrame:
    return runs.where(~F.col("colorspace") & ~platform_fits(F.col("platform"), long_reads)).groupBy("platform").agg(F.count("*").alias("n_runs"))


def first_runs(runs: DataFrame, limit: int, order: str = "accession") -> DataFrame:
    return runs.orderBy(order).limit(limit)


def round_robin(runs: DataFrame, limit: int = 0) -> DataFrame:
    """Project-balanced order: depth by sha1 of accession in its project, then sha1 of project.

    ``position`` counts from 1; with a limit only the first rows stay."""
    bucket = F.when(F.coalesce(F.col("bioproject"), F.lit("")) != "", F.col("bioproject")).otherwise(F.concat(F.lit("\x00"), "accession"))
    rows = runs.withColumn("bucket_hash", F.sha1(bucket.cast("binary"))).withColumn("own_hash", F.sha1(F.col("accession").cast("binary")))
    rows = rows.withColumn("depth", F.row_number().over(W.partitionBy("bucket_hash").orderBy("own_hash", "accession")) - 1)
    order = [F.col("depth"), F.col("bucket_hash")]
    if limit > 0:
        rows = rows.orderBy(*order).limit(limit)  # a top-k, so that only k rows meet for the numbering
    return rows.withColumn("position", F.row_number().over(W.orderBy(*order))).drop("bucket_hash", "own_hash")


def availability_todo(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """Runs whose availability is unknown: not in the cache, or in error there."""
    return requested.join(cache.where("status <> 'error'"), "accession", "left_anti")


def refreshed_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows in place of old ones."""
    return cache.join(new, "accession", "left_anti").unionByName(new)


def top_up(ordered: DataFrame, wanted: int) -> DataFrame:
    """Runs in order up to the one that makes ``wanted`` available ones; (position, accession, status)."""
    available = F.coalesce(F.col("status") == "available", F.lit(False)).cast("int")
    return running_sum(ordered, "position", available, "before", own=False).where(F.col("before") < wanted).drop("before")


def batch_ranges(runs: DataFrame, size: int) -> DataFrame:
    """(accession, k, n, x): spot ranges, inclusive, the last one possibly short."""
    rows = runs.select("accession", "total_spots", F.explode(F.sequence(F.lit(0).cast("long"), batches_of(F.col("total_spots"), size) - 1)).alias("k"))
    return rows.select("accession", "k", (F.col("k") * size).alias("n"), F.least((F.col("k") + 1) * size - 1, F.col("total_spots") - 1).alias("x"))


def shuffled_ranges(runs: DataFrame, size: int, seed: int) -> DataFrame:
    """Batch ranges with ``visit`` from 0: in hashed order, the last (possibly short) batch last."""
    rows = batch_ranges(runs, size).withColumn("last", F.col("x") >= F.max("x").over(W.partitionBy("accession")))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), "accession", F.col("k").cast("string")).cast("binary"))
    return rows.withColumn("visit", F.row_number().over(W.partitionBy("accession").orderBy("last", hashed, "k")) - 1).drop("last")


def duplicate_names(libraries: DataFrame) -> DataFrame:
    return libraries.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def unsampled(known: DataFrame, processed: DataFrame) -> DataFrame:
    return known.select("accession").subtract(processed.select("accession")).withColumn("status", F.lit("unsampled"))
