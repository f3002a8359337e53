"""Readers of the engine's own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Batch timings with a header line; n_batches may be missing."""
    df = spark.read.csv(path, sep="\t", header=True)
    kinds = dict(c.strip().split(" ") for c in schema.TIMING.split(","))
    have = [F.col(c).try_cast(k).alias(c) for c, k in kinds.items() if c in df.columns]
    return df.select(*have, *([F.lit(1).alias("n_batches")] if "n_batches" not in df.columns else []))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, tile_idx, n) of coverage lines 'chrom:idx;n'."""
    m = r"^(.*):(\d+);(\d+)$"
    part = lambda k: F.regexp_extract("value", m, k)
    return spark.read.text(path).where(F.col("value").rlike(m)).select(part(1).alias("chrom"), part(2).cast("long").alias("tile_idx"), part(3).cast("long").alias("n"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """Ranking rows by header name; columns that an older file lacks are null."""
    df = spark.read.csv(path, sep="\t", header=True)
    kinds = dict(c.strip().split(" ") for c in schema.SCREEN.split(",")) | {"rank": "int", "gain": "double", "bioproject": "string"}
    return df.select(*[(F.col(c).try_cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])


def tile_weights(spark: SparkSession, path: str) -> DataFrame:
    """(acc, chrom, tile_idx, w) of weight lines, compressed or not."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[0].alias("acc"), f[1].alias("chrom"), f[2].cast("long").alias("tile_idx"), f[3].cast("double").alias("w"))


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
