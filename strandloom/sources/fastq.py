"""Gzip FASTQ libraries: one pass turns them into a table keyed by spot; ranges are filters then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(lines: DataFrame) -> DataFrame:
    """(spot, name, seq, qual) of the lines (line_no, value) of one FASTQ file, spots from 0.

    ``line_no`` has no gaps.  A record with another shape than four lines, '@', '+', and as many
    qualities as bases raises an error, as do truncated and empty files.
    """
    four = lines.select(F.floor(F.col("line_no") / 4).cast("long").alias("spot"), (F.col("line_no") % 4).alias("k"), F.regexp_replace("value", r"\r$", "").alias("v"))
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    rows = four.groupBy("spot").agg(line(0).alias("head"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("qual"))
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.regexp_extract("head", r"^@(\S*)", 1)).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("spot").cast("string"))))
    return rows.select("spot", checked.alias("name"), "seq", "qual")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of one file.  Gzip text, also of several members, is one partition, whose row ids
    are line numbers; a larger plain file would not be, so it is read as one split."""
    lines = spark.read.option("wholetext", "false").text(path).coalesce(1).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return records(lines)


def ingest(spark: SparkSession, run: str, paths: list[str], out: str) -> None:
    """Write (run, mate, spot, name, seq) as Parquet, once; ranges then prune row groups."""
    table = None
    for mate, path in enumerate(paths, 1):
        part = read(spark, path).select(F.lit(run).alias("run"), F.lit(mate).alias("mate"), "spot", "name", "seq")
        table = part if table is None else table.unionByName(part)
    table.repartitionByRange("run", "spot").sortWithinPartitions("run", "spot", "mate").write.mode("overwrite").parquet(out)


def spot_range(table: DataFrame, run: str, n: int, x: int) -> DataFrame:
    """Spots n to x, both included; x may lie beyond the end."""
    return table.where((F.col("run") == run) & F.col("spot").between(n, x))


def mates_agree(table: DataFrame) -> DataFrame:
    """(run, n1, n2, agree): whether both mate files of each run have as many records."""
    n = table.groupBy("run").agg(F.count_if(F.col("mate") == 1).alias("n1"), F.count_if(F.col("mate") == 2).alias("n2"))
    return n.withColumn("agree", (F.col("n2") == 0) | (F.col("n1") == F.col("n2")))
