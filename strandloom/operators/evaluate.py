"""Evaluation: sensitivity, specificity, Jaccard, annotation introns, arm reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ["chrom", "start", "end"]
LEAST_INTRON, MOST_INTRON = 32, 350_000


def in_window(introns: DataFrame) -> DataFrame:
    return introns.where((F.col("end") - F.col("start") + 1).between(LEAST_INTRON, MOST_INTRON))


def coding_introns(cds: DataFrame) -> DataFrame:
    """Gaps of over one base between neighbouring CDS parts of a transcript.

    ``cds`` (chrom, parents, start, end); parents is a comma list."""
    parts = cds.select("chrom", F.explode(F.split("parents", ",")).alias("parent"), "start", "end")
    before = F.lag("end").over(W.partitionBy("chrom", "parent").orderBy("start", "end"))
    gaps = parts.withColumn("e", before).where(F.col("start") - F.col("e") > 1)
    return gaps.select("chrom", (F.col("e") + 1).alias("start"), (F.col("start") - 1).alias("end")).distinct()


def sn_sp(predicted: DataFrame, reference: DataFrame, levels: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """(level, sn, sp, common): shared introns of predictions with at least ``level`` reads.

    One full join by place and one aggregate give every level."""
    p = in_window(predicted).groupBy(*PLACE).agg(F.max("mult").alias("mult"))
    both = p.join(reference.select(*PLACE).distinct().withColumn("known", F.lit(1)), PLACE, "full")
    rows = both.select(F.explode(F.array(*map(F.lit, levels))).alias("level"), "mult", "known")
    said, known = F.coalesce(F.col("mult") >= F.col("level"), F.lit(False)), F.col("known").isNotNull()
    out = rows.groupBy("level").agg(F.count_if(said & known).alias("common"), F.count_if(said).alias("n_pred"), F.count_if(known).alias("n_ref"))
    return out.select("level", "common", F.try_divide(F.col("common").cast("double"), "n_ref").alias("sn"), F.try_divide(F.col("common").cast("double"), "n_pred").alias("sp"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select(*PLACE).distinct().withColumn("in_a", F.lit(1)).join(b.select(*PLACE).distinct().withColumn("in_b", F.lit(1)), PLACE, "full")
    common = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull())
    return both.agg(common.alias("common"), F.count("*").alias("either"), F.try_divide(common.cast("double"), F.count("*")).alias("jaccard"))


def arm_report(timings: DataFrame, base: str) -> DataFrame:
    """Sums of each arm's phases and its speed-up over the arm ``base``."""
    w = F.coalesce("n_batches", F.lit(1))
    arms = timings.groupBy("arm").agg(F.sum(w).alias("n_batches"), F.sum(F.when(F.col("success") == 0, w).otherwise(0)).alias("n_rejected"), *[F.sum(c).alias(c) for c in ("t_download", "t_align", "t_scan", "t_db", "t_estimate", "t_batch")])
    one = arms.where(F.col("arm") == base).select(F.col("t_batch").alias("t_base"))
    return arms.crossJoin(F.broadcast(one)).withColumn("speed_up", F.try_divide("t_base", "t_batch")).drop("t_base")  # the right side is one row


def log_phases(log: DataFrame) -> DataFrame:
    """(batch, t_align, t_scan, t_download) from log lines (line_no, value).

    Batches start at lines that begin with 'Batch '; a batch counts once its three marks and the
    next batch are there."""
    ts = F.to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1))
    msg = F.regexp_extract("value", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \w+ [\w.]+: (.*)", 1)
    rows = log.where(F.col("value").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \w+ [\w.]+: ")).select("line_no", ts.alias("ts"), msg.alias("msg"))
    order = W.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("batch", F.count_if(F.col("msg").startswith("Batch ")).over(order)).where("batch > 0")
    mark = lambda test: F.min_by("ts", F.when(test, F.col("line_no")))
    b = rows.groupBy("batch").agg(F.min_by("ts", "line_no").alias("t0"), mark(F.col("msg").startswith("HISAT2")).alias("align"), mark(F.col("msg").contains("UMRs across")).alias("scan"), mark(F.col("msg").startswith("fastq-dump")).alias("dump"))
    b = b.withColumn("next", F.lead("t0").over(W.orderBy("batch")))
    s = lambda x, y: (F.col(y).cast("long") - F.col(x).cast("long")).cast("double")
    return b.where("align is not null and scan is not null and dump is not null and next is not null").select("batch", s("align", "scan").alias("t_align"), s("scan", "dump").alias("t_scan"), s("dump", "next").alias("t_download"))
