"""Uniquely mapped reads per genome tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genomics import tile_index

TILE_SIZE = 5000


def mapped(aln: DataFrame) -> DataFrame:
    return aln.where((F.col("flag").bitwiseAND(4) == 0) & F.col("chrom").isNotNull())


def read_tiles(aln: DataFrame, tile_size: int = TILE_SIZE, *more: str) -> DataFrame:
    """Per read (and per ``more`` key columns): its tile if all its records share one tile with at
    most two of them, else a null tile.

    A single aggregate by read: least and greatest tile and the number of records tell all, so
    one shuffle with map-side combining does, and no second aggregate by (read, tile).
    """
    place = F.struct("chrom", tile_index(F.col("pos0"), tile_size).alias("tile_idx"))
    spliced = F.coalesce(F.col("cigar").contains("N"), F.lit(False)) if "cigar" in aln.columns else F.lit(False)
    reads = mapped(aln).select(*more, "qname", place.alias("place"), spliced.alias("spliced"))
    reads = reads.groupBy(*more, "qname").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("hits"), F.bool_or("spliced").alias("spliced"))
    unique = (F.col("lo") == F.col("hi")) & (F.col("hits") <= 2)
    return reads.select(*more, "qname", "spliced", F.when(unique, F.col("lo")).alias("tile"))


def umr_per_tile(aln: DataFrame, tile_size: int = TILE_SIZE, *more: str) -> DataFrame:
    """(more..., chrom, tile_idx, n): reads that count for each tile."""
    reads = read_tiles(aln, tile_size, *more).where("tile is not null")
    return reads.groupBy(*more, F.col("tile.chrom").alias("chrom"), F.col("tile.tile_idx").alias("tile_idx")).agg(F.count("*").alias("n"))


def read_totals(aln: DataFrame, *more: str) -> DataFrame:
    """n_reads and n_spliced: mapped reads, and those with a skip in any record."""
    reads = read_tiles(aln, TILE_SIZE, *more)
    grouped = reads.groupBy(*more) if more else reads
    return grouped.agg(F.count("*").alias("n_reads"), F.count_if("spliced").alias("n_spliced"))


def accumulate(*counts: DataFrame) -> DataFrame:
    """Sum of tile counts of several batches or runs."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("chrom", "tile_idx").agg(F.sum("n").alias("n"))


def new_tiles(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Observed tiles that the index does not hold, in the order in which they are appended."""
    return counts.select("chrom", "tile_idx").distinct().join(known.select("chrom", "tile_idx"), ["chrom", "tile_idx"], "left_anti").orderBy("chrom", "tile_idx")


def score(counts: DataFrame) -> DataFrame:
    """S = sum of ln(1 + n) over tiles."""
    return counts.agg(F.coalesce(F.sum(F.log1p("n")), F.lit(0.0)).alias("score"), F.count_if(F.col("n") >= 1).alias("tiles1"), F.count_if(F.col("n") >= 10).alias("tiles10"))


def region_groups(lengths: DataFrame, parts: int, tile_size: int = TILE_SIZE) -> DataFrame:
    """(chrom, start, end, part): regions on tile multiples, of about equal length, that cover
    every chromosome once; ``part`` numbers tasks of the scan."""
    goal = lengths.agg(F.sum("length").alias("all")).select(F.greatest(F.lit(1), F.ceil(F.col("all") / (parts * tile_size))).cast("long").alias("tiles"))
    step = F.col("tiles") * tile_size
    cut = lengths.crossJoin(F.broadcast(goal)).select("chrom", "length", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), step)).alias("start"))
    return cut.select("chrom", "start", F.least(F.col("start") + F.col("step"), "length").alias("end"), F.pmod(F.xxhash64("chrom", "start"), F.lit(parts)).cast("int").alias("part"))


def starting_in(aln: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records that start inside a region; on Parquet the range reaches the scan."""
    return aln.where((F.col("chrom") == chrom) & (F.col("pos0") >= start) & (F.col("pos0") < end))
