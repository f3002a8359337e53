"""Line formats for output: each function gives a ``value`` column in the order of its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import numbered

PLACE = ["chrom", "start", "end", "strand"]


def _line(sep: str, *columns: Column | str) -> Column:
    return F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value")


def run_list_lines(runs: DataFrame) -> DataFrame:
    bit = lambda c: F.col(c).cast("int")
    return runs.select(_line("\t", "accession", "total_spots", "total_bases", "avg_len", bit("paired"), bit("colorspace"), "platform", "bioproject"))


RUN_LIST_HEADER = "@Run_acc\ttotal_spots\ttotal_bases\tavg_len\tbool:paired\tcolor_space\tplatform\tbioproject"


def intron_gff(introns: DataFrame) -> DataFrame:
    info = F.format_string("mult=%d;pri=4;src=E", F.col("mult"))
    return introns.orderBy(*PLACE).select(_line("\t", "chrom", F.lit("b2h"), F.lit("intron"), "start", "end", "mult", "strand", F.lit("."), info))


def splice_sites(introns: DataFrame) -> DataFrame:
    """chrom, last base of the exon before and first of the one after, 0-based, strand."""
    rows = introns.where((F.col("strand") != ".") & (F.col("start") >= 2))
    return rows.orderBy(*PLACE).select(_line("\t", "chrom", F.col("start") - 2, "end", "strand"))


def junction_bed(introns: DataFrame) -> DataFrame:
    """BED12 of two one-base blocks around each intron; names number the written rows."""
    rows = introns.where((F.col("strand") != ".") & (F.col("start") >= 2))
    rows = numbered(rows, {"_chrom": F.col("chrom"), "_part": F.floor(F.col("start") / (1 << 20))}, PLACE, "k")
    a, b = F.col("start") - 2, F.col("end") + 1
    return rows.orderBy("k").select(_line("\t", "chrom", a, b, F.concat(F.lit("junc"), F.col("k").cast("string")), F.least(F.col("mult"), F.lit(1000)), "strand", a, b, F.lit("0"), F.lit("2"), F.lit("1,1"), F.concat(F.lit("0,"), (b - a - 1).cast("string"))))


def hint_gff(hints: DataFrame, chrom_order: DataFrame | None = None) -> DataFrame:
    """Hints by first appearance of their chromosome (chrom, pos), then place; the multiplicity is
    written from 2 on."""
    rows = hints if chrom_order is None else hints.join(chrom_order, "chrom", "left")
    order = ([F.col("pos").asc_nulls_last()] if chrom_order is not None else []) + [F.col(c) for c in ("chrom", "start", "end")]
    info = F.concat(F.when(F.col("mult") > 1, F.format_string("mult=%d;", F.col("mult"))).otherwise(""), F.lit("pri=4;src=E"))
    return rows.orderBy(*order).select(_line("\t", "chrom", F.lit("b2h"), F.lit("intron"), "start", "end", "mult", "strand", F.lit("."), info))


def coverage_lines(counts: DataFrame) -> DataFrame:
    return counts.orderBy("chrom", "tile_idx").select(F.concat(F.col("chrom"), F.lit(":"), F.col("tile_idx").cast("string"), F.lit(";"), F.col("n").cast("string")).alias("value"))


def run_statistics_lines(stats: DataFrame) -> DataFrame:
    """Runs by times downloaded, then uniqueness, both falling."""
    pct = lambda c: F.format_string("%.4f%%", F.col(c))
    rows = stats.orderBy(F.desc("times_downloaded"), F.desc("avg_umr_pct"), "accession")
    return rows.select(_line(";", "accession", "times_downloaded", pct("avg_umr_pct"), pct("avg_spliced_pct"), F.initcap(F.col("bad_quality").cast("string"))))


def db_log_lines(log: DataFrame) -> DataFrame:
    return log.select(_line("\t", "version", "op", "line"))


def manifest_lines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("batch").select(_line("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]))


def ranking_lines(stats: DataFrame) -> DataFrame:
    """Ranking rows by ``position``; blanks where a run was not scanned or not picked."""
    blank = lambda c, fmt=None: F.coalesce(F.format_string(fmt, F.col(c)) if fmt else F.col(c).cast("string"), F.lit(""))
    rows = stats.orderBy("position")
    has = F.coalesce(F.col("rank"), F.lit(0)) > 0
    return rows.select(_line("\t", "acc", "status", F.when(has, F.col("rank").cast("string")).otherwise(""), F.when(has, F.format_string("%.2f", F.col("gain"))).otherwise(""), blank("n_tiles"), blank("n_contigs"), F.when(F.col("yield_pct").isNotNull(), F.format_string("%.2f", F.col("yield_pct"))).otherwise(""), blank("bioproject")))


def tile_weight_lines(weights: DataFrame) -> DataFrame:
    return weights.orderBy("acc", "chrom", "tile_idx").select(_line("\t", "acc", "chrom", "tile_idx", F.format_string("%.3f", F.col("w"))))


def missing_lines(missing: DataFrame) -> DataFrame:
    return missing.orderBy("batch").select(_line("\t", "batch", "accession", "n", "x", "reason"))


def fasta_lines(reads: DataFrame) -> DataFrame:
    """Two lines for each read; a read without name is named by its spot."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("spot").cast("string"))
    return reads.orderBy("spot").select(F.concat(F.lit(">"), name, F.lit("\n"), F.col("seq")).alias("value"))


def summary_json(stats: DataFrame) -> DataFrame:
    """One row of JSON: how many runs have each status."""
    counts = stats.groupBy("status").agg(F.count("*").alias("n"))
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("value"))


def merged_records(*batches: DataFrame, partitions: int) -> DataFrame:
    """Records of several batches in coordinate order, dealt out by range."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.repartitionByRange(partitions, "chrom", "pos0").sortWithinPartitions("chrom", "pos0", "qname")


def write_text(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Folder of text parts, replaced as a whole by the committer."""
    lines.write.mode("overwrite").option("compression", compression).text(path)
