"""Versioned line sets, manifests, fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import running_sum


def db_diff(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """Log rows (version, op, line) that turn ``old`` into ``new``: removals and additions."""
    out = [old.select("line").subtract(new.select("line")).select(F.lit("-").alias("op"), "line"), new.select("line").subtract(old.select("line")).select(F.lit("+").alias("op"), "line")]
    return out[0].unionByName(out[1]).select(F.lit(version).alias("version"), "op", "line")


def log_order(log: DataFrame) -> DataFrame:
    """Log rows in file order: version, removals first, then chromosome, start, end, rest."""
    part = F.split("line", "\t")
    return log.orderBy("version", F.when(F.col("op") == "-", 0).otherwise(1), part[0], part[1].try_cast("long"), part[2].try_cast("long"), "line")


def snapshot(log: DataFrame, version: int) -> DataFrame:
    """Lines that hold at a version: the last operation up to it was an addition."""
    last = log.where(F.col("version") <= version).groupBy("line").agg(F.max_by("op", "version").alias("op"))
    return last.where("op = '+'").select("line")


def snapshots_of(batches: DataFrame, log: DataFrame) -> DataFrame:
    """(batch, n_lines) as of each batch's db_version: a running sum, not a range join."""
    change = log.groupBy("version").agg(F.sum(F.when(F.col("op") == "+", 1).otherwise(-1)).alias("d"))
    points = batches.select(F.col("db_version").alias("version")).distinct().withColumn("d", F.lit(0)).unionByName(change.withColumn("d", F.col("d").cast("int")))
    sums = running_sum(points.groupBy("version").agg(F.sum("d").alias("d")), "version", F.col("d"), "n_lines").select("version", "n_lines")
    return batches.join(sums, F.col("db_version") == F.col("version")).select("batch", "db_version", "n_lines")


def running_version(changes: DataFrame) -> DataFrame:
    """(batch, version): the version grows by one whenever a batch changed the set."""
    return running_sum(changes, "batch", F.coalesce(F.col("changed"), F.lit(False)).cast("int"), "version").select("batch", "version")


def compare_manifest(recorded: DataFrame, replayed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(batch, status): missing, differs or same."""
    both = recorded.select("batch", "uniq_pct").join(replayed.select("batch", F.col("uniq_pct").alias("now")), "batch", "left")
    status = F.when(F.col("now").isNull(), "missing").when(F.abs(F.col("uniq_pct") - F.col("now")) > tolerance, "differs").otherwise("same")
    return both.select("batch", status.alias("status"))


def compare_headers(recorded: DataFrame, now: DataFrame, keys: tuple[str, ...] = ("genome_md5", "mode")) -> DataFrame:
    """(key, recorded, now) of the header items (key, item) that must agree and do not; tool
    versions (keys that end in _version) are compared too."""
    asked = F.col("key").isin(*keys) | F.col("key").endswith("_version")
    both = recorded.where(asked).select("key", F.col("item").alias("recorded")).join(now.select("key", F.col("item").alias("now")), "key", "left")
    return both.where(~F.col("recorded").eqNullSafe(F.col("now")))


def transcript_fingerprint(gtf: DataFrame) -> DataFrame:
    """One row: MD5 over sorted transcripts (place, strand, exons, values), whatever their names
    and order.  ``gtf`` has the nine columns c0..c8."""
    rows = gtf.where(F.col("c2").isin("transcript", "exon")).withColumn("tid", F.regexp_extract("c8", r'transcript_id "([^"]+)"', 1)).where("tid <> ''")
    pairs = F.sort_array(F.transform(F.regexp_extract_all("c8", F.lit(r'((?:cov|longcov|FPKM|TPM) "[^"]+")'), F.lit(1)), lambda p: F.regexp_replace(p, r'^(\S+) "([^"]+)"$', "$1=$2")))
    exon = F.when(F.col("c2") == "exon", F.struct(F.col("c3").cast("long").alias("s"), F.concat_ws("-", "c3", "c4").alias("e")))
    t = rows.groupBy("tid").agg(F.first("c0").alias("chrom"), F.first("c6").alias("strand"), F.array_sort(F.collect_list(exon)).alias("exons"), F.max(F.when(F.col("c2") == "transcript", F.array_join(pairs, ";"))).alias("values"))
    line = F.concat_ws("\t", "chrom", "strand", F.array_join(F.transform("exons", lambda x: x["e"]), ","), F.coalesce("values", F.lit("")))
    return _md5_of(t.select(line.alias("line")).orderBy("line"))


def content_md5(lines: DataFrame) -> DataFrame:
    """MD5 of the lines (value, line_no) that do not start with '#', in file order."""
    return _md5_of(lines.where(~F.col("value").startswith("#")).orderBy("line_no", "value").select("value"), end="\n")


def _md5_of(lines: DataFrame, end: str = "") -> DataFrame:
    """MD5 of sorted lines joined by newlines, with ``end`` after the last one.  The hash of a
    file takes its bytes in turn, so the driver reads the lines, one range of the order at a time."""
    digest, n = hashlib.md5(), 0
    for row in lines.toLocalIterator():
        digest.update((("\n" if n else "") + row[0]).encode())
        n += 1
    digest.update(end.encode() if n else b"")
    return lines.sparkSession.createDataFrame([(digest.hexdigest(),)], "fingerprint string")
