"""Contig screen: scan of contig alignments, divergence, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.genomics import tile_index
from .quality import primary
from .tiles import TILE_SIZE

CAP = 50.0
READ_LENGTH = 150


def contig_records(aln: DataFrame, contigs: DataFrame) -> DataFrame:
    """Primary records with their contig's abundance: qname is <acc>_<idx>; unknown runs go, unknown
    contigs have no abundance."""
    acc = F.regexp_extract("qname", r"^(.*)_[^_]*$", 1)
    idx = F.substring_index("qname", "_", -1).try_cast("int")
    rows = primary(aln).withColumns({"acc": acc, "idx": idx})
    known = contigs.select("acc").distinct()
    return rows.join(known, "acc", "left_semi").join(contigs.select("acc", "idx", "ka"), ["acc", "idx"], "left")


def _parts(records: DataFrame, cap: float) -> DataFrame:
    ops = C.operations(F.col("cigar"))
    raw = F.when(F.col("ka").isNull() | F.isnan("ka"), 1.0).otherwise(F.greatest(F.col("ka"), F.lit(0.0)))
    weight = F.when(F.col("ka").isNull() | F.isnan("ka"), 1.0).otherwise(F.least(F.col("ka"), F.lit(cap)))
    is_mapped = (F.col("flag").bitwiseAND(4) == 0) & F.col("chrom").isNotNull()
    return records.withColumns({"ops": ops, "mass": raw * F.col("qlen"), "w": weight, "is_mapped": is_mapped})


def screen_scalars(records: DataFrame, runs: DataFrame, cap: float = CAP) -> DataFrame:
    """One row for each run of ``runs`` (acc, n_contigs), those without alignments included."""
    rows = _parts(records, cap)
    m = F.col("is_mapped")
    span = C.reference_span(F.col("ops"))
    one = rows.groupBy("acc").agg(
        F.count_if(m).alias("n_aligned"), F.coalesce(F.sum(F.when(m, C.aligned_query(F.col("ops")))), F.lit(0)).alias("aligned_bp"), F.count_if(m & F.coalesce(F.col("cigar").contains("N"), F.lit(False))).alias("n_spliced"),
        F.sum("mass").alias("mass_total"), F.coalesce(F.sum(F.when(m, F.col("mass"))), F.lit(0.0)).alias("mass_mapped"),
        F.coalesce(F.sum(F.when(m, F.col("w") * F.greatest(F.lit(1.0), span / READ_LENGTH))), F.lit(0.0)).alias("tile_mass"),
    )
    out = runs.join(one, "acc", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_aligned", "aligned_bp", "n_spliced")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("mass_total", "mass_mapped", "tile_mass")}
    pct = lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns(zero).withColumns({"mapped_pct": pct("n_aligned", "n_contigs"), "yield_pct": pct("mass_mapped", "mass_total")})


def screen_tiles(records: DataFrame, cap: float = CAP, tile_size: int = TILE_SIZE) -> DataFrame:
    """(acc, chrom, tile_idx, w)."""
    rows = _parts(records, cap).where("is_mapped")
    w = F.col("w") * F.greatest(F.lit(1.0), C.reference_span(F.col("ops")) / READ_LENGTH)
    return rows.groupBy("acc", "chrom", tile_index(F.col("pos0"), tile_size).alias("tile_idx")).agg(F.sum(w).alias("w"))


def screen_introns(records: DataFrame, cap: float = CAP) -> DataFrame:
    """(acc, chrom, start, end, w)."""
    rows = _parts(records, cap).where(F.col("is_mapped") & F.col("cigar").contains("N"))
    rows = rows.select("acc", "chrom", "w", F.explode(C.introns(F.col("pos0"), F.col("ops"))).alias("i"))
    return rows.groupBy("acc", "chrom", F.col("i.start").alias("start"), F.col("i.end").alias("end")).agg(F.sum("w").alias("w"))


def divergence_values(records: DataFrame) -> DataFrame:
    """(acc, v, w): the divergence tag, else edits per aligned base, weighted by aligned bases."""
    rows = _parts(records, CAP).where("is_mapped").withColumn("alen", C.aligned_query(F.col("ops"))).where("alen > 0")
    return rows.select("acc", F.coalesce(F.col("de"), F.try_divide(F.col("nm").cast("double"), F.col("alen"))).alias("v"), F.col("alen").cast("double").alias("w")).where("v is not null")


def weighted_median(values: DataFrame, key: str = "acc") -> DataFrame:
    """(key, median): the first value, by (value, weight), whose running weight reaches half.
    Weights of equal values are added first, so only distinct values of a key are sorted."""
    order = W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = values.groupBy(key, "v").agg(F.sum("w").alias("w")).withColumns({"cw": F.sum("w").over(order), "total": F.sum("w").over(W.partitionBy(key))})
    return rows.where(F.col("cw") >= F.col("total") / 2).groupBy(key).agg(F.min("v").alias("median"))


def gate_status(stats: DataFrame, least_contigs: int = 100, least_share: float = 0.10, most_divergence: float = 0.05) -> DataFrame:
    """Status of every scanned run; absent, error and unsampled runs keep theirs."""
    scanned = F.col("status").isin("pending", "accepted", "rejected", "too_few_contigs")
    divergent = F.lit(most_divergence > 0) & F.col("divergence").isNotNull() & ~F.isnan(F.coalesce("divergence", F.lit(0.0))) & (F.col("divergence") > most_divergence)
    few = F.col("n_contigs") < least_contigs
    best = stats.agg(F.coalesce(F.max(F.when(scanned & ~few & ~F.coalesce(divergent, F.lit(False)), F.col("n_tiles"))), F.lit(0)).alias("max_tiles"))
    status: Column = F.when(~scanned, F.col("status")).when(few, "too_few_contigs").when(F.coalesce(divergent, F.lit(False)), "rejected").when((F.col("n_tiles") > 0) & (F.col("n_tiles") >= least_share * F.col("max_tiles")), "accepted").otherwise("rejected")
    return stats.crossJoin(F.broadcast(best)).withColumn("status", status).drop("max_tiles")  # the right side is one row


def acceptance_rate(stats: DataFrame) -> DataFrame:
    good, judged = F.count_if(F.col("status") == "accepted"), F.count_if(F.col("status").isin("accepted", "rejected", "too_few_contigs"))
    return stats.agg(F.try_divide(good.cast("double"), judged).alias("rate"))


def prior_mass(tiles: DataFrame, status: DataFrame, batch_size: int, prior_batches: float = 1.0) -> DataFrame:
    """(acc, chrom, tile_idx, prior): tile weights of accepted runs, scaled to half a batch each."""
    rows = tiles.join(status.where("status = 'accepted'").select("acc"), "acc", "left_semi")
    total = rows.groupBy("acc").agg(F.sum("w").alias("total")).where("total > 0")
    return rows.join(total, "acc").select("acc", "chrom", "tile_idx", (F.col("w") / F.col("total") * (prior_batches * batch_size * 0.5)).alias("prior"))


def prior_runs(runs: DataFrame, stats: DataFrame, top: int = 0, only: bool = True, max_batches: int = 0) -> DataFrame:
    """Runs that the screen leaves, with status, rank and clipped yield.

    ``runs`` (accession, max_batches), ``stats`` (accession, status, rank, yield_pct).  Rejected
    runs go; ``top`` keeps the best ranks; unscreened runs go too, unless the accepted ones are
    none or hold fewer than ``max_batches`` batches.
    """
    st = F.coalesce("status", F.lit("unprocessed"))
    rows = runs.join(stats.select("accession", "status", "rank", "yield_pct"), "accession", "left").withColumn("status", st)
    in_top = F.lit(True) if top <= 0 else F.coalesce(F.col("rank"), F.lit(0)).between(1, top)
    ok = (F.col("status") == "accepted") & in_top
    room = rows.agg(F.count_if(ok).alias("n_ok"), F.coalesce(F.sum(F.when(ok, F.col("max_batches"))), F.lit(0)).alias("room"))
    strict = F.lit(only) & (F.col("n_ok") > 0) & (F.lit(max_batches <= 0) | (F.col("room") >= max_batches))
    kept = F.when(F.col("status") == "rejected", False).when(F.col("status") == "accepted", ok).otherwise(~strict)
    out = rows.crossJoin(F.broadcast(room)).where(kept)  # the right side is one row
    yields = F.when((F.col("status") == "accepted") & (F.col("yield_pct") > 0), F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("yield_pct") / 100)))
    label = F.when(F.col("status") == "accepted", "accepted").otherwise("unprocessed")
    return out.select("accession", "max_batches", label.alias("status"), F.coalesce("rank", F.lit(0)).alias("rank"), yields.alias("yield"))
