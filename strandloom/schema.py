"""Schemas of the tables that the engine reads and writes.  Unknown values are null, never NaN."""

from __future__ import annotations

RUN = "accession string, total_spots long, total_bases long, avg_len double, paired boolean, colorspace boolean, platform string, bioproject string"
ALIGNMENT = "run string, batch string, qname string, flag int, chrom string, pos0 long, mapq int, cigar string, nh int, de double, nm int, qlen int"
CONTIG = "acc string, idx int, ka double, len int"
TILE_COUNT = "chrom string, tile_idx long, n long"
INTRON = "chrom string, start long, end long, strand string, mult long"
DB_LOG = "version int, op string, line string"
MANIFEST = "batch int, accession string, n long, x long, db_version int, threads int, batch_size long, success boolean, uniq_pct double, spliced_pct double, seconds double"
TIMING = (
    "batch int, accession string, n long, x long, n_batches int, success int, t_download double, t_align double, t_scan double, t_db double, "
    "t_estimate double, t_batch double, score double, n_tiles long, n_introns long, threads int"
)
SCREEN = "acc string, status string, n_contigs long, n_aligned long, n_tiles long, n_spliced long, aligned_bp long, mapped_pct double, yield_pct double, divergence double"
STATUSES = ("accepted", "rejected", "too_few_contigs", "absent", "error", "unsampled", "pending")
