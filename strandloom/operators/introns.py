"""Junctions: multisets, strand from the genome, hints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.genomics import MOTIFS, motif_strand
from .tiles import mapped

CHUNK = 1 << 20
KEY = ("chrom", "start", "end", "strand")


def intron_multiset(aln: DataFrame, *more: str) -> DataFrame:
    """(more..., chrom, start, end, strand '.', mult): every skip of every mapped record."""
    return _walked(mapped(aln).where(F.col("cigar").contains("N")), lambda ops: C.introns(F.lit(0).cast("long"), ops), *more)


def merge(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy(*KEY).agg(F.sum("mult").alias("mult"))


def genome_chunks(genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_idx, bases): chunks of ``chunk`` bases and one more, so that two bases at any
    place stand in one chunk."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / F.lit(chunk)).cast("long"))
    cut = genome.select("chrom", "seq", F.explode(parts).alias("chunk_idx"))
    return cut.select("chrom", "chunk_idx", F.lower(F.substr("seq", (F.col("chunk_idx") * chunk + 1).cast("int"), F.lit(chunk + 1))).alias("bases"))


def assign_strand(introns: DataFrame, chunks: DataFrame, chunk: int = CHUNK, allowed: tuple[str, ...] = MOTIFS) -> DataFrame:
    """Introns with the strand of their splice motif; others, and those of unknown chromosomes, go.

    Both ends look their bases up by an equi-join on (chrom, chunk), so a genome of any size
    stays distributed; distinct introns only, since introns are a multiset by now.
    """
    two = lambda pos, name: F.substr("bases", (F.pmod(F.col(pos) - 1, F.lit(chunk)) + 1).cast("int"), F.lit(2)).alias(name)
    at = lambda pos: F.floor((F.col(pos) - 1) / F.lit(chunk)).cast("long")
    left = introns.withColumns({"chunk_idx": at("start"), "accept_at": F.col("end") - 1}).join(chunks, ["chrom", "chunk_idx"]).select(*introns.columns, "accept_at", two("start", "donor"))
    both = left.withColumn("chunk_idx", at("accept_at")).join(chunks, ["chrom", "chunk_idx"]).select(*introns.columns, "donor", two("accept_at", "acceptor"))
    motif = F.concat("donor", "acceptor")
    out = both.where((F.col("start") > 0) & (F.length(motif) == 4)).withColumn("strand", motif_strand(motif, allowed)).where("strand is not null")
    return out.select(*introns.columns).groupBy(*[c for c in introns.columns if c != "mult"]).agg(F.sum("mult").alias("mult")).select(*introns.columns)


def resolve_new(introns: DataFrame, cache: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(known, fresh): introns whose strand is in ``cache`` (chrom, start, end, strand; strand null
    for none), and the cache rows of those that were not.  Only unseen introns touch the genome."""
    place = ["chrom", "start", "end"]
    known = introns.drop("strand").join(cache, place).where("strand is not null").select(*introns.columns)
    unseen = introns.join(cache, place, "left_anti")
    found = assign_strand(unseen, chunks, chunk)
    fresh = unseen.select(*place).join(found.select(*place, "strand"), place, "left")
    return known.unionByName(found), fresh


def hint_multiset(aln: DataFrame) -> DataFrame:
    """Introns that pass the hint rules; alignments without a long gap are never walked, and of
    alike alignments, and of equal CIGARs at different places, one is."""
    rows = aln.where(F.col("chrom").isNotNull() & F.col("cigar").rlike("[DN]"))
    return _walked(rows, lambda ops: F.when(C.has_long_gap(ops), C.hint_introns(F.lit(0).cast("long"), ops)))


def _walked(rows: DataFrame, walk: Callable[[Column], Column], *more: str) -> DataFrame:
    """Multiset of the introns that ``walk`` finds from operations at place 0: a walk depends on
    the CIGAR alone, so each distinct one is walked once and its spans move to where it stands."""
    alike = rows.groupBy(*more, "chrom", "pos0", "cigar").agg(F.count("*").alias("n"))
    walks = rows.select("cigar").distinct().select("cigar", C.operations(F.col("cigar")).alias("ops"))
    walks = walks.select("cigar", F.explode(walk(F.col("ops"))).alias("i"))
    found = alike.join(walks, "cigar").select(*more, "chrom", (F.col("pos0") + F.col("i.start")).alias("start"), (F.col("pos0") + F.col("i.end")).alias("end"), "n")
    return found.groupBy(*more, "chrom", "start", "end").agg(F.sum("n").alias("mult")).withColumn("strand", F.lit(".")).select(*more, *KEY, "mult")


def at_least(introns: DataFrame, mult: int) -> DataFrame:
    return introns.where(F.col("mult") >= mult)


def union_of_runs(weighted: DataFrame) -> DataFrame:
    """Sum of weights over runs, rounded half to even, at least 1."""
    return weighted.groupBy(*KEY).agg(F.greatest(F.lit(1), F.bround(F.sum("w"))).cast("long").alias("mult"))
