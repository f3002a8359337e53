"""Small scalar expressions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splice motifs (donor then acceptor) of the forward strand.
MOTIFS = ("gtag", "gcag", "atac")
#: Platforms whose reads are long.
LONG_PLATFORMS = ("PACBIO_SMRT", "OXFORD_NANOPORE")


def tile_index(pos0: Column, tile_size: int) -> Column:
    if tile_size <= 0:
        raise ValueError("tile_size must be positive")
    return F.floor((pos0 + 1) / F.lit(tile_size)).cast("long")


def reverse_complement(motif: Column) -> Column:
    return F.translate(F.reverse(motif), "acgt", "tgca")


def motif_strand(motif: Column, allowed: tuple[str, ...] = MOTIFS) -> Column:
    """'+', '-' or null, for the four lower-case bases donor + acceptor."""
    return F.when(motif.isin(*allowed), "+").when(reverse_complement(motif).isin(*allowed), "-")


def platform_fits(platform: Column, long_reads: bool) -> Column:
    """An unknown platform fits both read types."""
    p = F.upper(F.trim(F.coalesce(platform, F.lit(""))))
    return (p == "") | (p.isin(*LONG_PLATFORMS) == F.lit(long_reads))


def long_read_preset(platform: Column) -> Column:
    p = F.upper(F.trim(F.coalesce(platform, F.lit(""))))
    return F.when(p == "OXFORD_NANOPORE", "ont").otherwise("pacbio")


def average_length(bases: Column, spots: Column) -> Column:
    """Two decimals, halves to even."""
    return F.bround(100 * bases / spots) / 100


def batches_of(spots: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(spots / F.lit(size))).cast("long")


def safe_name(name: Column) -> Column:
    """A file name without read suffix, fit for a directory name."""
    bare = F.regexp_replace(name, r"(?i)\.(fastq|fq|fasta|fa)(\.(gz|zst|bz2))?$", "")
    kept = F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(kept == "", "local").otherwise(kept)


def paired_name(first: Column, second: Column) -> Column:
    """Name of a pair of mate files: what precedes equal mate marks, else the common prefix."""
    strip = lambda c: F.regexp_replace(c, r"(?i)\.(fastq|fq|fasta|fa)(\.(gz|zst|bz2))?$", "")
    mark = r"(?i)[._-]?(R?[12]|R?[12]_001)$"
    a, b = strip(first), strip(second)
    sa, sb = F.regexp_replace(a, mark, ""), F.regexp_replace(b, mark, "")
    marked = (sa != a) & (sb != b) & (sa == sb) & (sa != "")
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    prefix = F.regexp_replace(F.substr(a, F.lit(1), n), r"[._-]+$", "")
    return safe_name(F.when(marked, sa).when(prefix != "", prefix).otherwise(a))
