"""The engine's tables, made from the test tables, in DataFrame code and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 500
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "acgtgatcagtcgagtcatagctgat"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments from order lines: a read is an order, a run a supplier, a place a part."""
    c = lambda name: F.col(name).cast("long")
    s = lambda col: col.cast("string")
    q, supp, part, ln = c("l_quantity"), c("l_suppkey"), c("l_partkey"), F.col("l_linenumber") % 4
    cigar = (
        F.when(ln == 0, F.concat(s(q), F.lit("M")))
        .when(ln == 1, F.concat(s(q + 2), F.lit("M"), s(10 + supp % 90), F.lit("N20M")))
        .when(ln == 2, F.concat(F.lit("12M"), s(5 + part % 15), F.lit("D"), s(q), F.lit("M"), s(30 + supp % 50), F.lit("N9M")))
        .otherwise(F.concat(F.lit("4S30M"), s(1 + part % 7), F.lit("I"), s(40 + supp % 60), F.lit("N15M")))
    )
    flag = F.when(F.col("l_quantity") < 3, 4).when(F.col("l_linenumber") == 6, 256).when(F.col("l_linenumber") == 7, 2048).otherwise(0)
    return load(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("qname"), s(supp).alias("run"), F.concat(F.lit("chr"), s(F.floor(part / 1000))).alias("chrom"), ((part % 1000) * 5).alias("pos0"), flag.alias("flag"),
        ((c("l_orderkey") * 7 + part) % 61).alias("mapq"), cigar.alias("cigar"), F.col("l_discount").alias("de"), q.alias("qlen"), F.col("l_linenumber").cast("long").alias("line"),
    )


ALN = """aln AS (
  SELECT CAST(l_orderkey AS BIGINT) AS qname, CAST(l_suppkey AS BIGINT) AS supp, CAST(CAST(l_suppkey AS BIGINT) AS VARCHAR) AS run, CAST(l_partkey AS BIGINT) AS part, CAST(l_quantity AS BIGINT) AS q,
    CAST(l_linenumber AS BIGINT) % 4 AS form, CAST(l_linenumber AS BIGINT) AS line, l_discount AS de, 'chr' || CAST(CAST(l_partkey AS BIGINT) // 1000 AS VARCHAR) AS chrom, (CAST(l_partkey AS BIGINT) % 1000) * 5 AS pos0,
    CASE WHEN l_quantity < 3 THEN 4 WHEN l_linenumber = 6 THEN 256 WHEN l_linenumber = 7 THEN 2048 ELSE 0 END AS flag,
    (CAST(l_orderkey AS BIGINT) * 7 + CAST(l_partkey AS BIGINT)) % 61 AS mapq FROM lineitem)"""

#: Introns of every alignment, in closed form for the four shapes of CIGAR.
SPANS = ALN + """, spans AS (
  SELECT *, CASE form WHEN 1 THEN pos0 + q + 3 WHEN 2 THEN pos0 + 18 + part % 15 + q WHEN 3 THEN pos0 + 31 END AS start,
    CASE form WHEN 1 THEN 10 + supp % 90 WHEN 2 THEN 30 + supp % 50 WHEN 3 THEN 40 + supp % 60 END AS gap,
    CASE form WHEN 0 THEN q WHEN 1 THEN q + 32 + supp % 90 WHEN 2 THEN 56 + part % 15 + q + supp % 50 ELSE 85 + supp % 60 END AS span,
    CASE form WHEN 0 THEN q WHEN 1 THEN q + 22 WHEN 2 THEN q + 21 ELSE 46 + part % 7 END AS alen FROM aln
), introns AS (
  SELECT chrom, start, start + gap - 1 AS "end", count(*) AS mult FROM spans WHERE form > 0 AND flag & 4 = 0 GROUP BY ALL
)"""

UMR = ALN + """, rec AS (SELECT qname, chrom, (pos0 + 1) // 500 AS tile_idx FROM aln WHERE flag & 4 = 0
), rt AS (SELECT qname, chrom, tile_idx, count(*) AS hits FROM rec GROUP BY ALL
), uniq AS (SELECT qname, min(chrom) AS chrom, min(tile_idx) AS tile_idx FROM rt GROUP BY qname HAVING count(*) = 1 AND max(hits) <= 2
), umr AS (SELECT chrom, tile_idx, count(*) AS n FROM uniq GROUP BY ALL)"""


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _FROM, _TO)
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("chr"), F.col("doc_id").cast("string")).alias("chrom"), seq.alias("seq"))


GENOME = f"genome AS (SELECT 'chr' || CAST(doc_id AS VARCHAR) AS chrom, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}') AS seq FROM documents)"

STRANDED = SPANS + ", " + GENOME + """, motif AS (
  SELECT i.*, substr(seq, start, 2) || substr(seq, "end" - 1, 2) AS m FROM introns i JOIN genome g ON g.chrom = i.chrom
), stranded AS (
  SELECT chrom, start, "end", CASE WHEN m IN ('gtag', 'gcag', 'atac') THEN '+' WHEN translate(reverse(m), 'acgt', 'tgca') IN ('gtag', 'gcag', 'atac') THEN '-' END AS strand, mult FROM motif
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from suppliers: spots are their order lines, the project is their nation."""
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("spots"))
    s = load(spark, sf_dir, "supplier").join(n, "s_suppkey", "left")
    k = F.col("s_suppkey").cast("long")
    spots = F.coalesce("spots", F.lit(0))
    platform = F.element_at(F.array(*map(F.lit, ("ILLUMINA", "pacbio_smrt ", "", "OXFORD_NANOPORE"))), (k % 4 + 1).cast("int"))
    return s.select(
        k.cast("string").alias("accession"), spots.alias("total_spots"), (spots * (100 + k % 7)).alias("total_bases"), (100.0 + k % 7).alias("avg_len"), (k % 2 == 0).alias("paired"),
        (k % 10 == 9).alias("colorspace"), platform.alias("platform"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("P"), F.col("s_nationkey").cast("string"))).alias("bioproject"),
    )


RUNS = """runs AS (
  SELECT CAST(k AS VARCHAR) AS accession, spots AS total_spots, spots * (100 + k % 7) AS total_bases, 100.0::DOUBLE + k % 7 AS avg_len, k % 2 = 0 AS paired, k % 10 = 9 AS colorspace,
    ['ILLUMINA', 'pacbio_smrt ', '', 'OXFORD_NANOPORE'][k % 4 + 1] AS platform, CASE WHEN k % 6 = 0 THEN '' ELSE 'P' || CAST(s_nationkey AS VARCHAR) END AS bioproject
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, s_nationkey, coalesce(spots, 0) AS spots FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS spots FROM lineitem GROUP BY 1) n ON l_suppkey = s_suppkey)
)"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch results by run and read residue."""
    a = aln(spark, sf_dir)
    primary = a.where(F.col("flag").bitwiseAND(4 + 256 + 2048) == 0)
    b = primary.groupBy(F.col("run").alias("accession"), (F.col("qname") % 5).alias("k")).agg(F.count("*").alias("spots"), F.count_if(F.col("mapq") >= 30).alias("num_uniq"), F.count_if(F.col("cigar").contains("N")).alias("spl"))
    return b.select("accession", "k", (F.col("k") % 2 + 1).alias("n_batches"), (F.col("k") * 30).alias("n"), (F.col("k") * 30 + F.col("spots") - 1).alias("x"), "num_uniq", (100.0 * F.col("spl") / F.col("spots")).alias("spliced_pct"))


BATCHES = ALN + """, batches AS (
  SELECT run AS accession, qname % 5 AS k, k % 2 + 1 AS n_batches, k * 30 AS n, k * 30 + count(*) - 1 AS x, count(*) FILTER (WHERE mapq >= 30) AS num_uniq, 100.0::DOUBLE * count(*) FILTER (WHERE form > 0) / count(*) AS spliced_pct
  FROM aln WHERE flag & 2308 = 0 GROUP BY run, qname % 5
), gated AS (
  SELECT *, 100.0::DOUBLE * num_uniq / CASE WHEN n_batches > 1 THEN x - n + 1 ELSE 110 END AS uniq_pct, uniq_pct >= 50.0 AS success FROM batches
)"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each order line of a supplier's orders; some have no abundance."""
    rows = load(spark, sf_dir, "lineitem")
    name = F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")
    ka = F.when(F.col("l_linenumber") == 5, None).otherwise(F.col("l_quantity") * 2 - 10)
    return rows.groupBy(F.col("l_suppkey").cast("long").cast("string").alias("acc"), name.cast("int").alias("idx")).agg(F.max(ka).alias("ka"))


def contig_aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aln(spark, sf_dir)
    return a.withColumns({"qname": F.concat("run", F.lit("_"), (F.col("qname") * 8 + F.col("line")).cast("string")), "de": F.when(F.col("line") % 3 == 0, None).otherwise(F.col("de")), "nm": (F.col("line") % 5).cast("int")})


SCREEN = SPANS + """, keyed AS (SELECT *, qname * 8 + line AS idx FROM spans
), ka AS (SELECT run, idx, max(CASE WHEN line = 5 THEN NULL ELSE q * 2 - 10 END) AS ka FROM keyed GROUP BY ALL
), recs AS (
  SELECT s.*, CASE WHEN ka IS NULL THEN 1 ELSE greatest(ka, 0) END::DOUBLE * q AS mass, CASE WHEN ka IS NULL THEN 1 ELSE least(ka, 50) END::DOUBLE AS w, flag & 4 = 0 AS ok FROM keyed s JOIN ka USING (run, idx) WHERE flag & 2304 = 0
), scalars AS (
  SELECT run AS acc, count(*) FILTER (WHERE ok) AS n_aligned, coalesce(CAST(sum(CASE WHEN ok THEN alen END) AS BIGINT), 0) AS aligned_bp, count(*) FILTER (WHERE ok AND form > 0) AS n_spliced, sum(mass) AS mass_total,
    coalesce(sum(CASE WHEN ok THEN mass END), 0) AS mass_mapped, coalesce(sum(CASE WHEN ok THEN w * greatest(1.0::DOUBLE, span / 150.0::DOUBLE) END), 0) AS tile_mass FROM recs GROUP BY 1
), stiles AS (
  SELECT run AS acc, chrom, (pos0 + 1) // 500 AS tile_idx, sum(w * greatest(1.0::DOUBLE, span / 150.0::DOUBLE)) AS w FROM recs WHERE ok GROUP BY ALL
), nc AS (SELECT run AS acc, count(*) AS n_contigs FROM ka GROUP BY 1
), dv AS (SELECT run AS acc, coalesce(CASE WHEN line % 3 = 0 THEN NULL ELSE de END, (line % 5)::DOUBLE / alen) AS v, alen::DOUBLE AS w FROM recs WHERE ok AND alen > 0
), med AS (
  SELECT acc, min(v) AS median FROM (SELECT acc, v, sum(w) OVER (PARTITION BY acc ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY acc) AS total FROM dv) WHERE cw >= total / 2 GROUP BY acc
), stats AS (
  SELECT acc, n_contigs, coalesce(n_tiles, 0) AS n_tiles, median AS divergence, 100.0::DOUBLE * mass_mapped / mass_total AS yield_pct, CAST(acc AS BIGINT) AS k,
    CASE WHEN CAST(acc AS BIGINT) % 11 = 0 THEN 'absent' ELSE 'pending' END AS status0
  FROM nc LEFT JOIN scalars USING (acc) LEFT JOIN (SELECT acc, count(*) AS n_tiles FROM stiles GROUP BY 1) USING (acc) LEFT JOIN med USING (acc)
), gate AS (
  SELECT *, CASE WHEN status0 = 'absent' THEN 'absent' WHEN n_contigs < lo THEN 'too_few_contigs' WHEN divergence > 0.065 THEN 'rejected' WHEN n_tiles > 0 AND n_tiles >= 0.9 * mx THEN 'accepted' ELSE 'rejected' END AS status
  FROM stats, (SELECT max(CASE WHEN status0 = 'pending' AND n_contigs >= lo AND NOT coalesce(divergence > 0.065, false) THEN n_tiles END) AS mx, any_value(lo) AS lo FROM stats, (SELECT CAST(avg(n_contigs) * 0.95 AS BIGINT) AS lo FROM nc))
)"""
