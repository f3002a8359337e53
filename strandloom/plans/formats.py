"""Named queries that write the engine's line formats over the test tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import introns, quality
from ..sources import sinks, text
from . import bindings as B
from .queries import _DB, _db, _gated, _records, _screened
from .registry import query


def _tabs(*columns):
    return F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("value")


@query("sam_scan", f"WITH {B.ALN} SELECT CAST(qname AS VARCHAR) AS qname, CAST(flag AS INTEGER) AS flag, CASE WHEN line = 3 THEN NULL ELSE chrom END AS chrom, pos0, CAST(mapq AS INTEGER) AS mapq, CASE WHEN line = 2 THEN NULL ELSE CAST(line AS INTEGER) END AS nh, CASE WHEN line = 5 THEN NULL ELSE CAST(line % 5 AS INTEGER) END AS nm, CASE WHEN line = 4 THEN 0 ELSE 4 END AS qlen FROM aln")
def sam_scan(spark, d):
    a = B.aln(spark, d)
    line = F.col("line")
    tags = F.concat_ws("\t", F.lit("XX:Z:a"), F.when(line != 2, F.concat(F.lit("NH:i:"), line.cast("string"))), F.when(line != 5, F.concat(F.lit("NM:i:"), (line % 5).cast("string"))))
    star = F.lit("*")
    rows = a.select(_tabs(F.col("qname"), F.col("flag"), F.when(line == 3, star).otherwise(F.col("chrom")), F.col("pos0") + 1, F.col("mapq"), F.col("cigar"), star, F.lit(0), F.lit(0), F.when(line == 4, star).otherwise(F.lit("ACGT")), star, tags))
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:chr0\tLN:9",)], "value string")
    return text.parse_sam(head.union(rows)).select("qname", "flag", "chrom", "pos0", "mapq", "nh", "nm", "qlen")


@query("run_pages", f"WITH {B.RUNS} SELECT accession, total_spots, total_bases, round_even(100.0::DOUBLE * total_bases / total_spots, 0) / 100 AS avg_len, paired, platform, bioproject FROM runs WHERE total_spots > 0")
def run_pages(spark, d):
    """Metadata pages of runs, one page for each project."""
    r = B.runs(spark, d)
    quoted = lambda name, c: F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))
    doc = F.concat(
        F.lit("<DocSum><Item>&lt;Summary&gt;<Platform instrument_model=\"x\">"), F.col("platform"), F.lit("</Platform>"), F.when(F.col("paired"), "<LIBRARY_LAYOUT><PAIRED/></LIBRARY_LAYOUT>").otherwise("<LIBRARY_LAYOUT><SINGLE/></LIBRARY_LAYOUT>"),
        F.lit("<Bioproject>"), F.col("bioproject"), F.lit("</Bioproject></Item><Item><Run"), quoted("acc", F.col("accession")), quoted("total_spots", F.col("total_spots")), quoted("total_bases", F.col("total_bases")), F.lit("/></Item></DocSum>"),
    )
    pages = r.groupBy("bioproject").agg(F.concat(F.lit("<eSummaryResult>"), F.array_join(F.collect_list(doc), ""), F.lit("</eSummaryResult>")).alias("xml"))
    return text.parse_run_pages(pages).drop("colorspace")


@query("manifest_roundtrip", f"WITH {B.BATCHES} SELECT CAST(CAST(accession AS BIGINT) * 10 + k AS INTEGER) AS batch, accession, n, x, CAST(k AS INTEGER) AS db_version, CAST(4 AS INTEGER) AS threads, CAST(50 AS BIGINT) AS batch_size, success, round(uniq_pct, 4) AS uniq_pct FROM gated")
def manifest_roundtrip(spark, d):
    g = _gated(spark, d)
    rows = g.select(
        (F.col("accession").cast("long") * 10 + F.col("k")).alias("batch"), "accession", "n", "x", F.col("k").alias("db_version"), F.lit(4).alias("threads"), F.lit(50).alias("batch_size"), "success", "uniq_pct", "spliced_pct", F.lit(1.5).alias("seconds"),
    )
    head, back = text.parse_manifest(sinks.manifest_lines(rows))
    return back.select("batch", "accession", "n", "x", "db_version", "threads", "batch_size", "success", F.round("uniq_pct", 4).alias("uniq_pct"))


@query("db_log_roundtrip", f"WITH {_DB} SELECT version, op, line FROM dblog")
def db_log_roundtrip(spark, d):
    return text.parse_db_log(sinks.db_log_lines(_db(spark, d)))


@query("fasta_sequences", f"WITH {B.GENOME} SELECT chrom, seq FROM genome WHERE length(seq) > 0")
def fasta_sequences(spark, d):
    """The genome as FASTA of lines of 60 bases, read back."""
    g = B.genome(spark, d).where(F.length("seq") > 0)
    n = F.ceil(F.length("seq") / 60).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(F.col("seq"), k * 60 + 1, F.lit(60)))
    lines = g.select(F.substring("chrom", 4, 20).cast("long").alias("k"), F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "chrom", F.lit(" text"))), cut)).alias("p", "value"))
    return text.parse_fasta(lines.select((F.col("k") * 100_000 + F.col("p")).alias("line_no"), "value"))


@query("contig_scan", "SELECT 'R1' AS acc, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS idx, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 50 AS DOUBLE) + 0.5 END AS ka, CAST(p_partkey % 7 + 1 + 10 AS INTEGER) AS len FROM part")
def contig_scan(spark, d):
    k = F.col("p_partkey").cast("long")
    head = F.concat(F.lit(">R1_"), k.cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" ka:f:"), (k % 50 + 0.5).cast("string"))))
    lines = B.load(spark, d, "part").select(k.alias("k"), F.posexplode(F.array(head, F.repeat(F.lit("A"), (k % 7 + 1).cast("int")), F.lit("C" * 10))).alias("p", "value"))
    return text.parse_contigs(lines.select((F.col("k") * 3 + F.col("p")).alias("line_no"), "value"), "R1")


@query("missing_list", f"WITH {B.BATCHES} SELECT concat_ws(chr(9), CAST(accession AS BIGINT) * 10 + k, accession, n, x, 'gone') AS value FROM gated WHERE NOT success")
def missing_list(spark, d):
    g = _gated(spark, d).where("not success")
    return sinks.missing_lines(g.select((F.col("accession").cast("long") * 10 + F.col("k")).alias("batch"), "accession", "n", "x", F.lit("gone").alias("reason")))


@query("fasta_extract", "SELECT '>' || CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END || chr(10) || 'ACGT' AS value FROM customer")
def fasta_extract(spark, d):
    c = B.load(spark, d, "customer")
    k = F.col("c_custkey").cast("long")
    return sinks.fasta_lines(c.select(k.alias("spot"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("ACGT").alias("seq")))


@query("screen_summary", f"WITH {B.SCREEN}, c AS (SELECT status, count(*) AS n FROM gate GROUP BY status) SELECT '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS value FROM c")
def screen_summary(spark, d):
    return sinks.summary_json(_screened(spark, d))


@query("introns_at_least", f"WITH {B.SPANS} SELECT chrom, start, \"end\", '.' AS strand, mult FROM introns WHERE mult >= 2")
def introns_at_least(spark, d):
    return introns.at_least(introns.intron_multiset(B.aln(spark, d)), 2)


@query("downloadable_runs", f"WITH {B.BATCHES}, {B.RUNS} SELECT accession FROM runs WHERE accession NOT IN (SELECT accession FROM gated WHERE uniq_pct < 35)")
def downloadable_runs(spark, d):
    """Runs without a failed batch, at a limit that some runs pass and some do not."""
    lenient = quality.gate(_gated(spark, d).drop("success"), 35.0)
    return quality.good_runs(B.runs(spark, d), lenient).select("accession")


@query("merged_batches", f"WITH {B.ALN} SELECT qname, chrom, pos0, flag FROM aln WHERE run IN ('3', '5')")
def merged_batches(spark, d):
    a = B.aln(spark, d)
    return sinks.merged_records(a.where("run = '3'"), a.where("run = '5'"), partitions=3).select("qname", "chrom", "pos0", "flag")


@query("contig_weights", f"WITH {B.SCREEN} SELECT concat_ws(chr(9), acc, chrom, tile_idx, format('{{:.3f}}', round(w, 6))) AS value FROM stiles")
def contig_weights(spark, d):
    from ..operators import screen

    return sinks.tile_weight_lines(screen.screen_tiles(_records(spark, d), tile_size=B.TILE).withColumn("w", F.round("w", 6)))
