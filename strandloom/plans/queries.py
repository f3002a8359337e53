"""Named queries of the engine's operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import genomics as G
from ..operators import estimate, evaluate, introns, provenance, quality, ranking, runs, screen, tiles
from ..sources import sinks, text
from . import bindings as B
from .registry import query

T = B.TILE


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _umr(spark: SparkSession, d: str) -> DataFrame:
    return tiles.umr_per_tile(B.aln(spark, d), T)


@query("umr_per_tile", f"WITH {B.UMR} SELECT * FROM umr")
def umr_per_tile(spark, d):
    return _umr(spark, d)


@query("read_totals", f"WITH {B.ALN} SELECT count(*) AS n_reads, count(*) FILTER (WHERE s) AS n_spliced FROM (SELECT qname, bool_or(form > 0) AS s FROM aln WHERE flag & 4 = 0 GROUP BY qname)")
def read_totals(spark, d):
    return tiles.read_totals(B.aln(spark, d))


@query("score_s", f"WITH {B.UMR} SELECT round(sum(ln(1 + n)), 6) AS score, count(*) FILTER (WHERE n >= 1) AS tiles1, count(*) FILTER (WHERE n >= 10) AS tiles10 FROM umr")
def score_s(spark, d):
    return tiles.score(_umr(spark, d)).withColumn("score", F.round("score", 6))


@query("umr_per_run", f"WITH {B.ALN}, rt AS (SELECT run, qname, chrom, (pos0 + 1) // 500 AS tile_idx, count(*) AS hits FROM aln WHERE flag & 4 = 0 GROUP BY ALL), u AS (SELECT run, qname, min(chrom) AS chrom, min(tile_idx) AS tile_idx FROM rt GROUP BY run, qname HAVING count(*) = 1 AND max(hits) <= 2) SELECT run, chrom, tile_idx, count(*) AS n FROM u GROUP BY ALL")
def umr_per_run(spark, d):
    return tiles.umr_per_tile(B.aln(spark, d), T, "run")


@query("tile_accumulation", f"WITH {B.ALN}, rt AS (SELECT run, qname, chrom, (pos0 + 1) // 500 AS tile_idx, count(*) AS hits FROM aln WHERE flag & 4 = 0 GROUP BY ALL), u AS (SELECT run, qname, min(chrom) AS chrom, min(tile_idx) AS tile_idx FROM rt GROUP BY run, qname HAVING count(*) = 1 AND max(hits) <= 2) SELECT chrom, tile_idx, count(*) AS n FROM u GROUP BY ALL")
def tile_accumulation(spark, d):
    per_run = tiles.umr_per_tile(B.aln(spark, d), T, "run")
    odd = F.col("run").cast("long") % 2 == 1
    return tiles.accumulate(per_run.where(odd).drop("run"), per_run.where(~odd).drop("run"))


@query("tiles_ge_k", f"WITH {B.UMR} SELECT k, count(*) FILTER (WHERE n >= k) AS n_tiles FROM umr, (SELECT unnest([1, 5, 10, 50]) AS k) GROUP BY k")
def tiles_ge_k(spark, d):
    rows = _umr(spark, d).select("n", F.explode(F.array(*map(F.lit, (1, 5, 10, 50)))).alias("k"))
    return rows.groupBy("k").agg(F.count_if(F.col("n") >= F.col("k")).alias("n_tiles"))


@query("coverage_csv", f"WITH {B.UMR} SELECT chrom || ':' || CAST(tile_idx AS VARCHAR) || ';' || CAST(n AS VARCHAR) AS value FROM umr")
def coverage_csv(spark, d):
    return sinks.coverage_lines(_umr(spark, d))


@query("region_scan", f"WITH {B.ALN} SELECT qname, pos0, flag FROM aln WHERE chrom = 'chr0' AND pos0 >= 1000 AND pos0 < 2000")
def region_scan(spark, d):
    return tiles.starting_in(B.aln(spark, d), "chr0", 1000, 2000).select("qname", "pos0", "flag")


@query("region_groups", f"WITH {B.ALN}, l AS (SELECT chrom, max(pos0) + 1 AS length FROM aln GROUP BY chrom), s AS (SELECT greatest(1, CAST(ceil(sum(length) / 2000.0) AS BIGINT)) * 500 AS step FROM l) SELECT chrom, \"start\", least(\"start\" + step, length) AS \"end\" FROM (SELECT chrom, length, step, unnest(range(0, greatest(length, 1), CAST(step AS BIGINT))) AS \"start\" FROM l, s)")
def region_groups(spark, d):
    lengths = B.aln(spark, d).groupBy("chrom").agg((F.max("pos0") + 1).alias("length"))
    return tiles.region_groups(lengths, 4, T).select("chrom", "start", "end")


@query("intron_multiset", f"WITH {B.SPANS} SELECT chrom, start, \"end\", '.' AS strand, mult FROM introns")
def intron_multiset(spark, d):
    return introns.intron_multiset(B.aln(spark, d))


@query("intron_merge", f"WITH {B.SPANS} SELECT chrom, start, \"end\", '.' AS strand, CAST(2 * mult AS BIGINT) AS mult FROM introns")
def intron_merge(spark, d):
    one = introns.intron_multiset(B.aln(spark, d))
    return introns.merge(one, one)


@query("strand_assign", f"WITH {B.STRANDED} SELECT chrom, start, \"end\", strand, mult FROM stranded WHERE strand IS NOT NULL")
def strand_assign(spark, d):
    return _stranded(spark, d)


def _stranded(spark: SparkSession, d: str) -> DataFrame:
    return introns.assign_strand(introns.intron_multiset(B.aln(spark, d)), introns.genome_chunks(B.genome(spark, d), 1000), 1000)


@query("strand_cache", f"WITH {B.STRANDED} SELECT chrom, start, \"end\", strand, mult FROM stranded WHERE strand IS NOT NULL")
def strand_cache(spark, d):
    """Every second intron is known already; only the others touch the genome."""
    found = introns.intron_multiset(B.aln(spark, d))
    chunks = introns.genome_chunks(B.genome(spark, d), 1000)
    place = ["chrom", "start", "end"]
    old = found.where("start % 2 = 0")
    cache = old.select(*place).join(introns.assign_strand(old, chunks, 1000).select(*place, "strand"), place, "left")
    return introns.resolve_new(found, cache, chunks, 1000)[0]


@query("intron_gff", f"WITH {B.SPANS} SELECT concat_ws(chr(9), chrom, 'b2h', 'intron', start, \"end\", mult, '.', '.', 'mult=' || mult || ';pri=4;src=E') AS value FROM introns")
def intron_gff(spark, d):
    return sinks.intron_gff(introns.intron_multiset(B.aln(spark, d)))


@query("intron_gff_roundtrip", f"WITH {B.SPANS} SELECT chrom, start, \"end\", '.' AS strand, mult FROM introns")
def intron_gff_roundtrip(spark, d):
    return text.parse_gff_introns(sinks.intron_gff(introns.intron_multiset(B.aln(spark, d))))


@query("splice_sites", f"WITH {B.STRANDED} SELECT concat_ws(chr(9), chrom, start - 2, \"end\", strand) AS value FROM stranded WHERE strand IS NOT NULL AND start >= 2")
def splice_sites(spark, d):
    return sinks.splice_sites(_stranded(spark, d))


@query("junc_bed", f"WITH {B.STRANDED} SELECT concat_ws(chr(9), chrom, start - 2, \"end\" + 1, 'junc' || (row_number() OVER (ORDER BY chrom, start, \"end\", strand) - 1), least(mult, 1000), strand, start - 2, \"end\" + 1, '0', '2', '1,1', '0,' || (\"end\" - start + 2)) AS value FROM stranded WHERE strand IS NOT NULL AND start >= 2")
def junc_bed(spark, d):
    return sinks.junction_bed(_stranded(spark, d))


_HINTS = """, hints AS (SELECT chrom, start, start + gap - 1 AS "end", count(*) AS mult FROM spans WHERE
  (form = 1 AND gap >= 32 AND q >= 6) OR (form = 2 AND 5 + part % 15 <= 14 AND gap >= 32) OR (form = 3 AND 1 + part % 7 <= 5) GROUP BY ALL)"""


@query("hint_introns", f"WITH {B.SPANS}{_HINTS} SELECT chrom, start, \"end\", '.' AS strand, mult FROM hints")
def hint_introns(spark, d):
    return introns.hint_multiset(B.aln(spark, d))


@query("hint_gff", f"WITH {B.SPANS}{_HINTS} SELECT concat_ws(chr(9), chrom, 'b2h', 'intron', start, \"end\", mult, '.', '.', CASE WHEN mult > 1 THEN 'mult=' || mult || ';' ELSE '' END || 'pri=4;src=E') AS value FROM hints")
def hint_gff(spark, d):
    return sinks.hint_gff(introns.hint_multiset(B.aln(spark, d)))


@query("hint_stranded", f"WITH {B.SPANS}{_HINTS}, {B.GENOME}, m AS (SELECT h.*, substr(seq, start, 2) || substr(seq, \"end\" - 1, 2) AS m FROM hints h JOIN genome g ON g.chrom = h.chrom) SELECT * FROM (SELECT chrom, start, \"end\", CASE WHEN m IN ('gtag', 'gcag', 'atac') THEN '+' WHEN translate(reverse(m), 'acgt', 'tgca') IN ('gtag', 'gcag', 'atac') THEN '-' END AS strand, mult FROM m) WHERE strand IS NOT NULL")
def hint_stranded(spark, d):
    return introns.assign_strand(introns.hint_multiset(B.aln(spark, d)), introns.genome_chunks(B.genome(spark, d), 1000), 1000)


@query("gap_prefilter", f"WITH {B.SPANS} SELECT form, count(*) AS n FROM (SELECT line % 4 AS form, gap, part FROM spans) WHERE form > 0 AND (gap > 14 OR (form = 2 AND 5 + part % 15 > 14)) GROUP BY form")
def gap_prefilter(spark, d):
    return B.aln(spark, d).where(C.has_long_gap(C.operations(F.col("cigar")))).groupBy((F.col("line") % 4).alias("form")).agg(F.count("*").alias("n"))


@query("cigar_spans", f"WITH {B.SPANS} SELECT form, CAST(sum(span) AS BIGINT) AS span, CAST(sum(alen) AS BIGINT) AS alen FROM spans GROUP BY form")
def cigar_spans(spark, d):
    ops = C.operations(F.col("cigar"))
    return B.aln(spark, d).groupBy((F.col("line") % 4).alias("form")).agg(F.sum(C.reference_span(ops)).alias("span"), F.sum(C.aligned_query(ops)).alias("alen"))


@query("quality_long", f"WITH {B.ALN} SELECT run, count(*) AS n_primary, count(*) FILTER (WHERE mapq >= 30) AS num_uniq, round(100.0::DOUBLE * count(*) FILTER (WHERE mapq >= 30) / count(*), 6) AS uniq_pct FROM aln WHERE flag & 2308 = 0 GROUP BY run")
def quality_long(spark, d):
    return quality.uniqueness_long(B.aln(spark, d), 30, "run").withColumn("uniq_pct", F.round("uniq_pct", 6))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate(quality.uniqueness_short(B.batches(spark, d), 110), 50.0)


@query("quality_gate", f"WITH {B.BATCHES} SELECT accession, k, round(uniq_pct, 6) AS uniq_pct, success FROM gated")
def quality_gate(spark, d):
    return _gated(spark, d).select("accession", "k", _r("uniq_pct"), "success")


@query("good_runs", f"WITH {B.BATCHES}, {B.RUNS} SELECT accession FROM runs WHERE accession NOT IN (SELECT accession FROM gated WHERE NOT success)")
def good_runs(spark, d):
    return quality.good_runs(B.runs(spark, d), _gated(spark, d)).select("accession")


_STATS = ", rs AS (SELECT accession, CAST(sum(n_batches) AS BIGINT) AS times_downloaded, sum(uniq_pct * n_batches) / sum(n_batches) AS avg_umr_pct, sum(spliced_pct * n_batches) / sum(n_batches) AS avg_spliced_pct FROM gated WHERE success GROUP BY accession)"


@query("run_statistics", f"WITH {B.BATCHES}{_STATS} SELECT accession, times_downloaded, round(avg_umr_pct, 6) AS avg_umr_pct, round(avg_spliced_pct, 6) AS avg_spliced_pct FROM rs")
def run_statistics(spark, d):
    return quality.run_statistics(_gated(spark, d)).select("accession", "times_downloaded", _r("avg_umr_pct"), _r("avg_spliced_pct"))


@query("smoothed_mean", f"WITH {B.BATCHES}{_STATS} SELECT round((400.0::DOUBLE + sum(avg_umr_pct)) / (4 + count(*)), 6) AS mean FROM rs")
def smoothed_mean(spark, d):
    return quality.smoothed_mean(quality.run_statistics(_gated(spark, d)), "avg_umr_pct").select(_r("mean"))


@query("runlist_filter", f"WITH {B.RUNS} SELECT accession, total_spots, avg_len FROM runs WHERE NOT colorspace AND paired AND (upper(trim(platform)) IN ('', 'ILLUMINA'))")
def runlist_filter(spark, d):
    return runs.usable_runs(B.runs(spark, d), False, True).select("accession", "total_spots", "avg_len")


@query("runlist_first", f"WITH {B.RUNS} SELECT accession FROM runs WHERE NOT colorspace AND upper(trim(platform)) IN ('', 'PACBIO_SMRT', 'OXFORD_NANOPORE') ORDER BY accession LIMIT 7")
def runlist_first(spark, d):
    return runs.first_runs(runs.usable_runs(B.runs(spark, d), True), 7).select("accession")


@query("leftout_by_platform", f"WITH {B.RUNS} SELECT platform, count(*) AS n_runs FROM runs WHERE NOT colorspace AND upper(trim(platform)) IN ('PACBIO_SMRT', 'OXFORD_NANOPORE') GROUP BY platform")
def leftout_by_platform(spark, d):
    return runs.left_out_by_platform(B.runs(spark, d))


@query("platform_presets", f"WITH {B.RUNS} SELECT platform, CASE WHEN upper(trim(platform)) = 'OXFORD_NANOPORE' THEN 'ont' ELSE 'pacbio' END AS preset, count(*) AS n FROM runs GROUP BY ALL")
def platform_presets(spark, d):
    return B.runs(spark, d).groupBy("platform", G.long_read_preset(F.col("platform")).alias("preset")).agg(F.count("*").alias("n"))


@query("average_length", f"WITH {B.RUNS} SELECT accession, round_even(100.0::DOUBLE * total_bases / (total_spots + 7), 0) / 100 AS avg_len FROM runs")
def average_length(spark, d):
    return B.runs(spark, d).select("accession", G.average_length(F.col("total_bases").cast("double"), F.col("total_spots") + 7).alias("avg_len"))


@query("runlist_roundtrip", f"WITH {B.RUNS} SELECT accession, total_spots, total_bases, avg_len, paired, colorspace, trim(platform) AS platform, bioproject FROM runs")
def runlist_roundtrip(spark, d):
    return text.parse_run_list(sinks.run_list_lines(B.runs(spark, d)))


@query("batch_ranges", f"WITH {B.RUNS} SELECT accession, k, k * 50 AS n, least((k + 1) * 50 - 1, total_spots - 1) AS x FROM (SELECT accession, total_spots, unnest(range(greatest(1, CAST(ceil(total_spots / 50.0) AS BIGINT)))) AS k FROM runs)")
def batch_ranges(spark, d):
    return runs.batch_ranges(B.runs(spark, d), 50)


@query("shuffled_ranges", f"WITH {B.RUNS}, b AS (SELECT accession, total_spots, unnest(range(greatest(1, CAST(ceil(total_spots / 50.0) AS BIGINT)))) AS k FROM runs), l AS (SELECT *, k = max(k) OVER (PARTITION BY accession) AS last FROM b) SELECT accession, k, CAST(row_number() OVER (PARTITION BY accession ORDER BY last, md5('7:' || accession || ':' || CAST(k AS VARCHAR)), k) - 1 AS INTEGER) AS visit FROM l")
def shuffled_ranges(spark, d):
    return runs.shuffled_ranges(B.runs(spark, d), 50, 7).select("accession", "k", "visit")


_RR = ", rr AS (SELECT accession, CASE WHEN bioproject <> '' THEN sha1(bioproject) ELSE sha1(chr(0) || accession) END AS bh, sha1(accession) AS oh FROM runs), rd AS (SELECT *, row_number() OVER (PARTITION BY bh ORDER BY oh, accession) - 1 AS depth FROM rr), rp AS (SELECT accession, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY depth, bh) AS INTEGER) AS position FROM rd)"


@query("round_robin_candidates", f"WITH {B.RUNS}{_RR} SELECT accession, depth, position FROM rp WHERE position <= 60")
def round_robin_candidates(spark, d):
    return runs.round_robin(B.runs(spark, d), 60).select("accession", "depth", "position")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("accession").cast("long")
    return B.runs(spark, d).where(k % 3 != 0).select("accession", F.when(k % 5 == 0, "error").when(k % 5 == 1, "absent").otherwise("available").alias("status"))


_CACHE = ", cache AS (SELECT accession, CASE WHEN CAST(accession AS BIGINT) % 5 = 0 THEN 'error' WHEN CAST(accession AS BIGINT) % 5 = 1 THEN 'absent' ELSE 'available' END AS status FROM runs WHERE CAST(accession AS BIGINT) % 3 <> 0)"


@query("availability_todo", f"WITH {B.RUNS}{_CACHE} SELECT accession FROM runs WHERE accession NOT IN (SELECT accession FROM cache WHERE status <> 'error')")
def availability_todo(spark, d):
    return runs.availability_todo(B.runs(spark, d), _cache(spark, d)).select("accession")


@query("candidate_topup", f"WITH {B.RUNS}{_RR}{_CACHE}, o AS (SELECT position, accession, coalesce(status, 'absent') AS status FROM rp LEFT JOIN cache USING (accession)) SELECT * FROM o WHERE coalesce((SELECT count(*) FROM o p WHERE p.position < o.position AND p.status = 'available'), 0) < 10")
def candidate_topup(spark, d):
    order = runs.round_robin(B.runs(spark, d)).select("accession", "position").join(_cache(spark, d), "accession", "left")
    return runs.top_up(order.select("position", "accession", F.coalesce("status", F.lit("absent")).alias("status")), 10)


@query("unsampled_runs", f"WITH {B.RUNS}{_CACHE} SELECT accession, 'unsampled' AS status FROM (SELECT accession FROM runs EXCEPT SELECT accession FROM cache)")
def unsampled_runs(spark, d):
    return runs.unsampled(B.runs(spark, d), _cache(spark, d))


@query("duplicate_names", "SELECT name, count(*) AS n FROM (SELECT regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM part) GROUP BY name HAVING count(*) > 1")
def duplicate_names(spark, d):
    return runs.duplicate_names(B.load(spark, d, "part").select(G.safe_name(F.col("p_brand")).alias("name")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return screen.contig_records(B.contig_aln(spark, d), B.contigs(spark, d))


def _per_run(spark: SparkSession, d: str) -> DataFrame:
    return B.contigs(spark, d).groupBy("acc").agg(F.count("*").alias("n_contigs"))


@query("screen_scalars", f"WITH {B.SCREEN} SELECT acc, n_contigs, n_aligned, aligned_bp, n_spliced, round(mass_total, 4) AS mass_total, round(mass_mapped, 4) AS mass_mapped, round(tile_mass, 4) AS tile_mass, round(100.0::DOUBLE * n_aligned / n_contigs, 6) AS mapped_pct, round(100.0::DOUBLE * mass_mapped / mass_total, 6) AS yield_pct FROM nc JOIN scalars USING (acc)")
def screen_scalars(spark, d):
    s = screen.screen_scalars(_records(spark, d), _per_run(spark, d))
    return s.select("acc", "n_contigs", "n_aligned", "aligned_bp", "n_spliced", _r("mass_total", 4), _r("mass_mapped", 4), _r("tile_mass", 4), _r("mapped_pct"), _r("yield_pct"))


@query("screen_tiles", f"WITH {B.SCREEN} SELECT acc, chrom, tile_idx, round(w, 6) AS w FROM stiles")
def screen_tiles(spark, d):
    return screen.screen_tiles(_records(spark, d), tile_size=T).withColumn("w", F.round("w", 6))


@query("screen_introns", f"WITH {B.SCREEN} SELECT run AS acc, chrom, start, start + gap - 1 AS \"end\", sum(w) AS w FROM recs WHERE ok AND form > 0 GROUP BY ALL")
def screen_introns(spark, d):
    return screen.screen_introns(_records(spark, d))


@query("intron_union", f"WITH {B.SCREEN} SELECT chrom, start, start + gap - 1 AS \"end\", '.' AS strand, greatest(1, CAST(round_even(sum(w) / 3, 0) AS BIGINT)) AS mult FROM recs WHERE ok AND form > 0 GROUP BY ALL")
def intron_union(spark, d):
    w = screen.screen_introns(_records(spark, d)).select("chrom", "start", "end", F.lit(".").alias("strand"), "w")
    sums = w.groupBy("chrom", "start", "end", "strand").agg((F.sum("w") / 3).alias("w"))
    return introns.union_of_runs(sums)


@query("weighted_median", f"WITH {B.SCREEN} SELECT * FROM med")
def weighted_median(spark, d):
    return screen.weighted_median(screen.divergence_values(_records(spark, d)))


def _screened(spark: SparkSession, d: str) -> DataFrame:
    rec = _records(spark, d)
    n = _per_run(spark, d)
    least = int(n.agg(F.avg("n_contigs")).first()[0] * 0.95 + 0.5)  # one number
    t = screen.screen_tiles(rec, tile_size=T).groupBy("acc").agg(F.count("*").alias("n_tiles"))
    s = screen.screen_scalars(rec, n).join(t, "acc", "left").join(screen.weighted_median(screen.divergence_values(rec)), "acc", "left").withColumnRenamed("median", "divergence")
    k = F.col("acc").cast("long")
    s = s.withColumns({"n_tiles": F.coalesce("n_tiles", F.lit(0)), "status": F.when(k % 11 == 0, "absent").otherwise("pending"), "bioproject": F.concat(F.lit("P"), (k % 7).cast("string"))})
    return screen.gate_status(s, least, 0.9, 0.065)


@query("gate_status", f"WITH {B.SCREEN} SELECT acc, status FROM gate")
def gate_status(spark, d):
    return _screened(spark, d).select("acc", "status")


@query("status_counts", f"WITH {B.SCREEN} SELECT status, count(*) AS n FROM gate GROUP BY status")
def status_counts(spark, d):
    return _screened(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("acceptance_rate", f"WITH {B.SCREEN} SELECT count(*) FILTER (WHERE status = 'accepted')::DOUBLE / count(*) FILTER (WHERE status IN ('accepted', 'rejected', 'too_few_contigs')) AS rate FROM gate")
def acceptance_rate(spark, d):
    return screen.acceptance_rate(_screened(spark, d))


@query("prior_mass", f"WITH {B.SCREEN} SELECT s.acc, chrom, tile_idx, round(w / sum(w) OVER (PARTITION BY s.acc) * 25000.0, 6) AS prior FROM stiles s JOIN gate g ON g.acc = s.acc WHERE status = 'accepted'")
def prior_mass(spark, d):
    p = screen.prior_mass(screen.screen_tiles(_records(spark, d), tile_size=T), _screened(spark, d), 50_000)
    return p.withColumn("prior", F.round("prior", 6))


_PRIOR = ", pr AS (SELECT r.accession, greatest(1, CAST(ceil(total_spots / 50.0) AS BIGINT)) AS max_batches, status, CASE WHEN CAST(r.accession AS BIGINT) % 2 = 0 THEN CAST(r.accession AS BIGINT) % 9 + 1 ELSE 0 END AS rank, yield_pct FROM runs r LEFT JOIN gate g ON g.acc = r.accession AND CAST(g.acc AS BIGINT) % 13 > 0), ok AS (SELECT *, status = 'accepted' AND rank BETWEEN 1 AND 8 AS good FROM pr), cap AS (SELECT count(*) FILTER (WHERE good) AS n_ok, coalesce(sum(CASE WHEN good THEN max_batches END), 0) AS room FROM ok)"


@query("prior_capacity_rule", f"WITH {B.SCREEN}, {B.RUNS}{_PRIOR} SELECT accession, max_batches, CASE WHEN status = 'accepted' THEN 'accepted' ELSE 'unprocessed' END AS status, CAST(CASE WHEN status IS NULL THEN 0 ELSE rank END AS INTEGER) AS rank FROM ok, cap WHERE CASE WHEN status = 'rejected' THEN false WHEN status = 'accepted' THEN good ELSE NOT (n_ok > 0 AND room >= 3) END")
def prior_capacity_rule(spark, d):
    r = B.runs(spark, d).select("accession", G.batches_of(F.col("total_spots"), 50).alias("max_batches"))
    k = F.col("acc").cast("long")
    s = _screened(spark, d).where(k % 13 > 0).select(F.col("acc").alias("accession"), "status", F.when(k % 2 == 0, k % 9 + 1).otherwise(0).cast("int").alias("rank"), "yield_pct")
    return screen.prior_runs(r, s, top=8, only=True, max_batches=3).drop("yield")


def _rank_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.scaled_rows(screen.screen_tiles(_records(spark, d), tile_size=T), _screened(spark, d), 25.0)


_ROWS = ", rows AS (SELECT s.acc, chrom, tile_idx, CAST(w * (25.0::DOUBLE * greatest(0.01, least(1.0, yield_pct / 100)) / sum(w) OVER (PARTITION BY s.acc)) AS FLOAT)::DOUBLE AS v FROM stiles s JOIN gate g ON g.acc = s.acc WHERE status = 'accepted')"


@query("greedy_gains", f"WITH {B.SCREEN}{_ROWS} SELECT acc, round(sum(ln(1 + v)), 4) AS gain FROM rows GROUP BY acc")
def greedy_gains(spark, d):
    return ranking.first_gains(_rank_rows(spark, d)).withColumn("gain", F.round("gain", 4))


@query("greedy_second_gains", f"WITH {B.SCREEN}{_ROWS}, g1 AS (SELECT acc, sum(ln(1 + v)) AS g FROM rows GROUP BY acc), best AS (SELECT acc FROM g1 ORDER BY round(g, 6) DESC, acc LIMIT 1), c AS (SELECT chrom, tile_idx, v AS c FROM rows WHERE acc IN (SELECT acc FROM best)) SELECT acc, round(sum(ln(1 + coalesce(c, 0) + v) - ln(1 + coalesce(c, 0))), 4) AS gain FROM rows LEFT JOIN c USING (chrom, tile_idx) WHERE acc NOT IN (SELECT acc FROM best) GROUP BY acc")
def greedy_second_gains(spark, d):
    rows = _rank_rows(spark, d)
    best = ranking.first_gains(rows).orderBy(F.desc(F.round("gain", 6)), "acc").limit(1).select("acc")
    covered = rows.join(best, "acc", "left_semi").select("chrom", "tile_idx", F.col("v").cast("double").alias("c"))
    return ranking.first_gains(rows.join(best, "acc", "left_anti"), covered).withColumn("gain", F.round("gain", 4))


@query("greedy_full")
def greedy_full(spark, d):
    s = _screened(spark, d)
    return ranking.rank(screen.screen_tiles(_records(spark, d), tile_size=T), s, 25.0)


@query("ranking_order", f"WITH {B.SCREEN}, k AS (SELECT acc, status, n_tiles, CASE WHEN status = 'accepted' AND CAST(acc AS BIGINT) % 3 = 0 THEN CAST(acc AS INTEGER) END AS rank FROM gate) SELECT acc, CAST(row_number() OVER (ORDER BY CASE WHEN coalesce(rank, 0) > 0 THEN rank ELSE 1000000000 END, list_position(['accepted', 'rejected', 'too_few_contigs', 'absent', 'error', 'unsampled'], status), n_tiles DESC, acc) AS INTEGER) AS position FROM k")
def ranking_order(spark, d):
    k = F.col("acc").cast("int")
    s = _screened(spark, d).withColumn("rank", F.when((F.col("status") == "accepted") & (k % 3 == 0), k))
    return ranking.ranking_order(s).select("acc", "position")


_MODEL = B.UMR + """, rt2 AS (SELECT run, qname, chrom, (pos0 + 1) // 500 AS tile_idx, count(*) AS hits FROM aln WHERE flag & 4 = 0 GROUP BY ALL
), u2 AS (SELECT run, qname, min(chrom) AS chrom, min(tile_idx) AS tile_idx FROM rt2 GROUP BY run, qname HAVING count(*) = 1 AND max(hits) <= 2
), cnt AS (SELECT run AS accession, chrom, tile_idx, count(*)::DOUBLE AS c FROM u2 WHERE CAST(run AS BIGINT) % 3 = 0 GROUP BY ALL HAVING (chrom, tile_idx) IN (SELECT (chrom, tile_idx) FROM umr)
), tot AS (SELECT sum(n)::DOUBLE AS s, count(*) AS t FROM umr
), sm AS (SELECT chrom, tile_idx, n::DOUBLE AS x, 0.1::DOUBLE + 3.0::DOUBLE * (n / s) * t AS smooth, t * 0.1::DOUBLE + 3.0::DOUBLE * t AS z FROM umr, tot
), cr AS (SELECT accession, sum(c) AS c_run FROM cnt GROUP BY 1
), p AS (SELECT r.accession, sm.chrom, sm.tile_idx, x, (smooth + coalesce(c, 0)) / (z + coalesce(c_run, 0)) AS p FROM (SELECT DISTINCT run AS accession FROM aln) r CROSS JOIN sm LEFT JOIN cnt ON cnt.accession = r.accession AND cnt.chrom = sm.chrom AND cnt.tile_idx = sm.tile_idx LEFT JOIN cr ON cr.accession = r.accession)"""


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pooled = _umr(spark, d)
    real = tiles.umr_per_tile(B.aln(spark, d).where(F.col("run").cast("long") % 3 == 0), T, "run").withColumnRenamed("run", "accession")
    return estimate.merged_counts(real, None, pooled), pooled, B.aln(spark, d).select(F.col("run").alias("accession")).distinct()


@query("tile_distribution", f"WITH {_MODEL} SELECT accession, chrom, tile_idx, round(p, 9) AS p FROM p")
def tile_distribution(spark, d):
    counts, pooled, r = _model(spark, d)
    return estimate.tile_distribution(counts, pooled, r).withColumn("p", F.round("p", 9))


_EFF = "CASE WHEN CAST(accession AS BIGINT) % 3 = 0 THEN (60.0 + CAST(accession AS BIGINT) % 7) / 100 * 500 WHEN CAST(accession AS BIGINT) % 3 = 1 THEN 0.01 * 120.0 / 100 * 500 ELSE 0.75 * 120.0 / 100 * 500 END"


def _effective(r: DataFrame) -> DataFrame:
    k = F.col("accession").cast("long")
    own = k % 3 == 0
    r = r.withColumns({"times_downloaded": own.cast("int"), "avg_umr_pct": F.when(own, 40.0 + k % 7), "avg_spliced_pct": F.when(own, 20.0), "yield": F.when(k % 3 == 1, 0.001), "status": F.lit("unprocessed")})
    return estimate.effective_reads(r, 80.0, 40.0, 500, 0.75)


@query("effective_reads", f"WITH {B.ALN} SELECT accession, round({_EFF}, 6) AS reads FROM (SELECT DISTINCT run AS accession FROM aln)")
def effective_reads(spark, d):
    return _effective(B.aln(spark, d).select(F.col("run").alias("accession")).distinct()).select("accession", _r("reads"))


@query("expected_profit", f"WITH {_MODEL}, e AS (SELECT *, {_EFF} AS reads FROM p) SELECT accession, round(sum(ln(1 + x + p * reads) - ln(1 + x)), 6) AS profit FROM e GROUP BY accession")
def expected_profit(spark, d):
    counts, pooled, r = _model(spark, d)
    return estimate.expected_profit(counts, pooled, _effective(r)).select("accession", _r("profit"))


@query("next_run", f"WITH {_MODEL}, e AS (SELECT *, {_EFF} AS reads FROM p), g AS (SELECT accession, round(sum(ln(1 + x + p * reads) - ln(1 + x)), 6) AS profit FROM e GROUP BY accession) SELECT accession, profit FROM g ORDER BY profit DESC, accession LIMIT 1")
def next_run(spark, d):
    return expected_profit(spark, d).orderBy(F.desc("profit"), "accession").limit(1)


@query("pool_profit", f"WITH {_MODEL}, e AS (SELECT *, {_EFF} AS reads FROM p), g AS (SELECT accession, sum(ln(1 + x + p * reads) - ln(1 + x)) AS profit FROM e GROUP BY accession) SELECT round(profit, 5) AS profit, count(*) AS n_runs FROM g WHERE CAST(accession AS BIGINT) % 3 > 0 GROUP BY 1")
def pool_profit(spark, d):
    counts, pooled, r = _model(spark, d)
    fresh = _effective(r).where("times_downloaded = 0")
    return estimate.expected_profit(counts, pooled, fresh).groupBy(F.round("profit", 5).alias("profit")).agg(F.count("*").alias("n_runs"))


@query("expected_gain", f"WITH {_MODEL} SELECT chrom, tile_idx, round(p * 300.0, 6) AS gain FROM p WHERE accession = '3' AND p * 300.0 > 1e-9")
def expected_gain(spark, d):
    counts, pooled, r = _model(spark, d)
    return estimate.expected_gain(estimate.tile_distribution(counts, pooled, r.where("accession = '3'")), 300.0).withColumn("gain", F.round("gain", 6))


def _db(spark: SparkSession, d: str) -> DataFrame:
    """Log of lines (part and brand) over five versions."""
    k = F.col("p_partkey").cast("long")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (k % 7).cast("string")), (k % 1000).cast("string"), (k % 1000 + 50).cast("string"), F.lit("+"))
    sets = B.load(spark, d, "part").select(k.alias("k"), line.alias("line"))
    versions = [sets.where("k < 0")] + [sets.where(f"(k + {v}) % {v + 2} > 0") for v in range(1, 6)]
    out = None
    for v in range(1, 6):
        step = provenance.db_diff(versions[v - 1], versions[v], v)
        out = step if out is None else out.unionByName(step)
    return out


_DB = "lines AS (SELECT CAST(p_partkey AS BIGINT) AS k, concat_ws(chr(9), 'chr' || (CAST(p_partkey AS BIGINT) % 7), CAST(p_partkey AS BIGINT) % 1000, CAST(p_partkey AS BIGINT) % 1000 + 50, '+') AS line FROM part), vs AS (SELECT DISTINCT v, line FROM lines, (SELECT unnest([1, 2, 3, 4, 5]) AS v) WHERE (k + v) % (v + 2) > 0), dblog AS (SELECT CAST(v AS INTEGER) AS version, '+' AS op, line FROM vs a WHERE NOT EXISTS (SELECT 1 FROM vs b WHERE b.v = a.v - 1 AND b.line = a.line) UNION ALL SELECT CAST(v + 1 AS INTEGER), '-', line FROM vs a WHERE v < 5 AND NOT EXISTS (SELECT 1 FROM vs b WHERE b.v = a.v + 1 AND b.line = a.line))"


@query("db_diff", f"WITH {_DB} SELECT version, op, line FROM dblog")
def db_diff(spark, d):
    return _db(spark, d)


@query("db_snapshot_asof", f"WITH {_DB} SELECT line FROM vs WHERE v = 3")
def db_snapshot_asof(spark, d):
    return provenance.snapshot(_db(spark, d), 3)


@query("db_versions_of_batches", f"WITH {_DB} SELECT CAST(b AS INTEGER) AS batch, CAST(b % 6 AS INTEGER) AS db_version, (SELECT count(*) FROM vs WHERE v = b % 6) AS n_lines FROM (SELECT unnest(range(40)) AS b)")
def db_versions_of_batches(spark, d):
    b = spark.range(40).select(F.col("id").cast("int").alias("batch"), (F.col("id") % 6).cast("int").alias("db_version"))
    log = _db(spark, d).unionByName(spark.createDataFrame([(0, "+", None)], "version int, op string, line string").where("line is not null"))
    return provenance.snapshots_of(b, log)


@query("db_version_counter", "SELECT CAST(event_id AS BIGINT) AS batch, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS version FROM events")
def db_version_counter(spark, d):
    e = B.load(spark, d, "events")
    return provenance.running_version(e.select(F.col("event_id").cast("long").alias("batch"), (F.col("user_id") % 3 == 0).alias("changed")))


@query("manifest_compare", f"WITH {B.BATCHES}, r AS (SELECT CAST(accession AS BIGINT) * 10 + k AS batch, uniq_pct FROM gated), n AS (SELECT batch, uniq_pct + CASE WHEN batch % 5 = 1 THEN 0.5 ELSE 0.001 END AS now FROM r WHERE batch % 7 > 0) SELECT r.batch, CASE WHEN now IS NULL THEN 'missing' WHEN abs(uniq_pct - now) > 0.01 THEN 'differs' ELSE 'same' END AS status FROM r LEFT JOIN n USING (batch)")
def manifest_compare(spark, d):
    r = _gated(spark, d).select((F.col("accession").cast("long") * 10 + F.col("k")).alias("batch"), "uniq_pct")
    now = r.where("batch % 7 > 0").withColumn("uniq_pct", F.col("uniq_pct") + F.when(F.col("batch") % 5 == 1, 0.5).otherwise(0.001))
    return provenance.compare_manifest(r, now)


@query("cds_introns", "WITH c AS (SELECT 'chr' || CAST(CAST(l_suppkey AS BIGINT) % 10 AS VARCHAR) AS chrom, CAST(l_orderkey AS BIGINT) AS parent, CAST(l_partkey AS BIGINT) * 20 AS s, CAST(l_partkey AS BIGINT) * 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), g AS (SELECT chrom, s, lag(e) OVER (PARTITION BY chrom, parent ORDER BY s, e) AS b FROM c) SELECT DISTINCT chrom, b + 1 AS start, s - 1 AS \"end\" FROM g WHERE s - b > 1")
def cds_introns(spark, d):
    c = lambda n: F.col(n).cast("long")
    cds = B.load(spark, d, "lineitem").select(F.concat(F.lit("chr"), (c("l_suppkey") % 10).cast("string")).alias("chrom"), c("l_orderkey").cast("string").alias("parents"), (c("l_partkey") * 20).alias("start"), (c("l_partkey") * 20 + c("l_quantity")).alias("end"))
    return evaluate.coding_introns(cds)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = B.aln(spark, d)
    return introns.intron_multiset(a.where("qname % 2 = 0")), introns.intron_multiset(a.where("qname % 3 = 0"))


_HALVES = B.SPANS + """, pred AS (SELECT chrom, start, start + gap - 1 AS "end", count(*) AS mult FROM spans WHERE form > 0 AND flag & 4 = 0 AND qname % 2 = 0 GROUP BY ALL
), ref AS (SELECT DISTINCT chrom, start, start + gap - 1 AS "end" FROM spans WHERE form > 0 AND flag & 4 = 0 AND qname % 3 = 0)"""


@query("sn_sp", f"WITH {_HALVES}, pw AS (SELECT * FROM pred WHERE \"end\" - start + 1 BETWEEN 32 AND 350000), l AS (SELECT CAST(unnest([1, 2, 5]) AS INTEGER) AS level), c AS (SELECT level, count(pw.chrom) AS n_pred, count(ref.chrom) AS common FROM l LEFT JOIN pw ON mult >= level LEFT JOIN ref ON ref.chrom = pw.chrom AND ref.start = pw.start AND ref.\"end\" = pw.\"end\" GROUP BY level) SELECT level, common, common::DOUBLE / (SELECT count(*) FROM ref) AS sn, CASE WHEN n_pred > 0 THEN common::DOUBLE / n_pred END AS sp FROM c")
def sn_sp(spark, d):
    return evaluate.sn_sp(*_halves(spark, d))


@query("jaccard", f"WITH {_HALVES}, i AS (SELECT count(*) AS common FROM pred JOIN ref USING (chrom, start, \"end\")), u AS (SELECT count(*) AS either FROM (SELECT chrom, start, \"end\" FROM pred UNION SELECT chrom, start, \"end\" FROM ref)) SELECT common, either, common::DOUBLE / either AS jaccard FROM i, u")
def jaccard(spark, d):
    return evaluate.jaccard(*_halves(spark, d))


@query("arm_report", "WITH t AS (SELECT event_type AS arm, CAST(user_id % 3 + 1 AS INTEGER) AS nb, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS success, event_id % 100 AS v FROM events), a AS (SELECT arm, sum(nb)::BIGINT AS n_batches, sum(CASE WHEN success = 0 THEN nb ELSE 0 END)::BIGINT AS n_rejected, sum(v)::DOUBLE AS t_batch FROM t GROUP BY arm) SELECT arm, n_batches, n_rejected, t_batch, round((SELECT t_batch FROM a ORDER BY arm LIMIT 1) / t_batch, 9) AS speed_up FROM a")
def arm_report(spark, d):
    e = B.load(spark, d, "events")
    v = (F.col("event_id") % 100).cast("double")
    t = e.select(F.col("event_type").alias("arm"), (F.col("user_id") % 3 + 1).alias("n_batches"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).alias("success"), *[v.alias(c) for c in ("t_download", "t_align", "t_scan", "t_db", "t_estimate", "t_batch")])
    base = e.agg(F.min("event_type")).first()[0]
    return evaluate.arm_report(t, base).select("arm", "n_batches", "n_rejected", "t_batch", F.round("speed_up", 9).alias("speed_up"))


def _gtf(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts from orders, exons from their lines."""
    li = B.load(spark, d, "lineitem").where("l_orderkey % 50 = 0")
    tid = F.format_string('transcript_id "T%d";', F.col("l_orderkey").cast("long"))
    at = F.col("l_partkey").cast("long") * 10
    cols = lambda kind, s, e, info: [F.lit("chr1").alias("c0"), F.lit("x").alias("c1"), F.lit(kind).alias("c2"), s.cast("string").alias("c3"), e.cast("string").alias("c4"), F.lit(".").alias("c5"), F.lit("+").alias("c6"), F.lit(".").alias("c7"), info.alias("c8")]
    exons = li.select(*cols("exon", at, at + F.col("l_linenumber"), tid))
    heads = li.select("l_orderkey").distinct().select(*cols("transcript", F.lit(1), F.lit(2), F.concat(tid, F.format_string(' cov "%d"; TPM "%d";', F.col("l_orderkey").cast("long") % 13, F.col("l_orderkey").cast("long") % 5))))
    return exons.unionByName(heads)


@query("gtf_fingerprint", "WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_partkey AS BIGINT) * 10 AS s, CAST(l_partkey AS BIGINT) * 10 + l_linenumber AS e FROM lineitem WHERE l_orderkey % 50 = 0), t AS (SELECT o, string_agg(s || '-' || e, ',' ORDER BY s, s || '-' || e) AS ex FROM e GROUP BY o) SELECT md5(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT 'chr1' || chr(9) || '+' || chr(9) || ex || chr(9) || 'TPM=' || (o % 5) || ';cov=' || (o % 13) AS line FROM t)")
def gtf_fingerprint(spark, d):
    return provenance.transcript_fingerprint(_gtf(spark, d))


@query("log_phases", "WITH p AS (SELECT o_orderkey % 1000 AS k, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(k + 1 AS BIGINT) AS batch, CAST(1 + k % 5 AS DOUBLE) AS t_align, CAST(2 + k % 3 AS DOUBLE) AS t_scan, CAST(60 - (1 + k % 5) - (2 + k % 3) - 1 AS DOUBLE) AS t_download FROM (SELECT unnest(range(30)) AS k) WHERE k < 29")
def log_phases(spark, d):
    """A log of 30 batches, a minute each."""
    k = F.col("id")
    t0 = F.lit(1_700_000_000) + k * 60
    marks = F.array(F.struct(t0.alias("t"), F.format_string("Batch %d", k).alias("m")), F.struct((t0 + 1).alias("t"), F.lit("HISAT2 done").alias("m")), F.struct((t0 + 2 + k % 5).alias("t"), F.lit("3 UMRs across 2 tiles").alias("m")), F.struct((t0 + 4 + k % 5 + k % 3).alias("t"), F.lit("fastq-dump start").alias("m")))
    rows = spark.range(30).select(k, F.posexplode(marks).alias("p", "x"))
    lines = rows.select((k * 4 + F.col("p")).alias("line_no"), F.concat(F.date_format(F.col("x.t").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO varlog.loop: "), F.col("x.m")).alias("value"))
    return evaluate.log_phases(lines)


@query("uniq_from_log", "SELECT CAST(4711 AS BIGINT) AS num_uniq")
def uniq_from_log(spark, d):
    lines = ["10000 reads", "  12 aligned concordantly 0 times", "    4711 (47.11%) aligned concordantly exactly 1 time", "    99 (1%) aligned exactly 1 time"]
    return text.uniquely_aligned(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))


@query("genome_lengths", f"WITH {B.GENOME} SELECT chrom, length(seq) AS length FROM genome")
def genome_lengths(spark, d):
    """Index lines of the genome, read back with the length check."""
    fai = B.genome(spark, d).select(F.concat_ws("\t", "chrom", F.length("seq").cast("string"), F.lit("0")).alias("value"))
    return text.sequence_lengths(fai)


@query("run_statistics_csv", f"WITH {B.BATCHES}{_STATS} SELECT accession || ';' || times_downloaded AS value FROM rs")
def run_statistics_csv(spark, d):
    s = quality.run_statistics(_gated(spark, d)).withColumn("bad_quality", F.lit(False))
    return sinks.run_statistics_lines(s).select(F.substring_index("value", ";", 2).alias("value"))
