import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import genomics as G
from strandloom.operators import estimate, evaluate, introns, provenance, quality, ranking, runs, screen, tiles

ALN = "qname string, flag int, chrom string, pos0 long, cigar string"


def aln(spark, rows):
    return spark.createDataFrame(rows, ALN)


def umr(df, size=5000):
    return {(r.chrom, r.tile_idx): r.n for r in tiles.umr_per_tile(df, size).collect()}


def test_umr_basic(spark):
    rows = [("r1", 0, "chr1", 0, "50M"), ("r2", 0, "chr1", 10, "50M"), ("r2", 256, "chr1", 6000, "50M"), ("r3", 99, "chr1", 10010, "50M"), ("r3", 147, "chr1", 10200, "50M")]
    assert umr(aln(spark, rows)) == {("chr1", 0): 1, ("chr1", 2): 1}


def test_umr_three_hits_in_one_tile(spark):
    assert umr(aln(spark, [("r", 0, "chr1", p, "50M") for p in (0, 100, 200)])) == {}


def test_read_totals(spark):
    r = tiles.read_totals(aln(spark, [("r1", 0, "chr1", 5, "50M"), ("r2", 0, "chr1", 9, "30M100N30M"), ("r3", 4, None, -1, "*")])).first()
    assert (r.n_reads, r.n_spliced) == (2, 1)


def test_umr_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(f"r{rnd.randrange(400)}", rnd.choice([0, 16, 256, 4]), rnd.choice(["chr1", "chr2"]), rnd.randrange(30000), "50M") for _ in range(1200)]
    by = defaultdict(list)
    for q, flag, c, p, _ in rows:
        if not flag & 4:
            by[q].append((c, (p + 1) // 5000))
    want = Counter(t[0] for t in by.values() if len(set(t)) == 1 and len(t) <= 2)
    assert umr(aln(spark, rows)) == dict(want)


def test_region_groups_cover_once(spark):
    lengths = spark.createDataFrame([("a", 23000), ("b", 1200), ("c", 852_000_000)], "chrom string, length long")
    for parts in (1, 3, 16):
        rows = sorted((r.chrom, r.start, r.end) for r in tiles.region_groups(lengths, parts).collect())
        for chrom, n in (("a", 23000), ("b", 1200), ("c", 852_000_000)):
            own = [(s, e) for c, s, e in rows if c == chrom]
            assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] and x[1] % 5000 == 0 for x, y in zip(own, own[1:], strict=False))


def test_introns_and_strand(spark):
    found = introns.intron_multiset(aln(spark, [("r", 0, "chr1", 99, "30M200N30M"), ("s", 256, "chr1", 99, "30M200N30M")])).collect()
    assert [(r.chrom, r.start, r.end, r.mult) for r in found] == [("chr1", 130, 329, 2)]
    genome = spark.createDataFrame([("p", "N" * 10 + "GT" + "N" * 36 + "AG" + "N" * 100), ("m", "N" * 10 + "CT" + "N" * 36 + "AC" + "N" * 100), ("x", "N" * 10 + "AA" + "N" * 36 + "TT" + "N" * 100)], "chrom string, seq string")
    rows = spark.createDataFrame([(c, 11, 50, ".", 7) for c in ("p", "m", "x", "gone")], "chrom string, start long, end long, strand string, mult long")
    for chunk in (10, 11, 49, 1000):
        got = {r.chrom: (r.strand, r.mult) for r in introns.assign_strand(rows, introns.genome_chunks(genome, chunk), chunk).collect()}
        assert got == {"p": ("+", 7), "m": ("-", 7)}


def test_platform_fits(spark):
    rows = spark.createDataFrame([("",), ("ILLUMINA",), (" pacbio_smrt",), ("OXFORD_NANOPORE",), (None,)], "p string")
    assert [r[0] for r in rows.select(G.platform_fits(F.col("p"), True)).collect()] == [True, False, True, True, True]
    assert [r[0] for r in rows.select(G.platform_fits(F.col("p"), False)).collect()] == [True, True, False, False, True]


def test_library_names(spark):
    pairs = [("lib_1.fq.gz", "lib_2.fq.gz", "lib"), ("S1_R1_001.fastq.gz", "S1_R2_001.fastq.gz", "S1"), ("abcX.fq", "abcY.fq", "abc"), ("a b.fq", "a b.fq", "a_b")]
    rows = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.got == r.want for r in rows.select(G.paired_name(F.col("a"), F.col("b")).alias("got"), "want").collect())


def test_uniqueness(spark):
    rows = [("a", 0, "c", 60), ("b", 0, "c", 60), ("d", 0, "c", 60), ("e", 0, "c", 0), ("f", 256, "c", 60), ("g", 4, None, 0)]
    df = spark.createDataFrame(rows, "qname string, flag int, chrom string, mapq int").withColumn("pos0", F.lit(1))
    r = quality.uniqueness_long(df, 1).first()
    assert (r.num_uniq, r.uniq_pct) == (3, 75.0)


def test_weighted_median(spark):
    rows = spark.createDataFrame([("a", 0.20, 100.0), ("a", 0.01, 300.0), ("a", 0.30, 50.0), ("b", 0.5, 1.0)], "acc string, v double, w double")
    assert {r.acc: r.median for r in screen.weighted_median(rows).collect()} == {"a": 0.01, "b": 0.5}


def test_screen_scan(spark):
    """Weights: capped abundance times span over 150; one for unknown abundance."""
    rows = [("SRR1_0", 0, "chr1", 0, "160M"), ("SRR1_1", 0, "chr1", 100, "100M"), ("SRR1_2", 0, "chr1", 9000, "240M"), ("SRR1_0", 256, "chr1", 7, "160M"), ("SRR2_0", 4, None, -1, "*"), ("SRR9_0", 0, "chr1", 0, "50M")]
    df = aln(spark, rows).withColumns({"qlen": F.lit(100), "de": F.lit(None).cast("double"), "nm": F.lit(None).cast("int")})
    contigs = spark.createDataFrame([("SRR1", 0, 80.0), ("SRR1", 1, 5.0), ("SRR1", 2, None), ("SRR2", 0, 2.0), ("SRR3", 0, 1.0)], "acc string, idx int, ka double")
    rec = screen.contig_records(df, contigs)
    w = {(r.acc, r.tile_idx): r.w for r in screen.screen_tiles(rec).collect()}
    assert w == {("SRR1", 0): 50 * 160 / 150 + 5, ("SRR1", 1): 240 / 150}
    s = {r.acc: r for r in screen.screen_scalars(rec, contigs.groupBy("acc").agg(F.count("*").alias("n_contigs"))).collect()}
    assert (s["SRR1"].n_aligned, s["SRR2"].n_aligned, s["SRR2"].mass_total, s["SRR3"].yield_pct) == (3, 0, 200.0, 0.0)
    assert s["SRR1"].mass_total == (80 + 5 + 1) * 100


def test_gate(spark):
    rows = [("GOOD", "pending", 500, 2400, None), ("OK", "pending", 500, 300, 0.01), ("FOREIGN", "pending", 500, 150, None), ("FEW", "pending", 50, 900, None), ("ZERO", "pending", 500, 0, None), ("DIV", "pending", 500, 9000, 0.2), ("ABSENT", "absent", 0, 0, None)]
    df = spark.createDataFrame(rows, "acc string, status string, n_contigs long, n_tiles long, divergence double")
    got = {r.acc: r.status for r in screen.gate_status(df).collect()}
    assert got == {"GOOD": "accepted", "OK": "accepted", "FOREIGN": "rejected", "FEW": "too_few_contigs", "ZERO": "rejected", "DIV": "rejected", "ABSENT": "absent"}


def test_prior_capacity(spark):
    r = spark.createDataFrame([("A", 20), ("B", 10), ("C", 5), ("D", 9)], "accession string, max_batches long")
    s = spark.createDataFrame([("A", "accepted", 1, 80.0), ("B", "accepted", 2, 0.2), ("D", "rejected", 0, 1.0)], "accession string, status string, rank int, yield_pct double")
    names = lambda **k: sorted(x.accession for x in screen.prior_runs(r, s, **k).collect())
    assert names(max_batches=30) == ["A", "B"]
    assert names(max_batches=31) == ["A", "B", "C"]
    assert names(only=False) == ["A", "B", "C"]
    assert names(top=1) == ["A"]
    assert {x.accession: x["yield"] for x in screen.prior_runs(r, s).collect()} == {"A": 0.8, "B": 0.01}


def brute_greedy(rows, projects, n, top, tie, least):
    c, left, picks, s, seen = np.zeros(n), set(rows), [], 0.0, set()
    while left and (top <= 0 or len(picks) < top):
        g = {a: float((np.log1p(c[rows[a][0]] + rows[a][1].astype(float)) - np.log1p(c[rows[a][0]])).sum()) for a in left}
        best = max(g.values())
        near = [a for a in left if g[a] >= (1 - tie) * best]
        a = min(near, key=lambda x: (projects[x] in seen, x))
        if picks and g[a] < least * s:
            break
        c[rows[a][0]] += rows[a][1]
        s += g[a]
        left.discard(a)
        seen |= {projects[a]} - {""}
        picks.append((a, round(g[a], 9)))
    return picks


def test_greedy_against_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(40):
        n = 30
        rows = {f"R{k}": (rng.choice(n, 8, replace=False), rng.random(8).astype(np.float32) * 10) for k in range(12)}
        if trial % 4 == 0:
            rows["Z"] = (np.zeros(0, np.int64), np.zeros(0, np.float32))
            rows["R1"] = rows["R0"]
        projects = {a: rng.choice(["", "P1", "P2"]) for a in rows}
        for top, tie, least in ((0, 0.01, 1e-3), (5, 0.2, 0.0), (0, 0.0, 0.05)):
            got = [(p.acc, round(p.gain, 9)) for p in ranking.choose(rows, projects, n, top, tie, least)]
            assert got == brute_greedy(rows, projects, n, top, tie, least)


def test_rank_driver_and_distributed_agree(spark):
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(f"R{a}", "c", int(x), float(w)) for a in range(6) for x, w in zip(rng.choice(20, 6, replace=False), rng.random(6), strict=True)], "acc string, chrom string, tile_idx long, w double")
    s = spark.createDataFrame([(f"R{a}", "accepted" if a < 5 else "rejected", 50.0 + a, f"P{a % 2}") for a in range(6)], "acc string, status string, yield_pct double, bioproject string")
    one = [(r.acc, round(r.gain, 6)) for r in ranking.rank(t, s, 100.0).orderBy("rank").collect()]
    limit, ranking.DRIVER_CELLS = ranking.DRIVER_CELLS, 3
    try:
        two = [(r.acc, round(r.gain, 6)) for r in ranking.rank(t, s, 100.0).orderBy("rank").collect()]
    finally:
        ranking.DRIVER_CELLS = limit
    assert one == two and len(one) >= 4


def test_estimator_matches_arrays(spark):
    pooled = {("c", 0): 5.0, ("c", 1): 0.0, ("c", 2): 9.0}
    own = {"A": {("c", 0): 3.0, ("c", 9): 4.0}, "B": {}}
    model = estimate.TileModel()
    model.add(pooled)
    po = spark.createDataFrame([(c, t, int(n)) for (c, t), n in pooled.items()], "chrom string, tile_idx long, n long")
    real = spark.createDataFrame([(a, c, t, int(n)) for a, m in own.items() for (c, t), n in m.items()], "accession string, chrom string, tile_idx long, n long")
    counts = estimate.merged_counts(real, None, po)
    r = spark.createDataFrame([("A", 100.0), ("B", 40.0)], "accession string, reads double")
    p = {(x.accession, x.tile_idx): x.p for x in estimate.tile_distribution(counts, po, r).collect()}
    profit = {x.accession: x.profit for x in estimate.expected_profit(counts, po, r).collect()}
    for a, reads in (("A", 100.0), ("B", 40.0)):
        want = model.distribution(own[a])
        assert math.isclose(want.sum(), 1)
        assert all(math.isclose(p[a, t], want[t]) for t in range(3))
        assert math.isclose(profit[a], model.profit(want, reads))


def test_snapshots(spark):
    sets = [[], ["a\t1\t2", "b\t1\t2"], ["b\t1\t2", "c\t9\t9"], ["a\t1\t2"]]
    df = lambda k: spark.createDataFrame([(x,) for x in sets[k]], "line string")
    log = None
    for v in range(1, 4):
        step = provenance.db_diff(df(v - 1), df(v), v)
        log = step if log is None else log.union(step)
    for v in range(4):
        assert sorted(r.line for r in provenance.snapshot(log, v).collect()) == sorted(sets[v])
    assert [(r.version, r.op) for r in provenance.log_order(log).collect()] == [(1, "+"), (1, "+"), (2, "-"), (2, "+"), (3, "-"), (3, "-"), (3, "+")]


def test_round_robin_spans_projects(spark):
    rows = [(f"A{k}", "PRJA") for k in range(5)] + [(f"B{k}", "PRJB") for k in range(3)] + [("C1", ""), ("C2", "")]
    got = [r.bioproject or r.accession for r in runs.round_robin(spark.createDataFrame(rows, "accession string, bioproject string"), 4).orderBy("position").collect()]
    assert sorted(got) == ["C1", "C2", "PRJA", "PRJB"]


def test_batch_ranges(spark):
    df = spark.createDataFrame([("A", 130_000), ("B", 120_000), ("C", 10)], "accession string, total_spots long")
    got = sorted((r.accession, r.n, r.x) for r in runs.batch_ranges(df, 50_000).collect())
    assert got == [("A", 0, 49999), ("A", 50000, 99999), ("A", 100000, 129999), ("B", 0, 49999), ("B", 50000, 99999), ("B", 100000, 119999), ("C", 0, 9)]
    last = {r.accession: r.k for r in runs.shuffled_ranges(df, 50_000, 1).orderBy("accession", "visit").collect()}
    assert last == {"A": 2, "B": 2, "C": 0}


def test_fingerprint_ignores_names_and_order(spark):
    def gtf(names, flip):
        rows = []
        for k, n in enumerate(names):
            rows.append(["c1", "x", "transcript", "1", "90", ".", "+", ".", f'transcript_id "{n}"; cov "{k}.5"; TPM "3"'])
            rows += [["c1", "x", "exon", str(s), str(s + 9), ".", "+", ".", f'transcript_id "{n}"'] for s in ((1, 50 + k), (50 + k, 1))[flip]]
        return spark.createDataFrame(rows[:: -1 if flip else 1], ", ".join(f"c{i} string" for i in range(9)))

    one, two, three = (provenance.transcript_fingerprint(g).first()[0] for g in (gtf(["T1", "T2"], 0), gtf(["S9", "S4"], 1), gtf(["T1"], 0)))
    assert one == two != three


def test_sn_sp(spark):
    p = spark.createDataFrame([("c", 1, 100, 1), ("c", 1, 200, 5), ("c", 1, 20, 9)], "chrom string, start long, end long, mult long")
    r = spark.createDataFrame([("c", 1, 200), ("c", 7, 300)], "chrom string, start long, end long")
    got = {x.level: (x.sn, x.sp) for x in evaluate.sn_sp(p, r).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.5, 1.0), 5: (0.5, 1.0)}


def test_headers_and_new_tiles(spark):
    h = lambda rows: spark.createDataFrame(rows, "key string, item string")
    got = provenance.compare_headers(h([("genome_md5", "a"), ("mode", "short"), ("aligner_version", "2"), ("note", "x")]), h([("genome_md5", "a"), ("mode", "long"), ("note", "y")]))
    assert sorted(map(tuple, got.collect())) == [("aligner_version", "2", None), ("mode", "short", "long")]
    t = lambda rows: spark.createDataFrame(rows, "chrom string, tile_idx long")
    assert [tuple(r) for r in tiles.new_tiles(t([("b", 1), ("a", 2), ("a", 1), ("a", 1)]), t([("a", 2)])).collect()] == [("a", 1), ("b", 1)]


def test_expected_gain_keeps_every_tile(spark):
    n = estimate.TOP_GAINS + 7
    p = spark.range(n).select(F.lit("A").alias("accession"), F.lit("chr1").alias("chrom"), F.col("id").alias("tile_idx"), F.lit(1.0 / n).alias("p"))
    zero = spark.createDataFrame([("A", "chr2", 0, 0.0)], p.schema)
    assert {(x.chrom, x.tile_idx) for x in estimate.expected_gain(p.unionByName(zero), 300.0).collect()} == {("chr1", t) for t in range(n)}
