import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import tiles
from strandloom.sources import bam, fastq, sinks, text
from strandloom.streaming.loop import NO_DATA, OK, Config, Loop, RecordedProvider, RunState
from strandloom.streaming.replay import replay_recorded, replay_with, stream_tile_counts


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_run_list(spark):
    rows = text.parse_run_list(lines(spark, "@Run_acc\tx", "", "bad\tline", " SRR1\t100000\t10000000\t100.0\t0\t0", "SRR2\t1\t2\t3.5\t1\t1\tILLUMINA\tPRJ", "SRR3\tx\t2\t3\t0\t0")).collect()
    assert [(r.accession, r.total_spots, r.paired, r.colorspace, r.platform, r.bioproject) for r in rows] == [("SRR1", 100000, False, False, "", ""), ("SRR2", 1, True, True, "ILLUMINA", "PRJ")]


def test_run_pages(spark):
    esc = '<DocSum>&lt;PAIRED/&gt;&lt;Platform instrument_model="x"&gt;ILLUMINA&lt;/Platform&gt;&lt;Bioproject&gt;PRJ1&lt;/Bioproject&gt;<Item>&lt;Run acc="SRR1" total_spots="1000" total_bases="100000" load_done="true"/&gt;</Item></DocSum>'
    raw = '<DocSum><Run acc="SRR2" total_spots="500" total_bases="20000"/><Run acc="SRR3" total_spots="" total_bases=""/></DocSum>'
    rows = text.parse_run_pages(spark.createDataFrame([("<x>" + esc + raw,)], "xml string")).orderBy("accession").collect()
    assert [(r.accession, r.avg_len, r.paired, r.platform, r.bioproject) for r in rows] == [("SRR1", 100.0, True, "ILLUMINA", "PRJ1"), ("SRR2", 40.0, False, "", "")]


def test_sam_and_gff(spark):
    r = text.parse_sam(lines(spark, "@HD\tx", "q1\t99\tchr1\t100\t60\t30M200N30M\t=\t200\t0\tACGT\tIIII\tNH:i:1\tde:f:0.01", "q2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*")).collect()
    assert (r[0].pos0, r[0].nh, r[0].de, r[0].qlen, r[1].chrom, r[1].qlen) == (99, 1, 0.01, 4, None, 0)
    g = text.parse_gff_introns(lines(spark, "#x", "c\tb2h\tintron\t5\t9\t.\t+\t.\tmult=3;pri=4", "c\tb2h\tintron\t5\t9\t.\t+\t.\tsrc=E", "c\tb2h\texon\t5\t9\t.\t+\t.\tmult=3")).collect()
    assert [(x.start, x.end, x.mult) for x in g] == [(5, 9, 4)]


def test_fasta_contigs_log(spark):
    f = {r.chrom: r.seq for r in text.parse_fasta(lines(spark, ">a x", "ACG", "T", ">b", "GG")).collect()}
    assert f == {"a": "ACGT", "b": "GG"}
    c = text.parse_contigs(lines(spark, ">S_0 ka:f:10.5 L:-:1:-", "ACGT", ">S_1", "ACGTACGT", ">S_2 km:f:bad", "A", "C"), "S").orderBy("idx").collect()
    assert [(x.idx, x.ka, x.len) for x in c] == [(0, 10.5, 4), (1, None, 8), (2, None, 2)]
    with pytest.raises(Exception, match="sequence too long"):
        text.sequence_lengths(lines(spark, f"big\t{2**31}\t0")).collect()


def test_sinks(spark):
    df = spark.createDataFrame([("c", 10, 50, "+", 7), ("c", 1, 30, "+", 1), ("c", 60, 90, ".", 1)], "chrom string, start long, end long, strand string, mult long")
    assert [r.value for r in sinks.splice_sites(df).collect()] == ["c\t8\t50\t+"]
    assert [r.value for r in sinks.junction_bed(df).collect()] == ["c\t8\t51\tjunc0\t7\t+\t8\t51\t0\t2\t1,1\t0,42"]
    assert sinks.hint_gff(df).first().value.endswith("pri=4;src=E") and "mult=1" not in sinks.hint_gff(df).first().value


@pytest.mark.parametrize("span", [1 << 30, 2000, 300])
def test_bam_round_trip(spark, tmp_path, span):
    rnd = random.Random(4)
    records = [(f"read{k}", rnd.choice([0, 16, 256]), rnd.choice(["chr1", "chr2"]), rnd.randrange(10**6), rnd.randrange(61), f"{rnd.randrange(1, 90)}M50N20M", rnd.randrange(1, 120), {"NH": 1, "de": 0.5}) for k in range(400)]
    records.append(("last", 4, None, -1, 0, "*", 10, {}))
    path = str(tmp_path / "x.bam")
    bam.write_bam(path, [("chr1", 10**6), ("chr2", 10**6)], records, block=700)
    bam.register(spark)
    df = spark.read.format("bam").option("span", str(span)).load(path)
    got = sorted((r.qname, r.flag, r.chrom, r.pos0, r.mapq, r.cigar, r.qlen, r.nh) for r in df.collect())
    assert got == sorted((q, f, c, p, m, g, n, t.get("NH")) for q, f, c, p, m, g, n, t in records)


def test_fastq(spark, tmp_path):
    rnd = random.Random(1)
    reads = [(f"r{k}", "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(30, 120)))) for k in range(300)]
    body = [f"@{n} extra\r\n{s}\r\n+\r\n{'I' * len(s)}\r\n".encode() for n, s in reads]
    path = tmp_path / "a.fq.gz"
    path.write_bytes(gzip.compress(b"".join(body[:100])) + gzip.compress(b"".join(body[100:])) + gzip.compress(b""))
    fastq.ingest(spark, "lib", [str(path)], str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert [(r.name, r.seq) for r in fastq.spot_range(t, "lib", 20, 400).orderBy("spot").collect()] == reads[20:]
    with pytest.raises(Exception, match="bad FASTQ record"):
        fastq.records(lines(spark, "@a", "ACGT", "+", "II")).collect()


def recorded(spark):
    """Runs A, B, C on tiles 0, 1, 0; D never maps uniquely."""
    rows = []
    for run, tile in (("A", 0), ("B", 1), ("C", 0), ("D", 2)):
        rows += [(run, s, f"{run}{s}", 0, "chr1", tile * 5000 + s + 10, 0 if run == "D" else 60, "20M100N20M") for s in range(30)]
    return spark.createDataFrame(rows, "run string, spot long, qname string, flag int, chrom string, pos0 long, mapq int, cigar string")


def test_loop_replay_and_stream(spark, tmp_path):
    a = recorded(spark)
    config = Config(batch_size=10, max_batches=6, seed=3)
    states = lambda: [RunState(r, 30) for r in "ABCD"]
    loop = Loop(states(), RecordedProvider(a), config)
    assert loop.run() == OK
    again = Loop(states(), RecordedProvider(a), config)
    again.run()
    assert loop.timings == again.timings and loop.done == 6
    assert loop.db_version == max(v for v, _, _ in loop.db_log) and len(loop.db_log) == len(loop.introns)
    wide = Loop(states(), RecordedProvider(a), Config(batch_size=10, max_batches=6, seed=3, in_flight=3))
    assert wide.run() == OK and wide.done == 6 and sum(wide.model.x) > 0
    assert sum(r.mult for r in loop.intron_table(spark).collect()) == loop.model.x.sum()
    assert all(r.bad == (r.accession == "D") for r in loop.runs if r.used)
    good = [t for t in loop.timings if t["success"]]
    pooled = sum(len(range(t["n"], t["x"] + 1)) for t in good)
    assert loop.model.x.sum() == pooled
    assert Loop([RunState("D", 30)], RecordedProvider(a), config).run() == NO_DATA
    m = spark.createDataFrame([(t["batch"], t["accession"], t["n"], t["x"], 10, bool(t["success"]), t["uniq_pct"]) for t in loop.timings] + [(99, "Z", 0, 9, 10, True, 50.0)], "batch int, accession string, n long, x long, batch_size long, success boolean, uniq_pct double")
    status = {r.batch: r.status for r in replay_recorded(m, a, 60).collect()}
    assert status.pop(99) == "missing" and set(status.values()) == {"same"}
    code, missing = replay_with(m, RecordedProvider(a), 60)
    assert code == 2 and [x[0] for x in missing] == [99]
    for k in range(3):
        a.where(F.col("spot") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = a.schema.simpleString()[7:-1].replace(":", " ")
    stream_tile_counts(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    total = spark.read.parquet(str(tmp_path / "out")).groupBy("chrom", "tile_idx").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, tiles.umr_per_tile(a).collect()))


def test_merged_claims(spark):
    loop = Loop([RunState("A", 100)], RecordedProvider(recorded(spark)), Config(batch_size=10, max_batches=20, merge_batches=4))
    r = loop.runs[0]
    r.times, r.umr_pct = 1, 90.0
    loop.model.add({("chr1", 0): 1.0})
    r.counts = {("chr1", 0): 1.0}
    loop.estimate()
    seen = []
    while r.used < 10:
        k, n, last = loop.claim(r, 0)
        assert last == k + n - 1 and n <= 4
        seen += range(k, last + 1)
    assert sorted(seen) == list(range(10))


def test_command_line(spark, tmp_path):
    from strandloom.cli import main

    (tmp_path / "a.sam").write_text("q1\t0\tchr1\t100\t60\t30M200N30M\t*\t0\t0\tACGT\tIIII\n")
    assert main(["--cores", "2", "count", "--sam", str(tmp_path / "a.sam"), "--out", str(tmp_path / "o")]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "o" / "coverage")).collect()] == ["chr1:0;1"]


def test_catalog_and_reports(spark, tmp_path):
    from strandloom.sources import catalog, reports

    class Pages:
        calls = 0

        def count(self, species, long_reads):
            return 25

        def page(self, start, size):
            self.calls += 1
            if self.calls == 2:
                raise OSError("again")
            return f"<DocSum><Run acc=\"S{start}\" total_spots=\"{size}\" total_bases=\"100\"/></DocSum>"

    got = list(catalog.pages(Pages(), "x", size=10))
    assert len(got) == 3
    (tmp_path / "p").mkdir()
    for k, page in enumerate(got):
        (tmp_path / "p" / f"{k}.xml").write_text(page)
    assert sorted(r.accession for r in catalog.saved_pages(spark, str(tmp_path / "p")).collect()) == ["S0", "S10", "S20"]
    codes = spark.createDataFrame([(200,), (404,), (403,), (503,), (418,), (None,)], "code int")
    assert [r[0] for r in codes.select(catalog.availability(F.col("code"))).collect()] == ["available", "absent", "absent", "error", "error", "error"]
    assert [r[0] for r in codes.select(catalog.retried(F.col("code"))).collect()] == [False, False, False, True, False, True]
    counts = spark.createDataFrame([("chr1", 0, 3), ("chr2", 7, 1)], "chrom string, tile_idx long, n long")
    sinks.write_text(sinks.coverage_lines(counts), str(tmp_path / "cov"))
    assert sorted(map(tuple, reports.coverage(spark, str(tmp_path / "cov")).collect())) == sorted(map(tuple, counts.collect()))
    w = spark.createDataFrame([("A", "chr1", 0, 0.5)], "acc string, chrom string, tile_idx long, w double")
    sinks.write_text(sinks.tile_weight_lines(w), str(tmp_path / "w"), "gzip")
    assert [tuple(r) for r in reports.tile_weights(spark, str(tmp_path / "w")).collect()] == [("A", "chr1", 0, 0.5)]
    (tmp_path / "t.tsv").write_text("batch\taccession\tt_batch\tsuccess\n1\tA\t2.5\t1\n")
    r = reports.timings(spark, str(tmp_path / "t.tsv")).first()
    assert (r.batch, r.t_batch, r.n_batches) == (1, 2.5, 1)
    (tmp_path / "r.tsv").write_text("acc\tstatus\trank\nA\taccepted\t\n")
    r = reports.ranking(spark, str(tmp_path / "r.tsv")).first()
    assert (r.acc, r.rank, r.gain) == ("A", None, None)
    assert len(reports.file_md5(spark, str(tmp_path / "t.tsv")).first().md5) == 32
