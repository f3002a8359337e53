"""Commands: runlist, screen, run, replay, evaluate.  Each reads files and writes a folder."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .operators import evaluate, introns, ranking, runs, screen, tiles
from .session import local_session
from .sources import sinks, text
from .streaming.loop import Config, Loop, RecordedProvider, RunState
from .streaming.replay import replay_with


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **texts: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for flag, what in texts.items():
            c.add_argument("--" + flag.replace("_", "-"), required=True, help=what)
        return c

    c = command("runlist", pages="folder of metadata pages (xml)", out="output folder")
    c.add_argument("--paired-only", action="store_true")
    c.add_argument("--long-reads", action="store_true")
    c.add_argument("--max-runs", type=int, default=0)
    c = command("count", sam="alignments (SAM text)", out="output folder")
    c.add_argument("--tile-size", type=int, default=tiles.TILE_SIZE)
    c = command("screen", runs="run list", sam="contig alignments", contigs="Parquet of contigs", out="output folder")
    c.add_argument("--batch-size", type=int, default=50_000)
    c.add_argument("--min-contigs", type=int, default=100)
    c.add_argument("--top", type=int, default=50)
    c = command("run", runs="run list", alignments="Parquet of alignments with run and spot", out="output folder")
    c.add_argument("--batch-size", type=int, default=50_000)
    c.add_argument("--max-batches", type=int, default=1000)
    c.add_argument("--seed", type=int, default=1)
    c.add_argument("--in-flight", type=int, default=1)
    c = command("replay", manifest="Parquet of the batch log", alignments="Parquet of alignments with run and spot", out="output folder")
    c.add_argument("--min-mapq", type=int, default=60)
    command("evaluate", introns="predicted introns (GFF)", annotation="annotation (GFF or GTF)", out="output folder")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session(a.cores)
    read = lambda path: spark.read.text(path)
    if a.command == "runlist":
        pages = spark.read.text(a.pages, wholetext=True).withColumnRenamed("value", "xml")
        found = runs.usable_runs(text.parse_run_pages(pages), a.long_reads, a.paired_only)
        found = runs.first_runs(found, a.max_runs) if a.max_runs else found
        sinks.write_text(sinks.run_list_lines(found), a.out)
    elif a.command == "count":
        aln = text.sam(spark, a.sam).persist()
        sinks.write_text(sinks.coverage_lines(tiles.umr_per_tile(aln, a.tile_size)), f"{a.out}/coverage")
        sinks.write_text(sinks.intron_gff(introns.intron_multiset(aln)), f"{a.out}/introns")
        sinks.write_text(sinks.hint_gff(introns.hint_multiset(aln)), f"{a.out}/hints")
    elif a.command == "screen":
        listed, contigs = text.run_list(spark, a.runs), spark.read.parquet(a.contigs)
        records = screen.contig_records(text.sam(spark, a.sam), contigs).persist()
        weights = screen.screen_tiles(records).persist()
        n = contigs.groupBy("acc").agg(F.count("*").alias("n_contigs"))
        stats = screen.screen_scalars(records, n).join(weights.groupBy("acc").agg(F.count("*").alias("n_tiles")), "acc", "left").join(screen.weighted_median(screen.divergence_values(records)).withColumnRenamed("median", "divergence"), "acc", "left")
        stats = stats.withColumns({"n_tiles": F.coalesce("n_tiles", F.lit(0)), "status": F.lit("pending")}).join(listed.select(F.col("accession").alias("acc"), "bioproject"), "acc", "left")
        stats = screen.gate_status(stats, a.min_contigs).persist()
        picks = ranking.rank(weights, stats, a.batch_size * 0.5, a.top)
        ranked = ranking.ranking_order(stats.join(picks.select("acc", "rank", "gain"), "acc", "left"))
        sinks.write_text(sinks.ranking_lines(ranked), f"{a.out}/ranking")
        sinks.write_text(sinks.tile_weight_lines(weights), f"{a.out}/tiles", "gzip")
        sinks.write_text(sinks.summary_json(stats), f"{a.out}/summary")
    elif a.command == "run":
        states = [RunState(r.accession, r.total_spots, r.avg_len) for r in text.run_list(spark, a.runs).orderBy("accession").collect()]
        loop = Loop(states, RecordedProvider(spark.read.parquet(a.alignments)), Config(batch_size=a.batch_size, max_batches=a.max_batches, seed=a.seed, in_flight=a.in_flight))
        code = loop.run()
        spark.createDataFrame([(json.dumps(t),) for t in loop.timings], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/timings")
        sinks.write_text(sinks.intron_gff(loop.intron_table(spark)), f"{a.out}/introns")
        return code
    elif a.command == "replay":
        code, missing = replay_with(spark.read.parquet(a.manifest), RecordedProvider(spark.read.parquet(a.alignments)), a.min_mapq)
        sinks.write_text(sinks.missing_lines(spark.createDataFrame(missing, "batch int, accession string, n long, x long, reason string")), f"{a.out}/missing")
        return code
    elif a.command == "evaluate":
        known = evaluate.coding_introns(text.parse_cds(text.parse_gff(read(a.annotation))))
        evaluate.sn_sp(text.parse_gff_introns(read(a.introns)), known).write.mode("overwrite").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
