"""Greedy ranking of runs by the coverage they add, and ordering of what is published."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DRIVER_CELLS = 20_000_000


def scaled_rows(tiles: DataFrame, stats: DataFrame, scale: float) -> DataFrame:
    """(acc, chrom, tile_idx, v): tile weights scaled to ``scale`` times the yield of accepted runs.

    A missing or non-positive yield counts as 1; values have single precision."""
    y = F.when(F.coalesce(F.col("yield_pct"), F.lit(0.0)) <= 0, 1.0).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("yield_pct") / 100)))
    good = stats.where("status = 'accepted'").select("acc", y.alias("y"))
    total = tiles.groupBy("acc").agg(F.sum("w").alias("total")).where("total > 0")
    rows = tiles.join(good, "acc").join(total, "acc")
    return rows.select("acc", "chrom", "tile_idx", (F.col("w") * (scale * F.col("y") / F.col("total"))).cast("float").alias("v"))


def first_gains(rows: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(acc, gain): what each run adds to S, over nothing or over ``covered`` (chrom, tile_idx, c)."""
    if covered is None:
        return rows.groupBy("acc").agg(F.sum(F.log1p(F.col("v").cast("double"))).alias("gain"))
    c = F.coalesce("c", F.lit(0.0))
    both = rows.join(covered, ["chrom", "tile_idx"], "left")
    return both.groupBy("acc").agg(F.sum(F.log1p(c + F.col("v").cast("double")) - F.log1p(c)).alias("gain"))


@dataclass
class Pick:
    acc: str
    gain: float
    score: float
    tiles: int


def choose(rows: dict[str, tuple[np.ndarray, np.ndarray]], projects: dict[str, str], n_tiles: int, top: int = 0, tie: float = 0.01, least: float = 1e-3) -> list[Pick]:
    """Greedy picks over sparse rows (tile numbers, values) by accession.

    Gains only fall as coverage grows, so a run is scored anew only while its last gain could
    still reach the tie threshold of the best fresh one.  Among runs within ``tie`` of the best
    an unseen project goes first, then the least accession; a run without project counts as unseen.
    After the first pick, a gain of under ``least`` times the score ends the list.
    """
    covered = np.zeros(n_tiles)

    def gain(acc: str) -> float:
        at, v = rows[acc]
        c = covered[at]
        return float((np.log1p(c + v.astype(np.float64)) - np.log1p(c)).sum())

    bound = {acc: gain(acc) for acc in rows}
    picks: list[Pick] = []
    seen: set[str] = set()
    score = 0.0
    while bound and (top <= 0 or len(picks) < top):
        queue = [(-g, acc) for acc, g in bound.items()]
        heapq.heapify(queue)
        best, fresh = 0.0, {}
        while queue and (not fresh or -queue[0][0] >= (1 - tie) * best):
            _, acc = heapq.heappop(queue)
            fresh[acc] = bound[acc] = gain(acc)
            best = max(best, fresh[acc])
        near = [a for a, g in fresh.items() if g >= ((1 - tie) * best if best > 0 else best)]
        acc = min(near, key=lambda a: (projects.get(a) in seen, a))
        if picks and fresh[acc] < least * score:
            break
        at, v = rows[acc]
        covered[at] += v
        score += fresh[acc]
        del bound[acc]
        if projects.get(acc):
            seen.add(projects[acc])
        picks.append(Pick(acc, fresh[acc], score, int(np.count_nonzero(covered))))
    return picks


def rank(tiles: DataFrame, stats: DataFrame, scale: float, top: int = 0, tie: float = 0.01, least: float = 1e-3) -> DataFrame:
    """(rank, acc, gain, score, n_tiles) of the picked runs.

    The scaled rows are made by Spark.  Up to ``DRIVER_CELLS`` of them the driver picks from
    arrays; a larger matrix stays distributed, with one aggregate for each pick.
    """
    spark = tiles.sparkSession
    rows = scaled_rows(tiles, stats, scale)
    accepted = stats.where("status = 'accepted'").select("acc", F.coalesce("bioproject", F.lit("")).alias("bioproject"))
    cells = rows.limit(DRIVER_CELLS + 1).count()
    if cells <= DRIVER_CELLS:
        pdf = rows.toPandas()
        place = (pdf["chrom"].astype(str) + ":" + pdf["tile_idx"].astype(str)).astype("category").cat
        by = {acc: (np.zeros(0, np.int64), np.zeros(0, np.float32)) for acc in (r.acc for r in accepted.collect())}
        for acc, part in pdf.assign(t=place.codes).groupby("acc"):
            by[acc] = (part["t"].to_numpy(np.int64), part["v"].to_numpy(np.float32))
        projects = {r.acc: r.bioproject for r in accepted.collect()}
        picks = choose(by, projects, len(place.categories), top, tie, least)
    else:
        picks = _distributed(rows.persist(), accepted, top, tie, least)
    out = [(k + 1, p.acc, p.gain, p.score, p.tiles) for k, p in enumerate(picks)]
    return spark.createDataFrame(out, "rank int, acc string, gain double, score double, n_tiles long")


def _distributed(rows: DataFrame, accepted: DataFrame, top: int, tie: float, least: float) -> list[Pick]:
    """The same picks with coverage held as a table: one aggregate for each pick."""
    left, covered, picks, score, seen = accepted, None, [], 0.0, []
    while top <= 0 or len(picks) < top:
        gains = left.join(first_gains(rows, covered), "acc", "left").select("acc", "bioproject", F.coalesce("gain", F.lit(0.0)).alias("gain"))
        best = gains.agg(F.max("gain")).first()[0]
        if best is None:
            break
        near = gains.where(F.col("gain") >= (1 - tie) * best if best > 0 else F.col("gain") >= best)
        row = near.orderBy(F.col("bioproject").isin(seen) if seen else F.lit(False), "acc").first()
        if picks and row.gain < least * score:
            break
        score += row.gain
        own = rows.where(F.col("acc") == row.acc).select("chrom", "tile_idx", F.col("v").cast("double").alias("c"))
        covered = own if covered is None else covered.unionByName(own).groupBy("chrom", "tile_idx").agg(F.sum("c").alias("c"))
        covered = covered.checkpoint() if len(picks) % 8 == 7 and rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else covered
        left = left.where(F.col("acc") != row.acc)
        seen += [row.bioproject] if row.bioproject else []
        picks.append(Pick(row.acc, row.gain, score, covered.where("c <> 0").count()))
    return picks


def ranking_order(stats: DataFrame) -> DataFrame:
    """Published order: rank, then status, then tiles, then accession, with ``position`` from 1."""
    status = F.array_position(F.array(*map(F.lit, ("accepted", "rejected", "too_few_contigs", "absent", "error", "unsampled"))), F.col("status"))
    order = [F.when(F.coalesce("rank", F.lit(0)) > 0, F.col("rank")).otherwise(10**9), F.when(status == 0, 99).otherwise(status), F.desc("n_tiles"), F.asc("acc")]
    return stats.withColumn("position", F.row_number().over(W.orderBy(*order)))


def ranked_run_list(stats: DataFrame) -> DataFrame:
    """Ranked runs, then accepted ones by tiles, then unscreened ones in input order; no rejected ones."""
    ranked = F.coalesce("rank", F.lit(0)) > 0
    group = F.when(ranked, 0).when(F.col("status") == "accepted", 1).when(F.col("status").isin("rejected", "too_few_contigs"), None).otherwise(2)
    rows = stats.withColumn("g", group).where("g is not null")
    order = [F.col("g"), F.when(ranked, F.col("rank")), F.when(F.col("g") == 1, -F.col("n_tiles")), F.when(F.col("g") == 2, F.col("input_pos")), F.col("acc")]
    return rows.withColumn("position", F.row_number().over(W.orderBy(*order))).drop("g")
