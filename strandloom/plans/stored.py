"""Named queries of the screen's store and of the sampling loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store
from ..streaming.loop import Config, Loop, RecordedProvider, RunState
from . import bindings as B
from .queries import _gated
from .registry import query


@query("screen_store_newest", f"WITH {B.BATCHES} SELECT accession AS acc, CAST(num_uniq AS BIGINT) AS num_uniq FROM gated g WHERE k = (SELECT max(k) FROM gated h WHERE h.accession = g.accession)")
def screen_store_newest(spark, d):
    """A run's last result, of several chunks that hold it."""
    return store.newest(_gated(spark, d).select(F.col("accession").alias("acc"), "num_uniq", F.col("k").alias("chunk")))


_STORED = ", stored AS (SELECT accession, CASE WHEN CAST(accession AS BIGINT) % 5 = 0 THEN 'error' ELSE 'accepted' END AS status FROM runs WHERE CAST(accession AS BIGINT) % 3 > 0)"


@query("screen_resume", f"WITH {B.RUNS}{_STORED} SELECT accession AS acc, accession IN (SELECT accession FROM stored WHERE status <> 'error') AS done FROM runs")
def screen_resume(spark, d):
    wanted = B.runs(spark, d).select(F.col("accession").alias("acc"))
    k = F.col("acc").cast("long")
    stored = wanted.where(k % 3 > 0).withColumn("status", F.when(k % 5 == 0, "error").otherwise("accepted"))
    done, todo = store.resume(wanted, stored)
    return done.withColumn("done", F.lit(True)).union(todo.withColumn("done", F.lit(False)))


@query("online_loop")
def online_loop(spark, d):
    """Three batches of the sampling loop over the recorded alignments of all runs."""
    records = B.aln(spark, d).withColumn("spot", F.col("qname") % 200)
    runs = [RunState(r.accession, 200, r.avg_len) for r in B.runs(spark, d).orderBy("accession").collect()]
    loop = Loop(runs, RecordedProvider(records), Config(batch_size=100, max_batches=3, tile_size=B.TILE, least_mapq=30))
    loop.run()
    rows = [(t["batch"], t["accession"], t["n"], t["x"], t["success"], float(t["uniq_pct"]), float(t["score"])) for t in loop.timings]
    return spark.createDataFrame(rows, "batch int, accession string, n long, x long, success int, uniq_pct double, score double")
