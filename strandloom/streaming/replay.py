"""Replay of recorded batches: as a batch job over the manifest, or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, tiles
from ..operators.provenance import compare_manifest
from .loop import INCOMPLETE, OK, BatchProvider


def replay_recorded(manifest: DataFrame, aln: DataFrame, least_mapq: int, tolerance: float = 0.01) -> DataFrame:
    """(batch, status) of every recorded batch: missing, differs or same.

    All batches in one job: records meet their batch by run and spot range, cut into even spans
    so that the join is an equi-join."""
    span = F.max("batch_size")
    size = manifest.agg(span.alias("s")).first().s or 1
    cells = manifest.select("batch", F.col("accession").alias("run"), "n", "x", F.explode(F.sequence(F.floor(F.col("n") / size), F.floor(F.col("x") / size))).alias("cell"))
    rows = aln.withColumn("cell", F.floor(F.col("spot") / F.lit(size))).join(cells, ["run", "cell"]).where(F.col("spot").between(F.col("n"), F.col("x")))
    return compare_manifest(manifest.where("success"), quality.uniqueness_long(rows.drop("n", "x"), least_mapq, "batch"), tolerance)


def replay_with(manifest: DataFrame, provider: BatchProvider, least_mapq: int, tolerance: float = 0.01) -> tuple[int, list[tuple]]:
    """Exit code and (batch, accession, n, x, reason) of batches that are missing or differ."""
    missing = []
    for b in manifest.where("success").orderBy("batch").collect():  # one row for each fetch
        aln = provider.fetch(b.accession, b.n, b.x)
        if aln is None or not aln.limit(1).count():
            missing.append((b.batch, b.accession, b.n, b.x, "missing"))
        elif abs(quality.uniqueness_long(aln, least_mapq).first().uniq_pct - b.uniq_pct) > tolerance:
            missing.append((b.batch, b.accession, b.n, b.x, "differs"))
    return (INCOMPLETE if missing else OK), missing


def stream_tile_counts(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, tile_size: int = tiles.TILE_SIZE):
    """Stream recorded batch files (one a micro-batch) into (chrom, tile_idx, n) rows by batch.

    A batch's reads never span files, so each micro-batch is counted on its own and written to
    its own folder: a retried micro-batch overwrites itself, and the sum over folders is the
    pooled state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        tiles.umr_per_tile(batch, tile_size).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_new_keys(spark: SparkSession, source: str, schema: str, keys: list[str]) -> DataFrame:
    """First sight of each key in a stream: state holds one row for each distinct key."""
    return spark.readStream.schema(schema).parquet(source).dropDuplicates(keys)
