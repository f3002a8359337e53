"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
FILE_BYTES = 1 << 24
HOT_KEYS = 2000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, where all
    tasks run in one process, falls back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="strandloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def durable(df: DataFrame, what: str, rows: int | None = None, width: int = 64) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and the rows
    outlive the executors that made them.  About ``rows`` rows of ``width`` bytes, where that is
    known, are dealt to files of ``FILE_BYTES`` by a shuffle of the rows made, which leaves the
    stage that makes them as wide as it is; each file costs a process or two on local disks.
    Tables that fill a quarter of the shuffle's partitions are written as they come."""
    spark = df.sparkSession
    if rows is not None and 4 * (files := max(1, -(-rows * width // FILE_BYTES))) <= shuffle_width(spark):
        df = df.repartition(files)
    path = f"{shared_dir(spark)}/strandloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)  # zstd keeps much memory outside the heap
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (made := _WRITTEN.get()) is not None:
        made.append(out)
    return out


@contextlib.contextmanager
def written() -> Iterator[list[DataFrame]]:
    """The tables that ``durable`` writes within the block, so that the caller can discard those
    that its own result does not read; an outer block gets them too."""
    outer, made = _WRITTEN.get(), []
    token = _WRITTEN.set(made)
    try:
        yield made
    finally:
        _WRITTEN.reset(token)
        if outer is not None:
            outer.extend(made)


def on_disk(df: DataFrame) -> DataFrame:
    """Compute ``df`` and keep its rows as blocks on the executors' disks, until ``discard``; blocks
    of a lost executor are made again.  For wide tables that the operator itself discards: unlike
    ``durable`` this writes no files to the shared folder, and on a local disk each such file starts
    two processes, which count the memory of the JVM twice while they start.  The plan goes on, so
    few steps may lie between this and the next ``durable``."""
    out = df.persist(StorageLevel.DISK_ONLY)
    out.count()
    return out


def give_back() -> None:
    """Return the freed memory of a Python worker, which outlives its task, to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``durable`` or ``on_disk`` keeps of these tables, once nothing that is still to
    run reads them."""
    for t in tables:
        if t is not None and t.is_cached:
            t.unpersist()
        if path := getattr(t, "_written_to", None):
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """Inner equi-join of ``rows`` with ``keyed``, which has one row for each key and in the
    column ``times`` how many of ``total`` rows hold it.  Keys of over a ``HOT_KEYS``-th of all
    rows, at most ``HOT_KEYS`` of them and so few enough to broadcast, are joined by broadcast;
    the other rows meet in a shuffle in which no key is large."""
    hot = keyed.where(F.col(times) * HOT_KEYS > total)
    cold = keyed.where(F.col(times) * HOT_KEYS <= total)
    names = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(names, on, "left_anti").join(cold, on))


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers take at most ``BATCH_ROWS`` rows at a time: whole texts are large, and
    no result depends on how rows are dealt into batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
