"""Token counts: an exact histogram of encoded lengths.

One pass counts the ids of each whole text and pre-aggregates documents by length, so the
shuffle carries one row for each length and task.  Suffix sums over the histogram then
answer, for every context limit, how many documents and ids there are, how many documents
exceed the limit and how many ids are left when every document is truncated to it.  The
sums are blocked: totals of blocks of ``BLOCK`` lengths first, then sums inside a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, durable, table
from .wordcode import encoder, tokenizer_path

BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the number of ids of the whole text; 0 for a null or empty text."""
    path = tokenizer or tokenizer_path()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            sizes = np.fromiter((coder.count(x.as_py() or b"") for x in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length L that occurs.

    n_docs, n_tokens: documents of this length and their ids.  docs_up_to, tokens_up_to:
    of lengths up to L.  docs_over: longer ones.  truncated_tokens: ids left when every
    document is cut to L.  share_up_to: docs_up_to of all, so the q quantile of the lengths
    is the smallest L with share_up_to >= q.  Null lengths are left out; an empty table
    gives no rows.
    """
    counts = durable(lengths.where("length is not null").groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")  # read twice below
    counts = counts.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    over = W.orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(everything).alias("d_all"))
    inside = W.partitionBy("block").orderBy("length").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = counts.join(blocks, "block").withColumns({"docs_up_to": F.col("d0") + F.sum("n_docs").over(inside), "tokens_up_to": F.col("t0") + F.sum("n_tokens").over(inside)})
    out = out.withColumn("docs_over", F.col("d_all") - F.col("docs_up_to"))
    return out.select("length", "n_docs", "n_tokens", "docs_up_to", "tokens_up_to", "docs_over", (F.col("tokens_up_to") + F.col("docs_over") * F.col("length")).alias("truncated_tokens"), (F.col("docs_up_to") / F.col("d_all")).alias("share_up_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = encoded_lengths(table(spark, sf_dir, "documents"))
    return length_histogram(lengths)
