"""Numbers and running values in a global order, without all rows in one task.

Rows are dealt to buckets that follow the order; windows run inside buckets, and only one row for
each bucket meets the others in one place.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 1 << 16  # of an integer order, for each bucket

_EARLIER = (W.unboundedPreceding, -1)


def _with_start(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the start of their bucket; null keys are a bucket, too."""
    starts = starts.withColumnsRenamed({k: f"of{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of{k}")) for k in keys])
    return rows.join(starts, on).drop(*[f"of{k}" for k in keys])


def numbered(rows: DataFrame, buckets: dict[str, Column], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0, as ``name``.

    ``buckets`` maps new column names to columns that rise with the order, so that all rows of
    one bucket come before those of the next."""
    keys = list(buckets)
    rows = rows.withColumns(buckets)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(W.orderBy(*keys).rowsBetween(*_EARLIER)), F.lit(0)).alias("_start"))
    own = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return _with_start(own, starts, keys).withColumn(name, F.col("_start") + F.col(name)).drop("_start", *keys)


def running_sum(rows: DataFrame, order: str, value: Column, name: str, own: bool = True) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows up to each, in the order of an integer
    column; without ``own`` over those before it."""
    rows = rows.withColumns({"_bucket": F.floor(F.col(order) / SPAN), "_value": value.cast("long")})
    sums = rows.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    starts = sums.select("_bucket", F.coalesce(F.sum("_sum").over(W.orderBy("_bucket").rowsBetween(*_EARLIER)), F.lit(0)).alias("_start"))
    inside = F.sum("_value").over(W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow if own else -1))
    out = _with_start(rows.withColumn("_inside", F.coalesce(inside, F.lit(0))), starts, ["_bucket"])
    return out.withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_value", "_start", "_inside")


def carried(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value up to each that is not null, in the order of an integer column."""
    rows = rows.withColumns({"_bucket": F.floor(F.col(order) / SPAN), "_value": value})
    last = rows.groupBy("_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    starts = last.select("_bucket", F.last("_last", ignorenulls=True).over(W.orderBy("_bucket").rowsBetween(*_EARLIER)).alias("_start"))
    inside = F.last("_value", ignorenulls=True).over(W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = _with_start(rows.withColumn("_inside", inside), starts, ["_bucket"])
    return out.withColumn(name, F.coalesce("_inside", "_start")).drop("_bucket", "_value", "_start", "_inside")
