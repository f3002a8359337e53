"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources sorted by code point (null last) weigh ``WEIGHTS`` in turn and share the
total of all sizes; no target exceeds ``MOST_EPOCHS`` times its source's size, and what is
over is shared again by weight.  Sorted by cap / weight, the capped sources are a prefix,
so the fixed point needs two running sums and no iteration.

Selection: a source's target is some complete epochs, which take every document, and a rest.
For the rest each document draws the key -ln(u) / w, with u from a hash of its id and w its
quality weight; the documents of least key are taken while the middle of the document lies
within the rest.  Keys are cut into ``SLICES`` ranges: totals of slices come first, then sums
inside the one slice in which the rest ends, so that a source of any size is spread over many
tasks.  What comes out is one row a source: its complete epochs and the key at the cut.

Everything is DataFrame code; the key depends on the document alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, durable, n_words, table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SLICES = 1024


def text_quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: lower, the more symbols stand in a text for each of its words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target of each source, from (source, size) rows."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (n - 1) % len(weights) + 1).cast("double")
    s = s.withColumns({"weight": weight, "n": n}).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "share": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the first source in this order that its fair share of what is left does not fill ends the capped ones
    fits = F.col("cap") * F.col("share") >= F.col("left") * F.col("weight")
    s = s.withColumns({"level": F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "n", "left", "share"))).over(whole), "fits": fits})
    free = F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("left"), F.col("share")) >= F.col("level")
    target = F.when(free, F.col("weight") * F.col("level.left") / F.col("level.share")).otherwise(F.col("cap"))
    return s.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def _meet(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on source, null or not, and the columns ``more``."""
    on = {c: f"its_{c}" for c in ("source", *more)}
    both = left.join(right.withColumnsRenamed(on), [F.col(a).eqNullSafe(F.col(b)) for a, b in on.items()], how)
    return both.drop(*on.values())


def drawn(text: Column, doc_id: Column, size: Column, seed: str, quality: Column | None) -> Column:
    """The exponential key of a document.  Without a doc_id the text stands for it."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.xxhash64(text).cast("string")))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name).cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(2**52)
    return -F.log(u) / (text_quality(text, size) if quality is None else quality)


def cuts(keys: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row for each source of the rows (source, size, key, tie): source_size, target, epochs
    (complete ones) and where the order by (key, tie) is cut for the rest: documents before
    ``cut`` are taken once more, and ``ties`` of those equal to it."""
    rows = keys.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1)))
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(by_slice.select("source", F.col("slice_size").alias("size"))) if targets is None else targets
    running = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = by_slice.withColumn("before_slice", F.coalesce(F.sum("slice_size").over(running), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0)
    sources = targets.select("source", "source_size", "target", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # the slice in which the rest ends is the only one that needs an order
    edges = _meet(slices, sources).select("source", "slice", "before_slice", "rest")
    edges = edges.where(F.col("before_slice") < F.col("rest")).groupBy("source").agg(F.max(F.struct("slice", "before_slice", "rest")).alias("e")).select("source", "e.*")
    tail = _meet(rows, edges, "slice").groupBy("source", "key", "tie", "size", "before_slice", "rest").agg(F.count("*").alias("times"))
    inside = W.partitionBy("source").orderBy("key", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    tail = tail.withColumn("before", F.col("before_slice") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(inside), F.lit(0)))
    # a document is taken while its middle lies within the rest
    fit = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)).otherwise(F.col("times"))
    tail = tail.where("size > 0").withColumn("ties", F.greatest(F.lit(0), F.least(F.col("times"), fit)))
    cut = tail.where("ties > 0").groupBy("source").agg(F.max(F.struct("key", "tie", "ties", "times")).alias("c"))
    # where no document of that slice fits, the cut lies at its start
    cut = _meet(_meet(sources, edges.select("source", "slice"), how="left"), cut, how="left")
    start = -F.log(1 - F.col("slice") / SLICES)
    return cut.select("source", "source_size", "target", "epochs", F.coalesce("c.key", start).alias("cut_key"), F.col("c.tie").alias("cut_tie"), F.col("c.ties").alias("ties"), F.col("c.times").alias("times"))


def mix(docs: DataFrame, seed: str = "mix", quality: Column | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target and taken.

    Null texts have size 0 and take nothing; null sources are a source of their own; rows
    without a doc_id are drawn by their text; of repeated rows each is a document.  Sizes of 0
    everywhere give targets of 0; an empty table gives no rows.
    """
    size = n_words(F.col("text"))
    keys = docs.select("doc_id", "source", size.alias("size"), drawn(F.col("text"), F.col("doc_id"), size, seed, quality).alias("key"))
    keys = durable(keys.withColumn("tie", F.monotonically_increasing_id()), "keys")  # without texts: few bytes, read several times; written, so numbers hold
    plan = durable(cuts(keys, targets), "cuts")
    rows = _meet(keys, plan)
    chosen = F.coalesce((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie"))), F.lit(False))
    taken = F.col("size") * (F.col("epochs") + chosen.cast("long"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; those it does not take go.

    Documents meet one row a source, so texts are not shuffled.  Rows that are alike in every
    column are counted, should the cut fall among them.  Texts without words take no part;
    nulls in other columns are carried; an empty table stays empty.
    """
    row = F.struct(*docs.columns)
    text, size = F.col("row")["text"], n_words(F.col("row")["text"])
    ready = docs.select(row.alias("row"), F.col("source").alias("source"), F.xxhash64(row).alias("tie"))
    ready = ready.withColumn("size", size)
    ready = ready.withColumn("key", drawn(text, F.col("row")["doc_id"], F.col("size"), "mix", None)).where(text.rlike(WORD_PATTERN))  # a filter on the size would count words twice
    plan = durable(cuts(durable(ready.select("source", "size", "key", "tie"), "keys")), "cuts")
    rows = _meet(ready, plan)
    here = F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("tie") == F.col("cut_tie")) & (F.col("ties") < F.col("times")), F.lit(False))
    before = F.coalesce((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie"))), F.lit(False))
    out = rows.withColumn("copies", F.col("epochs") + (before & ~here).cast("long")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row")
    if not plan.where("ties < times").isEmpty():
        alike = rows.where(here).groupBy("row").agg(F.max("ties").alias("ties"))
        out = out.union(alike.select("row", F.explode(F.sequence(F.lit(1), F.col("ties"))).alias("copy")).select("row"))
    return out.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)
    / coalesce(1.0::DOUBLE / (1.0::DOUBLE + (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(size, 1)::DOUBLE), 1.0::DOUBLE) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(n - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, n) AS pos,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share
  FROM w
), l AS (
  SELECT pos AS level_pos, remaining / 1 AS level_left, share AS level_share FROM r WHERE cap * share >= remaining * weight ORDER BY pos LIMIT 1
), t AS (
  SELECT r.source, r.source_size, least(CASE WHEN pos >= level_pos THEN weight * level_left / level_share ELSE cap END, cap) AS target FROM r LEFT JOIN l ON true
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
