"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitting: the driver gathers the statistics (20 numbers a row) of at most ``SAMPLE_ROWS``
labelled documents, cuts each into at most ``BINS`` quantile bins and grows trees of depth
``DEPTH`` on the gradients and curvatures of the logistic loss, summed by node and bin.
The trees are complete, so they flatten into three arrays; scoring walks all rows of an
Arrow batch through all trees at once by index arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .labelled import labelled_sample
from .textstats import STATISTICS, statistics

SAMPLE_ROWS = 16_000
TREES, DEPTH, BINS = 60, 4, 48
RATE, RIDGE, LEAST_CURVATURE = 0.2, 1.0, 2.0
THRESHOLD = 0.3


class BoostedTrees:
    """Flat trees: ``feature`` and ``threshold`` by tree and inner node, ``value`` by leaf."""

    def __init__(self, prior: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.prior, self.feature, self.threshold, self.value = prior, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.prior)
        if len(self.feature):
            trees = np.arange(len(self.feature))
            node = np.zeros((len(x), len(trees)), np.int64)
            inner = self.feature.shape[1]
            while node.size and node[0, 0] < inner:
                right = np.take_along_axis(x, self.feature[trees, node], 1) > self.threshold[trees, node]
                node = 2 * node + 1 + right
            total = total + self.value[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
    """Without rows the model says 0.5; with one label it says nearly that label."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    if len(y) == 0 or y.min() == y.max():
        return BoostedTrees(prior, feature, threshold, value)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: edges[b-1] < value <= edges[b]
    margin = np.full(len(y), prior)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, split = np.full(width, 1e-6), np.full((width, 2), -1)
            for j in range(x.shape[1]):
                key = node * BINS + binned[:, j]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST_CURVATURE) | (ha - hl < LEAST_CURVATURE)] = 0
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    b = gain.argmax(1)
                    better = gain[np.arange(width), b] > best
                    best[better] = gain[np.arange(width), b][better]
                    split[better] = np.stack([np.full(width, j), b], 1)[better]
            for k in range(width):
                if split[k, 0] >= 0:
                    feature[t, first + k], threshold[t, first + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
            at = first + node
            node = 2 * node + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = -RATE * gs / (hs + RIDGE)
        margin += value[t, node]
    return BoostedTrees(prior, feature, threshold, value)


def with_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """The statistics of every whole text as an array column ``stats`` next to ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(np.array([statistics(x.as_py() or b"") for x in batch.column(0)], np.float64).reshape(-1))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offsets, flat)], names=[*carried, "stats"])

    bound_batches(docs.sparkSession)
    kinds = dict(docs.select(*carried).dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", stats array<double>"
    return docs.select(F.col("text").cast("binary").alias("text"), *carried).mapInArrow(run, schema)


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> BoostedTrees:
    sample = with_statistics(labelled_sample(docs, labels, label, rows), "doc_id", "label").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(sample["stats"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    return fit(x, sample["label"].to_numpy(np.float64))


def classify(docs: DataFrame, model: BoostedTrees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of a text without words.  Null ids count as not held
    out; ties and repeated rows are scored each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(x.as_py() or b"") for x in batch.column(0)], np.float64)
                score = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    bound_batches(docs.sparkSession)
    id_text = F.col("doc_id").cast("string").cast("binary")
    ready = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(id_text) % 5 == 0, F.lit(False)).alias("held_out"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_classifier(docs, table(spark, sf_dir, "labels")))
