"""Quality rules: base rules, then a calibrated n-gram classifier against a fixed threshold.

The classifier is logistic regression over hashed word 1- and 2-grams and character 2-, 3-
and 4-grams.  The feature of a bucket is its share of the n-grams of its kind, so the
margin is the bias plus, for each kind, the mean weight of the text's n-grams: scoring is
a gather and a mean.  It is trained on at most ``SAMPLE_ROWS`` labelled documents, in one
task of an executor; a fifth of them is set aside to calibrate the margin into a probability
by a logistic curve.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .labelled import labelled_sample
from .textstats import base_counts, byte_counts, number_words

SAMPLE_ROWS = 4_000
BITS = 16
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; per cent
THRESHOLD = 0.3
STEPS, RATE, MOMENTUM, RIDGE = 40, 2.0, 0.9, 1e-4
FIT_BLOCK = 512

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_codes: dict[bytes, int] = {}


def _buckets(values: np.ndarray, seed: int) -> np.ndarray:
    """The top bits of a multiplied hash, one range of buckets for each n."""
    mixed = (values ^ np.uint64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _PRIME
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def ngram_buckets(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word n-grams and of the character n-grams of a text."""
    if len(_codes) > 150_000:
        _codes.clear()
    codes = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        c = _codes.get(w)
        if c is None:
            c = _codes[w] = zlib.crc32(w)
        codes[k] = c
    pairs = np.where(codes[:-1] == codes[1:], np.uint64(0), codes[:-1] * np.uint64(0x100000001B3) + codes[1:])  # any word twice running is one 2-gram
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    chars, gram = [], points
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(0x110000) + points[n - 1 :] if len(gram) else gram
        chars.append(_buckets(gram, n))
    return np.concatenate([_buckets(codes, 11), _buckets(pairs, 12)]), np.concatenate(chars)


class NgramModel:
    """Weights by kind and bucket, bias, and the calibrating curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, data: bytes, words: list[bytes]) -> float:
        kinds = ngram_buckets(data, words)
        return self.bias + sum(float(w[b].mean()) for w, b in zip(self.weights, kinds, strict=True) if len(b))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def fit(texts: list[bytes], y: np.ndarray) -> NgramModel:
    """Without both labels the model keeps every document."""
    size = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        return NgramModel(np.zeros((2, size), np.float32), 10.0 if len(y) == 0 or y[0] else -10.0)
    blocks, lengths, squares, norm = [], [], np.zeros(2 * size), 0.0  # of ``FIT_BLOCK`` texts each
    for a in range(0, len(texts), FIT_BLOCK):
        cells, shares, held = [], [], []
        for data in texts[a : a + FIT_BLOCK]:
            found = [np.unique(b + size * kind, return_counts=True) for kind, b in enumerate(ngram_buckets(data, data.split())) if len(b)]
            cells += [c.astype(np.int32) for c, _ in found]
            shares += [(n / n.sum()).astype(np.float32) for _, n in found]
            held.append(sum(len(c) for c, _ in found))
        blocks.append((np.concatenate([*cells, np.zeros(0, np.int32)]), np.concatenate([*shares, np.zeros(0, np.float32)])))
        lengths.append(np.array(held))
        squares += np.bincount(blocks[-1][0], blocks[-1][1].astype(np.float64) ** 2, 2 * size)
    tuned = np.arange(len(y)) % 5 == 4
    train = np.where(tuned, 0.0, np.where(y == 1, 0.5 / max(1, (y[~tuned] == 1).sum()), 0.5 / max(1, (y[~tuned] == 0).sum())))
    # columns are brought to one scale, so that rare and frequent n-grams learn alike
    scale = np.sqrt(squares / len(y))
    scale = np.maximum(scale, 1e-3 * scale.max() + 1e-30)
    for cell, share in blocks:
        share /= scale.astype(np.float32)[cell]
        norm += float(share @ share) / len(y)
    w, speed, bias, bias_speed = np.zeros(2 * size), np.zeros(2 * size), 0.0, 0.0

    def margins(k: int) -> np.ndarray:
        cell, share = blocks[k]
        out, full = np.full(len(lengths[k]), bias), lengths[k] > 0
        if full.any():
            out[full] += np.add.reduceat(w.astype(np.float32)[cell] * share, (np.cumsum(lengths[k]) - lengths[k])[full])
        return out

    for _ in range(STEPS):
        slope, lean = np.zeros(2 * size), 0.0
        for k, (cell, share) in enumerate(blocks):
            here = slice(k * FIT_BLOCK, k * FIT_BLOCK + len(lengths[k]))
            e = (1 / (1 + np.exp(-np.clip(margins(k), -30, 30))) - y[here]) * train[here]
            slope += np.bincount(cell, np.repeat(e.astype(np.float32), lengths[k]) * share, 2 * size)
            lean += e.sum()
        speed = MOMENTUM * speed - RATE / norm * (slope + RIDGE * w)
        bias_speed = MOMENTUM * bias_speed - RATE * lean / 4
        w, bias = w + speed, bias + bias_speed
    z = np.concatenate([margins(k) for k in range(len(blocks))])
    slope, shift = calibrate(z[tuned], y[tuned])
    return NgramModel((w / scale).reshape(2, size).astype(np.float32), float(bias), slope, shift)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood, by Newton's method;
    labels are softened, so that separable margins have a finite answer."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, b = np.stack([z / (z.std() + 1e-9), np.ones_like(z)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - soft) + 1e-6 * b)
        b = b - step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return max(1e-6, float(b[0] / (z.std() + 1e-9))), float(b[1])


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> NgramModel:
    """The model of at most ``rows`` labelled documents; one task of an executor fits it, and only
    the weights reach the driver."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(d * 2654435761 % 2**32, d, bytes(t) if t is not None else b"", y) for pdf in batches for d, t, y in zip(pdf["doc_id"], pdf["text"], pdf["label"], strict=True)]
        rows.sort()
        m = fit([r[2] for r in rows], np.array([r[3] for r in rows], np.float64))
        del rows
        with contextlib.suppress(OSError, AttributeError):  # the worker lives on: give its memory back
            ctypes.CDLL(None).malloc_trim(0)
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, rows).repartition(1)
    found = sample.mapInPandas(train, "weights binary, bias double, slope double, shift double").first()
    if found is None:  # no rows, so no task
        return fit([], np.zeros(0))
    return NgramModel(np.frombuffer(found.weights, np.float32).reshape(2, -1), found.bias, found.slope, found.shift)


def judge(docs: DataFrame, model: NgramModel, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, probability and verdict of every document.

    Null and empty texts have no words, so they fail the base rules, as do texts of under
    ``LEAST_WORDS`` words and texts of which over ``MOST_REPEATED`` per cent of the words
    stand in repeated windows.  Repeated rows are judged each; null ids are carried; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, margins = [], []
            for x in batch.column(1):
                data = x.as_py() or b""
                words = data.split()
                rows.append(base_counts(data, words, number_words(words), byte_counts(data)))
                margins.append(model.margin(data, words))
            base = np.array(rows, np.int64).reshape(-1, 5)
            good = model.probability(np.array(margins))
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(~failed & (good >= threshold)), pa.array(good)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    bound_batches(docs.sparkSession)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass over the texts.

    The model learns from the whole documents table, so it does not depend on what earlier
    stages left."""
    bound_batches(spark)
    model = fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                data = (text or "").encode()
                words = data.split()
                base = base_counts(data, words, number_words(words), byte_counts(data))
                failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
                out.append(not failed and bool(model.probability(np.array([model.margin(data, words)]))[0] >= THRESHOLD))
            yield pd.Series(out, dtype=bool)

    return docs.where(F.pandas_udf(verdict, "boolean")(F.col("text")))
