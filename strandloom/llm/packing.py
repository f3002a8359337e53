"""Packing: cut the token stream of documents into windows by dynamic programming.

Documents are laid end to end in the order in which a partition holds them.  Candidate
cuts are document ends (free), sentence ends (``SENTENCE_PENALTY``) and, inside sentences
of over ``LONG_SENTENCE`` ids (an eighth of a window, which ending before them could pad), every
``HARD_STEP`` ids; such a cut costs as much as ``HARD_PENALTY`` ids of padding.  With p the
position of a cut and f its least cost,

    f[j] = penalty[j] + window - p[j] + min(f[i] + p[i]),  p[j] - p[i] <= window,

so the least costs come from one pass with a monotone queue over f[i] + p[i].

No row is shuffled: each scan task packs its own documents in blocks of about
``BLOCK_IDS`` ids and hands the last, open window of a block on to the next.  The last, short
windows of the tasks are then put together, first fit by falling length, so padding and the
number of sequences hardly depend on how the table is split.  Memory holds one block, or one
document if it is longer.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, durable, give_back, table
from .wordcode import encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
SENTENCE_PENALTY, HARD_PENALTY = 2, 64
LONG_SENTENCE, HARD_STEP = 256, 64
TAILS = 4096  # short windows that one task puts together
BLOCK_IDS = 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_cuts(positions: list[int], penalties: list[int], window: int) -> list[int]:
    """Indexes of the chosen cuts, first and last position included.  Neighbouring
    positions are at most ``window`` apart."""
    n = len(positions)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(positions[0], positions[0], 0)])  # f + p, p, index
    for j in range(1, n):
        p = positions[j]
        least = p - window
        while queue[0][1] < least:
            queue.popleft()
        best, _, back[j] = queue[0]
        cost[j] = value = penalties[j] + window - p + best
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of all candidate cuts of a block that starts at 0."""
    at = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(at)
    step = min(HARD_STEP, max(1, window // 8))
    wide = np.flatnonzero(gaps > min(LONG_SENTENCE, max(1, window // 8)))
    steps = (gaps[wide] - 1) // step
    inner = np.repeat(at[wide], steps) + step * (1 + np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
    every = np.concatenate([at, inner])
    penalty = np.concatenate([np.where(np.isin(at, doc_ends), 0, SENTENCE_PENALTY), np.full(len(inner), HARD_PENALTY)])
    order = np.argsort(every, kind="stable")
    return every[order], penalty[order]


class Packer:
    """Packs documents that are added one by one; ``flush`` yields finished pieces."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.parts: list[tuple[object, int, np.ndarray, int, np.ndarray]] = []
        self.held = 0

    def add(self, key: object, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        self.parts.append((key, 0, ids, len(ids), sentence_ends))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.parts:
            return []
        sizes = np.array([len(x[2]) for x in self.parts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sentences = np.concatenate([x[4] + s for x, s in zip(self.parts, starts, strict=True)])
        positions, penalties = candidate_cuts(ends, sentences, self.window)
        chosen = plan_cuts(positions.tolist(), penalties.tolist(), self.window)
        cuts = positions[chosen]
        stop = int(cuts[-1]) if last or len(cuts) < 3 else int(cuts[-2])
        if not last and len(cuts) < 3:
            return []
        cuts = cuts[cuts <= stop]
        edges = np.unique(np.concatenate([starts[starts < stop], cuts]))
        begin, length = edges[:-1], np.diff(edges)
        which = np.searchsorted(ends, begin, side="right")
        window = np.searchsorted(cuts, begin, side="right") - 1
        out = []
        for b, n, w, k in zip(begin.tolist(), length.tolist(), which.tolist(), window.tolist(), strict=True):
            key, before, ids, total, _ = self.parts[w]
            off = b - int(starts[w])
            short = stop - int(cuts[k]) if last and k == len(cuts) - 2 else self.window
            out.append((key, before + off, n, zlib.crc32(ids[off : off + n].astype("<u4", copy=False).tobytes()), total, self.sequence + k, b - int(cuts[k]), short))
        self.sequence += len(cuts) - 1
        rest = []
        for (key, before, ids, total, ends_in), s in zip(self.parts, starts.tolist(), strict=True):
            cut = max(0, stop - s)
            if cut < len(ids):
                rest.append((key, before + cut, ids[cut:], total, ends_in[ends_in > cut] - cut))
        self.parts, self.held = rest, sum(len(x[2]) for x in rest)
        return out


def first_fit(sizes: list[int], names: list[int], window: int) -> tuple[list[int], list[int]]:
    """For each short window the name of the window it goes into, and where there."""
    into, shift = list(names), [0] * len(names)
    room: list[tuple[int, int]] = []  # free ids and place of the windows, by free ids
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], names[k])):
        at = bisect.bisect_left(room, (sizes[k], -1))
        if at < len(room):
            free, home = room.pop(at)
            into[k], shift[k] = names[home], window - free
        else:
            free, home = window, k
        bisect.insort(room, (free - sizes[k], home))
    return into, shift


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, forget: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts in the document, how long it is,
    and its sequence and offset there.

    Null and empty texts are documents of the end id alone.  Null ids, ties and repeated
    rows are kept: each row is packed on its own.  An empty table gives no rows.  Columns
    other than doc_id and text are not read.  With ``forget`` each task ends by emptying the memo
    of words, for sessions whose idle workers would each hold one.
    """
    path = tokenizer or tokenizer_path()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        tail = np.array([end_id], np.uint32)

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filled"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, ends = coder.encode(data.as_py() or b"")
                packer.add(key, np.concatenate([ids, tail]), ends[ends < len(ids)])
                if packer.held >= BLOCK_IDS:
                    yield from rows(packer.flush(False))
        yield from rows(packer.flush(True))
        if forget:
            coder.forget()
            give_back()

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES + ", filled long")
    pieces = durable(made, "pieces")  # written, so the numbers of sequences hold
    short = pieces.where(F.col("filled") < window)
    tails = short.groupBy("sequence_id").agg(F.max("filled").alias("filled"))
    parts = max(1, -(-tails.count() // TAILS))

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        into, shift = first_fit(pdf["filled"].tolist(), pdf["sequence_id"].tolist(), window)
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "into": into, "shift": shift})

    moved = tails.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(parts)).alias("part")).applyInPandas(put_together, "sequence_id long, into long, shift long")
    columns = [c.split()[0] for c in PIECES.split(", ")]
    placed = short.join(moved, "sequence_id").withColumns({"sequence_id": F.col("into"), "offset": F.col("offset") + F.col("shift")})
    return pieces.where(F.col("filled") == window).select(*columns).unionByName(placed.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; a document that the mix repeats is packed as
    often."""
    return pack(docs, forget=True)
